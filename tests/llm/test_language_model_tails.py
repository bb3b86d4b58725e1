"""Every token of the fold is a target of the language model, wherever rows of tokens are cut."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import grulm

P = grulm.Gru(outputs=12, buckets=4, classes=4, hidden=6, unroll=4)


def _seen(monkeypatch):
    """Targets that the softmax gets with gradients."""
    seen, real = [], grulm.Network.log_p

    def log_p(self, states, targets, grads=None):
        if grads is not None:
            seen.extend(np.asarray(targets).tolist())
        return real(self, states, targets, grads)
    monkeypatch.setattr(grulm.Network, "log_p", log_p)
    return seen


@pytest.mark.parametrize("length, streams", [(2, 1), (2, 8), (9, 8), (40, 7), (41, 8), (65, 16), (100, 3)])
def test_targets_are_all_tokens_once(monkeypatch, length, streams):
    rng = np.random.default_rng(length)
    tokens = rng.integers(0, 12, length)
    start = grulm.train([], grulm.Vocabulary([b""], np.array([1]), 1, 1, np.ones(P.buckets)), P)
    seen = _seen(monkeypatch)
    assert start.learn(tokens, 0, streams) == length - 1
    assert sorted(seen) == sorted(tokens[1:].tolist())


def test_learned_targets_are_the_folds_tokens(spark):
    p = grulm.Gru(outputs=28, buckets=4, classes=4, hidden=8, train_rows=1, epochs=1, streams=2, unroll=8, rounds=2, lanes=8, block=301, share=400)
    docs = spark.createDataFrame([(i, "one two three four " * (7 if i % 5 else 43)) for i in range(120)], "doc_id long, text string")
    for parts in (1, 5):
        learned = docs.repartition(parts, "doc_id").where(~grulm.held_out(F.col("doc_id")))
        v = grulm.vocabulary(grulm.count_words(learned), p)
        rows = grulm.encoded(learned, spark.sparkContext.broadcast(v), p)
        tokens = []
        net, end = grulm.train([], v, p), v.index(p)[b""]
        for r in rows.select("ids").collect():
            tokens += np.frombuffer(bytes(r.ids), p.kind).tolist()
        held, total = np.array([end, *tokens]), 0
        while len(held) > p.block:
            total += net.learn(held[:p.block], end, p.lanes)
            held = held[p.block - 1:]
        total += net.learn(held, end, p.lanes)
        assert total == v.total == len(tokens)

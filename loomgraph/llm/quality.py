"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Features of a text are its words and word pairs, as written and by shape (A for A-Z, a for other
letters, 0 for digits, first and last signs kept), each hashed to one of ``2**bits`` weights. A text's
score is a sparse dot product: the sum of its features' weights over the square root of their number,
plus a bias. Weights are learned one text at a time with FTRL-proximal updates in one task, from a
bounded sample of labelled texts; the task's only result is the weight vector, which is broadcast
(4 * 2**bits bytes, whatever the corpus). Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm._common import bounded_sample, fold, free_name, map_arrow, table

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_LOWER = bytes(range(ord("a"), ord("z") + 1)) + bytes(range(0x80, 0x100))
_DIGIT = b"0123456789"
SHAPE = bytes.maketrans(_UPPER + _LOWER + _DIGIT, b"A" * len(_UPPER) + b"a" * len(_LOWER) + b"0" * 10)


@dataclass(frozen=True)
class Ftrl:
    """``train_rows`` bounds the labelled texts learned from (the first by the hash of their id);
    ``cut``: predicted is 1 from this score on."""

    bits: int = 18
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    epochs: int = 4
    train_rows: int = 6000
    cut: float = 0.7


DEFAULT = Ftrl()


def features(text: str | None, bits: int) -> np.ndarray:
    """Feature numbers of a text, repeats included; none for a null, empty or blank text."""
    raw = text.encode() if text else b""
    words = raw.split()
    if not words:
        return np.zeros(0, np.int64)
    shapes = [w[:1] + w[-2:] for w in raw.translate(SHAPE).split()]
    n = len(words)
    w = np.fromiter(map(zlib.crc32, words), np.uint64, n)
    s = np.fromiter(map(zlib.crc32, shapes, repeat(7)), np.uint64, n)
    k = np.uint64(0x9E3779B97F4A7C15)
    pairs = [w * k, s * k + np.uint64(1)]
    for x, salt in ((w, 2), (s, 3)):
        pairs.append((x[:-1] * np.uint64(31) + x[1:] + np.uint64(salt << 40)) * k)
    return (np.concatenate(pairs) >> np.uint64(64 - bits)).astype(np.int64)


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def train(texts: list[str | None], labels: list[int], p: Ftrl = DEFAULT) -> np.ndarray:
    """``2**bits`` weights and the bias. Without any example all are zero; the order given is the order learned."""
    size = (1 << p.bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    rows = []
    for t in texts:
        i, c = np.unique(features(t, p.bits), return_counts=True)
        rows.append((np.append(i, size - 1), np.append(c / max(1.0, np.sqrt(c.sum())), 1.0)))

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * p.l1) / ((p.beta + np.sqrt(n[i])) / p.alpha + p.l2)
        return np.where(np.abs(z[i]) <= p.l1, 0.0, w)

    for _ in range(p.epochs):
        for (i, x), y in zip(rows, labels):
            w = weights(i)
            g = (_sigmoid(w @ x) - y) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / p.alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange(size)).astype(np.float32)


def score_texts(texts: list[str | None], weights: np.ndarray, bits: int) -> np.ndarray:
    """Probability of label 1 of each text."""
    out = np.full(len(texts), float(weights[-1]))
    for k, t in enumerate(texts):
        if len(i := features(t, bits)):
            out[k] += float(weights[i].sum(dtype=np.float64)) / np.sqrt(len(i))
    return _sigmoid(out)


def fit(docs: DataFrame, labels: DataFrame, label: str, usable: Column, p: Ftrl = DEFAULT) -> np.ndarray:
    """Weights learned from a bounded sample of labelled rows, in one task of at most ``p.train_rows`` texts."""
    sample = bounded_sample(docs, labels, label, usable, p.train_rows).select(F.xxhash64("doc_id").alias("at"), "doc_id", "label", "text")

    def learn(batches):
        rows = []
        for b in batches:
            rows += zip(*(c.to_pylist() for c in b.columns))
        rows.sort(key=lambda r: r[:2])
        w = train([r[3] for r in rows], [r[2] for r in rows], p)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], ["weights"])
    made = sample.repartition(1).mapInArrow(learn, "weights binary").first()
    return np.frombuffer(made[0], np.float32) if made else np.zeros((1 << p.bits) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, p: Ftrl = DEFAULT, *, into: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, unless given) of ``docs`` and ``into``: the probability of label 1. Keeps all rows."""
    kept = docs.columns if keep is None else keep
    shipped = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        w = shipped.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = score_texts(batch.column("text").to_pylist(), w, p.bits)
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(s)], [*kept, into])
        return step
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return map_arrow(docs, make, f"{kinds}, `{into}` double")


def held_out(doc_id: Column) -> Column:
    return fold(doc_id, 4) == 2


def classify(docs: DataFrame, labels: DataFrame, p: Ftrl = DEFAULT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text).

    Null and empty texts get the bias's score; repeated rows are repeated; a null doc_id is scored and
    never learned from; without usable labels every score is 0.5; an empty table gives no rows.
    """
    usable = ~held_out(F.col("doc_id"))
    w = fit(docs, labels, "quality", usable, p)
    scored = score(docs.select("doc_id", "text"), w, p, keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= p.cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, p: Ftrl = DEFAULT) -> DataFrame:
    """The rows of ``docs`` that are predicted to be of quality 1, all columns as they were."""
    w = fit(docs, labels, "quality", ~held_out(F.col("doc_id")), p)
    name = free_name(docs.columns, "loom_score")
    text_only = docs if "text" in docs.columns else docs.withColumn("text", F.lit(None).cast("string"))
    return score(text_only, w, p, into=name).where(F.col(name) >= p.cut).select(*(F.col(f"`{c}`") for c in docs.columns))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))

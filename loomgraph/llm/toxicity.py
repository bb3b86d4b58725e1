"""Toxicity by compression distance: two zstandard dictionaries and calibrated thresholds.

A text is cut into windows of words. Each window is compressed twice, with a dictionary of ordinary text
and with one of toxic text, and the difference of the two lengths says which it is closer to. A text's
differences (largest, mean of the three largest, sum, sum over one byte, share of clear ones) give its
score through a logistic function fitted on labelled texts that the dictionaries have not seen.

Both dictionaries end in the same ordinary text, picked by zstandard's trainer, so ordinary windows
compress alike and the difference is not noise; before it stands what tells the two apart: toxic
windows, cut down to the parts of words that are far more frequent in toxic texts, or as much more
ordinary text. They are raw-content dictionaries: literals cost eight bits, so a single word that only one of
them has shows in whole bytes. Every window starts with the text that ends both dictionaries, or short
windows would be stored rather than compressed.

Learning is one task over a bounded sample of labelled texts; the model (two dictionaries and a few
numbers, about 200 kB) is broadcast; scoring is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

import base64
import json
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm._common import bounded_sample, fold, free_name, map_arrow, table

#: The end of both dictionaries and the start of every window.
LEAD = b"window: " + bytes(range(33, 126)) + b" "


@dataclass(frozen=True)
class Compression:
    """``train_rows`` bounds the labelled texts learned from; ``window``: words; ``base`` and ``own``: bytes of
    the shared and the separate part of a dictionary; ``gram``: length of the byte sequences compared;
    ``ratio`` and ``texts``: how much more frequent in toxic texts, and in how many of them, a telling
    sequence is; ``cut``: predicted is 1 from this score on; ``pieces``: 4-word windows of the sampled ordinary
    texts, in random order, that each of the two ordinary parts is trained on; ``times``: how often a text counts
    at most for a sequence."""

    train_rows: int = 8000
    window: int = 16
    base: int = 65536
    own: int = 16384
    gram: int = 6
    ratio: float = 8.0
    texts: float = 0.03
    cut: float = 0.7
    pieces: int = 60_000
    times: int = 4


DEFAULT = Compression()
PARAMETERS = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY2, min_match=4, window_log=18, chain_log=18, hash_log=17, search_log=6, target_length=64, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)


def words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def windows(text: str | None, size: int) -> list[bytes]:
    """Runs of ``size`` words, the last one shorter; none for a null, empty or blank text."""
    w = words(text)
    return [b" ".join(w[i:i + size]) for i in range(0, len(w), size)]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=PARAMETERS)
    return zstandard.ZstdCompressor(compression_params=PARAMETERS, dict_data=d)


def _grams(word: bytes, n: int) -> set[bytes]:
    w = b" " + word + b" "
    return {w[i:i + n] for i in range(max(1, len(w) - n + 1))}


def _spans(word: bytes, good: set[bytes], n: int) -> list[bytes]:
    """The parts of a word that telling sequences cover: what follows is ordinary and must not match."""
    w = b" " + word + b" "
    out, begin, end = [], -1, -1
    for i in range(max(1, len(w) - n + 1)):
        if w[i:i + n] in good:
            if begin >= 0 and i > end:
                out.append(w[begin:end])
                begin = -1
            begin, end = (i if begin < 0 else begin), i + n
    return [*out, w[begin:end]] if begin >= 0 else out


def telling_parts(toxic: list[str], ordinary: list[str], p: Compression = DEFAULT) -> Counter:
    """The parts of words of toxic texts that are far more frequent there, with their counts. A text
    counts at most ``times`` for a sequence, so one long text decides nothing."""
    seen: list[Counter] = [Counter(), Counter()]
    texts: Counter = Counter()
    parts: dict[bytes, set[bytes]] = {}
    for side, group in enumerate((toxic, ordinary)):
        for t in group:
            own: Counter = Counter()
            for w, n in Counter(words(t)).items():
                g = parts.get(w)
                if g is None:
                    g = parts[w] = _grams(w, p.gram)
                for x in g:
                    own[x] += n
            for x, n in own.items():
                seen[side][x] += min(n, p.times)
            if side == 0:
                texts.update(own.keys())
    least, scale = max(3, p.texts * len(toxic)), (len(ordinary) + 1) / max(1, len(toxic))
    good = {x for x, n in seen[0].items() if texts[x] >= least and n * scale >= p.ratio * (seen[1][x] + 1)}
    spans = {w: _spans(w, good, p.gram) for w, g in parts.items() if not good.isdisjoint(g)}
    found: Counter = Counter()
    for t in toxic:
        for w in words(t):
            found.update(spans.get(w, ()))
    return found


def _trained(samples: list[bytes], size: int) -> bytes:
    """Content that zstandard's trainer picks from samples; what there is if that is too little to train on."""
    whole = b" ".join(samples)
    if len(whole) <= 4 * size:
        return whole[-size:]
    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes()[512:]
    except zstandard.ZstdError:
        return whole[-size:]


def measures(text: str | None, ordinary: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor, size: int) -> list[float]:
    """What is measured of a text: see the module. All zero without words."""
    w = windows(text, size)
    if not w:
        return [0.0] * 6
    a = np.fromiter((len(ordinary.compress(LEAD + x)) - len(toxic.compress(LEAD + x)) for x in w), np.float64, len(w))
    n = sum(map(len, w))
    top = np.sort(a)[::-1]
    return [top[0], top[:3].mean(), 100 * a.sum() / (n + 200), 100 * np.maximum(a - 1, 0).sum() / (n + 200), (a >= 3).sum() / (len(a) + 2), np.sqrt(np.maximum(a - 1, 0).sum() / (n + 200))]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients and intercept by Newton's method; with one class only the intercept differs from zero."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], ridge)
    pull[-1] = 1e-3
    for _ in range(30):
        s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (s * (1 - s))[:, None]).T @ x + np.diag(pull), x.T @ (s - y) + pull * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]

    def dump(self) -> bytes:
        return json.dumps([base64.b64encode(self.ordinary).decode(), base64.b64encode(self.toxic).decode(), self.mean, self.scale, self.weights]).encode()

    @staticmethod
    def load(raw: bytes) -> Model:
        o, t, mean, scale, weights = json.loads(raw)
        return Model(base64.b64decode(o), base64.b64decode(t), tuple(mean), tuple(scale), tuple(weights))


def train(texts: list[str | None], labels: list[int], p: Compression = DEFAULT) -> Model:
    """Dictionaries from two of three texts in the order given, the logistic function from the third. Without
    toxic texts (or any) the model gives every text the rate of toxic ones, 0.5 if there are none at all."""
    made = [(t, y) for i, (t, y) in enumerate(zip(texts, labels)) if i % 3]
    held = [(t, y) for i, (t, y) in enumerate(zip(texts, labels)) if not i % 3]
    toxic, ordinary = [t for t, y in made if y], [t for t, y in made if not y]
    telling = telling_parts(toxic, ordinary, p)
    own = b"".join(w for w, _ in sorted(telling.items(), key=lambda x: (x[1], x[0])))[-p.own:]
    pieces = [w for t in ordinary for w in windows(t, 4)]
    order = np.random.default_rng(0).permutation(len(pieces))
    shared = _trained([pieces[i] for i in order[: p.pieces]], p.base)
    more = _trained([pieces[i] for i in order[p.pieces: 2 * p.pieces]], max(len(own), 256))[: len(own)]
    model = (shared + more + LEAD, shared + own + LEAD)
    o, t = map(compressor, model)
    x = np.array([measures(text, o, t, p.window) for text, _ in held] or np.zeros((0, 6)), float).reshape(len(held), 6)
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(6), np.ones(6))
    w = _logistic((x - mean) / scale, np.array([y for _, y in held], float))
    return Model(*model, tuple(mean.tolist()), tuple(scale.tolist()), tuple(w.tolist()))


@lru_cache(maxsize=2)
def _loaded(raw: bytes) -> tuple:
    m = Model.load(raw)
    return m, compressor(m.ordinary), compressor(m.toxic)


def score_text(text: str | None, raw: bytes, p: Compression = DEFAULT) -> float:
    m, o, t = _loaded(raw)
    x = (np.array(measures(text, o, t, p.window)) - m.mean) / m.scale
    return float(1 / (1 + np.exp(-np.clip(x @ np.array(m.weights[:-1]) + m.weights[-1], -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, label: str, usable: Column, p: Compression = DEFAULT) -> bytes:
    """The model learned from a bounded sample of labelled rows, in one task of at most ``p.train_rows`` texts."""
    sample = bounded_sample(docs, labels, label, usable, p.train_rows).select(F.xxhash64("doc_id").alias("at"), "doc_id", "label", "text")

    def learn(batches):
        rows = []
        for b in batches:
            rows += zip(*(c.to_pylist() for c in b.columns))
        rows.sort(key=lambda r: r[:2])
        made = train([r[3] for r in rows], [r[2] for r in rows], p)
        yield pa.RecordBatch.from_arrays([pa.array([made.dump()], pa.binary())], ["model"])
    made = sample.repartition(1).mapInArrow(learn, "model binary").first()
    return bytes(made[0]) if made else train([], [], p).dump()


def score(docs: DataFrame, model: bytes, p: Compression = DEFAULT, *, into: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, unless given) of ``docs`` and ``into``: the probability of being toxic. Keeps all rows."""
    kept = docs.columns if keep is None else keep
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        raw = shipped.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = [score_text(t.as_py(), raw, p) for t in batch.column("text")]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(s, pa.float64())], [*kept, into])
        return step
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return map_arrow(docs, make, f"{kinds}, `{into}` double")


def held_out(doc_id: Column) -> Column:
    return fold(doc_id, 3) == 1


def classify(docs: DataFrame, labels: DataFrame, p: Compression = DEFAULT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text).

    Null, empty and blank texts get the score of a text without windows; repeated rows are repeated; a
    null doc_id is scored and never learned from; an empty table gives no rows.
    """
    model = fit(docs, labels, "toxic", ~held_out(F.col("doc_id")), p)
    scored = score(docs.select("doc_id", "text"), model, p, keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= p.cut).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, p: Compression = DEFAULT) -> DataFrame:
    """The rows of ``docs`` that are not predicted to be toxic, all columns as they were."""
    model = fit(docs, labels, "toxic", ~held_out(F.col("doc_id")), p)
    name = free_name(docs.columns, "loom_score")
    with_text = docs if "text" in docs.columns else docs.withColumn("text", F.lit(None).cast("string"))
    return score(with_text, model, p, into=name).where(F.col(name) < p.cut).select(*(F.col(f"`{c}`") for c in docs.columns))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))

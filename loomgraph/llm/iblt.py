"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraphs.

A text is cut at line feeds and then, by its own content, into short runs of words ("paragraphs" here);
the set of their digests (a repeat counts as another one) is put into a table of cells, each digest into three of
them. A cell holds how many digests it has, their XOR, and the XOR of their check hashes. Sketches of
two versions are subtracted cell by cell: what both have is gone. Cells left with one digest give it
away; removing it ("peeling") frees others, until the table is empty and every differing digest is
known with its side. If peeling sticks, a table four times as large is tried; the last size is over
twice the digests of both, where failure is a matter of chance, and then new hash functions are tried.

All documents of an Arrow batch are handled at once with numpy, so a document costs no Python loop.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm._common import table
from loomgraph.llm._ranges import LOWEST, range_cuts, shard_of

#: A run of words ends at a line feed and where a word ends in one of these signs, about every second word.
CUT = re.compile(r"\n+|(?<=[acegikmoqsuwy.!?|。]) +")
#: Runs without such an end are cut from half of this length on, where the text itself says.
LONG = 128
#: About how many shards there are at most; beyond that they grow.
MOST_SHARDS = 20_000
_U = np.uint64


@dataclass(frozen=True)
class Sketch:
    """``cells``: of the smallest table, a multiple of 3; each retry has four times as many."""

    cells: int = 24
    shard_rows: int = 4096
    batch_bytes: int = 4 << 20


DEFAULT = Sketch()


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ _U(salt)) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


def paragraphs(text: str | None) -> list[str]:
    """The pieces of a text whose digests are sketched. Long ones are cut after a character whose code is
    divisible by 16, so that an edit moves few cuts."""
    out = []
    for x in CUT.split(text or ""):
        if len(x) <= LONG:
            if x:
                out.append(x)
            continue
        at = 0
        for i, c in enumerate(x):
            if i - at >= LONG // 2 and not ord(c) & 15 or i - at >= 4 * LONG:
                out.append(x[at:i + 1])
                at = i + 1
        if at < len(x):
            out.append(x[at:])
    return out


def digests(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, digest) of every paragraph of every text, sorted by text; the digest of a repeated
    paragraph covers which occurrence it is, so the digests of a text are a set."""
    sizes, raw = [], []
    for t in texts:
        x = paragraphs(t)
        sizes.append(len(x))
        raw += x
    h = np.fromiter(map(xxhash.xxh64_intdigest, raw, repeat(0)), np.uint64, len(raw))
    of = np.repeat(np.arange(len(texts)), sizes)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])] if len(h) else np.zeros(0, bool)
    number = np.arange(len(h)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    return of, _mix(h + number.astype(np.uint64) * _U(0xA24BAED4963EE407), 1)


def _places(of: np.ndarray, key: np.ndarray, third: int, salt: int) -> np.ndarray:
    """The three cells of each digest in the table of its text, 3 x n."""
    return np.stack([(of * 3 + j) * third + (_mix(key, 2 + j + 8 * salt) % _U(third)).astype(np.int64) for j in range(3)])


def build(of: np.ndarray, key: np.ndarray, texts: int, cells: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of ``cells`` cells for texts 0 .. texts-1: (counts, XOR of digests, XOR of checks)."""
    size = texts * cells
    count, xor, check = np.zeros(size, np.int64), np.zeros(size, np.uint64), np.zeros(size, np.uint64)
    g = _mix(key, 99)
    for at in _places(of, key, cells // 3, salt):
        count += np.bincount(at, minlength=size)
        np.bitwise_xor.at(xor, at, key)
        np.bitwise_xor.at(check, at, g)
    return count, xor, check


def subtract(a: tuple, b: tuple) -> tuple:
    return a[0] - b[0], a[1] ^ b[1], a[2] ^ b[2]


def peel(sketch: tuple, texts: int, cells: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Peel subtracted tables: (number of the pair, digest, side +1 or -1) of all found, and which pairs came out empty."""
    count, xor, check = (x.copy() for x in sketch)
    found: list[tuple] = []
    at = np.arange(len(count))
    while len(at):
        at = at[np.abs(count[at]) == 1]
        at = at[_mix(xor[at], 99) == check[at]]
        if not len(at):
            break
        pair, key, sign = at // cells, xor[at], count[at]
        order = np.lexsort((key, pair))
        pair, key, sign = pair[order], key[order], sign[order]
        one = np.r_[True, (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])]
        pair, key, sign = pair[one], key[one], sign[one]
        found.append((pair, key, sign))
        places = _places(pair, key, cells // 3, salt)
        g = _mix(key, 99)
        for p in places:
            np.subtract.at(count, p, sign)
            np.bitwise_xor.at(xor, p, key)
            np.bitwise_xor.at(check, p, g)
        at = places.ravel()
    left = (count.reshape(texts, cells) != 0) | (xor.reshape(texts, cells) != 0)
    whole = ~left.any(axis=1)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), whole
    return *(np.concatenate([f[k] for f in found]) for k in range(3)), whole


def differences(a: tuple, b: tuple, texts: int, p: Sketch = DEFAULT) -> tuple[np.ndarray, np.ndarray]:
    """How many digests only the first and only the second text of each pair has, by peeling; a, b: (of, key)."""
    only = np.zeros((2, texts), np.int64)
    sizes = np.bincount(a[0], minlength=texts) + np.bincount(b[0], minlength=texts)
    want = np.full(texts, p.cells)  # the table that a pair needs next
    salt = 0
    left = np.arange(texts)
    while len(left):
        cells = int(want[left].min())
        now, left = left[want[left] == cells], left[want[left] != cells]
        where = np.full(texts, -1)
        where[now] = np.arange(len(now))
        many = max(1, (1 << 21) // cells)  # as many pairs at a time as fit in memory
        for s in range(0, len(now), many):
            part = now[s:s + many]
            lo, hi = part[0], part[-1] + 1

            def tables(x):
                i, j = np.searchsorted(x[0], [lo, hi])
                of, key = where[x[0][i:j]] - s, x[1][i:j]
                in_it = (of >= 0) & (of < len(part))
                return build(of[in_it], key[in_it], len(part), cells, salt)
            rest = subtract(tables(a), tables(b))
            # Each difference adds 1 or -1 to three cells: a third of the sum of squares estimates how many there are.
            guess = (rest[0].reshape(len(part), cells) ** 2).sum(axis=1) // 3
            hopeful = guess <= cells  # far more differences than cells can't peel
            pair, _, sign, whole = peel(tuple(x.reshape(len(part), cells)[hopeful].ravel() for x in rest), int(hopeful.sum()), cells, salt)
            good = whole[pair]
            names = part[hopeful]
            for k, side in enumerate((1, -1)):
                only[k, names[whole]] = np.bincount(pair[good & (sign == side)], minlength=len(names))[whole]
            failed = np.r_[part[~hopeful], names[~whole]]
            need = np.minimum(2 * np.r_[guess[~hopeful], guess[hopeful][~whole]], 3 * sizes[failed])
            grow = np.maximum(cells * 4, p.cells * 4 ** np.ceil(np.log(np.maximum(need, p.cells) / p.cells) / np.log(4)).astype(np.int64))
            # beyond three times the digests of both a failure is chance: other hash functions at the same size
            want[failed] = np.where(cells > 3 * sizes[failed] + p.cells, cells, grow)
            left = np.r_[left, failed]
        left.sort()
        if len(left) and (want[left] == cells).any():
            salt += 1
    return only[0], only[1]


def likeness(a: tuple, b: tuple, texts: int, p: Sketch = DEFAULT) -> np.ndarray:
    """Of each pair: digests that both have over those of the larger; 1 if neither has any."""
    na, nb = np.bincount(a[0], minlength=texts), np.bincount(b[0], minlength=texts)
    only_a, _ = differences(a, b, texts, p)
    most = np.maximum(na, nb)
    return np.where(most == 0, 1.0, (na - only_a) / np.maximum(most, 1))


def sketches(a: tuple, texts: int, p: Sketch = DEFAULT) -> list[bytes]:
    """The smallest table of each text, as bytes: counts, digests, checks of its cells, little-endian."""
    c, x, k = (v.reshape(texts, p.cells) for v in build(*a, texts, p.cells))
    raw = np.concatenate([c.astype("<i4").view(np.uint8), x.astype("<u8").view(np.uint8), k.astype("<u8").view(np.uint8)], axis=1)
    return [r.tobytes() for r in raw]


def edit(text: str, following: str) -> str:
    """The last quarter of the code points (rounded down) replaced by the first as many (or all) of ``following``."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def with_next(docs: DataFrame, rows: int) -> DataFrame:
    """(shard, ahead, doc_id, text) dealt by shard and sorted by (shard, ahead, doc_id, text): the rows of
    each range shard in ascending order, then (ahead = 1) the first rows of the next shard, the last
    shard's being the first shard's. Every text moves once, but for those of the first ids of shards."""
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id"), F.lit(LOWEST))
    ids = docs.select(key.alias("key"))
    cuts = range_cuts(ids.select("key", F.lit(1).cast("long").alias("weight")), max(rows, ids.count() // MOST_SHARDS))
    # One row a shard: its first id, and the shard before it. Their number is bounded by rows / shard size.
    first = ids.withColumn("shard", shard_of(F.col("key"), cuts)).groupBy("shard").agg(F.min("key").alias("key")).collect()
    first.sort()
    ahead = spark.createDataFrame([(r["key"], first[i - 1]["shard"]) for i, r in enumerate(first)] or [(None, None)], "key long, before int")
    whole = docs.select(key.alias("key"), "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    marked = whole.withColumn("shard", shard_of(F.col("key"), cuts)).join(F.broadcast(ahead), "key", "left")
    own = F.struct(F.col("shard").alias("shard"), F.lit(0).alias("ahead"))
    both = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("before").alias("shard"), F.lit(1).alias("ahead"))))
    dealt = marked.select(F.explode(both).alias("at"), "doc_id", "text").select("at.shard", "at.ahead", "doc_id", "text")
    # A partition a shard: dealing by hash would put several of them together and leave others empty.
    return dealt.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", "ahead", F.col("doc_id").asc_nulls_first(), "text")


def fingerprint_documents(docs: DataFrame, p: Sketch = DEFAULT) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, sketch, edited_sketch, near_edited, near_next) of every row.

    The next document is the next row by (doc_id, text), null ids first; after the last comes the first,
    which for a single row is itself. Null texts count as empty; two texts without paragraphs are alike
    (1.0), one without and one with are not (0.0). Repeated rows are each other's next. Extra columns
    are not read. doc_id is a whole number (smaller kinds become long); other kinds are refused.
    """
    if docs.schema["doc_id"].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError("doc_id must be a whole number")
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    kind = "bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (doc_id, text) of one shard, not yet given out; the last waits for its next
        shard, size, closed = None, 0, False

        def flush(following: list[str]) -> pa.RecordBatch:
            ids, texts = [h[0] for h in held], [h[1] for h in held]
            edited = [edit(t, f) for t, f in zip(texts, following)]
            n = len(texts)
            a = digests([*texts, following[-1]])
            i, j = np.searchsorted(a[0], [n, 1])
            own, after = (a[0][:i], a[1][:i]), (a[0][j:] - 1, a[1][j:])
            e = digests(edited)
            cols = [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(sketches(own, n, p), pa.binary()), pa.array(sketches(e, n, p), pa.binary()), pa.array(likeness(own, e, n, p)), pa.array(likeness(own, after, n, p))]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_chars", "edited_sha256", "sketch", "edited_sketch", "near_edited", "near_next"])

        for batch in batches:
            for s, ahead, doc_id, text in zip(*(batch.column(c) for c in ("shard", "ahead", "doc_id", "text"))):
                s = s.as_py()
                if s != shard:
                    shard, held, size, closed = s, [], 0, False
                if closed:
                    continue
                text = text.as_py()
                if ahead.as_py():
                    yield flush([h[1] for h in held[1:]] + [text])
                    held, closed = [], True
                    continue
                if size > p.batch_bytes:
                    yield flush([h[1] for h in held[1:]] + [text])
                    held, size = [], 0
                held.append((doc_id.as_py(), text))
                size += len(text)
    return with_next(docs, p.shard_rows).mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, sketch binary, edited_sketch binary, near_edited double, near_next double")


def read_sketch(raw: bytes, p: Sketch = DEFAULT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The table that ``sketches`` has made bytes of; two of them can be subtracted and peeled."""
    n = p.cells
    return np.frombuffer(raw, "<i4", n).astype(np.int64), np.frombuffer(raw, "<u8", n, 4 * n), np.frombuffer(raw, "<u8", n, 12 * n)


def op2_iblt(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprint_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_chars", "edited_sha256", F.base64("sketch").alias("fingerprint"), F.base64("edited_sketch").alias("edited_fingerprint"), "near_edited", "near_next")

"""Importance resampling towards a target corpus, over bucket-partitioned inverted postings.

Features of a text are its runs of one to three words; a feature's bucket is its CRC-32 modulo a number
of buckets. The steps:

1. Texts are read once, in blocks of a bounded size. A block becomes inverted postings (bucket, document,
   count), packed for each of ``parts`` ranges of buckets, with the block's total for each bucket; they
   are written, so nothing reads a text again.
2. The buckets' totals of both corpora are added up where they meet, one group a bucket.
3. Postings are shuffled by (range of buckets, slab of blocks). A slab bounds what one task holds, however
   common a bucket is. Ahead of them, each partition gets both corpora's totals of its buckets, computes
   each bucket's gain from these, and adds up a document's gains over its buckets.
4. These contributions are shuffled by block and reduced by document.

The CRC-32 of a run is put together from those of its words (CRCs are linear over GF(2)): appending a
word shifts what is there by its length, by tables, and adds the word's own. So no run is ever spelled out.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm._common import durable, numbered, remove, table

#: A-Z become a-z; what is no ASCII digit or letter and no byte of a longer character becomes a space.
WORDS_ONLY = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Shift tables are kept for words up to this length; longer ones get theirs when they come up.
SHORT = 64


@dataclass(frozen=True)
class Resampling:
    """``share``: percent of the documents with ``least_words`` words that are drawn. ``block_bytes`` and
    ``block_docs`` bound a block, ``slab`` is the number of blocks whose postings share a shuffle key."""

    buckets: int = 10_000
    longest: int = 3
    least_words: int = 20
    share: int = 5
    seed: int = 42
    parts: int = 64
    block_bytes: int = 4 << 20
    block_docs: int = 8192
    slab: int = 256


DEFAULT = Resampling()


# CRC-32 of appended words


@lru_cache(1)
def _byte_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


@lru_cache(512)
def _zeros(n: int) -> np.ndarray:
    """Images of the 32 unit CRCs when ``n`` zero bytes follow them, without the CRC's own start and end."""
    if n == 0:
        return np.uint32(1) << np.arange(32, dtype=np.uint32)
    if n == 1:
        unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
        return _byte_table()[unit & 255] ^ (unit >> 8)
    half = _zeros(n // 2)
    twice = _through(half, half)
    return _through(_zeros(1), twice) if n % 2 else twice


def _through(images: np.ndarray, x: np.ndarray) -> np.ndarray:
    bits = (x[:, None] >> np.arange(32, dtype=np.uint32)) & 1
    return np.bitwise_xor.reduce(np.where(bits == 1, images[None, :], np.uint32(0)), axis=1)


@lru_cache(512)
def _shift(n: int) -> np.ndarray:
    """The shift by ``n`` bytes as four tables of 256, one for each byte of a CRC, end to end."""
    byte = np.arange(256, dtype=np.uint32)
    return np.concatenate([_through(_zeros(n), byte << np.uint32(8 * k)) for k in range(4)])


@lru_cache(1)
def _short_shifts() -> np.ndarray:
    return np.concatenate([_shift(n) for n in range(SHORT + 2)])


def _shifted(crc: np.ndarray, row: np.ndarray, tables: np.ndarray) -> np.ndarray:
    base = row * 1024
    out = tables[base + (crc & 255)]
    for k in (1, 2, 3):
        out ^= tables[base + 256 * k + ((crc >> np.uint32(8 * k)) & 255)]
    return out


def word_crcs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each word, byte by byte for all words at once; long words one by one."""
    step, length = _byte_table(), ends - starts
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-np.minimum(length, SHORT), kind="stable")
    at, size = starts[order], length[order]
    crc_in_order = crc[order]
    longest = int(size.max(initial=0)) if len(size) else 0
    left = np.searchsorted(-np.minimum(size, SHORT), -np.arange(1, min(longest, SHORT) + 1), side="right")
    for k, n in enumerate(left):
        c = crc_in_order[:n]
        crc_in_order[:n] = step[(c ^ buf[at[:n] + k]) & 255] ^ (c >> np.uint32(8))
    crc[order] = ~crc_in_order
    for i in np.flatnonzero(length > SHORT):
        crc[i] = zlib.crc32(buf[starts[i]:ends[i]].data)
    return crc


class _Runs:
    """Buckets of the runs of a stream of words that comes in pieces; the last words of a piece are kept."""

    def __init__(self, p: Resampling):
        self.p = p
        self.kept: tuple[np.ndarray, ...] | None = None

    def buckets(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, document) of every run that ends in this piece."""
        p = self.p
        crc, length = word_crcs(buf, starts, ends), ends - starts
        spaced = _shifted(np.full(len(crc), zlib.crc32(b" "), np.uint32), np.minimum(length, SHORT), _short_shifts()) ^ crc
        for i in np.flatnonzero(length > SHORT):
            spaced[i] = zlib.crc32(buf[starts[i]:ends[i]].data, zlib.crc32(b" "))
        old = 0
        if self.kept is not None:
            old = len(self.kept[0])
            crc, spaced, length, doc = (np.concatenate(x) for x in zip(self.kept, (crc, spaced, length, doc)))
        tables, row = _short_shifts(), length + 1
        far = np.flatnonzero(length > SHORT)
        if len(far):
            sizes, which = np.unique(length[far], return_inverse=True)
            tables = np.concatenate([tables, *(_shift(int(n) + 1) for n in sizes)])
            row[far] = SHORT + 2 + which
        out_b, out_d, run = [crc[old:] % p.buckets], [doc[old:]], crc
        for n in range(1, p.longest):
            # run[i] is the run of n words that begins at word i; add the word after it.
            run, last = run[:len(crc) - n], slice(n, None)
            run = _shifted(run, row[last], tables) ^ spaced[last]
            good = (doc[:len(crc) - n] == doc[last]) & (np.arange(n, len(crc)) >= old)
            out_b.append(run[good] % p.buckets)
            out_d.append(doc[last][good])
            if not len(run):
                break
        k = max(0, len(crc) - p.longest + 1)
        self.kept = (crc[k:].copy(), spaced[k:].copy(), length[k:].copy(), doc[k:].copy())
        return np.concatenate(out_b), np.concatenate(out_d)


def _pieces(raw: bytes, size: int):
    """Cut at spaces into pieces of about ``size`` bytes; a longer word is left whole."""
    at = 0
    while at < len(raw):
        to = at + size
        if to < len(raw):
            cut = raw.rfind(b" ", at, to)
            to = cut if cut > at else raw.find(b" ", to)
            to = len(raw) if to < 0 else to
        yield at, raw[at:to]
        at = to


def invert(texts: list[str | None], p: Resampling) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Postings (bucket, document, count), ordered, and the documents' numbers of words; null texts have none."""
    coded = [(t or "").encode("utf-8", "surrogatepass").translate(WORDS_ONLY) for t in texts]
    raw = b" ".join(coded)
    begin = np.cumsum([0, *(len(c) + 1 for c in coded)])[:-1] if coded else np.zeros(0, np.int64)
    words, runs, found = np.zeros(len(texts), np.int64), _Runs(p), []
    for at, piece in _pieces(raw, p.block_bytes):
        buf = np.frombuffer(piece, np.uint8)
        edge = np.flatnonzero(np.diff((buf != 32).view(np.int8), prepend=0, append=0))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            continue
        doc = np.searchsorted(begin, starts + at, side="right") - 1
        words += np.bincount(doc, minlength=len(texts))
        bucket, of = runs.buckets(buf, starts, ends, doc)
        key = np.sort(bucket.astype(np.int64) * len(texts) + of)
        first = np.flatnonzero(np.diff(key, prepend=-1))
        found.append((key[first], np.diff(first, append=len(key))))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, words
    key, count = (np.concatenate(x) for x in zip(*found))
    if len(found) > 1:
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key, count = key[first], np.add.reduceat(count, first)
    return key // len(texts), key % len(texts), count, words


def _planes(x: np.ndarray, kind: str) -> bytes:
    """The bytes of numbers, all lowest ones first: high bytes are nearly all zero and pack to nothing."""
    x = x.astype(kind)
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _from_planes(raw: memoryview, n: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width).reshape(width, n).T).view(kind).ravel()


def pack(each: np.ndarray, doc: np.ndarray, count: np.ndarray) -> bytes:
    """Postings of a range of buckets: how many each bucket has, gaps between documents (modulo 2**16), counts."""
    gaps = np.diff(doc, prepend=0) & 0xFFFF
    return zstandard.compress(_planes(each, "<u4") + _planes(gaps, "<u2") + _planes(count, "<u4"), 1)


def unpack(raw: bytes, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket's place in its range, document, count) of what ``pack`` made of so many buckets."""
    plain = memoryview(zstandard.decompress(raw))
    each = _from_planes(plain, buckets, "<u4")
    n = int(each.sum())
    doc = np.cumsum(_from_planes(plain[4 * buckets:], n, "<u2"), dtype=np.int64) & 0xFFFF
    count = _from_planes(plain[4 * buckets + 2 * n:], n, "<u4").astype(np.int64)
    return np.repeat(np.arange(buckets), each), doc, count


INVERTED = "block long, part int, docs int, ids array<long>, words array<long>, totals array<long>, postings binary"


def inverted(docs: DataFrame, id_column: str | None, p: Resampling) -> DataFrame:
    """Blocks of ``docs`` as rows: one (part -1) with the documents' ids and numbers of words, and one a range of
    buckets with its totals and, where there are ids, its packed postings. Block numbers are those of the task and
    its blocks, the same for every attempt."""
    edge = np.arange(p.parts + 1) * p.buckets // p.parts

    def run(batches):
        base, held, size = TaskContext.get().partitionId() << 32, [], 0

        def block(number: int):
            bucket, doc, count, words = invert([t for _, t in held], p)
            cut = np.searchsorted(bucket, edge)
            total = np.bincount(bucket, count, p.buckets).astype(np.int64)
            rows = [[number, -1, len(held), [i for i, _ in held], words, None, None]] if id_column else []
            for k in range(p.parts):
                a, b = cut[k], cut[k + 1]
                width = edge[k + 1] - edge[k]
                packed = pack(np.bincount(bucket[a:b] - edge[k], minlength=width), doc[a:b], count[a:b]) if id_column else None
                rows.append([number, k, len(held), None, None, total[edge[k]:edge[k + 1]], packed])
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["block", "part", "docs", "ids", "words", "totals", "postings"]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)
        n = 0
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for i, t in zip(ids, batch.column("text").to_pylist()):
                held.append((i, t))
                size += len(t or "")
                if size >= p.block_bytes or len(held) >= p.block_docs:
                    yield block(base + n)
                    held, size, n = [], 0, n + 1
        if held:
            yield block(base + n)
    given = docs.select((F.col(id_column) if id_column else F.lit(0)).cast("long").alias("id"), "text")
    return given.mapInArrow(run, INVERTED)


def gains(own: np.ndarray, target: np.ndarray, all_own: int, all_target: int, p: Resampling) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target, with one added to every bucket."""
    def one(s: int, t: int) -> int:
        return math.floor(1000 * math.log((t + 1.0) * (all_own + float(p.buckets)) / ((s + 1.0) * (all_target + float(p.buckets)))))
    return np.array([one(int(s), int(t)) for s, t in zip(own, target)], np.int64)


def _contribute(all_own: int, all_target: int, p: Resampling):
    """Over rows ordered by (part, slab, kind): a header sets the gains, postings after it become contributions."""
    def run(batches):
        now, gain = None, np.zeros(0, np.int64)
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("part", "slab", "kind", "block", "docs", "own", "target", "postings")))
            out = []
            for part, slab, kind, block, docs, own, target, postings in rows:
                if kind == 0:
                    now, gain = (part, slab), gains(own, target, all_own, all_target, p)
                    continue
                if now != (part, slab):
                    raise ValueError("postings came before the totals of their buckets")
                bucket, doc, count = unpack(postings, len(gain))
                made = np.bincount(doc, gain[bucket] * count, docs)
                out.append((block, part, made.astype("<i8").tobytes()))
            if out:
                a, b, c = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.binary())], ["block", "part", "made"])
    return run


def _reduce():
    """Over rows ordered by (block, part): the documents of a block, then all contributions to them."""
    names = ["doc_id", "n_words", "weight"]

    def run(batches):
        block, ids, words, total = None, [], [], np.zeros(0, np.int64)

        def done():
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.int64()), pa.array(total)], names)
        for batch in batches:
            for b, part, i, w, made in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "ids", "words", "made"))):
                if part < 0:
                    if block is not None:
                        yield done()
                    block, ids, words, total = b, i, w, np.zeros(len(i), np.int64)
                elif b != block:
                    raise ValueError("contributions came before the documents of their block")
                else:
                    total += np.frombuffer(made, "<i8")
        if block is not None:
            yield done()
    return run


def weighed(docs: DataFrame, target: DataFrame, p: Resampling = DEFAULT) -> DataFrame:
    """(doc_id, n_words, n_features, weight), a row for each of ``docs`` (doc_id, text): the sum of its features'
    gains towards the texts of ``target`` (text).

    Null, empty and blank texts have no features and weigh 0; texts are read whole, whatever their length; repeated
    rows and null ids are kept, each on its own; an empty ``docs`` gives no rows, an empty ``target`` gains against
    no words; further columns are ignored. The result is written in the shared folder.
    """
    own = durable(inverted(docs, "doc_id", p), "postings")
    other = inverted(target, None, p)
    both = own.where("part >= 0").select("part", "totals", F.lit(0).alias("corpus")).unionByName(other.select("part", "totals", F.lit(1).alias("corpus")))
    each = both.select("part", "corpus", F.posexplode("totals").alias("at", "n"))
    of = lambda k: F.coalesce(F.sum(F.when(F.col("corpus") == k, F.col("n"))), F.lit(0))
    totals = durable(each.groupBy("part", "at").agg(of(0).alias("own"), of(1).alias("target")), "bucket-totals")
    all_own, all_target = (int(x or 0) for x in totals.agg(F.sum("own"), F.sum("target")).first())
    docs_of = own.where("part < 0").select("block", "ids", "words")
    # Blocks are numbered by task and place; a slab is some blocks of like numbers, by hash, about ``slab`` of them.
    blocks = own.where("part < 0").count()
    slabs = max(1, -(-blocks // p.slab))
    slab = F.pmod(F.xxhash64("block"), F.lit(slabs)).cast("int").alias("slab")
    rows = totals.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("at", "own", "target"))).alias("t"))
    header = rows.select("part", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))).alias("slab"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("block"),
                         F.lit(0).alias("docs"), F.col("t.own").alias("own"), F.col("t.target").alias("target"), F.lit(None).cast("binary").alias("postings"))
    none = F.lit(None).cast("array<long>")
    body = own.where("part >= 0").select("part", slab, F.lit(1).alias("kind"), "block", "docs", none.alias("own"), none.alias("target"), "postings")
    keys = ["part", "slab"]
    made = header.unionByName(body).repartition(*keys).sortWithinPartitions(*keys, "kind").mapInArrow(_contribute(all_own, all_target, p), "block long, part int, made binary")
    whole = docs_of.select("block", F.lit(-1).alias("part"), "ids", "words", F.lit(None).cast("binary").alias("made"))
    made = made.select("block", "part", none.alias("ids"), none.alias("words"), "made")
    summed = whole.unionByName(made).repartition("block").sortWithinPartitions("block", "part").mapInArrow(_reduce(), "doc_id long, n_words long, weight long")
    runs = sum((F.greatest(F.col("n_words") - k, F.lit(0)) for k in range(p.longest)), F.lit(0))
    out = durable(summed.select("doc_id", "n_words", runs.cast("long").alias("n_features"), "weight"), "weights")
    remove(own, totals)
    return out


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor of 1000 times a Gumbel number drawn from the id's hash; a null id counts as the empty text."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, p: Resampling = DEFAULT) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of all ``docs`` (doc_id, text); rank is null where not drawn.

    Of the N documents with ``least_words`` words, the floor(share N / 100) highest scores (weight and noise) are
    drawn: sampling without replacement in proportion to exp(weight / 1000). Ties go to the smaller id, a null id
    last; repeated rows are drawn apart. See ``weighed`` for odd texts and tables.
    """
    rows = weighed(docs, target, p)
    rows = rows.select("*", (F.col("weight") + gumbel(F.col("doc_id"), p.seed)).alias("score"), (F.col("n_words") >= p.least_words).alias("fit"))
    drawn = rows.where("fit").count() * p.share // 100
    placed = numbered(rows, [F.col("fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "place", "drawn")
    rank = F.when(F.col("fit") & (F.col("place") <= drawn), F.col("place"))
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

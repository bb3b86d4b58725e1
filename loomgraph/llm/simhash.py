"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints are made in one pass over the texts. Pairs are only looked for among *distinct*
fingerprints: the 64 bits of the first word are cut into ``blocks`` blocks, and each choice of
``agree`` of them is a key. Two words that differ in d bits leave at least ``blocks - d`` blocks alike,
so every pair with d <= blocks - agree shares a key; ``agree`` sets how selective keys are (4 bits, 7
blocks, 3 alike: 35 keys of 27 bits). Rows are dealt by key, and inside a key the Hamming distances are
computed in blocks with numpy. No pair is emitted: a search from one fingerprint over those left
gives a spanning forest, at most one link a fingerprint and key.

A key with more than ``tile`` fingerprints (a large group of near copies) is dealt as tiles: its
fingerprints are put in chunks by hash and each pair of chunks is a task's work of bounded size, so
nothing is dropped and no task holds the whole key. Components of the links follow, on all machines.

``keep_one`` asks for a Jaccard similarity. Sets of shingles whose fingerprints are near enough are found as above
and are compared; as a pair at exactly the least similarity differs in about ten bits, MinHash bands name further
sets to compare. A link is made after the sets themselves are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm._common import durable, free_name, map_arrow, shuffle_partitions, table
from loomgraph.llm.components import components

#: Fixed value: the odd multiplier of a 64-bit mixer, for the further words of long fingerprints.
MIX = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class SimHash:
    """``words``: 64-bit words of a fingerprint. ``near``: bits by which the first words of a pair may
    differ; ``distance``: bits by which the whole fingerprints may. Pairs with at most
    ``blocks - agree`` differing bits in the first word are certain to meet; others may."""

    shingle: int = 4
    words: int = 1
    near: int = 4
    distance: int = 4
    blocks: int = 7
    agree: int = 3
    tile: int = 4096


#: The query's contract: 4-word shingles, 64 bits, 4 differing bits; every such pair meets.
CONTRACT = SimHash()


@dataclass(frozen=True)
class Similar:
    """``at_least``: the Jaccard similarity of two shingle sets that links them, as a fraction (numerator,
    denominator). Sets are candidates if their fingerprints, of distinct shingles, are linked by ``prints``, or if one of ``bands`` groups of ``rows`` least hashes agrees: of pairs at
    similarity s, (1 - s ** rows) ** bands are never compared, 5 in a million at 0.8, 7 in a thousand million
    at 0.85. ``tile``: sets of a group of candidates that are compared at once."""

    shingle: int = 5
    at_least: tuple[int, int] = (4, 5)
    bands: int = 40
    rows: int = 6
    tile: int = 512
    prints: SimHash = CONTRACT


SIMILAR = Similar()


def words_of(text: str | None) -> list[bytes]:
    """Words of the lower-cased (A-Z only) text; bytes.split() splits at exactly 0x20 and 0x09-0x0D."""
    return text.encode().lower().split() if text else []


def shingles(text: str | None, size: int) -> np.ndarray:
    """The 64-bit hashes of a text's shingles of ``size`` words, in order; none if it has no words."""
    w = words_of(text)
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    if len(w) <= size:
        grams = [joined]
    else:
        at = np.zeros(len(w) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1, out=at[1:])
        n = len(w) - size + 1
        grams = [joined[a:b] for a, b in zip(at[:n].tolist(), (at[size:size + n] - 1).tolist())]
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64, len(grams))


def fingerprint(text: str | None, p: SimHash = CONTRACT) -> np.ndarray:
    """The ``p.words`` words of a text's fingerprint; all zero if it has no words."""
    return majority(shingles(text, p.shingle), p)


def majority(h: np.ndarray, p: SimHash) -> np.ndarray:
    """The ``p.words`` words of the fingerprint of the hashes ``h``."""
    if not len(h):
        return np.zeros(p.words, np.uint64)
    out = np.empty(p.words, np.uint64)
    for k in range(p.words):
        if k:
            h = (h ^ (h >> np.uint64(29))) * np.uint64(MIX)
            h ^= h >> np.uint64(32)
        ones = np.zeros(64, np.int64)
        for s in range(0, len(h), 1 << 16):
            part = h[s:s + (1 << 16)]
            ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")
    return out


def fingerprints(docs: DataFrame, p: SimHash = CONTRACT, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *also, f0 .. f<words-1>: long) of every row. Null texts count as empty."""
    kept = ["doc_id", *also]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [fingerprint(t.as_py(), p) for t in batch.column("text")]
            cols = np.array(rows, np.uint64).reshape(len(rows), p.words).view(np.int64)
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(cols[:, k]) for k in range(p.words))], [*kept, *(f"f{k}" for k in range(p.words))])
        return step
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept]
    return map_arrow(docs.select("text", *kept), make, ", ".join([*kinds, *(f"f{k} long" for k in range(p.words))]))


def block_keys(p: SimHash, f: Column) -> Column:
    """All keys of a first word: the bits of ``agree`` blocks, side by side, under the number of the choice."""
    edges = [round(64 * i / p.blocks) for i in range(p.blocks + 1)]
    cut = [(F.shiftrightunsigned(f, a).bitwiseAND(F.lit((1 << (b - a)) - 1)), b - a) for a, b in zip(edges, edges[1:])]
    keys = []
    for k, chosen in enumerate(combinations(range(p.blocks), p.agree)):
        key, width = F.lit(k).cast("long"), 0
        for i in chosen:
            bits, n = cut[i]
            key, width = F.shiftleft(key, n).bitwiseOR(bits), width + n
        if width + math.ceil(math.log2(math.comb(p.blocks, p.agree) + 1)) > 62:
            raise ValueError("keys of these blocks don't fit 62 bits")
        keys.append(key)
    return F.array(*keys)


def forest(f: np.ndarray, p: SimHash) -> list[tuple[int, int]]:
    """Links (i, j) between rows of ``f`` (n x words) that span the graph of all pairs near enough."""
    out: list[tuple[int, int]] = []
    left = np.arange(len(f))
    while len(left) > 1:
        front, left = left[:1], left[1:]
        root = int(front[0])
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for s in range(0, len(front), 256):
                x = front[s:s + 256]
                rest = np.flatnonzero(~near)
                if not len(rest):
                    break
                d = np.bitwise_count(f[x, 0][:, None] ^ f[left[rest], 0][None, :])
                i, j = np.nonzero(d <= p.near)
                if p.words > 1 and len(i):
                    d = np.bitwise_count(f[x[i]] ^ f[left[rest[j]]]).sum(axis=1, dtype=np.int64)
                    j = j[d <= p.distance]
                near[rest[j]] = True
            front, left = left[near], left[~near]
            out += zip(repeat(root), front.tolist())
    return out


def _spanning_links(rows: DataFrame, p: SimHash) -> DataFrame:
    """Rows (key, tile, node, f...) sorted by (key, tile) in each partition -> links (a, b)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(m: np.ndarray) -> pa.RecordBatch | None:
            starts = np.flatnonzero(np.r_[True, (m[1:, :2] != m[:-1, :2]).any(axis=1)])
            ends = np.r_[starts[1:], len(m)]
            many = ends - starts > 1
            found = []
            for a, b in zip(starts[many].tolist(), ends[many].tolist()):
                part = m[a:b]
                found += [(part[i, 2], part[j, 2]) for i, j in forest(part[:, 3:].view(np.uint64), p)]
            if not found:
                return None
            x = np.array(found, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            m = np.ascontiguousarray(np.column_stack([c.to_numpy() for c in batch.columns]))
            held.append(m)
            if (m[0, :2] == m[-1, :2]).all() and (len(held) == 1 or (held[0][0, :2] == m[0, :2]).all()):
                continue  # still one group: at most two chunks of a tile
            m = np.concatenate(held)
            last = int(np.flatnonzero((m[:, :2] != m[-1, :2]).any(axis=1))[-1]) + 1
            held = [m[last:]]
            if (out := links(m[:last])) is not None:
                yield out
        if held and (out := links(np.concatenate(held))) is not None:
            yield out
    return rows.mapInArrow(run, "a long, b long")


def link_fingerprints(distinct: DataFrame, p: SimHash = CONTRACT) -> DataFrame:
    """(a, b): nodes linked directly or through others in the same key. ``distinct``: (node long, f0 ...),
    one row a fingerprint."""
    spark = distinct.sparkSession
    words = [f"f{k}" for k in range(p.words)]
    keyed = distinct.select(F.explode(block_keys(p, F.col("f0"))).alias("key"), "node", *words)
    hot = durable(keyed.groupBy("key").count().where(F.col("count") > p.tile), "hot-keys")
    parts = shuffle_partitions(spark)
    if hot.isEmpty():
        tiled = keyed.select("key", F.lit(0).cast("long").alias("tile"), "node", *words)
    else:
        # The hot side has one row for over `tile` rows of the other; Spark decides by its size.
        n = F.ceil(F.col("count") / F.lit(p.tile)).cast("long")
        both = keyed.join(hot, "key", "left").withColumn("n", F.coalesce(n, F.lit(1).cast("long")))
        both = both.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("n")))
        both = both.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        tiled = both.select("key", (F.least("chunk", "other") * F.col("n") + F.greatest("chunk", "other")).alias("tile"), "node", *words)
    dealt = tiled.repartition(parts, "key", "tile").sortWithinPartitions("key", "tile")
    return _spanning_links(dealt, p).distinct()


def _groups(made: DataFrame, p: SimHash, order: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(made with its node, one row a node with its first row by ``order``, the linked nodes' roots)."""
    words = [f"f{k}" for k in range(p.words)]
    # One node a distinct fingerprint. One word is its own node; longer ones get a 64-bit digest.
    made = made.withColumn("node", F.col("f0") if p.words == 1 else F.xxhash64(*words))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), *order)).alias("first")
    nodes = durable(made.groupBy("node").agg(*(F.first(w).alias(w) for w in words), first), "nodes")
    return made, nodes, components(link_fingerprints(nodes.select("node", *words), p), "links")


def near_duplicates(docs: DataFrame, p: SimHash = CONTRACT) -> DataFrame:
    """(doc_id, f0 .., component_id) of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id that links reach, the row's own included. Null and empty texts
    have fingerprint zero and link like any other; repeated rows are repeated in the result; a null
    doc_id is never the smallest unless the group has no other (then component_id is null). An empty
    table gives an empty result; columns other than doc_id and text are not read.
    """
    made, nodes, linked = _groups(durable(fingerprints(docs, p), "fingerprints"), p, ["doc_id"])
    both = linked.join(nodes.select("node", "first"), "node")
    group = both.groupBy("root").agg(F.min("first").alias("least"))
    named = linked.join(group, "root").select("node", "least")
    known = nodes.join(named, "node", "left").select("node", F.coalesce("least", "first")["doc_id"].alias("component_id"))
    return made.join(known, "node").drop("node")


def band_keys(distinct: np.ndarray, p: Similar = SIMILAR) -> np.ndarray:
    """One key a band of a set of shingle hashes: a digest of the band's number and its least hashes."""
    k = p.bands * p.rows
    salt = np.random.default_rng(7).integers(1, 1 << 32, (2, k, 1), np.uint64).astype(np.uint32)
    x = (distinct ^ (distinct >> np.uint64(32))).astype(np.uint32)
    least = np.full(k, 0xFFFFFFFF, np.uint32)
    for s in range(0, len(x), 2048):
        h = (x[s:s + 2048] ^ salt[0]) * (salt[1] | np.uint32(1))
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        np.minimum(least, h.min(axis=1), out=least)
    raw, width = least.astype("<u4").tobytes(), 4 * p.rows
    return np.fromiter((xxhash.xxh64_intdigest(raw[b * width:(b + 1) * width], b) for b in range(p.bands)), np.uint64, p.bands)


def shingle_sets(docs: DataFrame, p: Similar, also: tuple[str, ...]) -> DataFrame:
    """(*also, node, keys, f0 ..) of every row of ``docs`` (text, *also): node is the digest of its set of shingles,
    keys those of its bands (texts without words have none), f0 .. the words of the set's fingerprint."""
    words = [f"f{k}" for k in range(p.prints.words)]
    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            nodes, keys, size, prints = [], [], [], []
            for t in batch.column("text"):
                h = np.unique(shingles(t.as_py(), p.shingle))
                nodes.append(xxhash.xxh64_intdigest(h.tobytes()))
                size.append(p.bands if len(h) else 0)
                prints.append(majority(h, p.prints))
                if len(h):
                    keys.append(band_keys(h, p))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *size]), pa.int32()), pa.array(flat.view(np.int64)))
            cols = np.array(prints, np.uint64).reshape(len(prints), len(words)).view(np.int64)
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in also), pa.array(np.array(nodes, np.uint64).view(np.int64)), lists, *(pa.array(cols[:, k]) for k in range(len(words)))], [*also, "node", "keys", *words])
        return step
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in also]
    return map_arrow(docs.select("text", *also), make, ", ".join([*kinds, "node long", "keys array<long>", *(f"{w} long" for w in words)]))


def set_forest(sets: list[np.ndarray], p: Similar = SIMILAR) -> list[tuple[int, int]]:
    """Links (i, j) that span the graph of all pairs of ``sets`` (distinct hashes each) similar enough. Common
    shingles are counted by an inverted list, and the similarity is compared in whole numbers."""
    out: list[tuple[int, int]] = []
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    if not size.sum():
        return out
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(sets)), size)[np.argsort(ids, kind="stable")]
    start = np.r_[0, np.cumsum(np.bincount(ids))]
    top, base = p.at_least
    left = np.ones(len(sets), bool)
    for root in range(len(sets)):
        if not left[root]:
            continue
        left[root] = False
        front = [root]
        while front and left.any():
            x = front.pop()
            mine = ids[ends[x] - size[x]:ends[x]]
            n = start[mine + 1] - start[mine]
            at = np.repeat(start[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
            common = np.bincount(owner[at], minlength=len(sets))
            # common / (a + b - common) >= top / base
            near = np.flatnonzero(left & (common > 0) & (common * (top + base) >= top * (size + size[x])))
            left[near] = False
            out += zip(repeat(x), near.tolist())
            front += near.tolist()
    return out


def _verified_links(rows: DataFrame, p: Similar) -> DataFrame:
    """Rows (root, tile, node, text) sorted by (root, tile) in each partition -> links (a, b)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, sets = None, [], []

        def links() -> pa.RecordBatch:
            found = [(nodes[i], nodes[j]) for i, j in set_forest(sets, p)]
            x = np.array(found, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])

        for batch in batches:
            for root, tile, node, text in zip(*(batch.column(c).to_pylist() for c in ("root", "tile", "node", "text"))):
                if (root, tile) != group:
                    if len(nodes) > 1:
                        yield links()
                    group, nodes, sets = (root, tile), [], []
                nodes.append(node)
                sets.append(np.unique(shingles(text, p.shingle)))
        if len(nodes) > 1:
            yield links()
    return rows.select("root", "tile", "node", "text").mapInArrow(run, "a long, b long")


def link_sets(nodes: DataFrame, texts: DataFrame, p: Similar = SIMILAR) -> DataFrame:
    """(a, b): nodes linked directly or through others by sets as similar as ``p`` asks. ``nodes``: (node,
    keys, f0 ..), one row a set; ``texts``: (node, text), one row or more a set.

    Sets with near fingerprints or that share a key, or that others connect so, are a group; all pairs of a group are compared
    on their whole sets. A group with more than ``tile`` sets is dealt as pairs of chunks.
    """
    keyed = nodes.select(F.explode("keys").alias("key"), "node")
    shared = keyed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    meet = keyed.join(shared, "key").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    alike = link_fingerprints(nodes.where(F.size("keys") > 0).select("node", *(f"f{k}" for k in range(p.prints.words))), p.prints)
    rough = durable(components(meet.unionByName(alike), "candidates"), "groups")
    count = rough.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(p.tile)).cast("long").alias("n"))
    both = rough.join(count, "root").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("n")))
    both = both.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    tiles = both.select("root", (F.least("chunk", "other") * F.col("n") + F.greatest("chunk", "other")).alias("tile"), "node")
    found = durable(texts.join(rough, "node", "left_semi").dropDuplicates(["node"]), "candidate-texts")
    dealt = tiles.join(found, "node").repartition(shuffle_partitions(nodes.sparkSession), "root", "tile").sortWithinPartitions("root", "tile")
    return _verified_links(dealt, p).distinct()


def keep_one(docs: DataFrame, p: Similar = SIMILAR) -> DataFrame:
    """The rows of ``docs``, one of each group of near duplicates, all columns as they were.

    Rows are near duplicates if their sets of shingles are as similar as ``p`` asks, or others in between
    are; texts without words are alike. The row with the smallest doc_id stays (null ids last, then by a
    hash of the whole row); of rows that are the same in every column one stays.
    """
    row, key = free_name(docs.columns, "loom_row"), free_name(docs.columns, "loom_key")
    plain = [F.col(f"`{c}`") for c, t in docs.dtypes if t != "void" and "map<" not in t and "variant" not in t]
    keyed = docs.withColumn(row, F.xxhash64(*plain)).withColumn(key, F.coalesce(F.col("doc_id"), F.lit(-1)))
    made = durable(shingle_sets(keyed, p, ("doc_id", row)), "shingle-sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", f"`{row}`")).alias("first")
    nodes = durable(made.groupBy("node").agg(*(F.first(c).alias(c) for c in ("keys", *(f"f{k}" for k in range(p.prints.words)))), first), "nodes")
    pick = nodes.where(F.size("keys") > 0).select("node", F.coalesce(F.col("first.doc_id"), F.lit(-1)).alias(key), F.col(f"first.{row}").alias(row))
    texts = keyed.select(key, row, "text").join(pick, [key, row]).select("node", "text")
    linked = components(link_sets(nodes, texts, p), "links")
    group = nodes.join(linked, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("first").alias("least"))
    stay = group.select(F.coalesce(F.col("least.doc_id"), F.lit(-1)).alias(key), F.col(f"least.{row}").alias(row)).distinct()
    return keyed.join(stay, [key, row], "left_semi").dropDuplicates([key, row]).select(*(F.col(f"`{c}`") for c in docs.columns))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), CONTRACT)
    return near.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")

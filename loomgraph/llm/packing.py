"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted. A document of n tokens (words and one end) longer than the
longest is cut into full sequences and a rest; no token is lost. A sequence of length c costs
c + overhead + c * c / attention: its tokens, what every sequence costs, and attention, which grows with
the square. Pieces are placed in descending length: a piece goes to the open bin with the least room left
that holds it (best fit); if there is none, a bin is opened of the size with the least cost for each
token that can still come into it, given the lengths that are left. At the end each bin is downsized
to the smallest permitted length that holds its contents.

The sizes are chosen jointly: each subset of the permitted lengths that has the longest one is tried on
the whole group, and the one with the least total cost is kept.

Packing runs in groups of bounded size. A group is a run of documents by the hash of their id within a
hash range; how many ranges there are follows from a count. Lengths are a few bytes a document, so the
text is read once and never shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate, combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm._common import durable, shuffle_partitions, table


@dataclass(frozen=True)
class Packing:
    """``capacities``: permitted lengths, ascending; ``group_rows``: about how many documents are packed
    together; ``overhead``: tokens that a sequence costs besides its length; ``attention``: the length at
    which attention costs as much as everything else of a token."""

    capacities: tuple[int, ...] = (512, 1024, 2048, 4096)
    group_rows: int = 20_000
    overhead: int = 16
    attention: int = 8192

    def cost(self, capacity: int) -> float:
        return capacity + self.overhead + capacity * capacity / self.attention


DEFAULT = Packing()


def token_count(text: Column) -> Column:
    """Words (runs of signs other than 0x20 and 0x09-0x0D) and one end. A null or blank text has the end only."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return (F.length(F.regexp_replace(body, r"[\x20\x09-\x0D]+", "")) + 1).cast("long")


def pieces(n: int, longest: int) -> list[tuple[int, int]]:
    """(first token, tokens) of each piece of a document of ``n`` tokens."""
    return [(a, min(longest, n - a)) for a in range(0, n, longest)]


def open_size(length: int, fits: Callable[[int], int], sizes: tuple[int, ...], p: Packing) -> int:
    """The size to open for a piece: the least cost for each token that can come to stand in it. ``fits``: tokens
    of the pieces still to be placed that are no longer than a given room. Ties: the smallest."""
    return min((c for c in sizes if c >= length), key=lambda c: (p.cost(c) / min(c, length + fits(c - length)), c))


def fit(order: list[tuple], sizes: tuple[int, ...], p: Packing) -> tuple[float, list[tuple], list[int]]:
    """Best fit of items (length, *name) in the order given, longest first: the cost after downsizing, the places
    (*name, bin, offset, length), and each bin's capacity."""
    up = [x[0] for x in reversed(order)]
    total = [0, *accumulate(up)]
    room: list[tuple[int, int]] = []  # (room left, bin), ascending
    used: list[int] = []
    placed = []
    for k, (length, *name) in enumerate(order):
        at = bisect_left(room, (length, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            b, after = len(used), len(order) - 1 - k  # pieces after this one, none of them longer
            free = open_size(length, lambda r, n=after: total[min(bisect_right(up, r), n)], sizes, p)
            used.append(0)
        placed.append((*name, b, used[b], length))
        used[b] += length
        if free > length:
            insort(room, (free - length, b))
    final = [min(c for c in p.capacities if c >= u) for u in used]
    return sum(map(p.cost, final)), placed, final


def pack(items: list[tuple], p: Packing = DEFAULT) -> list[tuple]:
    """Items (length, *name), each at most the longest capacity -> (*name, bin, offset, length, capacity), bins
    numbered by opening: the cheapest of the fits with each subset of the capacities (ties: the fewest sizes).

    The order of placing is length descending, then name; equal room goes to the earlier bin.
    """
    order = sorted(items, key=lambda x: (-x[0], x[1:]))
    *less, longest = p.capacities
    best = None
    for n in range(len(less) + 1):
        for sizes in combinations(less, n):
            made = fit(order, (*sizes, longest), p)
            if best is None or made[0] < best[0]:
                best = made
    _, placed, final = best
    return [(*x, final[x[-3]]) for x in placed]


def pack_documents(docs: DataFrame, p: Packing = DEFAULT) -> DataFrame:
    """(doc_id, copy, piece, first_token, n_tokens, group_id, bin, offset, capacity) of every piece of every row.

    Null and empty texts are documents of one token. Rows that repeat doc_id are packed each on its own
    (``copy`` numbers them in no particular order of content, all being of one id); null ids keep null.
    An empty table gives no rows. Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    slim = durable(docs.select("doc_id", token_count(F.col("text")).alias("n")), "lengths")
    n = slim.count()
    groups = max(1, -(-n // p.group_rows))
    # The hash covers the length, so that rows that share an id spread over groups as lengths do; rows that
    # repeat both are counted, not listed, until they are placed.
    counted = slim.groupBy("doc_id", "n").agg(F.count(F.lit(1)).alias("times"))
    spread = counted.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("copy"))
    keyed = spread.withColumn("group_id", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "n", "copy"), F.lit(groups)).cast("long"))
    dealt = keyed.repartition(min(groups, 4 * shuffle_partitions(spark)), "group_id").sortWithinPartitions("group_id")
    names = ["doc_id", "copy", "piece", "first_token", "n_tokens", "group_id", "bin", "offset", "capacity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, items = None, []

        def done() -> Iterator[pa.RecordBatch]:
            # null ids sort first; the name is (no id, id, copy, piece, first token)
            out = [(None if none else doc, copy, piece, first, length, group, b, at, size) for none, doc, copy, piece, first, b, at, length, size in pack(items, p)]
            for s in range(0, len(out), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[s:s + 50_000])], names)
        for batch in batches:
            for doc, n, copy, g in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "copy", "group_id"))):
                if g != group:
                    if items:
                        yield from done()
                    group, items = g, []
                items += [(length, doc is None, doc or 0, copy, k, first) for k, (first, length) in enumerate(pieces(n, p.capacities[-1]))]
        if items:
            yield from done()
    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))

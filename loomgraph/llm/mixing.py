"""Mixing sources to target weights: whole copies of documents by pivotal dependent rounding.

Every source has a target of words; a document's expected copies are its source's target over its size. Whole
copies are taken as they are, and the fractions left are rounded in pairs: of two documents of a source one gives
the other expected words until one of the two has none or a whole copy, at random in both directions, so that
the expectation of each stays what it was and the words of both together stay exact. The one still in between
goes on. Documents are dealt to leaves of bounded size, and what is left of each leaf, one document a source, is
rounded again, ``fan`` leaves at a time, up a tree. So a source's words miss its target by less than one document,
a small one, as larger ones are paired first. Draws come from hashes of ids: another run gives the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm._common import durable, numbered, table, with_values

#: A word is a run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """``weights`` go round over the sources in order; no source gives more than ``most`` copies of itself.
    ``leaf_rows``: rows of a leaf, about; ``fan``: leaves joined at a step of the tree."""

    weights: tuple[int, ...] = (1, 2, 3)
    most: int = 3
    leaf_rows: int = 4096
    fan: int = 64
    seed: int = 42


DEFAULT = Mix()


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, p: Mix = DEFAULT) -> DataFrame:
    """(source, source_size, target) from ``sources`` (source, source_size), one row each, written.

    Sources share all words by weight; those that would exceed ``most`` times their size stop there and the rest
    share on. All that is not stopped has the same words a unit of weight, and each pass over the sources computes
    that number from those stopped so far: they only become more, so it ends. Only sums come to the driver.
    """
    placed = numbered(sources, [F.col("source").asc_nulls_last()], "place", "sources")
    cycle = F.array(*(F.lit(float(w)) for w in p.weights))
    rows = placed.select("source", "source_size", F.get(cycle, ((F.col("place") - 1) % len(p.weights)).cast("int")).alias("weight"))
    top, unit, seen = F.lit(float(p.most)) * F.col("source_size"), 0.0, -1
    while True:
        stopped = F.lit(unit) * F.col("weight") > top
        total, held, share, count = rows.agg(F.sum("source_size"), F.sum(F.when(stopped, F.col("source_size"))), F.sum(F.when(~stopped, F.col("weight"))), F.count_if(stopped)).first()
        if count == seen:
            break
        seen = count
        unit = (float(total or 0) - p.most * float(held or 0)) / share if share else unit
    return rows.select("source", "source_size", F.when(F.lit(unit) * F.col("weight") > top, top).otherwise(F.lit(unit) * F.col("weight")).alias("target"))


def draw(seed: int, a: int | None, b: int | None) -> float:
    """A number in [0, 1) from two ids."""
    return (xxhash.xxh64_intdigest(f"{a}:{b}", seed) >> 11) / 2.0**53


def transfer(s: float, p: float, t: float, q: float, u: float) -> tuple[float, float]:
    """New fractions of two documents of sizes ``s`` and ``t``: s p + t q stays, one of them becomes 0 or 1, and over
    ``u`` in [0, 1) the mean of each is what it was."""
    up, down = min(s * (1 - p), t * q), min(s * p, t * (1 - q))
    if u * (up + down) < down:
        a, b = (1.0, q - up / t) if s * (1 - p) <= t * q else (p + up / s, 0.0)
    else:
        a, b = (0.0, q + down / t) if s * p <= t * (1 - q) else (p - down / s, 1.0)
    near = lambda x: round(x) if min(abs(x), abs(1 - x)) < 1e-12 else x
    return near(a), near(b)


COLUMNS = ["source", "node", "doc_id", "size", "source_size", "target", "base", "part"]
KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64()]
SCHEMA = "source string, node long, doc_id long, size long, source_size long, target double, base long, part double"


def _round(last: bool, seed: int):
    """Over rows ordered by (source, node, size): ``part`` becomes 0, ``base`` the copies, except for one row a group;
    that one too in the ``last`` step."""
    def run(batches):
        group, held = None, None

        def settle(row: list) -> list:
            row[6], row[7] = row[6] + int(row[7]), 0.0
            return row

        def close(out: list) -> None:
            if held is not None:
                if last:
                    held[7] = 1.0 if draw(seed, held[2], None) < held[7] else 0.0
                    settle(held)
                out.append(held)

        def batch_of(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), KINDS)], COLUMNS)
        for batch in batches:
            out: list[list] = []
            for row in map(list, zip(*(c.to_pylist() for c in batch.columns))):
                if (row[0], row[1]) != group:
                    close(out)
                    group, held = (row[0], row[1]), None
                if held is None:
                    held = row
                    continue
                held[7], row[7] = transfer(held[3], held[7], row[3], row[7], draw(seed, held[2], row[2]))
                still = [r for r in (held, row) if 0.0 < r[7] < 1.0]
                out += [settle(r) for r in (held, row) if r[7] in (0.0, 1.0)]
                held = still[0] if still else None
            if out:
                yield batch_of(out)
        tail: list[list] = []
        close(tail)
        if tail:
            yield batch_of(tail)
    return run


def mix(docs: DataFrame, p: Mix = DEFAULT) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of ``docs`` (doc_id, text, source).

    Null, empty and blank texts have size 0 and nothing is taken of them; a null source is a source of its own,
    the last; sources without words have target 0; repeated rows and null ids are documents of their own, texts are
    counted whole; an empty table gives no rows; further columns are ignored.
    """
    sized = durable(docs.select("doc_id", F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("at")), "sizes")
    sources = durable(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    rows = with_values(sized, targets(sources, p), "source", F.col("at"))
    leaves = max(1, -(-sized.count() // p.leaf_rows))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    base = F.floor(expected)
    part = F.when(F.col("size") > 0, expected - base).otherwise(F.lit(0.0))
    rows = rows.select("source", F.pmod("at", F.lit(leaves)).alias("node"), F.col("doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", base.alias("base"), part.alias("part"))
    whole, open_rows = rows.where("part = 0"), rows.where("part > 0")
    done, keys = [whole.select(*COLUMNS)], ["source", "node"]
    while True:
        order = [*keys, F.col("size").desc(), F.col("doc_id").asc_nulls_last()]
        level = durable(open_rows.select(*COLUMNS).repartition(*keys).sortWithinPartitions(*order).mapInArrow(_round(leaves == 1, p.seed), SCHEMA), "rounded")
        done.append(level.where("part = 0"))
        if leaves == 1:
            break
        leaves = -(-leaves // p.fan)
        open_rows = level.where("part > 0").withColumn("node", F.floor(F.col("node") / p.fan))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "size", "source_size", "target", (F.col("base") * F.col("size")).alias("taken"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))

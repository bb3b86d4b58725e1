"""Interval joins: lines to the smallest span that holds them, matches, diffs, nesting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.plans.io import written

#: Lines of a bin. Spans are filed under every bin they touch, so the range join has an equality key.
BIN = 16


def enclosing(points: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """``points`` (key, line, ...) with anchor of the narrowest span (key, anchor, start_line, end_line) that
    holds the line, ties to the smallest anchor; null where none does. Equal points are one row."""
    filed = spans.select(key, "anchor", "start_line", "end_line", F.explode(F.sequence(F.floor(F.col("start_line") / BIN), F.floor(F.col("end_line") / BIN))).alias("bin"))
    asked = points.withColumn("bin", F.floor(F.col("line") / BIN))
    met = asked.select(key, "line", "bin").distinct().join(filed, [key, "bin"]).where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    best = met.groupBy(key, "line").agg(F.min_by("anchor", F.struct(F.col("end_line") - F.col("start_line"), "anchor")).alias("anchor"))
    return points.join(best, [key, "line"], "left")


def matches(lines: DataFrame, pattern: str, *, literal: bool = True, ignore_case: bool = False) -> DataFrame:
    """Lines that hold the literal or match the regular expression."""
    text, what = F.col("text"), pattern
    if ignore_case and literal:
        text, what = F.lower(text), pattern.lower()
    return lines.where(text.contains(what) if literal else F.col("text").rlike(("(?i)" if ignore_case else "") + pattern))


def counted_top(rows: DataFrame, order: list[Column], k: int) -> tuple[DataFrame, int]:
    """The first ``k`` rows in order, written, and the exact number of all rows, from one pass over ``rows``: each task
    keeps a heap of ``k`` and counts what it has seen."""
    seen = Observation()
    top = written(rows.observe(seen, F.count(F.lit(1)).alias("total")).orderBy(*order).limit(k), "top")
    return top, seen.get["total"]


def changed_lines(diffs: DataFrame) -> DataFrame:
    """(file, line) of unified diffs (id, text): every line of each hunk's new range; an empty range is its join point."""
    rows = diffs.select("id", F.posexplode(F.split("text", "\n")).alias("at", "row"))
    file = F.when(F.col("row").startswith("+++ "), F.regexp_replace(F.regexp_extract("row", r"^\+\+\+ (?:b/)?([^\t]*)", 1), r"\s+$", ""))
    whole = rows.withColumn("file", F.last(file, ignorenulls=True).over(W.partitionBy("id").orderBy("at")))
    hunk = whole.where(F.col("row").startswith("@@ ")).select("file", F.regexp_extract("row", r"\+(\d+)", 1).cast("int").alias("a"), F.regexp_extract("row", r"\+\d+,(\d+)", 1).alias("n"))
    size = F.when(F.col("n") == "", 1).otherwise(F.col("n").cast("int"))
    sized = hunk.where(F.col("file") != "/dev/null").withColumn("size", F.greatest(size, F.lit(1)))
    return sized.select("file", F.explode(F.sequence(F.greatest(F.col("a"), F.lit(1)), F.greatest(F.col("a"), F.lit(1)) + F.col("size") - 1)).alias("line")).distinct()


def nesting(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """``spans`` with depth (how many other spans hold it) and parent (the narrowest of them)."""
    s = spans.select(key, "anchor", "start_line", "end_line").distinct()
    o = s.select(key, F.col("anchor").alias("p"), F.col("start_line").alias("ps"), F.col("end_line").alias("pe"))
    wider = (F.col("ps") <= F.col("start_line")) & (F.col("pe") >= F.col("end_line")) & ((F.col("pe") - F.col("ps") > F.col("end_line") - F.col("start_line")) | ((F.col("ps") == F.col("start_line")) & (F.col("pe") == F.col("end_line")) & (F.col("p") < F.col("anchor"))))
    held = s.join(o, key).where(wider).groupBy(key, "anchor", "start_line", "end_line").agg(F.count(F.lit(1)).alias("depth"), F.min_by("p", F.struct(F.col("pe") - F.col("ps"), F.col("p"))).alias("parent"))
    return s.join(held, [key, "anchor", "start_line", "end_line"], "left").fillna(0, ["depth"])

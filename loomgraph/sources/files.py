"""Sources and sinks: file trees, paragraphs, CSV tables, light markup, triples, rendered output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import glob_to_regex


def scan(spark: SparkSession, root: str, glob: str = "*.{adoc,md,txt}", ignore: list[str] | None = None) -> DataFrame:
    """(path, text) of all files under ``root`` that match, without those whose path an ignore glob fits."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    out = raw.select("path", F.decode("content", "UTF-8").alias("text"))
    for g in ignore or []:
        out = out.where(~F.col("path").rlike(glob_to_regex(f"**/{g}")))
    return out


def paragraphs(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, para, start_line, end_line, text): runs of lines that aren't blank, numbered from 1; within a row, no shuffle."""
    rows = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text"), (F.trim(x) == "").alias("blank")))
    kind = "array<struct<start_line:int,end_line:int,text:string>>"
    empty = F.struct(F.array().cast(kind).alias("done"), F.lit(True).alias("closed"))

    def step(acc: Column, r: Column) -> Column:
        last = F.element_at(acc["done"], -1)
        grown = F.struct(last["start_line"].alias("start_line"), r["line"].alias("end_line"), F.concat(last["text"], F.lit("\n"), r["text"]).alias("text"))
        fresh = F.struct(r["line"].alias("start_line"), r["line"].alias("end_line"), r["text"].alias("text"))
        n = F.size(acc["done"])
        done = F.when(r["blank"], acc["done"]).when(acc["closed"], F.array_append(acc["done"], fresh)).otherwise(F.array_append(F.slice(acc["done"], 1, F.greatest(n - 1, F.lit(0))), grown))
        return F.struct(done.cast(kind).alias("done"), r["blank"].alias("closed"))
    return docs.select(key, F.posexplode(F.aggregate(rows, empty, step, lambda a: a["done"])).alias("para", "p")).select(key, (F.col("para") + 1).alias("para"), "p.*")


def csv_table(spark: SparkSession, path: str, rows: int = 100) -> DataFrame:
    """The first ``rows`` rows of a CSV file with a header, all columns as text."""
    return spark.read.csv(path, header=True).limit(rows)


def markup(docs: DataFrame) -> DataFrame:
    """(path, line, kind, value) of light markup (path, text): anchor, heading, ref, include, edge, attribute."""
    line = docs.select("path", F.posexplode(F.split("text", "\n")).alias("line", "row")).withColumn("line", F.col("line") + 1)
    every = lambda p, g=1: F.regexp_extract_all("row", F.lit(p), F.lit(g))
    kinds = F.create_map(F.lit("anchor"), every(r"\[\[([^\],]+)[^\]]*\]\]"), F.lit("heading"), every(r"^(?:=+|#+)\s+(.+)$"), F.lit("ref"), every(r"<<([^>,]+)[^>]*>>"), F.lit("include"), every(r"^include::([^\[]+)\["), F.lit("edge"), every(r"(edge::\w+\[[^\]]+\])", 1), F.lit("attribute"), every(r"^(:[\w-]+:.*)$"))
    return line.select("path", "line", F.explode(kinds).alias("kind", "values")).select("path", "line", "kind", F.explode("values").alias("value"))


def edge_macros(items: DataFrame, known: list[str]) -> DataFrame:
    """(src, dst, edge_type) of edge::TYPE[target] values (path, value): unknown types relate, member_of is Contains reversed."""
    kind, target = F.regexp_extract("value", r"edge::(\w+)\[", 1), F.regexp_extract("value", r"\[([^\]]+)\]", 1)
    found = F.coalesce(F.get(F.filter(F.array(*map(F.lit, known)), lambda x: F.lower(x) == F.lower(F.regexp_replace(kind, "_", ""))), F.lit(0)), F.lit("RelatesTo"))
    swap = F.lower(kind) == "member_of"
    return items.select(F.when(swap, target).otherwise(F.col("path")).alias("src"), F.when(swap, F.col("path")).otherwise(target).alias("dst"), F.when(swap, "Contains").otherwise(found).alias("edge_type"))


def merge_triples(sources: DataFrame) -> DataFrame:
    """(s, p, o, sources) of triples (s, p, o, source): each once, with where it is from."""
    return sources.groupBy("s", "p", "o").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def fingerprint(files: DataFrame, group: list[str] | None = None) -> DataFrame:
    """SHA-256 over the sorted (path, SHA-256 of text) of each group: what a reader compares to know it is current."""
    one = files.select(*(group or []), F.concat_ws(" ", "path", F.sha2(F.coalesce("text", F.lit("")), 256)).alias("h"))
    return one.groupBy(*(group or [])).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("fingerprint"), F.count(F.lit(1)).alias("files"))


def mermaid(edges: DataFrame) -> DataFrame:
    """(diagram) of a bounded slice of edges."""
    row = F.format_string('  %s["%s"] -->|%s| %s["%s"]', F.concat(F.lit("n"), F.abs(F.xxhash64("src")).cast("string")), "src", "edge_type", F.concat(F.lit("n"), F.abs(F.xxhash64("dst")).cast("string")), "dst")
    return edges.agg(F.concat(F.lit("graph LR\n"), F.array_join(F.array_sort(F.collect_list(row)), "\n")).alias("diagram"))


def dot(edges: DataFrame) -> DataFrame:
    row = F.format_string('  "%s" -> "%s" [label="%s"];', "src", "dst", "edge_type")
    return edges.agg(F.concat(F.lit("digraph {\n"), F.array_join(F.array_sort(F.collect_list(row)), "\n"), F.lit("\n}")).alias("diagram"))

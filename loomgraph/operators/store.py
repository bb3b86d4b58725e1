"""Changes and reads of the stored graph, and edges built from what texts say. Anti and semi joins throughout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions import forms


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """``edges`` without those in ``gone`` (src, dst, edge_type)."""
    return edges.join(gone.select("src", "dst", "edge_type").distinct(), ["src", "dst", "edge_type"], "left_anti")


def clear_calls(edges: DataFrame, callers: DataFrame) -> DataFrame:
    """``edges`` without the Calls edges of ``callers`` (anchor)."""
    calls = callers.select(F.col("anchor").alias("src"), F.lit("Calls").alias("edge_type")).distinct()
    return edges.join(calls, ["src", "edge_type"], "left_anti").select(*edges.columns)


def spans_of(spans: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``spans`` (anchor, ...) whose anchor is among ``keys`` (anchor)."""
    return spans.join(keys.select("anchor").distinct(), "anchor", "left_semi")


def first_wins(sources: list[DataFrame], key: str) -> DataFrame:
    """Of rows with one key that of the earliest source."""
    both = reduce(lambda a, b: a.unionByName(b), (s.withColumn("_from", F.lit(i)) for i, s in enumerate(sources)))
    rank = F.row_number().over(W.partitionBy(key).orderBy("_from", *(c for c in sources[0].columns if c != key)))
    return both.withColumn("_r", rank).where("_r = 1").drop("_r", "_from")


def missing_embeddings(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """(key): keys of ``wanted`` (key) that ``have`` (key) lacks, once each: what must be embedded."""
    return wanted.select("key").distinct().join(have.select("key"), "key", "left_anti")


def incremental_embeddings(have: DataFrame, now: DataFrame) -> DataFrame:
    """(anchor, action) of (anchor, key) then and now: embed what is new or has changed, drop what is gone; what is
    as it was gives no row."""
    both = have.select("anchor", F.col("key").alias("old")).join(now.select("anchor", F.col("key").alias("new")), "anchor", "full")
    action = F.when(F.col("new").isNull(), "drop").when(F.col("old").isNull() | (F.col("old") != F.col("new")), "embed")
    return both.select("anchor", action.alias("action")).where("action is not null")


def page_of(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """(total, returned, offset, truncated, rows): one page of ``rows`` in a total order, in its envelope."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    page = rows.orderBy(*order).offset(offset).limit(limit)
    packed = page.agg(F.count(F.lit(1)).alias("returned"), F.array_sort(F.collect_list(F.struct(*rows.columns))).alias("rows"))
    return total.crossJoin(packed).select("total", "returned", F.lit(offset).cast("long").alias("offset"), (F.col("total") > offset + F.col("returned")).alias("truncated"), "rows")


def node_json(nodes: DataFrame) -> DataFrame:
    """(anchor, json) of (anchor, depth, node_type, via): keys in this order."""
    return nodes.select("anchor", F.to_json(F.struct("anchor", "depth", "node_type", "via")).alias("json"))


def capped(rows: DataFrame, group: str, order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each group, and how many each has (of): what an outline shows."""
    w = W.partitionBy(group)
    return rows.withColumn("_r", F.row_number().over(w.orderBy(*order))).withColumn("of", F.count(F.lit(1)).over(w)).where(F.col("_r") <= most).drop("_r")


def induced(edges: DataFrame, inside: DataFrame) -> DataFrame:
    """The edges with both ends among ``inside`` (anchor)."""
    a = inside.select("anchor").distinct()
    return edges.join(a.withColumnRenamed("anchor", "src"), "src", "left_semi").join(a.withColumnRenamed("anchor", "dst"), "dst", "left_semi").select(*edges.columns)


def node_type(anchor: Column, path: Column) -> Column:
    """Adr, Plan, Module, Test or Note of an anchor, by its prefix and then by its path."""
    kind = forms.doc_type(anchor)
    return F.when(kind == "adr", "Adr").when(kind == "plan", "Plan").when(kind == "module", "Module").when(forms.is_test(path), "Test").otherwise("Note")


def ref_edges(refs: DataFrame) -> DataFrame:
    """Of references (src, target): Uses and the UsedBy back; RelatesTo both ways if either side is a decision record."""
    record = F.lower("src").startswith("adr-") | F.lower("target").startswith("adr-")
    there, back = F.when(record, "RelatesTo").otherwise("Uses"), F.when(record, "RelatesTo").otherwise("UsedBy")
    both = F.array(F.struct("src", F.col("target").alias("dst"), there.alias("edge_type")), F.struct(F.col("target").alias("src"), F.col("src").alias("dst"), back.alias("edge_type")))
    return refs.where("src <> target").select(F.explode(both).alias("e")).select("e.*").distinct()


def exact_edges(pairs: DataFrame, nodes: DataFrame, kind: str, swap: bool = False) -> DataFrame:
    """Edges of one kind from (src, target) whose target is a node, turned round with ``swap``; never to itself."""
    known = pairs.join(nodes.select(F.col("anchor").alias("target")).distinct(), "target", "left_semi").where("src <> target")
    a, b = ("target", "src") if swap else ("src", "target")
    return known.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(kind).alias("edge_type")).distinct()


def supersedes(notes: DataFrame) -> DataFrame:
    """Supersedes edges of (src, target, direction): by means that the target is the newer one."""
    new, old = F.when(F.col("direction") == "by", F.col("target")).otherwise(F.col("src")), F.when(F.col("direction") == "by", F.col("src")).otherwise(F.col("target"))
    return notes.select(new.alias("src"), old.alias("dst"), F.lit("Supersedes").alias("edge_type")).where("src <> dst").distinct()


def include_edges(includes: DataFrame, files: DataFrame) -> DataFrame:
    """Requires edges of (src, path): to the file (anchor, path) whose stem is the included one's, if only one has it."""
    stem = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
    one = files.groupBy(stem.alias("stem")).agg(F.min("anchor").alias("dst"), F.countDistinct("anchor").alias("k")).where("k = 1")
    return includes.select("src", stem.alias("stem")).join(one, "stem").where("src <> dst").select("src", "dst", F.lit("Requires").alias("edge_type")).distinct()


def implements(claims: DataFrame, names: DataFrame) -> DataFrame:
    """(src, dst) of claims (src, target) of the form Trait::method: the method of that full name, else the trait,
    else the bare method; each only if one anchor has the name (name, anchor)."""
    one = names.groupBy("name").agg(F.min("anchor").alias("to"), F.countDistinct("anchor").alias("k")).where("k = 1").drop("k")
    tried = claims.select("src", F.posexplode(F.array("target", F.element_at(F.split("target", "::"), 1), F.element_at(F.split("target", "::"), -1))).alias("tier", "name"))
    return tried.join(one, "name").where("src <> to").groupBy("src").agg(F.min_by("to", "tier").alias("dst")).select("src", "dst")


def heading_containment(headings: DataFrame) -> DataFrame:
    """Contains edges of (file, anchor, level, line): from a file's representative, its shallowest and then first
    heading, to all others."""
    first = F.first("anchor").over(W.partitionBy("file").orderBy("level", "line", "anchor"))
    return headings.select(first.alias("src"), F.col("anchor").alias("dst"), F.lit("Contains").alias("edge_type")).where("src <> dst").distinct()


def bridge(hits: DataFrame, edges: DataFrame, code: DataFrame) -> DataFrame:
    """(anchor, score): code reached from prose hits (anchor, score) over RelatesTo or Documents, either way, with the
    best score of the hits that lead there."""
    e = edges.where(F.col("edge_type").isin("RelatesTo", "Documents"))
    both = e.select(F.col("src").alias("at"), F.col("dst").alias("to")).unionByName(e.select(F.col("dst").alias("at"), F.col("src").alias("to")))
    met = hits.withColumnRenamed("anchor", "at").join(both, "at").select(F.col("to").alias("anchor"), "score")
    return met.join(code.select("anchor"), "anchor", "left_semi").groupBy("anchor").agg(F.max("score").alias("score"))


def expand(words: DataFrame, synonyms: DataFrame, vocabulary: DataFrame, most: int = 8) -> DataFrame:
    """(word, synonym): for each query word (word) its synonyms (a, b; either way) that the corpus (token) has, the
    first ``most`` in order of the alphabet."""
    both = synonyms.select(F.col("a").alias("word"), F.col("b").alias("synonym")).unionByName(synonyms.select(F.col("b").alias("word"), F.col("a").alias("synonym")))
    met = words.select("word").distinct().join(both.distinct(), "word").where("word <> synonym")
    known = met.join(vocabulary.select(F.col("token").alias("synonym")).distinct(), "synonym", "left_semi")
    return known.withColumn("r", F.row_number().over(W.partitionBy("word").orderBy("synonym"))).where(F.col("r") <= most).select("word", "synonym")


def symbol_matches(names: DataFrame, symbol: str) -> DataFrame:
    """(anchor, tier): anchors whose fragment or leaf is the symbol in any case (0); only if there is none, those
    that go on from it with an underscore (1)."""
    a, want = F.col("anchor"), symbol.lower()
    tier = F.when((F.lower(forms.fragment(a)) == want) | (F.lower(forms.leaf(a)) == want), 0).when(F.lower(forms.leaf(a)).startswith(want + "_"), 1)
    met = names.select("anchor", tier.alias("tier")).where("tier is not null")
    least = met.agg(F.min("tier").alias("least"))
    return met.crossJoin(least).where("tier = least").select("anchor", "tier")


def drift_weight(events: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(anchor, weight, bucket): the sum of what drifts (anchor, severity) count, at most 1, and clean, minor or major."""
    w = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("severity")), F.lit(0.0))
    by = events.groupBy("anchor").agg(F.least(F.lit(1.0), F.round(F.sum(w), 6)).alias("weight"))
    return by.withColumn("bucket", F.when(F.col("weight") >= 0.5, "major").when(F.col("weight") > 0, "minor").otherwise("clean"))


def licences(packages: DataFrame, allowed: list[str]) -> DataFrame:
    """(licence, packages, verdict) of (name, licence): allowed, denied, or unknown where none is given."""
    kind = F.coalesce(F.when(F.trim("licence") != "", F.trim("licence")), F.lit("unknown"))
    verdict = F.when(F.col("kind") == "unknown", "unknown").when(F.col("kind").isin(allowed), "allowed").otherwise("denied")
    return packages.withColumn("kind", kind).groupBy(F.col("kind").alias("licence"), verdict.alias("verdict")).agg(F.countDistinct("name").alias("packages"))


def lines_between(lines: DataFrame, first: int, last: int, most_bytes: int) -> DataFrame:
    """Lines (doc_id, line, text) of a range, each text's as long as they stay within so many bytes, line ends counted."""
    inside = lines.where(F.col("line").between(first, last))
    running = F.sum(F.octet_length("text") + 1).over(W.partitionBy("doc_id").orderBy("line"))
    return inside.withColumn("bytes", running).where(F.col("bytes") <= most_bytes)

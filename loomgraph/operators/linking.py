"""Linking: names to anchors with locality tiers, mentions, co-change, deduplication, table updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.plans.io import written
from loomgraph.plans.tables import TASK_ROWS


def name_index(anchors: DataFrame) -> DataFrame:
    """(name, anchor): an anchor's fragment after # and the last part of it after :: or a dot."""
    frag = F.element_at(F.split("anchor", "#"), -1)
    return anchors.select("anchor", F.explode(F.array_distinct(F.array(frag, F.element_at(F.split(frag, r"::|\."), -1)))).alias("name")).where("name <> ''").select("name", "anchor").distinct()


def resolve_local(calls: DataFrame, names: DataFrame) -> DataFrame:
    """(caller, name, anchor) of calls (caller, file, module, name): the only candidate (name, anchor, file,
    module) in the same file, else in the same module, else anywhere; more than one at the first tier that
    has any is ambiguous and gives no row; a caller never links to itself.

    No call meets its candidates: they are counted by tier, less the caller's own, with the least and the greatest
    anchor, one of which is the only other one if one is left. A tier counts only if those before it have none, so
    that its group holds no candidate of an earlier one.
    """
    known = names.where("anchor is not null").select("name", "anchor", "file", "module")
    rows = calls.where("caller is not null").select("caller", "name", "file", "module")
    for t, key in enumerate((["name", "file"], ["name", "module"], ["name"])):
        each = known.groupBy(*key, "anchor").agg(F.count(F.lit(1)).alias("k"))
        group = each.groupBy(*key).agg(F.sum("k").alias("all"), F.min("anchor").alias("lo"), F.max("anchor").alias("hi"))
        own = each.select(*key, F.col("anchor").alias("caller"), F.col("k").alias("own"))
        met = rows.join(group, key, "left").join(own, [*key, "caller"], "left")
        n = F.coalesce("all", F.lit(0)) - F.coalesce("own", F.lit(0))
        other = F.when(F.col("lo") == F.col("caller"), F.col("hi")).otherwise(F.col("lo"))
        rows = met.withColumn(f"n{t}", n).withColumn(f"a{t}", F.when(n == 1, other)).drop("all", "own", "lo", "hi")
    by = rows.groupBy("caller", "name").agg(*(F.sum(f"n{t}").alias(f"n{t}") for t in range(3)), *(F.min(f"a{t}").alias(f"a{t}") for t in range(3)))
    pick = F.when(F.col("n0") > 0, F.when(F.col("n0") == 1, F.col("a0"))).when(F.col("n1") > 0, F.when(F.col("n1") == 1, F.col("a1"))).when(F.col("n2") == 1, F.col("a2"))
    return by.select("caller", "name", pick.alias("anchor")).where("anchor is not null")


def link_tests(edges: DataFrame, is_test: Column) -> DataFrame:
    """``edges`` and a Tests edge beside every Calls edge of a test symbol (``is_test`` looks at src)."""
    tests = edges.where((F.col("edge_type") == "Calls") & is_test).withColumn("edge_type", F.lit("Tests"))
    return edges.unionByName(tests)


def drop_stats(calls: DataFrame, names: DataFrame) -> DataFrame:
    """(status, n) of calls (caller, name): resolved, ambiguous or unresolved."""
    n = names.groupBy("name").agg(F.countDistinct("anchor").alias("k"))
    status = F.when(F.col("k").isNull(), "unresolved").when(F.col("k") == 1, "resolved").otherwise("ambiguous")
    return calls.join(n, "name", "left").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def mentions(tokens: DataFrame, names: DataFrame, least: int = 4) -> DataFrame:
    """(src, dst): a text (src, token) mentions what a name of at least ``least`` signs stands for, if only one
    anchor has the name. The index is made unique first, so it joins once a name."""
    one = names.where(F.length("name") >= least).groupBy("name").agg(F.min("anchor").alias("dst"), F.countDistinct("anchor").alias("k")).where("k = 1")
    return tokens.select("src", F.col("token").alias("name")).distinct().join(one.select("name", "dst"), "name").where("src <> dst").select("src", "dst").distinct()


def cochange(commits: DataFrame, support: int = 3, low: int = 2, high: int = 20) -> DataFrame:
    """(a, b, together): files of at least ``support`` common commits (commit_id, file) that change ``low`` to
    ``high`` files. The size gate is before the self-join: at most high**2 / 2 pairs a commit. Commits are dealt to
    as many tasks as the counted rows need, and are made distinct there."""
    one = commits.select("commit_id", "file").where("commit_id is not null and file is not null")
    n = max(commits.sparkSession.sparkContext.defaultParallelism, -(-one.count() // TASK_ROWS))
    sized = one.repartition(n, "commit_id").groupBy("commit_id").agg(F.array_sort(F.collect_set("file")).alias("files")).where(F.size("files").between(low, high))
    a = sized.select("files", F.posexplode("files").alias("i", "a"))
    pairs = a.select("a", F.explode(F.slice("files", F.col("i") + 2, high)).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("together")).where(F.col("together") >= support)


def last_wins(base: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Upsert: for each key the row with the greatest ``order``, rows of ``new`` before equal ones of ``base``."""
    both = base.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.col(order).desc(), F.col("_side").desc()))
    return both.withColumn("_r", rank).where("_r = 1").drop("_r", "_side")


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without those of ``gone`` (anchor): no edge is left dangling."""
    e = edges.join(gone.select(F.col("anchor").alias("src")), "src", "left_anti").join(gone.select(F.col("anchor").alias("dst")), "dst", "left_anti")
    return nodes.join(gone, "anchor", "left_anti"), e.select(edges.columns)


def merge_proposal(base: DataFrame, working: DataFrame, fresh: DataFrame) -> DataFrame:
    """(tag, action) of generated blocks (tag, content): changed -> update, gone -> delete, new -> insert; either
    of the first two is a conflict if working (tag, region) has a block of another region with the tag."""
    durable = working.where("region <> 'generated'").select("tag").distinct().withColumn("held", F.lit(True))
    both = base.select("tag", F.col("content").alias("old")).join(fresh.select("tag", F.col("content").alias("new")), "tag", "full").join(durable, "tag", "left")
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), F.when(F.col("held"), "conflict").otherwise("delete")).when(F.col("old") != F.col("new"), F.when(F.col("held"), "conflict").otherwise("update"))
    return both.select("tag", action.alias("action")).where("action is not null")


def publish(df: DataFrame, label: str) -> DataFrame:
    """A new immutable version of a table in the shared folder; its _SUCCESS file is the commit."""
    return written(df, label)

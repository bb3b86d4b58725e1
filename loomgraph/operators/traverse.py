"""Graph traversals over (src, dst, edge_type): breadth first, first visit, bounded or to the fixpoint.

A walk writes the directed edges once (filtered to the wanted types) and then each level: the frontier meets
the edges first, and only what it meets is grouped, so the edges are never shuffled. A frontier of at most
``SMALL`` rows, which are counted, is broadcast; a larger one is joined by its key. Lineage stays one level
long whatever the depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.io import written
from loomgraph.plans.tables import IMPACT_TYPES, STRUCTURE_TYPES


def directed(edges: DataFrame, types: list[str] | None = None, reverse: bool = False) -> DataFrame:
    """(at, to, edge_type) of the wanted types, against the arrows if ``reverse``."""
    e = edges if types is None else edges.where(F.col("edge_type").isin(types))
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return e.select(F.col(a).alias("at"), F.col(b).alias("to"), "edge_type")


#: Rows of a written frontier that may be broadcast.
SMALL = 100_000


def few(df: DataFrame) -> tuple[DataFrame, bool]:
    """A written table, marked for broadcast if it is small, and whether it has any rows."""
    n = df.count()
    return (F.broadcast(df) if n <= SMALL else df), n > 0


def walk(edges: DataFrame, start: DataFrame, depth: int, *, skip_structure: bool = False) -> DataFrame:
    """(anchor, depth, parent, via): nodes reached from ``start`` (anchor) in at most ``depth`` steps, starts
    at depth 0. ``edges``: (at, to, edge_type). A node's parent is the smallest at its least depth; via are
    the sorted edge types from it. ``skip_structure``: pairs joined by containment only are not walked."""
    edges = written(edges.select("at", "to", "edge_type"), "walk-edges")
    seen = written(start.select("anchor", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), F.array().cast("array<string>").alias("via")).distinct(), "walk")
    front, any_left = few(seen)
    for d in range(1, depth + 1):
        if not any_left:
            break
        met = edges.join(front.select(F.col("anchor").alias("at")), "at")
        pairs = met.groupBy("at", "to").agg(F.array_sort(F.collect_set("edge_type")).alias("via"))
        if skip_structure:
            pairs = pairs.where(F.size(F.array_except("via", F.array(*map(F.lit, STRUCTURE_TYPES)))) > 0)
        first = pairs.groupBy(F.col("to").alias("anchor")).agg(F.min_by(F.struct(F.col("at").alias("parent"), "via"), "at").alias("p"))
        new = first.join(seen.select("anchor"), "anchor", "left_anti").select("anchor", F.lit(d).alias("depth"), "p.parent", "p.via")
        level = written(new, "walk")
        front, any_left = few(level)
        seen = seen.unionByName(level)
    return seen


def from_anchor(edges: DataFrame, start: DataFrame, depth: int = 3, types: list[str] | None = None) -> DataFrame:
    """What a node reaches along the arrows."""
    return walk(directed(edges, types), start, depth)


def backlinks(edges: DataFrame, start: DataFrame, depth: int = 3, types: list[str] | None = None) -> DataFrame:
    """What reaches a node; without a type filter, pairs joined by containment only are skipped."""
    return walk(directed(edges, types, reverse=True), start, depth, skip_structure=types is None)


def impact(edges: DataFrame, start: DataFrame, depth: int = 3, types: list[str] | None = None) -> DataFrame:
    """What a node depends on for a change: impact types along the arrows; a filter outside them gives no steps."""
    wanted = IMPACT_TYPES if types is None else [t for t in types if t in IMPACT_TYPES]
    return walk(directed(edges, wanted), start, depth)


def dependents(edges: DataFrame, start: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(anchor): all that depends on ``start`` directly or through others, the start excluded, at any depth."""
    e = written(directed(edges, types or IMPACT_TYPES, reverse=True).select("at", "to").distinct(), "dependents-edges")
    seen = written(start.select("anchor").distinct(), "dependents")
    front, found = few(seen)[0], None
    while True:
        step = e.join(front.select(F.col("anchor").alias("at")), "at").select(F.col("to").alias("anchor")).distinct()
        level = written(step.join(seen, "anchor", "left_anti"), "dependents")
        front, any_left = few(level)
        if not any_left:
            break
        seen = seen.unionByName(level)
        found = level if found is None else found.unionByName(level)
    return found if found is not None else level


def affected_tests(edges: DataFrame, touched: DataFrame) -> DataFrame:
    """(anchor): sources of Tests edges into the touched nodes (anchor), themselves excluded."""
    into = edges.where((F.col("edge_type") == "Tests") & (F.col("src") != F.col("dst")))
    return into.join(touched.select(F.col("anchor").alias("dst")), "dst", "left_semi").select(F.col("src").alias("anchor")).distinct()


def hub_pruned(edges: DataFrame, start: DataFrame, depth: int, hub: Column, degree: int = 32, fan: int = 16) -> DataFrame:
    """Nodes reached along the arrows, hubs (``hub`` of anchor and more than ``degree`` out-edges) not walked
    through beyond the start, and up to ``fan`` callers of each node folded in, smallest anchors first.
    -> (anchor, depth, role)."""
    edges = written(edges, "hub-edges")
    out = directed(edges).select("at", "to")
    seen = written(start.select("anchor", F.lit(0).alias("depth")).distinct(), "hub")
    front, any_left = few(seen)
    for d in range(1, depth + 1):
        if not any_left:
            break
        source = front.select("anchor")
        if d > 1:
            # Degrees are counted of the frontier's hubs only.
            named, _ = few(written(source.where(hub), "hub-named"))
            heavy = edges.join(named.select(F.col("anchor").alias("src")), "src").groupBy(F.col("src").alias("anchor")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > degree)
            source, _ = few(written(source.join(heavy.select("anchor"), "anchor", "left_anti"), "hub-source"))
        step = out.join(source.select(F.col("anchor").alias("at")), "at").select(F.col("to").alias("anchor")).distinct()
        level = written(step.join(seen.select("anchor"), "anchor", "left_anti").withColumn("depth", F.lit(d)), "hub")
        front, any_left = few(level)
        seen = seen.unionByName(level)
    back = directed(edges, ["Calls", "Uses"], reverse=True).select("at", "to").distinct()
    near = back.join(start.select(F.col("anchor").alias("at")), "at").groupBy("at").agg(F.slice(F.array_sort(F.collect_set("to")), 1, fan).alias("first"))
    callers = near.select(F.explode("first").alias("anchor")).distinct().join(seen.select("anchor"), "anchor", "left_anti")
    return seen.select("anchor", "depth", F.lit("reached").alias("role")).unionByName(callers.select("anchor", F.lit(1).alias("depth"), F.lit("caller").alias("role")))


def slice_of(edges: DataFrame, start: DataFrame, depth: int, cap: int, types: list[str] | None = None, both_ways: bool = False) -> DataFrame:
    """Edges among the first ``cap`` nodes (by depth, then anchor) around ``start``."""
    e = directed(edges, types)
    if both_ways:
        e = e.unionByName(directed(edges, types, reverse=True))
    kept = walk(e, start, depth).orderBy("depth", "anchor").limit(cap).select("anchor")
    inside = edges if types is None else edges.where(F.col("edge_type").isin(types))
    return inside.join(kept.select(F.col("anchor").alias("src")), "src", "left_semi").join(kept.select(F.col("anchor").alias("dst")), "dst", "left_semi").select("src", "dst", "edge_type")


def gate(changed: DataFrame, mandate: DataFrame, blast: DataFrame, footprint: DataFrame) -> DataFrame:
    """(verdict, outside, beyond): 0 all within, 1 the blast radius passes the footprint, 2 files outside the mandate."""
    outside = changed.join(mandate, "anchor", "left_anti").agg(F.count(F.lit(1)).alias("outside"))
    beyond = blast.join(footprint, "anchor", "left_anti").agg(F.count(F.lit(1)).alias("beyond"))
    both = outside.crossJoin(beyond)  # one row each
    return both.select(F.when(F.col("outside") > 0, 2).when(F.col("beyond") > 0, 1).otherwise(0).alias("verdict"), "outside", "beyond")

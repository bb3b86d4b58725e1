"""Iterative graph analytics: PageRank, communities, cycles. Each iteration starts from written tables."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.plans.io import written


def pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame | None = None, *, damping: float = 0.85, iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(anchor, rank) by power iteration, personalised by ``seeds`` (anchor, weight); uniform without any.

    Loops are dropped, parallel edges kept, the mass of nodes without out-edges goes to the seeds. Stops
    when the ranks' L1 change is at most ``tolerance``. ``edges`` and ``nodes`` are read once, all else begins at what
    is written of them. A step is one join and one map-side combined sum; the only numbers that come to the driver
    are the dangling mass and the change, from one look at the step.
    """
    out = edges.where("src <> dst").repartition("src").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m"))
    share = F.col("m") / F.sum("m").over(W.partitionBy("src"))
    links = written(out.select("src", "dst", share.alias("share")), "links")
    walks = links.select(F.col("src").alias("anchor")).distinct().withColumn("walks", F.lit(True))
    nodes = written(nodes.select("anchor").distinct().join(walks, "anchor", "left"), "rank-nodes")
    if seeds is not None:
        total = seeds.join(nodes, "anchor", "left_semi").agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
        seeds = None if total <= 0 else seeds.groupBy("anchor").agg((F.sum("weight") / total).alias("p"))
    n = nodes.count()
    base = nodes.withColumn("p", F.lit(1.0 / max(n, 1))) if seeds is None else written(nodes.join(seeds, "anchor", "left").fillna(0.0, ["p"]), "rank-base")
    rank = base.select("anchor", "walks", "p", F.col("p").alias("rank"))
    halting = F.coalesce(F.sum(F.when(F.col("walks").isNull(), F.col("rank"))), F.lit(0.0))
    dangling = rank.agg(halting).first()[0]
    for _ in range(iterations):
        sent = links.join(rank.select(F.col("anchor").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("anchor")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = F.lit(damping) * (F.coalesce("got", F.lit(0.0)) + F.lit(float(dangling)) * F.col("p")) + (1 - damping) * F.col("p")
        step = written(rank.withColumnRenamed("rank", "old").join(sent, "anchor", "left").select("anchor", "walks", "p", "old", new.alias("rank")), "rank")
        change, dangling = step.agg(F.coalesce(F.sum(F.abs(F.col("rank") - F.col("old"))), F.lit(0.0)), halting).first()
        rank = step.drop("old")
        if change <= tolerance:
            break
    return rank.select("anchor", "rank")


def _lines(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each node's line starts, its neighbours and their weights, of arrows a -> b; parallel ones are summed."""
    order = np.lexsort((b, a))
    a, b, w = a[order], b[order], w[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
    start = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(a[first], minlength=n), out=start[1:])
    return start, b[first], np.add.reduceat(w, first) if len(a) else w


def _louvain(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, gamma: float, margin: float, standard: bool = True) -> np.ndarray:
    """The community of each of the nodes 0 .. n-1: local moving and aggregation on one bounded graph of pairs; nodes in
    order, ties to the lowest community. Everything by node or pair is an array of plain numbers."""
    same = a == b
    loops = np.bincount(a[same], weights=w[same], minlength=n)
    start, to, weight = _lines(np.minimum(a, b)[~same], np.maximum(a, b)[~same], w[~same], n)
    near = np.repeat(np.arange(n, dtype=np.int32), np.diff(start))
    start, to, weight = _lines(np.r_[near, to], np.r_[to, near], np.r_[weight, weight], n)
    member = np.arange(n, dtype=np.int32)
    while True:
        n = len(start) - 1
        near = np.repeat(np.arange(n, dtype=np.int32), np.diff(start))
        degree = np.bincount(near, weights=weight, minlength=n) + 2 * loops
        m2 = float(degree.sum())
        # Arrays of the standard library give plain numbers, one at a time, faster than numpy's.
        com, k, tot = array("i", range(n)), array("d", degree.tobytes()), array("d", degree.tobytes())
        begin, others, heavy = array("q", start.tobytes()), array("i", to.astype(np.int32).tobytes()), array("d", weight.tobytes())
        moved_any, moved = False, m2 > 0
        while moved:
            moved = False
            for i in range(n):
                own = com[i]
                into: dict[int, float] = {own: 0.0}
                for x in range(begin[i], begin[i + 1]):
                    c = com[others[x]]
                    into[c] = into.get(c, 0.0) + heavy[x]
                tot[own] -= k[i]
                value = {c: x - gamma * tot[c] * k[i] / m2 for c, x in into.items()}
                best = own
                for c in sorted(value):
                    if value[c] > value[best] + margin:
                        best = c
                tot[best] += k[i]
                if best != own:
                    com[i], moved, moved_any = best, True, True
        if not moved_any:
            return member
        found, label = np.unique(np.frombuffer(com, np.int32), return_inverse=True)
        label, n = label.astype(np.int32), len(found)
        member = label[member]
        ca, cb = label[near], label[to]
        inner = ca == cb
        loops = np.bincount(label, weights=loops, minlength=n) + np.bincount(ca[inner], weights=weight[inner] / 2 if standard else weight[inner], minlength=n)
        start, to, weight = _lines(ca[~inner], cb[~inner], weight[~inner], n)


def louvain(pairs: DataFrame, *, gamma: float = 1.0, margin: float = 1e-12, standard: bool = True) -> DataFrame:
    """(anchor, community) of a bounded graph of pairs (a, b, w): the order of moves is part of the definition,
    so one task runs it, in some 100 bytes a pair and the names. Use ``label_propagation`` where a graph has no bound.
    Communities are numbered by their smallest member. ``standard=False`` counts a community's inner weight from both
    sides when it becomes a node, which weighs it twice in upper levels."""
    def run(table: pa.Table) -> pa.Table:
        names = pc.unique(pa.chunked_array([*table["a"].chunks, *table["b"].chunks], pa.string()))
        names = names.take(pc.sort_indices(names))
        a, b = (pc.index_in(table[x], value_set=names).to_numpy() for x in ("a", "b"))
        found = _louvain(a, b, table["w"].to_numpy(), len(names), gamma, margin, standard)
        _, first, label = np.unique(found, return_index=True, return_inverse=True)
        number = np.empty(len(first), np.int32)
        number[np.argsort(first)] = np.arange(len(first))
        return pa.table({"anchor": names, "community": number[label]})
    return pairs.select(F.lit(1).alias("g"), "a", "b", F.col("w").cast("double").alias("w")).groupBy("g").applyInArrow(run, "anchor string, community int")


def modularity(pairs: DataFrame, labels: DataFrame, gamma: float = 1.0) -> DataFrame:
    """(modularity) of labels (anchor, community) over pairs (a, b, w), as joins and sums of any size."""
    la = labels.select(F.col("anchor").alias("a"), F.col("community").alias("ca"))
    lb = labels.select(F.col("anchor").alias("b"), F.col("community").alias("cb"))
    e = pairs.join(la, "a").join(lb, "b")
    ends = e.select(F.explode(F.array("ca", "cb")).alias("c"), "w").groupBy("c").agg(F.sum("w").alias("d"))
    total = e.agg(F.sum("w").alias("m"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inside"))
    return ends.crossJoin(F.broadcast(total)).groupBy("m", "inside").agg(F.sum(F.pow(F.col("d") / (2 * F.col("m")), 2)).alias("s")).select((F.col("inside") / F.col("m") - gamma * F.col("s")).alias("modularity"))


def label_propagation(pairs: DataFrame, rounds: int = 10) -> DataFrame:
    """(anchor, community): each node takes the heaviest label around it, ties to the smallest; for any size."""
    both = written(pairs.select("a", "b", "w").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "pairs")
    labels = both.select(F.col("a").alias("anchor")).distinct().withColumn("community", F.col("anchor"))
    for _ in range(rounds):
        votes = both.join(labels.select(F.col("anchor").alias("b"), "community"), "b").groupBy("a", "community").agg(F.sum("w").alias("w"))
        best = votes.groupBy(F.col("a").alias("anchor")).agg(F.min_by("community", F.struct(-F.col("w"), F.col("community"))).alias("community"))
        labels = written(best, "labels")
    return labels


def degree_cap(nodes: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """(anchor, degree, dst, edge_type): the ``most`` nodes of the highest degree (in and out, parallel edges too, 0 for
    nodes without edges), ties by name, each with its edges to others of them and itself; one row without if it has none."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("anchor"), F.lit(1).alias("k"))
    degree = nodes.select("anchor", F.lit(0).alias("k")).unionByName(ends).groupBy("anchor").agg(F.sum("k").alias("degree"))
    kept = written(degree.orderBy(F.col("degree").desc(), "anchor").limit(most), "kept-nodes")
    # ``most`` rows are broadcast; semi joins go down into the tables of the edges, so few are shuffled again.
    inner = edges.select("src", "dst", "edge_type")
    for end in ("src", "dst"):
        inner = inner.join(F.broadcast(kept.select(F.col("anchor").alias(end))), end, "left_semi")
    return kept.join(inner.distinct().withColumnRenamed("src", "anchor"), "anchor", "left").select("anchor", "degree", "dst", "edge_type")


def _trimmed(left: DataFrame) -> tuple[DataFrame, int]:
    """Edges (src, dst) less all that begin or end where nothing comes in or goes out, until none is left to cut."""
    size = left.count()
    while size:
        comes, goes = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
        left = written(left.join(comes, "src", "left_semi").join(goes, "dst", "left_semi").select("src", "dst"), "cycle")
        now = left.count()
        if now == size:
            break
        size = now
    return left, size


def cycles(edges: DataFrame, kind: str = "Requires") -> DataFrame:
    """(anchor): nodes on a cycle of one edge type. There is no bound: every loop ends when nothing changes.

    Edges are cut off at dead ends; what is left has cycles and paths between them. Every node takes the
    greatest name that reaches it; the nodes that reach their own namesake back, through nodes of that
    name, are its strongly connected component, hence on cycles. They go, and the rest is looked at again.
    """
    left = written(edges.where(F.col("edge_type") == kind).select("src", "dst").distinct(), "cycle")
    found = written(left.where("src = dst").select(F.col("src").alias("anchor")), "cycle-found")
    left, size = _trimmed(left)
    while size:
        names = written(left.select(F.explode(F.array("src", "dst")).alias("v")).distinct().withColumn("name", F.col("v")), "cycle-names")
        seen = None
        while True:
            come = left.join(names.withColumnRenamed("v", "src"), "src").select(F.col("dst").alias("v"), "name")
            names = written(names.unionByName(come).groupBy("v").agg(F.max("name").alias("name")), "cycle-names")
            state = names.agg(F.sum(F.xxhash64("v", "name").cast("decimal(38,0)"))).first()[0]
            if state == seen:
                break
            seen = state
        alike = left.join(names.select(F.col("v").alias("src"), F.col("name").alias("a")), "src").join(names.select(F.col("v").alias("dst"), F.col("name").alias("b")), "dst").where("a = b").select("src", "dst")
        alike = written(alike, "cycle-alike")
        back = written(names.where("v = name").select("v"), "cycle-back")
        n = back.count()
        while True:
            more = alike.join(back.select(F.col("v").alias("dst")), "dst", "left_semi").select(F.col("src").alias("v"))
            back = written(back.unionByName(more).distinct(), "cycle-back")
            now = back.count()
            if now == n:
                break
            n = now
        # A component of one node is no cycle, unless it has a loop, which was found above.
        inner = alike.join(back.select(F.col("v").alias("src")), "src", "left_semi").join(back.select(F.col("v").alias("dst")), "dst", "left_semi").where("src <> dst")
        found = written(found.unionByName(inner.select(F.explode(F.array("src", "dst")).alias("anchor"))).distinct(), "cycle-found")
        rest = left.join(back.select(F.col("v").alias("src")), "src", "left_anti").join(back.select(F.col("v").alias("dst")), "dst", "left_anti")
        left, size = _trimmed(written(rest, "cycle"))
    return found


def cycle_paths(edges: DataFrame, kind: str = "Requires", depth: int = 8) -> DataFrame:
    """(path): every simple cycle of at most ``depth`` edges, begun at its smallest node. Only nodes on cycles are walked."""
    on = cycles(edges, kind)
    e = edges.where(F.col("edge_type") == kind).select("src", "dst").distinct().join(on.withColumnRenamed("anchor", "src"), "src", "left_semi")
    paths = e.where("src <= dst").select(F.array("src").alias("path"), F.col("dst").alias("at"))
    found = None
    for _ in range(depth):
        closed = paths.where(F.col("at") == F.col("path")[0]).select("path")
        found = closed if found is None else found.unionByName(closed)
        step = paths.where((F.col("at") > F.col("path")[0]) & ~F.array_contains("path", F.col("at")))
        paths = step.join(e.withColumnRenamed("src", "at"), "at").select(F.array_append("path", F.col("at")).alias("path"), F.col("dst").alias("at"))
    return found

"""Deterministic range shards of a long key: the same rows give the same shards on any cluster."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Buckets counted at a time; what comes to the driver is two numbers a bucket.
BUCKETS = 1 << 14
LOWEST = -(1 << 63)


def shard_of(key: Column, cuts: np.ndarray) -> Column:
    """The shard of a key: how many cuts are at most the key. Only the key goes through Arrow."""
    at = np.asarray(cuts, np.int64)

    @pandas_udf("int")
    def find(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, k.to_numpy(np.int64), side="right").astype(np.int32))
    return find(key)


def range_cuts(rows: DataFrame, target: int) -> np.ndarray:
    """Where shards begin, ascending, for ``rows`` (key long, weight long).

    Keys are counted in equal buckets; buckets heavier than ``target`` are divided and counted again
    until they are light or one key wide. Then neighbours are joined up to ``target``. A shard is
    heavier only by one bucket or one key. The cuts number at most about twice the weight over target.
    """
    lo, hi = rows.agg(F.min("key"), F.max("key")).first()
    if lo is None or lo == hi:
        return np.zeros(0, np.int64)
    light: list[tuple[int, int]] = []
    spans = [(lo, hi + 1)]
    for _ in range(8):
        edges: list[int] = []
        share = max(16, BUCKETS // len(spans))
        for a, b in spans:
            step = max(1, -(-(b - a) // share))
            edges += range(a, b, step)
            edges.append(b)
        edge = np.unique(np.array([min(e, (1 << 63) - 1) for e in edges], np.int64))
        inside = rows.where(" or ".join(f"key between {a} and {b - 1}" for a, b in spans)) if len(spans) <= 64 else rows
        found = inside.groupBy(shard_of(F.col("key"), edge).alias("b")).agg(F.sum("weight").alias("w")).collect()
        starts = {a for a, _ in spans}
        ends = np.array([b for _, b in spans])
        spans, weights = [], {int(r.b): int(r.w) for r in found}
        for i in range(1, len(edge) + 1):
            a = int(edge[i - 1])
            b = int(edge[i]) if i < len(edge) else hi + 1
            w = weights.get(i, 0)
            if not w or (a in ends and a not in starts):
                continue
            if w > target and b - a > 1:
                spans.append((a, b))
            else:
                light.append((a, w))
        if not spans:
            break
    light += [(a, target) for a, _ in spans]
    light.sort()
    cuts, held = [], 0
    for a, w in light:
        if held and held + w > target:
            cuts.append(a)
            held = 0
        held += w
    return np.array(cuts, np.int64)

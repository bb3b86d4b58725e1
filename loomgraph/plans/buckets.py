"""Tables stored by buckets of a key in the shared folder, in versions: what a change touches is written anew,
what a reader asks for is opened by path, and a commit is one small file.

A table's rows are in folders ``<table>/version=<v>/bucket=<b>``, sorted by the table's order. Which folders
are live is said by the manifest of a commit, one row each; it is written after the data, so a writer that
dies leaves folders that no manifest names (``vacuum`` deletes them), and a reader sees whole commits of all
tables together. One writer at a time: two that commit the same number are noticed, and reading is refused.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    """``key``: rows of a key share a bucket. ``spread``: a bucket's rows are dealt to so many tasks by the last
    column of ``order``, so one frequent key is no single task's. Rows with a null key are not stored."""

    schema: str
    key: str
    order: tuple[str, ...]
    buckets: int = 64
    spread: int = 8


@dataclass
class Commit:
    """What is live: of each table the versions of each bucket, oldest first; and what the writer noted."""

    number: int = 0
    live: dict[str, dict[int, list[str]]] = field(default_factory=dict)
    notes: dict = field(default_factory=dict)


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(buckets)).cast("int")


def bucket_of_value(value: object, buckets: int) -> int:
    return zlib.crc32(str(value).encode()) % buckets


class BucketStore:
    def __init__(self, spark: SparkSession, root: str, layouts: dict[str, Layout]):
        self.spark, self.root, self.layouts = spark, root.rstrip("/"), layouts
        self.now = self._latest()

    def _latest(self) -> Commit:
        try:
            manifests = self.spark.read.parquet(f"{self.root}/manifest")
            last = manifests.agg(F.max("number")).first()[0]
        except AnalysisException:  # nothing has been committed yet
            return Commit()
        if last is None:
            return Commit()
        out, writers = Commit(int(last)), set()
        for r in manifests.where(F.col("number") == last).orderBy("version").collect():
            writers.add(r.writer)
            if r.table is None:
                out.notes = json.loads(r.notes)
            else:
                out.live.setdefault(r.table, {}).setdefault(r.bucket, []).append(r.version)
        if len(writers) > 1:
            raise RuntimeError(f"commit {last} of {self.root} has two writers")
        return out

    def write(self, table: str, rows: DataFrame) -> tuple[str, list[int]]:
        """Store rows as a new version, not yet live: (version, buckets it has). One shuffle; ``rows`` is read once."""
        at = self.layouts[table]
        version = f"{self.now.number + 1:08d}-{uuid.uuid4().hex[:8]}"
        salt = F.pmod(F.xxhash64(at.order[-1]), F.lit(at.spread))
        placed = rows.where(F.col(at.key).isNotNull()).withColumn("bucket", bucket_of(F.col(at.key), at.buckets)).repartition("bucket", salt)
        path = f"{self.root}/{table}/version={version}"
        placed.sortWithinPartitions("bucket", *at.order).write.option("compression", "zstd").partitionBy("bucket").parquet(path)
        return version, self._written(path)

    def _written(self, path: str) -> list[int]:
        try:
            return sorted(r[0] for r in self.spark.read.parquet(path).select("bucket").distinct().collect())
        except AnalysisException:  # no rows, so no folders
            return []

    def planned(self, added: dict[str, tuple[str, list[int]]], replaced: dict[str, Iterable[int] | None] | None = None, notes: dict | None = None) -> Commit:
        """What a commit of written versions would make live; ``read`` takes it. ``replaced``: of a table the buckets
        (None: all) whose earlier versions go."""
        nxt = Commit(self.now.number + 1, {t: {b: list(v) for b, v in bs.items()} for t, bs in self.now.live.items()}, self.now.notes if notes is None else notes)
        for table, which in (replaced or {}).items():
            held = nxt.live.setdefault(table, {})
            for b in list(held) if which is None else which:
                held.pop(b, None)
        for table, (version, buckets) in added.items():
            for b in buckets:
                nxt.live.setdefault(table, {}).setdefault(b, []).append(version)
        return nxt

    def commit(self, added: dict[str, tuple[str, list[int]]], replaced: dict[str, Iterable[int] | None] | None = None, notes: dict | None = None) -> None:
        """Make written versions live, all together."""
        nxt = self.planned(added, replaced, notes)
        writer = uuid.uuid4().hex
        rows = [(t, b, v, None, writer) for t, bs in nxt.live.items() for b, vs in bs.items() for v in vs] + [(None, None, None, json.dumps(nxt.notes), writer)]
        frame = self.spark.createDataFrame(rows, "table string, bucket int, version string, notes string, writer string")
        frame.coalesce(1).write.parquet(f"{self.root}/manifest/number={nxt.number}")
        self.now = nxt

    def buckets(self, table: str, keys: DataFrame | Iterable[object]) -> list[int]:
        """The buckets of keys: of values, or of a DataFrame's first column (one number a bucket comes to the driver)."""
        n = self.layouts[table].buckets
        if isinstance(keys, DataFrame):
            return sorted(r[0] for r in keys.select(bucket_of(F.col(keys.columns[0]), n).alias("b")).where("b is not null").distinct().collect())
        return sorted({bucket_of_value(k, n) for k in keys})

    def read(self, table: str, buckets: Iterable[int] | None = None, after: str = "", of: Commit | None = None) -> DataFrame:
        """Live rows, with ``version`` and ``bucket``, of the given buckets (None: all) and of versions beyond ``after``;
        of the latest commit, or of one that is ``planned``."""
        live, at = (of or self.now).live.get(table, {}), self.layouts[table]
        wanted = sorted(live) if buckets is None else [b for b in buckets if b in live]
        paths = [f"{self.root}/{table}/version={v}/bucket={b}" for b in wanted for v in live[b] if v > after]
        schema = f"{at.schema}, version string, bucket int"
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*paths)

    def versions(self, table: str) -> list[str]:
        return sorted({v for vs in self.now.live.get(table, {}).values() for v in vs})

    def vacuum(self) -> int:
        """Delete folders and manifests that are not live; no one may read an earlier commit then. How many went."""
        jvm, gone = self.spark._jvm, 0
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())

        def inside(path):
            return [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
        for table in self.layouts:
            live = self.now.live.get(table, {})
            for version in inside(jvm.org.apache.hadoop.fs.Path(root, table)):
                name = version.getName().removeprefix("version=")
                for b in inside(version):
                    if b.getName().startswith("bucket=") and name not in live.get(int(b.getName()[7:]), []):
                        gone += fs.delete(b, True)
        for m in inside(jvm.org.apache.hadoop.fs.Path(root, "manifest")):
            if m.getName().startswith("number=") and m.getName() != f"number={self.now.number}":
                gone += fs.delete(m, True)
        return gone

"""Links kept up under changes of files: what a change of files does to names decides which links are made anew.

A reference links to what its name stands for if exactly one anchor has the name. Definitions, references and
links are stored by buckets of the name, and by file what each file said. An update compares what the changed files
said and say; of the names with changed definitions it keeps those that now stand for something else, and only the
links of these names, and of changed references, are retracted and made. Buckets no such name is in are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.traverse import few
from loomgraph.plans.buckets import BucketStore, Layout, bucket_of
from loomgraph.plans.io import written

c = F.col


def unique_targets(defs: DataFrame) -> DataFrame:
    """(name, dst) of names that exactly one anchor has, from definitions (name, anchor)."""
    by = defs.groupBy("name").agg(F.min("anchor").alias("dst"), F.max("anchor").alias("other"))
    return by.where("dst = other").select("name", "dst")


def linked(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """(name, src, dst, file) of references (name, src, file) to targets (name, dst); none to oneself."""
    return refs.join(targets, "name").where("src <> dst").select("name", "src", "dst", "file").distinct()


@dataclass(frozen=True)
class Touched:
    """What an update did: names that stand for something else now, links taken away and made, rows and buckets
    written, and how many buckets of names there are."""

    names: int
    retracted: int
    added: int
    rows: int
    buckets: int
    of_buckets: int


class Links:
    """``defs`` (file, name, anchor) and ``refs`` (file, name, src) of files; rows with a null are left out."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.n = spark, buckets
        self.store = BucketStore(spark, root, {
            "defs": Layout("name string, anchor string, file string", "name", ("name", "file"), buckets),
            "refs": Layout("name string, src string, file string", "name", ("name", "file"), buckets),
            "links": Layout("name string, src string, dst string, file string", "name", ("name", "src"), buckets),
            "said": Layout("file string, kind string, name string, node string", "file", ("file", "name"), buckets),
        })

    def links(self) -> DataFrame:
        """(src, dst), each once."""
        return self.store.read("links").select("src", "dst").distinct()

    def _said(self, defs: DataFrame, refs: DataFrame) -> DataFrame:
        both = defs.select("file", F.lit("def").alias("kind"), "name", c("anchor").alias("node")).unionByName(refs.select("file", F.lit("ref").alias("kind"), "name", c("src").alias("node")))
        return both.dropna().distinct()

    def update(self, files: DataFrame, defs: DataFrame, refs: DataFrame) -> Touched:
        """Files (file) have changed, come or gone; ``defs`` and ``refs`` are all that they say now (rows of other
        files are ignored). One commit; the first update builds everything. Repeating an update changes nothing."""
        store = self.store
        files = written(files.select("file").dropna().distinct(), "files")
        files, _ = few(files)
        of_files = store.buckets("said", files)
        was = store.read("said", of_files)
        old = was.join(files, "file", "left_semi").select("file", "kind", "name", "node")
        new = written(self._said(defs, refs).join(files, "file", "left_semi"), "said")
        # A row that only one side has is a change; its name's bucket is written anew.
        sides = old.withColumn("at", F.lit(1)).unionByName(new.withColumn("at", F.lit(2)))
        changes = written(sides.groupBy("file", "kind", "name", "node").agg(F.sum("at").alias("at")).where("at <> 3"), "changes")
        names = {k: written(changes.where(c("kind") == k).select("name").distinct(), "names") for k in ("def", "ref")}
        touched = {"defs": store.buckets("defs", names["def"]), "refs": store.buckets("refs", names["ref"])}
        added, rows = {}, 0
        for table, kind, node in (("defs", "def", "anchor"), ("refs", "ref", "src")):
            kept = store.read(table, touched[table]).join(files, "file", "left_anti").select("name", node, "file")
            fresh = new.where((c("kind") == kind) & bucket_of(c("name"), self.n).isin(touched[table])).select("name", c("node").alias(node), "file")
            added[table] = store.write(table, kept.unionByName(fresh))
        nxt = store.planned(added, touched)
        at = touched["defs"]
        before = unique_targets(store.read("defs", at).join(names["def"], "name", "left_semi"))
        after = unique_targets(store.read("defs", at, of=nxt).join(names["def"], "name", "left_semi"))
        moved = before.withColumnRenamed("dst", "was").join(after, "name", "full").where(~c("was").eqNullSafe(c("dst")))
        moved = written(moved.select("name"), "moved")
        moved, _ = few(moved)
        concerned = moved.select("name").unionByName(names["ref"]).distinct()
        touched["links"] = store.buckets("links", concerned)
        here = touched["links"]
        held = store.read("links", here).select("name", "src", "dst", "file")
        left = held.join(files, "file", "left_anti").join(moved, "name", "left_anti")
        asked = store.read("refs", here, of=nxt).select("name", "src", "file")
        of_moved = asked.join(moved, "name", "left_semi")
        of_files = asked.join(files, "file", "left_semi").join(moved, "name", "left_anti")
        anew = of_moved.unionByName(of_files)
        targets = unique_targets(store.read("defs", here, of=nxt))
        made = written(linked(anew, targets), "links")
        added["links"] = store.write("links", left.unionByName(made))
        touched["said"] = store.buckets("said", files)
        added["said"] = store.write("said", was.join(files, "file", "left_anti").select("file", "kind", "name", "node").unionByName(new))
        gone = written(held.join(left, ["name", "src", "dst", "file"], "left_anti"), "retracted")
        both = gone.withColumn("k", F.lit(1)).unionByName(made.withColumn("k", F.lit(2))).groupBy("name", "src", "dst", "file").agg(F.sum("k").alias("k"))
        retracted, came = both.agg(F.count_if(c("k") == 1), F.count_if(c("k") == 2)).first()
        store.commit(added, touched)
        for table, (version, buckets) in added.items():
            rows += self._rows(table, version) if buckets else 0
        return Touched(moved.count(), retracted, came, rows, sum(len(v) for v in touched.values()), 4 * self.n)

    def _rows(self, table: str, version: str) -> int:
        return self.spark.read.parquet(f"{self.store.root}/{table}/version={version}").count()


def changed_files(stored: DataFrame, now: DataFrame) -> DataFrame:
    """(file, change) of files (file, hash) that are new, changed or gone since ``stored``."""
    both = stored.select("file", c("hash").alias("was"), F.lit(1).alias("a")).join(now.select("file", c("hash").alias("is"), F.lit(1).alias("b")), "file", "full")
    change: Column = F.when(c("a").isNull(), "new").when(c("b").isNull(), "gone").when(~c("was").eqNullSafe(c("is")), "changed")
    return both.select("file", change.alias("change")).where("change is not null")


def decision(changes: DataFrame, files: int, most: float = 0.3) -> DataFrame:
    """One row (decision, changed): fresh if nothing changed, rebuild if more than ``most`` of so many files did, else
    update."""
    n = changes.agg(F.count(F.lit(1)).alias("changed"))
    return n.select(F.when(c("changed") == 0, "fresh").when(c("changed") > most * files, "rebuild").otherwise("update").alias("decision"), "changed")

"""Shared pieces of the corpus operators: tables, durable intermediates, folds and names."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables; the path is only ever opened by Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none and runs on this machine alone (tests, a laptop) is a temporary
    folder chosen and set; on a cluster its absence is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="loom-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/loom-{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Lineage ends at replicated files, so losing an executor never recomputes what came before.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(*written: DataFrame) -> None:
    """Delete what ``durable`` has written, once nothing reads it any more, and let go of the shuffle files of
    queries that are over (Spark drops them when the driver's collector finds their handles)."""
    for df in written:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if written:
        gc.collect()
        written[0].sparkSession._jvm.System.gc()


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo; a null id counts as the empty text (remainder 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def free_name(taken: Iterable[str], base: str) -> str:
    """A column name that no column has, whatever its case."""
    used = {c.lower() for c in taken}
    name, n = base, 0
    while name.lower() in used:
        n += 1
        name = f"{base}_{n}"
    return name


def map_arrow(df: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """mapInArrow with per-task state: ``make()`` runs once in each task, its result on each batch."""
    def run(batches):
        step = make()
        for batch in batches:
            out = step(batch)
            if out is not None:
                yield out
    return df.mapInArrow(run, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def bounded_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents (doc_id, text, label), the same ones on every run.

    Ids are chosen from the labels alone in the order of their hash, so what is joined to the
    documents has at most ``rows`` ids and may be broadcast. Repeated ids collapse to the smallest
    text and the smallest label; null ids and null labels are never learned from.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable)
        .groupBy("doc_id").agg(F.min(F.col(label)).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    found = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return (
        found.join(F.broadcast(ids), "doc_id")
        .groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    )


def numbered(rows: DataFrame, order: list[Column], into: str, label: str) -> DataFrame:
    """The columns of ``rows`` and ``into``: 1, 2, 3... in the order given, without a window over one partition.

    Rows are range-partitioned (a last key tells equal rows apart, so that ties can be split too), written in
    order with their place in their partition, and the partitions' sizes, one number each, are added up.
    ``rows`` is computed twice (once to choose the ranges), so let it be something written.
    """
    spark = rows.sparkSession
    at, part = free_name(rows.columns, "loom_at"), free_name([*rows.columns, "loom_at"], "loom_part")
    keys = [*order, F.col(at)]
    ranged = rows.withColumn(at, F.monotonically_increasing_id()).repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)
    # Written in this order by the task that sorted it: the low 33 bits of the id are the row's place.
    placed = durable(ranged.select(*(F.col(f"`{c}`") for c in rows.columns), F.monotonically_increasing_id().alias(at)), label)
    placed = placed.select("*", F.shiftright(at, 33).alias(part))
    sizes = sorted((r[0], r[1]) for r in placed.groupBy(part).count().collect())
    starts, n = [], 0
    for p, k in sizes:
        starts.append((p, n))
        n += k
    begins = spark.createDataFrame(starts, f"`{part}` long, loom_start long")
    place = F.col("loom_start") + F.col(at).bitwiseAND((1 << 33) - 1) + 1
    return placed.join(F.broadcast(begins), part).select(*(F.col(f"`{c}`") for c in rows.columns), place.alias(into))


#: Rows and bytes of keys up to which ``with_values`` sends its table to all executors.
LOOKUP_ROWS, LOOKUP_BYTES, SALTS = 100_000, 8 << 20, 64


def with_values(rows: DataFrame, values: DataFrame, key: str, salt: Column) -> DataFrame:
    """``rows`` with the columns that ``values`` (one row a key, null being a key) has for their key.

    A table of counted, small size is broadcast. Beyond that both sides are shuffled by (key, salt), with each
    value repeated for every salt, so that a key with a third of all rows is dealt over ``SALTS`` tasks.
    """
    n, size = values.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(F.col(key).cast("string"))), F.lit(0))).first()
    side = values.withColumnRenamed(key, "loom_key")
    if n <= LOOKUP_ROWS and size * 4 <= LOOKUP_BYTES:
        return rows.join(F.broadcast(side), F.col(key).eqNullSafe(F.col("loom_key")), "left").drop("loom_key")
    side = side.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("loom_side"))
    salted = rows.withColumn("loom_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    on = F.col(key).eqNullSafe(F.col("loom_key")) & (F.col("loom_salt") == F.col("loom_side"))
    return salted.join(side, on, "left").drop("loom_key", "loom_side", "loom_salt")

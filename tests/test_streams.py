"""Streams give what the batch gives; ingest folds each file once."""

import uuid

from pyspark.sql import functions as F

from loomgraph.streaming import events as S


def _run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def _stream(spark, sf, tmp_path):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    ev.write.parquet(str(tmp_path / "in"))
    return ev, spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))


def test_tumbling_equals_batch(spark, sf, tmp_path):
    batch, stream = _stream(spark, sf, tmp_path)
    got = _run(spark, S.tumbling(stream), "tumbling", "complete")
    want = S.tumbling(batch).withColumn("start", F.col("start").cast("timestamp"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_state_equals_batch(spark, sf, tmp_path):
    batch, stream = _stream(spark, sf, tmp_path)
    got = _run(spark, S.running_totals(stream), "totals", "update").groupBy("user_id").agg(F.max("n").alias("n"))
    assert dict(map(tuple, got.collect())) == dict(map(tuple, batch.groupBy("user_id").count().collect()))


def test_ingest_is_once(spark, sf, tmp_path):
    batch, _ = _stream(spark, sf, tmp_path)
    seen, name = [], uuid.uuid4().hex
    for _ in range(2):
        S.ingest(spark, str(tmp_path / "in"), batch.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", "), lambda df, i: seen.append(df.count()), name).awaitTermination()
    assert sum(seen) == batch.count()


def _in_batches(spark, tmp_path, batches):
    """A stream that brings each list of (user_id, ts, value) as a batch of its own, then an empty-handed last one."""
    schema, at = "user_id long, ts timestamp, value double", str(tmp_path / uuid.uuid4().hex)
    for rows in batches:
        spark.createDataFrame(rows, "user_id long, ts string, value double").selectExpr("user_id", "cast(ts as timestamp) as ts", "value").coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at)


def test_state_of_idle_users_goes(spark, tmp_path):
    stream = _in_batches(spark, tmp_path, [[(1, "2024-01-01 00:00:00", 1.0)], [(2, "2024-01-03 00:00:00", 2.0)], [(2, "2024-01-03 00:01:00", 2.0)], [(1, "2024-01-03 00:02:00", 5.0), (2, "2024-01-03 00:02:00", 1.0)]])
    rows = _run(spark, S.running_totals(stream, idle="1 hour"), "idle", "update").collect()
    assert [(r.n, r.total) for r in rows if r.user_id == 1] == [(1, 1.0), (1, 5.0)]
    assert [(r.n, r.total) for r in rows if r.user_id == 2][-1] == (3, 5.0)


def test_keys_are_forgotten_behind_the_watermark(spark, tmp_path):
    stream = _in_batches(spark, tmp_path, [[(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:01:00", 2.0)], [(2, "2024-01-02 00:00:00", 3.0)], [(3, "2024-01-02 00:00:30", 4.0)], [(1, "2024-01-02 00:01:00", 5.0), (2, "2024-01-02 00:01:00", 6.0)]])
    out = S.deduplicated(stream, ["user_id"])
    query = out.writeStream.format("memory").queryName("keys").outputMode("append").start()
    query.processAllAvailable()
    state = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    query.stop()
    assert sorted(r.user_id for r in spark.table("keys").collect()) == [1, 1, 2, 3]
    assert state <= 3

"""Streams: windows, sessions, deduplication and state over events (event_id, ts, user_id, event_type, value).

The functions take a batch or a streaming DataFrame; ``watermark`` has an effect on streams only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomgraph.plans.io import shared_dir


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Watermarks are on timestamps with a zone; batches keep their own type."""
    if events.isStreaming and dict(events.dtypes)["ts"] == "timestamp_ntz":
        events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    w = _timed(events, late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 hours", slide: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    w = _timed(events, late).groupBy(F.window("ts", size, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    w = _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Each key once. On a stream a key is forgotten once the watermark has passed its event by ``late``, so state is
    bounded by the keys of that time; an event with a forgotten key counts as new."""
    timed = _timed(events, late)
    return timed.dropDuplicatesWithinWatermark(keys) if events.isStreaming else timed.dropDuplicates(keys)


def running_totals(events: DataFrame, idle: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(user_id, n, total) kept as state for each user, given out after each batch.

    ``idle`` (on streams): a user's state is dropped once the watermark is so far beyond their last event, so state is
    bounded by the users of that time; one who comes back starts anew. Without it totals are of all time.
    """
    wait = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)
    if wait is not None:
        events = _timed(events, late)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, total, last = state.get if state.exists else (0, 0.0, 0)
        for f in frames:
            n, total = n + len(f), total + float(f["value"].sum())
            last = max(last, int(f["ts"].max().timestamp() * 1000))
        state.update((n, total, last))
        if wait is not None:
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + wait)
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})
    timeout = GroupStateTimeout.NoTimeout if wait is None else GroupStateTimeout.EventTimeTimeout
    return events.groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, total double", "n long, total double, last long", "update", timeout)


def ingest(spark: SparkSession, source: str, schema: str, fold: Callable[[DataFrame, int], None], name: str):
    """Incremental ingest: new Parquet files go to ``fold`` batch by batch, once each; progress is kept in the
    shared folder, so a restarted query goes on where it stopped. Returns the started query."""
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", f"{shared_dir(spark)}/ingest-{name}").trigger(availableNow=True).start()

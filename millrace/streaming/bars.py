"""Bars of a live feed: watermark, event-time windows, closed bars only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace import schemas
from millrace.operators.incremental import last_wins
from millrace.sources.versions import PART, Versions, upsert


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files that arrive in a folder, as a stream with instants (watermarks need them)."""
    rows = spark.readStream.schema(schemas.EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def streaming_bars(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars that are closed: later than the watermark nothing changes them, and only then are they emitted (append)."""
    size = F.get_json_object("props", "$.k").cast("bigint")
    order = F.struct("ts", "event_id")
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"))
        .agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.sum(size).alias("volume"), F.count("*").alias("n_trades"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("bar_ts"), "open", "high", "low", "close", "volume", "n_trades")
    )


def run_to_files(bars: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends closed bars exactly once as Parquet, working off all that is there; a restart goes on from the checkpoint."""
    return bars.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserted(stream: DataFrame, key: str, order: str, out: str, checkpoint: str, buckets: int = 64, step: Callable[[str], None] = lambda name: None) -> StreamingQuery:
    """Last-wins compaction batch by batch into a table of versions (``sources.versions``) in ``buckets`` parts: a batch rewrites only those that its keys fall into.

    A version is published by one rename and remembers its batch, so a batch
    that is done again after a failure at any point is merged once.
    """
    part = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias(PART)

    def merge(batch: DataFrame, number: int) -> None:
        def last(rows: DataFrame) -> DataFrame:
            return last_wins(rows, [key], [order]).select("*", part).repartition(PART)

        upsert(Versions(batch.sparkSession, out), batch.select("*", part), checkpoint, number, last, step)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Sinks: committed Parquet, JSON lines, appends and one-row reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parquet(frame: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Zstandard Parquet through Spark's committer: readers see all of a write or none of it."""
    writer = frame.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def json_lines(frame: DataFrame, path: str, mode: str = "errorifexists") -> None:
    frame.write.mode(mode).json(path)


def appended(frame: DataFrame, path: str) -> None:
    """Adds files, never touches those there: the durable append of logs and records."""
    frame.write.mode("append").json(path)


def repair_log(before: DataFrame, after: DataFrame, key: str, column: str) -> DataFrame:
    """key, before, after of every value that a repair changed."""
    a = before.select(key, F.col(column).alias("before"))
    b = after.select(key, F.col(column).alias("after"))
    return a.join(b, key).where(~F.col("before").eqNullSafe(F.col("after")))


def orphans(listing: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """What lies there and is not in the keep set: what a prune would delete."""
    return listing.join(kept.select(key).distinct(), key, "left_anti")


def report(counts: DataFrame, name: str, value: str) -> DataFrame:
    """Long rows (name, value) as one row with a sorted JSON object: a manifest."""
    entries = F.array_sort(F.collect_list(F.struct(name, value)))
    return counts.groupBy().agg(F.to_json(F.map_from_entries(entries)).alias("report"))

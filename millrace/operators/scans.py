"""Numbering, running values and predecessors within groups of any size.

A window over a whole group is one task's work, however large the group. Here
rows are placed in bins of the order of (group, order columns) first: Spark's
range partitioning samples the whole key, so bins hold like numbers of rows
whatever the keys look like (a common prefix, one hot group, ties, nulls first
and NaN last as in any sort). Bins are aggregated, what stands before each bin in
its group is found on the aggregates (a row per group and bin), and goes into the
bin as a row of its own ahead of its rows. Windows then run per group and bin, so
one hot group is spread over as many tasks as it has bins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.scratch import stored


def bins_of(frame: DataFrame) -> int:
    """Bins that a frame is placed in: as many as a shuffle has partitions, or as the cluster has cores, if that is more."""
    spark = frame.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, 2)


def magnitude_bin(value: Column, fine: int) -> Column:
    """``fine`` bins for each factor of e in a number's size, never falling as it rises; infinity and then NaN are in the last one."""
    x = value.cast("double")
    return F.when(F.isnan(x), F.lit((1 << 63) - 1)).otherwise(F.floor(F.signum(x) * F.log1p(F.abs(x)) * fine))


def placed(frame: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``frame`` with _bin, which never falls as (``by``, ``order``) rises, written to the shared folder.

    Rows that tie are told apart, so that many equal keys take several bins too.
    The functions below place their input unless it has a column _bin, which they
    then use and keep: place it once where several are wanted.
    """
    told = frame.withColumn("_tie", F.monotonically_increasing_id())
    dealt = told.repartitionByRange(bins_of(frame), *by, *order, "_tie").withColumn("_bin", F.spark_partition_id())
    return stored(dealt.drop("_tie"))


def _binned(frame: DataFrame, by: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The placed rows, and the helper columns to drop in the end."""
    return (frame, []) if "_bin" in frame.columns else (placed(frame, by, order), ["_bin"])


def _in_bins(rows: DataFrame, heads: DataFrame, by: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, Window]:
    """Rows and heads together, and the window over a group's bin with its head first."""
    both = rows.withColumn("_head", F.lit(False)).unionByName(heads.withColumn("_head", F.lit(True)), allowMissingColumns=True)
    return both, Window.partitionBy(*by, "_bin").orderBy(F.desc("_head"), *order)


def running(frame: DataFrame, by: Sequence[str], order: Sequence[str], value: str | Column, name: str, how: str = "sum") -> DataFrame:
    """Adds ``name``: the sum (or max, min) of ``value`` from the group's first row to this one. Rows that tie in ``order`` stand in any order, as in a window."""
    agg = {"sum": F.sum, "max": F.max, "min": F.min}[how]
    rows, helpers = _binned(frame, by, order)
    rows = rows.withColumn("_x", F.col(value) if isinstance(value, str) else value)
    kind = rows.groupBy().agg(agg("_x")).schema[0].dataType
    per_bin = rows.groupBy(*by, "_bin").agg(agg("_x").alias("_part"))
    before = agg("_part").over(Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    heads = per_bin.select(*by, "_bin", before.cast(kind).alias("_x"))
    both, w = _in_bins(rows.withColumn("_x", F.col("_x").cast(kind)), heads, by, order)
    found = both.withColumn(name, agg("_x").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast(kind))
    return found.where("not _head").drop("_head", "_x", *helpers)


def numbered(frame: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds _i (from 0) and _n within each group."""
    rows, helpers = _binned(frame, by, order)
    per_bin = rows.groupBy(*by, "_bin").agg(F.count("*").alias("_part"))
    w = Window.partitionBy(*by)
    before = F.sum("_part").over(w.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    heads = per_bin.select(*by, "_bin", F.coalesce(before, F.lit(0)).cast("bigint").alias("_off"), F.sum("_part").over(w).cast("bigint").alias("_all"))
    both, own = _in_bins(rows, heads, by, order)
    whole = Window.partitionBy(*by, "_bin")
    found = both.withColumn("_i", F.max("_off").over(whole) + F.row_number().over(own) - 2).withColumn("_n", F.max("_all").over(whole))
    return found.where("not _head").drop("_head", "_off", "_all", *helpers)


def previous(frame: DataFrame, by: Sequence[str], order: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Adds the values that the row before has: ``columns`` maps a column to the new name. Null in a group's first row."""
    rows, helpers = _binned(frame, by, order)
    last = F.max_by(F.struct(*columns), F.struct(*order))
    per_bin = rows.groupBy(*by, "_bin").agg(last.alias("_last"))
    carried = F.lag("_last").over(Window.partitionBy(*by).orderBy("_bin"))
    heads = per_bin.withColumn("_last", carried).select(*by, "_bin", *[F.col(f"_last.{c}").alias(c) for c in columns if c not in by])
    # A head ahead of the first bin's rows holds nulls, so their predecessor is null as well.
    both, w = _in_bins(rows, heads, by, order)
    return both.select("*", *[F.lag(c).over(w).alias(name) for c, name in columns.items()]).where("not _head").drop("_head", *helpers)

"""Deterministic samples: allocation, strides, hash quotas, even picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.scans import numbered


def allocation(sizes: DataFrame, name: str, size: str, n: int, floor: int) -> DataFrame:
    """name, size, quota: ``floor`` for each class (or all it has), then the rest by largest remainder; ties by name.

    What rounding leaves is dealt one by one in order of the remainders, round
    and round, past classes that are full: the j-th unit of a class comes in
    round j, so the first ``short`` units by (round, remainder, name) are taken.
    Classes are few; rows of the table are not touched here.
    """
    base = sizes.select(F.col(name), F.col(size).cast("bigint").alias("size")).withColumn("least", F.least(F.lit(floor).cast("bigint"), F.col("size")))
    one = base.agg(F.sum("least").alias("given"), F.sum(F.col("size") - F.col("least")).alias("pool"))
    rows = base.crossJoin(F.broadcast(one))  # one row
    left = F.greatest(F.lit(n) - F.col("given"), F.lit(0))
    room = F.col("size") - F.col("least")
    # Whole shares and remainders in integers: no rounding of quotients.
    rows = rows.withColumn("_left", left).withColumn("_room", room)
    share = F.when(F.col("pool") > 0, F.expr("_left * _room div pool")).otherwise(0)
    rows = rows.withColumn("_share", share).withColumn("_rest", F.when(F.col("pool") > 0, F.expr("_left * _room % pool")).otherwise(0))
    rows = rows.withColumn("_first", F.least(F.col("least") + F.col("_share"), F.col("size")))
    short = F.least(F.lit(n), F.sum("size").over(Window.partitionBy())) - F.sum("_first").over(Window.partitionBy())
    rows = rows.withColumn("_short", F.when(F.col("_left") > 0, F.greatest(short, F.lit(0))).otherwise(0))
    units = rows.select(name, "size", "_first", "_rest", "_short", F.explode_outer(F.when(F.col("size") > F.col("_first"), F.sequence(F.lit(1).cast("bigint"), F.least(F.col("size") - F.col("_first"), F.greatest(F.col("_short"), F.lit(1)))))).alias("_round"))
    order = Window.orderBy(F.col("_round").asc_nulls_last(), F.desc("_rest"), name)
    taken = units.withColumn("_turn", F.row_number().over(order)).withColumn("_one", F.when(F.col("_round").isNotNull() & (F.col("_turn") <= F.col("_short")), 1).otherwise(0))
    return taken.groupBy(name, "size").agg((F.max("_first") + F.sum("_one")).cast("bigint").alias("quota"))


def stride_sample(frame: DataFrame, by: Sequence[str], order: Sequence[str], k: int | str) -> DataFrame:
    """k rows of each group, evenly spread over its order (half-even places); all of a group with k rows or fewer.

    ``k`` is a number or a column. Each row decides for itself: it is taken if the
    place nearest to it maps back to it.
    """
    rows = numbered(frame, by, order).withColumn("_k", F.col(k).cast("bigint") if isinstance(k, str) else F.lit(k).cast("bigint"))
    near = F.when(F.col("_n") > 1, F.floor(F.col("_i") * F.greatest(F.col("_k") - 1, F.lit(1)) / (F.col("_n") - 1))).otherwise(0)
    place = lambda j: F.bround(j * (F.col("_n") - 1) / F.greatest(F.col("_k") - 1, F.lit(1)))
    hit = F.exists(F.filter(F.array(near - 1, near, near + 1), lambda j: (j >= 0) & (j < F.col("_k"))), lambda j: place(j) == F.col("_i"))
    return rows.where((F.col("_k") >= F.col("_n")) | ((F.col("_k") > 0) & hit)).drop("_i", "_n", "_k")


def even_pick(frame: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """n picks of each group at (k + 1/2) / n of its length (repeats once): the middle of each of n equal parts."""
    rows = numbered(frame, by, order)
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.least(F.floor(F.col("_n") * (k * 2 + 1) / F.lit(2 * n)), F.col("_n") - 1))
    return rows.where(F.array_contains(places, F.col("_i").cast("bigint"))).drop("_i", "_n")


def quota_sample(frame: DataFrame, by: Sequence[str], key: str, n: int, seed: str = "0") -> DataFrame:
    """n rows in all, shared evenly over groups (the first groups get one more), drawn by the digest of seed and key.

    Only digests are ranked, in bins of their first characters; groups with fewer
    rows than their share give all. Groups are few: they are numbered in one window.
    """
    groups = frame.select(*by).distinct()
    w = Window.orderBy(*by)
    quotas = groups.withColumn("_g", F.row_number().over(w)).withColumn("_all", F.count("*").over(Window.partitionBy()))
    quotas = quotas.withColumn("quota", F.expr(f"{n} div _all + if(_g <= {n} % _all, 1, 0)")).drop("_g", "_all")
    drawn = frame.withColumn("_draw", F.md5(F.concat(F.lit(seed), F.lit(":"), F.col(key).cast("string"))))
    return numbered(drawn, by, ["_draw", key]).join(quotas, list(by)).where("_i < quota").drop("_draw", "_i", "_n", "quota")


def preferred(frame: DataFrame, by: Sequence[str], prefer: Column) -> DataFrame:
    """The rows of each group that ``prefer`` holds for; all of a group that has none."""
    marked = frame.withColumn("_p", F.coalesce(prefer, F.lit(False)))
    has = marked.where("_p").select(*by).distinct().withColumn("_has", F.lit(True))
    return marked.join(has, list(by), "left").where("_p or _has is null").drop("_p", "_has").select(frame.columns)

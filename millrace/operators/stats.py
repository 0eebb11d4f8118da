"""Percentiles, histograms, cross-tabs and rollups with the definitions stated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.scans import magnitude_bin


def order_statistics(frame: DataFrame, by: Sequence[str], value: str, picks: dict[str, str]) -> DataFrame:
    """``by``, n, and for each name the value at a place of the sorted values.

    picks: name to an expression of n that gives a place from 0. Places are found
    by ranking distinct values over their counts. Values are ranked in bins of
    their magnitude (at most a few thousand, whatever the data), and each bin gets
    the number of values before it, so neither one hot group nor the lack of
    groups puts all values in one task, and no list is collected.
    """
    v = F.col(value)
    magnitude = magnitude_bin(v, 64)
    counts = frame.where(v.isNotNull()).groupBy(*by, magnitude.alias("_bin"), v.alias("_v")).agg(F.count("*").alias("_c"))
    bins = counts.groupBy(*by, "_bin").agg(F.sum("_c").alias("_m"))
    before = F.sum("_m").over(Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    heads = bins.select(*by, "_bin", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_m").over(Window.partitionBy(*by)).alias("_all"))
    w = Window.partitionBy(*by, "_bin")
    both = counts.unionByName(heads, allowMissingColumns=True).select("*", F.max("_before").over(w).alias("_off"), F.max("_all").over(w).alias("n"))
    upto = F.sum("_c").over(w.orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    ranked = both.withColumn("_hi", F.col("_off") + upto).where("_v is not null").withColumn("_lo", F.col("_hi") - F.col("_c"))
    chosen = [
        F.max(F.when((F.expr(place) >= F.col("_lo")) & (F.expr(place) < F.col("_hi")), F.col("_v"))).alias(name) for name, place in picks.items()
    ]
    return ranked.groupBy(*by).agg(F.max("n").alias("n"), *chosen)


def nearest_rank(p: float) -> str:
    """The half-even nearest rank: no interpolation."""
    return f"least(n - 1, cast(bround({p} * (n - 1)) as bigint))"


def truncated_rank(p: float) -> str:
    return f"cast(floor(n * {p}) as bigint)"


UPPER_MEDIAN = "n div 2"


def limit_histogram(frame: DataFrame, by: Sequence[str], value: str, limits: Sequence[float]) -> DataFrame:
    """``by``, bucket (from 1; one past the last is the overflow), limit, n (in this bucket) and upto (at or below the limit).

    Upper limits are inclusive. One pass counts all buckets; nulls count nowhere.
    """
    v = F.col(value)
    under = [F.count_if(v <= x) for x in limits]
    sums = frame.groupBy(*by).agg(F.array(*under, F.count(value)).alias("_upto"))
    rows = sums.select(*by, F.posexplode("_upto").alias("_i", "upto"), "_upto")
    marks = F.array(*[F.lit(float(x)) for x in limits])
    before = F.when(F.col("_i") > 0, F.get("_upto", F.col("_i") - 1)).otherwise(0)
    return rows.select(*by, (F.col("_i") + 1).alias("bucket"), F.get(marks, F.col("_i")).alias("limit"), (F.col("upto") - before).alias("n"), "upto")


def crosstab(frame: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by both, by either and in all; ALL stands for what was summed over."""
    found = frame.groupingSets([[a, b], [a], [b], []], a, b).agg(F.count("*").alias("n"), F.grouping(a).alias("_ga"), F.grouping(b).alias("_gb"))
    return found.select(F.when(F.col("_ga") == 1, "ALL").otherwise(F.col(a)).alias(a), F.when(F.col("_gb") == 1, "ALL").otherwise(F.col(b)).alias(b), "n")


def first_examples(frame: DataFrame, by: Sequence[str], key: str, n: int) -> DataFrame:
    """``by``, the n smallest keys in order, and how many there are: ranked, not collected whole."""
    w = Window.partitionBy(*by).orderBy(key)
    few = frame.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n).groupBy(*by).agg(F.array_sort(F.collect_list(key)).alias("examples"))
    every = frame.groupBy(*by).agg(F.count("*").alias("n_all")).select(*[F.col(c).alias(f"_{c}") for c in by], "n_all")
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))  # a null group is a group
    return few.join(every, same).select(*by, "examples", "n_all")


def merged_counts(parts: DataFrame, by: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """Sums of partial counts: partial results merge into corpus results."""
    return parts.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in counts])


def stable_lines(lines: DataFrame, group: str, member: str, line: str, min_members: int) -> DataFrame:
    """group, n_members, n_core (lines that every member has) and n_varying, of groups with enough members."""
    members = lines.groupBy(group).agg(F.count_distinct(member).alias("n_members"))
    seen = lines.select(group, member, line).distinct().groupBy(group, line).agg(F.count("*").alias("_in"))
    both = seen.join(members.where(F.col("n_members") >= min_members), group)
    return both.groupBy(group).agg(F.max("n_members").alias("n_members"), F.count_if(F.col("_in") == F.col("n_members")).alias("n_core"), F.count_if(F.col("_in") < F.col("n_members")).alias("n_varying"))


#: Values that a sketch keeps (its accuracy), and the error of a quantile's rank, as a share of all rows, that holds with room to spare (the sketch's own bound at 99 % is a third of it).
SKETCH_K, RANK_ERROR = 400, 0.02


def sketched(frame: DataFrame, by: Sequence[str], value: str, name: str = "sketch") -> DataFrame:
    """``by`` and a quantile sketch (KLL) of each part: a few kilobytes, to be stored and merged without the rows. Nulls are left out."""
    return frame.where(F.col(value).isNotNull()).groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), SKETCH_K).alias(name))


def merged_sketches(parts: DataFrame, by: Sequence[str], name: str = "sketch") -> DataFrame:
    """Sketches of parts merged by ``by``; parts may be merged in any order and in several steps."""
    return parts.groupBy(*by).agg(F.kll_merge_agg_double(name, SKETCH_K).alias(name))


def sketch_quantiles(sketches: DataFrame, by: Sequence[str], picks: dict[str, float], name: str = "sketch") -> DataFrame:
    """``by``, n, and for each name a value whose rank is within ``RANK_ERROR`` of the share asked for."""
    return sketches.select(*by, F.kll_sketch_get_n_double(name).alias("n"), *[F.kll_sketch_get_quantile_double(name, F.lit(p)).alias(c) for c, p in picks.items()])


def rank_within(frame: DataFrame, by: Sequence[str], value: str, found: DataFrame, picks: dict[str, float], error: float = RANK_ERROR) -> DataFrame:
    """``by`` and, for each name, whether the rank of its value among all rows is within ``error`` of the share asked for. ``found`` has one row a group."""
    rows = frame.select(*by, F.col(value).alias("_v")).where("_v is not null").join(found.select(*by, *picks), list(by))
    total = F.count("*")
    near = [((F.count_if(F.col("_v") < F.col(c)) / total <= p + error) & (F.count_if(F.col("_v") <= F.col(c)) / total >= p - error)).alias(c) for c, p in picks.items()]
    return rows.groupBy(*by).agg(*near)

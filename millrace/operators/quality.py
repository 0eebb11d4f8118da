"""Data-quality gates. Each returns counts or rows, never a verdict without them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


BLANKS = " \t\n\r\f\v"


def named_where(conditions: dict[str, Column]) -> Column:
    """The names whose condition holds, in order."""
    marked = F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()])
    return F.array_compact(marked)


def pair_changes(pairs: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """Per pair: shared labels, how many moved, and too_few (below two), none_changed, all_changed or mixed."""
    found = pairs.groupBy(*by).agg(F.count("*").alias("n_shared"), F.count_if(F.col(a) != F.col(b)).alias("n_moved"))
    kind = F.when(F.col("n_shared") < 2, "too_few").when(F.col("n_moved") == 0, "none_changed").when(F.col("n_moved") == F.col("n_shared"), "all_changed").otherwise("mixed")
    return found.withColumn("class", kind)


def collapsed(rows: DataFrame, by: Sequence[str], value: str, label: str) -> DataFrame:
    """Groups in which distinct labels share one value."""
    found = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count_distinct(label).alias("n_labels"), F.count("*").alias("n_rows"))
    return found.where("n_labels > 1")


def sequence_report(rows: DataFrame, by: Sequence[str], position: str, ts: str, tolerance: str) -> DataFrame:
    """Per group: n, is the position 0..n-1, steps back in time beyond the tolerance, repeated positions."""
    w = Window.partitionBy(*by).orderBy(position, ts)
    marked = rows.withColumn("_i", F.row_number().over(w) - 1).withColumn("_before", F.lag(ts).over(w)).withColumn("_same", F.lag(position).over(w))
    back = F.col(ts) < F.col("_before") - F.expr(f"interval {tolerance}")
    return marked.groupBy(*by).agg(
        F.count("*").alias("n"), (F.count_if(F.col(position) != F.col("_i")) == 0).alias("contiguous"),
        F.count_if(back).alias("n_back"), F.count_if(F.col(position) == F.col("_same")).alias("n_repeated"),
    )


def repeat_ratio(rows: DataFrame, by: Sequence[str], order: Sequence[str], text: str, more_than: int = 20, limit: float = 0.35) -> DataFrame:
    """Per group: n, repeats of the text before (blank ones do not count) and looping, judged only above ``more_than`` rows."""
    stripped = F.trim(F.col(text), F.lit(BLANKS))
    w = Window.partitionBy(*by).orderBy(*order)
    marked = rows.withColumn("_t", stripped).withColumn("_before", F.lag(stripped).over(w))
    found = marked.groupBy(*by).agg(F.count("*").alias("n"), F.count_if((F.col("_t") == F.col("_before")) & (F.col("_t") != "")).alias("n_repeats"))
    return found.withColumn("looping", (F.col("n") > more_than) & (F.col("n_repeats") > F.col("n") * F.lit(limit)))


def transcript_facts(segments: DataFrame, by: Sequence[str], start: str, end: str, text: str, tolerance: float = 0.5) -> DataFrame:
    """Per recording: n_segments, n_back (starts before the one ahead by more than the tolerance, in the rows' order), last_end and n_repeats.

    ``segments`` need a column ``i`` that gives their order.
    """
    w = Window.partitionBy(*by).orderBy("i")
    stripped = F.trim(F.col(text), F.lit(BLANKS))
    rows = segments.select(*by, start, end, stripped.alias("_t"), F.lag(start).over(w).alias("_start"), F.lag(stripped).over(w).alias("_same"))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n_segments"), F.count_if(F.col(start) < F.col("_start") - tolerance).alias("n_back"), F.max(end).alias("last_end"),
        F.count_if((F.col("_t") == F.col("_same")) & (F.col("_t") != "")).alias("n_repeats"),
    )


def recording_gates(facts: DataFrame, least_coverage: float = 0.85, least_frames: int = 3, more_than: int = 20, most_repeats: float = 0.35) -> DataFrame:
    """Adds issues and redo (arrays of names): what is wrong with a recording and which stages must run again.

    facts: undone (array of stages that are not done), duration, the columns of
    ``transcript_facts`` (null: no transcript), n_moments and n_outside, n_frames
    (listed), n_files (found), n_tiny and n_unsorted.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    empty = n("n_segments") == 0
    back, loop = n("n_back") > 0, (n("n_segments") > more_than) & (n("n_repeats") > n("n_segments") * F.lit(most_repeats))
    uncovered = ~empty & (F.col("duration") > 0) & (n("last_end") < F.col("duration") * F.lit(least_coverage))
    outside, silent = n("n_outside") > 0, n("n_moments") == 0  # silent is a warning: nothing is redone for it
    frames = {"no_frames": n("n_frames") == 0, "few_frames": n("n_frames").between(1, least_frames - 1), "files_differ": n("n_frames") != n("n_files"), "tiny_files": n("n_tiny") > 0, "unsorted": n("n_unsorted") > 0}
    issues = named_where({"undone": F.size("undone") > 0, "no_transcript": empty, "back": back, "uncovered": uncovered, "loop": loop, "outside": outside, "silent": silent, **frames})
    any_frames = F.lit(False)
    for c in frames.values():
        any_frames |= c
    redo = named_where({"transcribe": empty | back | uncovered | loop, "moments": outside, "keyframes": any_frames})
    return facts.withColumn("issues", issues).withColumn("redo", F.array_sort(F.array_union("undone", redo)))


def level_verdicts(levels: DataFrame, bars: DataFrame, key: str, parsed: str, has_bars: str, within: float, bin_width: float) -> DataFrame:
    """Adds verdict to levels: unparseable, no_bars, ohlc_match (a leg within so many ticks), in_range_no_match or out_of_range; with in_range and the nearest leg."""
    from millrace.functions.prices import TICK
    from millrace.operators.joins import nearest_leg

    judged = levels.where(F.col(parsed).isNotNull() & F.col(has_bars))
    near = nearest_leg(judged.select(key, parsed), bars, key, parsed, TICK, bin_width=bin_width).drop(parsed)
    envelope = F.broadcast(bars.agg(F.min("low").alias("_lo"), F.max("high").alias("_hi")))  # one row
    rows = levels.join(near, key, "left").crossJoin(envelope)
    inside = F.when(F.col(parsed).isNotNull() & F.col(has_bars), F.col(parsed).between(F.col("_lo"), F.col("_hi")))
    verdict = (
        F.when(F.col(parsed).isNull(), "unparseable").when(~F.col(has_bars), "no_bars").when(F.col("delta") <= within, "ohlc_match")
        .when(F.col("in_range"), "in_range_no_match").otherwise("out_of_range")
    )
    return rows.withColumn("in_range", inside).withColumn("verdict", verdict).drop("_lo", "_hi")


def diagnosis(quads: DataFrame, bars: DataFrame, widest: DataFrame, legs: Sequence[str]) -> DataFrame:
    """Why an observation met no bar: outside_envelope, too_wide or unexplained. ``widest``: one row, the widest plausible range."""
    open_, high, low, close = legs
    envelope = bars.agg(F.min(low).alias("_lo"), F.max(high).alias("_hi"))
    rows = quads.crossJoin(F.broadcast(envelope)).crossJoin(F.broadcast(widest.toDF("_widest")))  # one row each
    outside = F.greatest(*[F.coalesce((F.col(x) < F.col("_lo")) | (F.col(x) > F.col("_hi")), F.lit(False)).cast("int") for x in legs]) == 1
    reason = F.when(outside, "outside_envelope").when(F.col(high) - F.col(low) > F.col("_widest"), "too_wide").otherwise("unexplained")
    return rows.withColumn("reason", reason).drop("_lo", "_hi", "_widest")


def residual_boundaries(changes: DataFrame, starts: DataFrame, by: Sequence[str], position: str) -> DataFrame:
    """Per group: independent changes, those not on a run's start, and whether the share is within 5 %."""
    marks = starts.select(*by, position).distinct().withColumn("_start", F.lit(True))
    met = changes.join(marks, [*by, position], "left")
    return met.groupBy(*by).agg(F.count("*").alias("n_changes"), F.count_if(F.col("_start").isNull()).alias("n_residual")).withColumn("ok", F.col("n_residual") * 20 <= F.col("n_changes"))


def repaired(text: Column, pattern: str, right: str) -> tuple[Column, Column]:
    """The text with every match replaced, and the number of replacements."""
    return F.regexp_replace(text, pattern, right), F.regexp_count(text, F.lit(pattern))


def dataset_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """check, n: keys of either side that the other lacks, and rows of either side that repeat a key."""
    a, b = left.select(key), right.select(key)
    counts = (
        ("left_only", a.distinct().join(b.distinct(), key, "left_anti")),
        ("right_only", b.distinct().join(a.distinct(), key, "left_anti")),
        ("left_repeated", a.groupBy(key).count().where("count > 1")),
        ("right_repeated", b.groupBy(key).count().where("count > 1")),
    )
    out = None
    for name, rows in counts:
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
        out = one if out is None else out.unionByName(one)
    return out

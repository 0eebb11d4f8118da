"""Order-dependent operators.

What depends on earlier *decisions* (an anchor, the last kept row) is folded row
by row, in chunks that are worked on in parallel and stitched together
(``chunks.py``), so one hot group keeps many tasks busy. Greedy groups, whose
state is every decision before, are folded in one stream a group. What only looks
at neighbours stays in window functions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import pairwise, repeat
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import scans
from millrace.operators.chunks import folded


def anchored_runs(frame: DataFrame, by: Sequence[str], order: Sequence[str], value: str, limit: float) -> DataFrame:
    """Runs against their first row: a row further than ``limit`` from the run's anchor begins the next run.

    Adds run (from 0) and starts.
    """

    def step(anchor, row):
        x = row[0]
        if anchor is None or (x is not None and abs(x - anchor) > limit):
            return x, (True,)
        return anchor, (False,)

    return folded(frame, by, order, [value], None, step, "starts boolean", ("starts", "run"))


def clustered_runs(frame: DataFrame, by: Sequence[str], order: Sequence[str], dhash: str, cells: str, hamming_max: int = 4, delta: float = 6.0, share_max: float = 0.005) -> DataFrame:
    """Runs against their first row by two criteria, a 64-bit hash and a grid of cells.

    A row leaves the run if more than ``hamming_max`` bits differ (dhash) or, else,
    more than ``share_max`` of the cells changed by more than ``delta`` (fine).
    Adds run, starts, reason (why the row began a run; null for the first) and
    share (of changed cells against the anchor).
    """

    def step(anchor, row):
        h, c = row
        if anchor is None:
            return row, (True, None, 0.0)
        share = sum(abs(x - y) > delta for x, y in zip(c, anchor[1], strict=True)) / max(1, len(c))
        reason = "dhash" if ((h ^ anchor[0]) & (1 << 64) - 1).bit_count() > hamming_max else "fine" if share > share_max else None
        if reason:
            return row, (True, reason, 0.0)
        return anchor, (False, None, share)

    return folded(frame, by, order, [dhash, cells], None, step, "starts boolean, reason string, share double", ("starts", "run"))


def run_spans(runs: DataFrame, by: Sequence[str], position: str) -> DataFrame:
    """A row per run: its first and last position and number of rows."""
    return runs.groupBy(*by, "run").agg(F.min(position).alias("first_pos"), F.max(position).alias("last_pos"), F.count("*").alias("n_rows"))


def drift_kept(frame: DataFrame, by: Sequence[str], order: Sequence[str], position: str, value: str, min_gap: float = 6, threshold: float = 2.5) -> DataFrame:
    """Adds kept: far enough from the last kept row both in position and in value. The first row is kept."""

    def step(state, row):
        at, x = row
        if state is None or (at - state[0] >= min_gap and abs(x - state[1]) > threshold):
            return row, (True,)
        return state, (False,)

    return folded(frame, by, order, [position, value], None, step, "kept boolean")


def restarting_windows(frame: DataFrame, by: Sequence[str], order: Sequence[str], position: str, width: float) -> DataFrame:
    """Adds window_start: a row ``width`` or more after the window's first row begins a new window there."""

    def step(state, row):
        at = row[0]
        state = at if state is None or at - state >= width else state
        return state, (state,)

    return folded(frame, by, order, [position], None, step, f"window_start {frame.schema[position].dataType.simpleString()}")


def thinned(frame: DataFrame, by: Sequence[str], order: Sequence[str], position: str, priority: str, min_gap: float = 6) -> DataFrame:
    """The rows that survive thinning: a row closer than ``min_gap`` to the last selected is dropped, unless it has priority and the last one has not: then it takes its place.

    A replaced row is only known later, so a row that replaces one names its place, and
    those named are taken out.
    """

    def step(state, row):
        at, first, place = row
        if state is None or at - state[0] >= min_gap:
            return row, (place, None)
        if first and not state[1]:
            return row, (place, state[2])
        return state, (None, None)

    marked = folded(frame, by, order, [position, priority], None, step, "_place bigint, _instead_of bigint", place=True).where("_place is not null")
    gone = marked.where("_instead_of is not null").select(F.col("_instead_of").alias("_place"))
    return marked.join(gone, "_place", "left_anti").select(frame.columns)


def greedy_groups(frame: DataFrame, by: Sequence[str], order: Sequence[str], dhash: str, hamming_max: int = 4) -> DataFrame:
    """Adds recur_group: the first earlier group whose anchor (its first row) is within ``hamming_max`` bits, else a new one. A null hash has none.

    Equal hashes fall into the same group as their first one, so only first ones
    are folded, a stream per group of rows. Anchors are indexed by bands: of
    ``hamming_max`` + 1 bands of the 64 bits two hashes that close have at least one
    in common, so only anchors of a common band are tried. The index grows with
    the number of anchors, not with rows.
    """
    by = list(by)
    edges = [64 * i // (hamming_max + 1) for i in range(hamming_max + 2)]
    bands = [(i, lo, (1 << hi - lo) - 1) for i, (lo, hi) in enumerate(pairwise(edges))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, index, n = object(), {}, 0
        for batch in batches:
            found = []
            keys = zip(*[batch.column(c).to_pylist() for c in by], strict=True) if by else repeat(())
            for key, h in zip(keys, batch.column(dhash).to_pylist(), strict=False):
                if key != group:
                    group, index, n = key, {}, 0
                own = [(i, h >> lo & mask) for i, lo, mask in bands]
                best = n
                for band in own:
                    for k, anchor in index.get(band, ()):  # in order of their numbers
                        if k >= best:
                            break
                        if ((h ^ anchor) & (1 << 64) - 1).bit_count() <= hamming_max:
                            best = k
                            break
                if best == n:
                    n += 1
                    for band in own:
                        index.setdefault(band, []).append((best, h))
                found.append(best)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*by, dhash]), pa.array(found, pa.int64())], names=[*by, dhash, "recur_group"])

    firsts = frame.where(F.col(dhash).isNotNull()).groupBy(*by, dhash).agg(F.min(F.struct(*order)).alias("_first"))
    dealt = (firsts.repartition(*by) if by else firsts.coalesce(1)).sortWithinPartitions(*by, "_first").select(*by, dhash)
    schema = T.StructType([*frame.select(*by, dhash).schema.fields, T.StructField("recur_group", T.LongType())])
    groups = dealt.mapInArrow(run, schema).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, dhash])], "recur_group")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*by, dhash])])
    return frame.join(groups, same, "left").select(*frame.columns, "recur_group")


def gap_points(picks: DataFrame, by: Sequence[str], position: str, end: str, every: int) -> DataFrame:
    """Positions inserted every ``every`` while the gap from the point before exceeds it; from 0 to the first pick and from the last pick to ``end``."""
    w = Window.partitionBy(*by).orderBy(position)
    before = picks.select(*by, F.coalesce(F.lag(position).over(w), F.lit(0)).alias("lo"), F.col(position).alias("hi"))
    last = picks.groupBy(*by).agg(F.max(position).alias("lo"), F.max(end).alias("hi"))
    gaps = before.unionByName(last).where(F.col("hi") - F.col("lo") > every)
    return gaps.select(*by, F.explode(F.sequence(F.col("lo") + every, F.col("hi") - 1, F.lit(every))).alias(position))


def upserted_candidates(offers: DataFrame, by: Sequence[str], slot: str, label: str, order: Sequence[str]) -> DataFrame:
    """One offer per slot: the first labelled one, else the first."""
    w = Window.partitionBy(*by, slot).orderBy(F.desc(F.coalesce(F.col(label), F.lit("")) != ""), *order)
    return offers.withColumn("_turn", F.row_number().over(w)).where("_turn = 1").drop("_turn")


def medoids(members: DataFrame, by: Sequence[str], position: str, dhash: str, cap: int | None = None) -> DataFrame:
    """The member of each group with the least sum of Hamming distances to the others; ties go to the later one.

    The sum over a group is taken bit by bit (how many members have each bit), so
    no pairs are made and no cap is needed for cost. With ``cap``, groups beyond
    it are represented by that many evenly spaced members; n_members counts all.
    """
    rows = members
    if cap is not None:
        rows = scans.numbered(members, by, [position])
        step = lambda k: F.bround(k * (F.col("_n") - 1) / F.lit(cap - 1))
        nearest = F.bround(F.col("_i") * F.lit(cap - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
        picked = (F.col("_n") <= cap) | F.array_contains(F.array(step(nearest - 1), step(nearest), step(nearest + 1)), F.col("_i").cast("double"))
        rows = rows.where(picked)
    bit = lambda i: F.shiftrightunsigned(F.col(dhash), i).bitwiseAND(F.lit(1).cast("bigint"))
    n = F.count("*") if cap is None else F.max("_n")
    counts = rows.groupBy(*by).agg(F.count("*").alias("_m"), n.alias("_of"), F.array(*[F.sum(bit(i)) for i in range(64)]).alias("_ones"))
    far = sum((F.when(bit(i) == 1, F.col("_m") - F.get("_ones", F.lit(i))).otherwise(F.get("_ones", F.lit(i))) for i in range(64)), F.lit(0).cast("bigint"))
    scored = rows.join(counts, list(by)).withColumn("_far", far)
    out = scored.groupBy(*by).agg(F.min(F.struct(F.col("_far").alias("total"), (-F.col(position)).alias("later"))).alias("_best"), F.max("_of").alias("n_members"))
    return out.select(*by, (-F.col("_best.later")).alias(position), F.col("_best.total").alias("total_distance"), "n_members")


def line_runs(lines: DataFrame, by: Sequence[str], position: str, kind: str, at_least: int) -> DataFrame:
    """Adds in_run: the line stands in a stretch of ``at_least`` consecutive lines of its (non-null) kind."""
    w = Window.partitionBy(*by).orderBy(position)
    island = F.col(position) - F.row_number().over(Window.partitionBy(*by, kind).orderBy(position))
    marked = lines.withColumn("_island", island)
    n = F.count("*").over(Window.partitionBy(*by, kind, "_island"))
    return marked.withColumn("in_run", F.col(kind).isNotNull() & (n >= at_least)).drop("_island")


def failure_runs(rows: DataFrame, by: Sequence[str], order: Sequence[str], failed: str, limit: int = 10) -> DataFrame:
    """Groups with a stretch of ``limit`` consecutive failures, and the longest one."""
    w = Window.partitionBy(*by).orderBy(*order)
    islands = rows.withColumn("_i", F.row_number().over(w) - F.row_number().over(Window.partitionBy(*by, failed).orderBy(*order)))
    runs = islands.where(F.col(failed)).groupBy(*by, "_i").agg(F.count("*").alias("n"))
    return runs.groupBy(*by).agg(F.max("n").alias("longest")).where(F.col("longest") >= limit)

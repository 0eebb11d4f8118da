"""Resumable work: last wins, what is still to do, staleness, rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.scans import numbered

MAX_ATTEMPTS = 3


def last_wins(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key. Aggregated before the shuffle, so a hot key costs a row a task."""
    rest = [c for c in rows.columns if c not in by]
    best = rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*by, "_row.*")


def still_to_do(expected: DataFrame, done: DataFrame, key: str, status: str = "status", attempts: str = "attempts", limit: int = MAX_ATTEMPTS) -> DataFrame:
    """Keys without a record, or whose record failed fewer than ``limit`` times, with the attempts so far."""
    known = done.select(key, F.col(status).alias("_status"), F.col(attempts).alias("_attempts"))
    retry = F.col("_status").isNull() | ((F.col("_status") == "error") & (F.col("_attempts") < limit))
    return expected.join(known, key, "left").where(retry).select(expected.columns + [F.coalesce("_attempts", F.lit(0)).alias("attempts_so_far")])


def complete_only(records: DataFrame, stages: DataFrame, group: str, stage: str, status: str = "status") -> DataFrame:
    """Records of groups whose ``stage`` is done: nothing is edited while it is still being made."""
    done = stages.where((F.col("stage") == stage) & (F.col(status) == "done")).select(group).distinct()
    return records.join(done, group, "left_semi")


def stale(rows: DataFrame, by: Sequence[str], ts: str, now: Column, limit: str) -> DataFrame:
    """Keys whose latest sign of life is older than ``limit`` (an interval) at ``now``."""
    latest = rows.groupBy(*by).agg(F.max(ts).alias("last_seen"))
    return latest.where(F.col("last_seen") < now - F.expr(f"interval {limit}"))


def progress(rows: DataFrame, by: Column, done: Column, total: int) -> DataFrame:
    """period, n_done, so far and what remains of ``total``."""
    per = rows.where(done).groupBy(by.alias("period")).agg(F.count("*").alias("n_done"))
    w = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return per.select("period", "n_done", F.sum("n_done").over(w).alias("so_far")).withColumn("remaining", F.greatest(F.lit(total).cast("bigint") - F.col("so_far"), F.lit(0).cast("bigint")))


def merged_ledger(parts: Sequence[DataFrame], key: str, order: Sequence[str]) -> DataFrame:
    """Append-only ledgers of several sources as one: the last entry of every key."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return last_wins(out, [key], order)


def within_budget(todo: DataFrame, done: DataFrame, by: Sequence[str], order: Sequence[str], budget: int) -> DataFrame:
    """The first rows of each group that its budget still allows: the budget counts what earlier runs did, so the same call again adds nothing."""
    spent = done.groupBy(*by).agg(F.count("*").alias("_spent"))
    rows = numbered(todo, by, order).join(spent, list(by), "left")
    return rows.where(F.col("_i") < F.lit(budget) - F.coalesce("_spent", F.lit(0))).select(todo.columns)


def stage_states(marks: DataFrame, by: Sequence[str], stages: Sequence[str], now: Column, silence: str, limit: int = MAX_ATTEMPTS) -> DataFrame:
    """Per key and stage: status, attempts and next (is it the stage to run now?).

    marks: ``by``, stage, ts, status (running, done or failed). The last mark
    counts; a running stage without a sign of life for ``silence`` (an interval)
    is pending again; a failed one is pending until it has failed ``limit``
    times. A stage runs only once all before it are done, so what comes after a
    stage that is not done is reset to pending: the cascade.
    """
    known = marks.groupBy(*by, "stage").agg(F.max_by("status", F.struct("ts", "status")).alias("_last"), F.max("ts").alias("_ts"), F.count_if(F.col("status") == "failed").alias("attempts"))
    places = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(s).alias("stage")) for i, s in enumerate(stages)])).alias("_s")
    every = marks.select(*by).distinct().select(*by, places).select(*by, "_s.place", "_s.stage")
    rows = every.join(known, [*by, "stage"], "left").withColumn("attempts", F.coalesce("attempts", F.lit(0).cast("bigint")))
    stale_ = F.col("_ts") < now - F.expr(f"interval {silence}")
    own = (
        F.when(F.col("_last").isNull(), "pending").when((F.col("_last") == "running") & stale_, "pending")
        .when((F.col("_last") == "failed") & (F.col("attempts") < limit), "pending").otherwise(F.col("_last"))
    )
    ahead = Window.partitionBy(*by).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # one row a stage
    rows = rows.withColumn("_own", own).withColumn("_ready", F.coalesce(F.min(F.col("_own") == "done").over(ahead), F.lit(True)))
    status = F.when(F.col("_ready"), F.col("_own")).otherwise("pending")
    return rows.select(*by, "stage", status.alias("status"), "attempts", (F.col("_ready") & (F.col("_own") == "pending")).alias("next"))


def rate_and_eta(rows: DataFrame, by: Sequence[str], ts: str, resumed: Column, remaining: int) -> DataFrame:
    """Per group: n_now (this run's rows), n_before (resumed ones), per_hour and eta_hours, by this run alone; null where it shows no rate."""
    own = F.when(~resumed, F.col(ts))
    found = rows.groupBy(*by).agg(F.count(own).alias("n_now"), F.count_if(resumed).alias("n_before"), (F.unix_micros(F.max(own).cast("timestamp")) - F.unix_micros(F.min(own).cast("timestamp"))).alias("_us"))
    hours = F.col("_us") / F.lit(3_600_000_000.0)
    rate = F.when((F.col("n_now") > 1) & (F.col("_us") > 0), (F.col("n_now") - 1) / hours)
    left = F.greatest(F.lit(remaining) - F.col("n_now") - F.col("n_before"), F.lit(0))
    return found.withColumn("per_hour", rate).withColumn("eta_hours", left / F.col("per_hour")).drop("_us")


def ranked_jobs(jobs: DataFrame, key: str, group: Column, ranks: dict[str, int]) -> DataFrame:
    """Adds grp, grp_rank (last for unknown groups) and turn: jobs in order of their group's rank, then of their key."""
    known = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    rows = jobs.withColumn("grp", group).withColumn("grp_rank", F.coalesce(known[F.col("grp")], F.lit(max(ranks.values()) + 7)))
    sizes = rows.groupBy("grp_rank").agg(F.count("*").alias("_m"))
    ahead = F.coalesce(F.sum("_m").over(Window.orderBy("grp_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a rank
    starts = F.broadcast(sizes.select("grp_rank", ahead.alias("_ahead")))  # as many rows as ranks
    return numbered(rows, ["grp_rank"], [key]).join(starts, "grp_rank").withColumn("turn", F.col("_ahead") + F.col("_i")).drop("_i", "_n", "_ahead")

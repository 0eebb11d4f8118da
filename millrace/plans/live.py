"""Queries over live feeds, worked off and read back: sessions, joins of two feeds, keys under watch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.records import _STAGES
from millrace.plans.registry import query
from millrace.sources.scratch import scratch_dir
from millrace.sources.versions import Versions
from millrace.streaming import bars as live
from millrace.streaming import sessions as S
from millrace.streaming import watch


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.event_stream(spark, f"{sf_dir}/event[s].parquet")


def worked_off(found: DataFrame) -> DataFrame:
    """Everything that a stream has to emit for the rows that are there: it runs when this is called."""
    spark = found.sparkSession
    out = scratch_dir(spark)
    live.run_to_files(found, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{out}/rows")


_MARK = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@query(f"""
WITH b AS (SELECT *, ts - lag(ts) OVER w > INTERVAL 6 HOUR AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM b)
SELECT user_id, min(ts) AS session_start, max(ts) AS last_seen, count(*) AS n_events, count(*) FILTER (event_type = 'purchase') AS n_purchases, max(value) AS top
FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= {_MARK}
""")
def live_sessions(spark, sf_dir):
    """Closed sessions of every user: six hours of silence end one."""
    sums = {"n_events": F.count("*"), "n_purchases": F.count_if(F.col("event_type") == "purchase"), "top": F.max("value")}
    return _plain(worked_off(S.sessions(feed(spark, sf_dir), ["user_id"], "6 hours", sums)), "session_start", "last_seen")


def _plain(frame: DataFrame, *times: str) -> DataFrame:
    return frame.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})


@query("""
WITH p AS (SELECT user_id, event_id AS purchase, ts FROM events WHERE event_type = 'purchase'),
v AS (SELECT user_id, event_id AS view, ts AS seen FROM events WHERE event_type = 'view'),
j AS (SELECT p.user_id, purchase, ts, view, seen FROM p LEFT JOIN v ON v.user_id = p.user_id AND seen <= ts AND seen >= ts - INTERVAL 12 HOUR)
SELECT * FROM j WHERE view IS NOT NULL OR ts <= (SELECT least((SELECT max(ts) FROM p), (SELECT max(seen) FROM v)) - INTERVAL 10 MINUTE)
""")
def live_view_before_purchase(spark, sf_dir):
    """Purchases with the views of the same user in the twelve hours before, from two feeds; without one, once none can come."""
    bought = feed(spark, sf_dir).where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), "ts")
    viewed = feed(spark, sf_dir).where("event_type = 'view'").select("user_id", F.col("event_id").alias("view"), F.col("ts").alias("seen"))
    return _plain(worked_off(S.joined(bought, viewed, ["user_id"], "ts", "seen", "12 hours", "left")), "ts", "seen")


@query(f"""
WITH g AS (SELECT user_id, ts AS last_seen, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events)
SELECT user_id, date_trunc('millisecond', last_seen) AS last_seen FROM g
WHERE coalesce(epoch_ms(after) - epoch_ms(last_seen) >= 43200000, epoch_ms(last_seen) + 43200000 <= epoch_ms({_MARK}))
""")
def live_silences(spark, sf_dir):
    """Users without a sign of life for twelve hours, told by a timer or by their next sign."""
    return _plain(worked_off(watch.silent(feed(spark, sf_dir), "user_id", "12 hours")), "last_seen")


@query(f"""
WITH o AS (SELECT *, event_type IN ('error', 'view') AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type IN ('error', 'view') ORDER BY ts, event_id) AS i
  FROM events WHERE epoch_ms(ts) < epoch_ms({_MARK})),
r AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id, i ORDER BY ts, event_id) AS n FROM o WHERE bad)
SELECT user_id, date_trunc('millisecond', min(ts)) AS ended_at, arg_min(event_id, ts) AS by_id FROM r WHERE n = 4 GROUP BY user_id
""")
def live_failures(spark, sf_dir):
    """Users whose fourth bad event in a row ended them."""
    return _plain(worked_off(watch.ended(feed(spark, sf_dir), "user_id", F.col("event_type").isin("error", "view"), "event_id", 4)), "ended_at")


@query(f"""
WITH m AS (SELECT user_id, event_type AS stage, epoch_ms(ts) AS ts, CASE WHEN value < 45 THEN 'done' WHEN value < 75 THEN 'running' ELSE 'failed' END AS status FROM events WHERE event_type <> 'error'),
k AS (SELECT user_id, stage, arg_max(status, (ts, status)) AS last, max(ts) AS ts, count(*) FILTER (status = 'failed') AS attempts FROM m GROUP BY ALL),
s AS (SELECT unnest(range(0, 4)) AS place, unnest(['signup', 'view', 'click', 'purchase']) AS stage),
a AS (SELECT u.user_id, s.place, s.stage, last, ts, coalesce(attempts, 0) AS attempts FROM (SELECT DISTINCT user_id FROM m) u CROSS JOIN s LEFT JOIN k ON k.user_id = u.user_id AND k.stage = s.stage),
o AS (SELECT *, CASE WHEN last IS NULL THEN 'pending' WHEN last = 'running' AND ts + 864000000 <= (SELECT max(ts) - 600000 FROM m) THEN 'pending' WHEN last = 'failed' AND attempts < 3 THEN 'pending' ELSE last END AS own FROM a),
r AS (SELECT *, coalesce(bool_and(own = 'done') OVER (PARTITION BY user_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS ready FROM o)
SELECT user_id, stage, CASE WHEN ready THEN own ELSE 'pending' END AS status, attempts, ready AND own = 'pending' AS next FROM r
""")
def live_stage_states(spark, sf_dir):
    """``stage_states`` from a feed, with the watermark as the present time."""
    status = F.when(F.col("value") < 45, "done").when(F.col("value") < 75, "running").otherwise("failed")
    marks = feed(spark, sf_dir).where("event_type <> 'error'").select("user_id", F.col("event_type").alias("stage"), "ts", status.alias("status"))
    return watch.latest(worked_off(watch.stages(marks, "user_id", _STAGES, "10 days")), "user_id")


@query("SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def live_upserts(spark, sf_dir):
    """The last event of every user, from a table of versions that a feed is merged into (it runs when this is called)."""
    out = scratch_dir(spark)
    rows = feed(spark, sf_dir).select("user_id", "ts", "event_id", "event_type", "value", F.struct("ts", "event_id").alias("at"))
    live.upserted(rows, "user_id", "at", f"{out}/table", f"{out}/checkpoint", 16).awaitTermination()
    return _plain(Versions(spark, f"{out}/table").read(rows.schema).drop("at"), "ts")

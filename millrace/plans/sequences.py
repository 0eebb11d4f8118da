"""Queries over ordered sequences: folds, neighbours, overlaps, samples, resumable work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import prices as P
from millrace.functions import text as X
from millrace.operators import folds, incremental, joins, quality, sampling, scans, stats
from millrace.plans.registry import query
from millrace.sources.readers import table

#: Events as rows of a sequence per user: whole seconds since the start of 2024.
EV_SQL = "(SELECT user_id, event_id, ts, event_type, value, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000000 AS sec FROM events)"


def seconds(ts: str = "ts") -> Column:
    return F.expr(f"(unix_micros(cast({ts} as timestamp)) - unix_micros(timestamp'2024-01-01 00:00:00')) div 1000000")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value", seconds().alias("sec"))


def _recursive(columns: str, first: str, step: str) -> str:
    """Folds of each user's events in order, row by row: the state columns, their first values, and their next (from f and e)."""
    return f"""
e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM {EV_SQL}),
f AS (
  SELECT user_id, i, event_id, sec, value, event_type, {first} FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.i, e.event_id, e.sec, e.value, e.event_type, {step} FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)"""


_RUNS_SQL = _recursive("run, anchor", "0 AS run, value AS anchor, true AS starts", """
  CASE WHEN abs(e.value - f.anchor) > 40 THEN f.run + 1 ELSE f.run END, CASE WHEN abs(e.value - f.anchor) > 40 THEN e.value ELSE f.anchor END, abs(e.value - f.anchor) > 40""")


def _runs(spark, sf_dir, limit=40.0):
    return folds.anchored_runs(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value", limit)


@query(f"WITH RECURSIVE {_RUNS_SQL} SELECT user_id, run::BIGINT AS run, min(sec) AS first_pos, max(sec) AS last_pos, count(*) AS n_rows FROM f GROUP BY ALL")
def run_clustering(spark, sf_dir):
    return folds.run_spans(_runs(spark, sf_dir), ["user_id"], "sec")


@query(f"""WITH RECURSIVE {_RUNS_SQL},
s AS (SELECT user_id, run, count(*) AS n, max(sec) - min(sec) + 1 AS d FROM f GROUP BY ALL),
l AS (SELECT list_sort(list(d)) AS d, count(*) AS n, sum(n) AS rows, count(*) FILTER (d = 1) AS ones FROM s)
SELECT n AS n_states, rows::BIGINT AS n_frames, d[round_even(0.5 * (n - 1), 0)::BIGINT + 1] AS p50, d[round_even(0.95 * (n - 1), 0)::BIGINT + 1] AS p95, ones AS n_one_second, n / rows::DOUBLE AS share FROM l""")
def dedupe_shape(spark, sf_dir):
    spans = folds.run_spans(_runs(spark, sf_dir), ["user_id"], "sec").withColumn("d", F.col("last_pos") - F.col("first_pos") + 1)
    places = stats.order_statistics(spans, [], "d", {"p50": stats.nearest_rank(0.5), "p95": stats.nearest_rank(0.95)}).drop("n")
    sums = spans.agg(F.count("*").alias("n_states"), F.sum("n_rows").alias("n_frames"), F.count_if(F.col("d") == 1).alias("n_one_second"))
    return sums.crossJoin(places).withColumn("share", F.col("n_states") / F.col("n_frames"))  # one row each


@query("WITH RECURSIVE t AS (SELECT unnest([20.0, 40.0, 80.0])::DOUBLE AS threshold)," + f"""
e AS (SELECT threshold, *, row_number() OVER (PARTITION BY threshold, user_id ORDER BY ts, event_id) AS i FROM {EV_SQL}, t),
f AS (SELECT threshold, user_id, i, 0 AS run, value AS anchor FROM e WHERE i = 1
  UNION ALL SELECT e.threshold, e.user_id, e.i, CASE WHEN abs(e.value - f.anchor) > e.threshold THEN f.run + 1 ELSE f.run END,
    CASE WHEN abs(e.value - f.anchor) > e.threshold THEN e.value ELSE f.anchor END
  FROM f JOIN e ON e.threshold = f.threshold AND e.user_id = f.user_id AND e.i = f.i + 1),
s AS (SELECT threshold, user_id, run, count(*) AS n FROM f GROUP BY ALL)
SELECT threshold, count(*) AS n_states, list_sort(list(n))[round_even(0.5 * (count(*) - 1), 0)::BIGINT + 1] AS median_rows, count(*) FILTER (n = 1) AS n_single,
  count(*) * 8.0::DOUBLE AS extrapolated FROM s GROUP BY threshold""")
def threshold_sweep(spark, sf_dir):
    grid = F.explode(F.array(F.lit(20.0), F.lit(40.0), F.lit(80.0))).alias("threshold")
    rows = events(spark, sf_dir).select(grid, "*")

    def step(state, row):
        x, limit = row
        return (state, (False,)) if state is not None and abs(x - state) <= limit else (x, (True,))

    marked = folds.folded(rows, ["threshold", "user_id"], ["ts", "event_id"], ["value", "threshold"], None, step, "starts boolean", ("starts", "run"))
    runs = marked.groupBy("threshold", "user_id", "run").agg(F.count("*").alias("n"))
    places = stats.order_statistics(runs, ["threshold"], "n", {"median_rows": stats.nearest_rank(0.5)}).drop("n")
    sums = runs.groupBy("threshold").agg(F.count("*").alias("n_states"), F.count_if(F.col("n") == 1).alias("n_single"))
    return sums.join(places, "threshold").withColumn("extrapolated", F.col("n_states") * F.lit(8.0))


@query(f"""WITH RECURSIVE {_RUNS_SQL},
c AS (SELECT user_id, event_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 60 AS jump FROM {EV_SQL}),
m AS (SELECT c.user_id, f.starts FROM c JOIN f USING (user_id, event_id) WHERE c.jump)
SELECT user_id, count(*) AS n_changes, count(*) FILTER (NOT starts) AS n_residual, count(*) FILTER (NOT starts) * 20 <= count(*) AS ok FROM m GROUP BY user_id""")
def residual_boundary(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    jumps = events(spark, sf_dir).withColumn("before", F.lag("value").over(w)).where(F.abs(F.col("value") - F.col("before")) > 60)
    return quality.residual_boundaries(jumps.select("user_id", "event_id"), runs.where("starts").select("user_id", "event_id"), ["user_id"], "event_id")


@query("WITH RECURSIVE " + _recursive("", "true AS kept, sec AS at, value AS v", """
  e.sec - f.at >= 21600 AND abs(e.value - f.v) > 25, CASE WHEN e.sec - f.at >= 21600 AND abs(e.value - f.v) > 25 THEN e.sec ELSE f.at END,
  CASE WHEN e.sec - f.at >= 21600 AND abs(e.value - f.v) > 25 THEN e.value ELSE f.v END""") + " SELECT user_id, event_id FROM f WHERE kept")
def drift_keep(spark, sf_dir):
    kept = folds.drift_kept(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "sec", "value", 21600, 25)
    return kept.where("kept").select("user_id", "event_id")


@query("WITH RECURSIVE " + _recursive("", "sec AS ws", "CASE WHEN e.sec - f.ws >= 86400 THEN e.sec ELSE f.ws END") + " SELECT user_id, ws AS window_start, count(*) AS n_rows FROM f GROUP BY ALL")
def restart_windows(spark, sf_dir):
    rows = folds.restarting_windows(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "sec", 86400)
    return rows.groupBy("user_id", "window_start").agg(F.count("*").alias("n_rows"))


@query("WITH RECURSIVE " + _recursive("", "'new' AS mark, sec AS at, event_type = 'purchase' AS p", """
  CASE WHEN e.sec - f.at >= 21600 THEN 'new' WHEN e.event_type = 'purchase' AND NOT f.p THEN 'replace' END,
  CASE WHEN e.sec - f.at >= 21600 OR (e.event_type = 'purchase' AND NOT f.p) THEN e.sec ELSE f.at END,
  CASE WHEN e.sec - f.at >= 21600 OR (e.event_type = 'purchase' AND NOT f.p) THEN e.event_type = 'purchase' ELSE f.p END""") + """,
m AS (SELECT *, lead(mark) OVER (PARTITION BY user_id ORDER BY i) AS after FROM f WHERE mark IS NOT NULL)
SELECT user_id, event_id, event_type FROM m WHERE after IS NULL OR after <> 'replace'""")
def min_gap_thinning(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("first", F.col("event_type") == "purchase")
    return folds.thinned(rows, ["user_id"], ["ts", "event_id"], "sec", "first", 21600).select("user_id", "event_id", "event_type")


@query(f"""
WITH p AS (SELECT DISTINCT user_id, sec // 3600 AS h FROM {EV_SQL}),
g AS (SELECT user_id, coalesce(lag(h) OVER (PARTITION BY user_id ORDER BY h), 0) AS lo, h AS hi FROM p UNION ALL SELECT user_id, max(h), 720 FROM p GROUP BY user_id)
SELECT user_id, unnest(range(lo + 12, hi, 12)) AS h FROM g WHERE hi - lo > 12
""")
def gap_fill(spark, sf_dir):
    picks = events(spark, sf_dir).select("user_id", F.expr("sec div 3600").alias("h"), F.lit(720).cast("bigint").alias("end")).distinct()
    return folds.gap_points(picks, ["user_id"], "h", "end", 12)


@query(f"""
WITH o AS (SELECT user_id, sec // 21600 AS slot, CASE WHEN event_type IN ('purchase', 'signup') THEN event_type ELSE '' END AS label, event_id FROM {EV_SQL}),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, slot ORDER BY (label <> '') DESC, event_id) AS i FROM o)
SELECT user_id, slot, label, event_id FROM k WHERE i = 1
""")
def candidate_upsert(spark, sf_dir):
    label = F.when(F.col("event_type").isin("purchase", "signup"), F.col("event_type")).otherwise("")
    offers = events(spark, sf_dir).select("user_id", F.expr("sec div 21600").alias("slot"), label.alias("label"), "event_id")
    return folds.upserted_candidates(offers, ["user_id"], "slot", "label", ["event_id"])


@query(f"""
WITH s AS (SELECT user_id, sec AS start, sec + 1 + regexp_extract(props, '"k": (\\d+)', 1)::BIGINT AS "end", event_type AS text, event_id FROM {EV_SQL} JOIN (SELECT event_id, props FROM events) USING (event_id)),
u AS (SELECT DISTINCT user_id, unnest(range(0, 120)) * 21600 - 15 AS lo FROM s)
SELECT u.user_id, lo, string_agg(text, ' ' ORDER BY start, event_id) AS text, count(*) AS n_parts FROM u JOIN s ON s.user_id = u.user_id AND s."end" > lo AND s.start < lo + 21630 GROUP BY ALL
""")
def overlap_join_text(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("bigint")
    rows = table(spark, sf_dir, "events").select("user_id", seconds().alias("start"), (seconds() + 1 + k).alias("end"), F.col("event_type").alias("text"), "event_id")
    lo = F.explode(F.transform(F.sequence(F.lit(0), F.lit(119)), lambda k: k.cast("bigint") * 21600 - 15)).alias("lo")
    spans = rows.select("user_id").distinct().select("user_id", lo).withColumn("hi", F.col("lo") + 21630)
    met = joins.overlapping(rows, spans, ["user_id"], 21600)
    return joins.text_in_order(met, ["user_id", "lo"], ["start", "event_id"], "text")


@query(f"""
WITH k AS (SELECT user_id, sec AS t, lead(sec) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM {EV_SQL} WHERE event_type = 'purchase'),
s AS (SELECT user_id, sec AS start, sec + 60 AS "end", event_type AS text, event_id FROM {EV_SQL} WHERE event_type <> 'purchase')
SELECT k.user_id, t, string_agg(text, ' ' ORDER BY start, event_id) AS narration, count(*) AS n_parts
FROM k JOIN s ON s.user_id = k.user_id AND s."end" > t - 5 AND s.start < coalesce(next, 9999999) GROUP BY ALL
""")
def lead_span_join(spark, sf_dir):
    rows = events(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    keys = rows.where("event_type = 'purchase'").select("user_id", F.col("sec").alias("t"), F.lead("sec").over(w).alias("next"))
    spans = keys.select("user_id", "t", (F.col("t") - 5).alias("lo"), F.coalesce("next", F.lit(9999999)).alias("hi"))
    said = rows.where("event_type <> 'purchase'").select("user_id", F.col("sec").alias("start"), (F.col("sec") + 60).alias("end"), F.col("event_type").alias("text"), "event_id")
    return joins.text_in_order(joins.overlapping(said, spans, ["user_id"], 86400), ["user_id", "t"], ["start", "event_id"], "text", "narration")


@query("""
WITH s AS (SELECT o_custkey, o_orderstatus, min(date_diff('day', TIMESTAMP '1990-01-01', o_orderdate)) AS lo, max(date_diff('day', TIMESTAMP '1990-01-01', o_orderdate)) AS hi FROM orders GROUP BY ALL),
t AS (SELECT *, hi >= 2900 AND lo <= 3200 AS meets, lo <= 2900 AND hi >= 3200 AS covers FROM s)
SELECT o_custkey, count(*) FILTER (meets) AS n_overlap, count(*) FILTER (covers) AS n_cover, count(*) FILTER (meets) = 1 AND count(*) FILTER (covers) = 1 AS ok FROM t GROUP BY o_custkey
""")
def interval_cover(spark, sf_dir):
    day = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("bigint")
    spans = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    meets, covers = (F.col("hi") >= 2900) & (F.col("lo") <= 3200), (F.col("lo") <= 2900) & (F.col("hi") >= 3200)
    found = spans.groupBy("o_custkey").agg(F.count_if(meets).alias("n_overlap"), F.count_if(covers).alias("n_cover"))
    return found.withColumn("ok", (F.col("n_overlap") == 1) & (F.col("n_cover") == 1))


@query("""
SELECT a.conv_id, a.turn AS a_pos, a.role AS a_role, b.role AS b_role, length(b.text) - length(a.text) AS longer
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
""")
def adjacent_pairs(spark, sf_dir):
    pairs = joins.adjacent(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", ["role", "text"])
    return pairs.select("conv_id", "a_pos", "a_role", "b_role", (F.char_length("b_text") - F.char_length("a_text")).cast("bigint").alias("longer"))


@query(f"""
WITH h AS (SELECT event_type, sec // 3600 AS h, count(*) AS n FROM {EV_SQL} GROUP BY ALL),
o AS (SELECT a.event_type, a.h, b.h - a.h AS off, b.n FROM h a JOIN h b ON a.event_type = b.event_type AND b.h BETWEEN a.h - 2 AND a.h + 2),
m AS (SELECT event_type, h, min(n) AS least, max(n) FILTER (off = 0) AS own, count(*) AS n_offsets FROM o GROUP BY ALL)
SELECT event_type, h, least, n_offsets, own = least AS optimal, least <= 8 AS bounded FROM m
""")
def offset_lookup(spark, sf_dir):
    counts = events(spark, sf_dir).groupBy("event_type", F.expr("sec div 3600").alias("h")).agg(F.count("*").alias("n"))
    met = joins.at_offsets(counts, ["event_type"], "h", "n", 2)
    best = met.groupBy("event_type", "h").agg(F.min("found").alias("least"), F.count("*").alias("n_offsets"), F.max(F.when(F.col("offset") == 0, F.col("found"))).alias("own"))
    return best.select("event_type", "h", "least", "n_offsets", (F.col("own") == F.col("least")).alias("optimal"), (F.col("least") <= 8).alias("bounded"))


_HASH_SQL = "list_reduce([0::BIGINT] || list_transform(range(0, 56), lambda j: CASE WHEN e[j // 7 * 8 + j % 7 + 1] > e[j // 7 * 8 + j % 7 + 2] THEN 1::BIGINT ELSE 0::BIGINT END), lambda x, y: x * 2 + y)"
_V_SQL = f"v AS (SELECT vec_id, label, e, {_HASH_SQL} AS h FROM (SELECT vec_id, label, embedding AS e FROM embeddings))"


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", X.gradient_hash("embedding").alias("h"))


@query(f"""
WITH RECURSIVE {_V_SQL},
o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM v),
g AS (SELECT label, i, vec_id, [h] AS anchors, 0 AS grp FROM o WHERE i = 1
  UNION ALL SELECT o.label, o.i, o.vec_id, CASE WHEN k IS NULL THEN anchors || [o.h] ELSE anchors END, coalesce(k - 1, len(anchors))
  FROM (SELECT g.*, o.h, o.vec_id AS next_id, list_position(list_transform(anchors, lambda a: bit_count(xor(a, o.h)) <= 20), true) AS k FROM g JOIN o ON o.label = g.label AND o.i = g.i + 1) x
  JOIN o ON o.label = x.label AND o.i = x.i + 1)
SELECT label, vec_id, grp::BIGINT AS recur_group FROM g
""")
def recurrence_groups(spark, sf_dir):
    return folds.greedy_groups(vectors(spark, sf_dir).drop("embedding"), ["label"], ["vec_id"], "h", 20).select("label", "vec_id", "recur_group")


@query(f"""
WITH {_V_SQL}, p AS (SELECT a.label, a.vec_id, sum(bit_count(xor(a.h, b.h)))::BIGINT AS total FROM v a JOIN v b ON a.label = b.label GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY total, vec_id DESC) AS i, count(*) OVER (PARTITION BY label) AS n FROM p)
SELECT label, vec_id, total AS total_distance, n AS n_members FROM k WHERE i = 1
""")
def medoid_per_run(spark, sf_dir):
    return folds.medoids(vectors(spark, sf_dir).drop("embedding"), ["label"], "vec_id", "h")


@query(f"""
WITH {_V_SQL}
SELECT a.vec_id, lower(printf('%014x', a.h)) AS dhash, bit_count(xor(a.h, b.h))::INTEGER AS distance FROM v a JOIN v b ON b.vec_id = a.vec_id + 1
""")
def dhash_hamming(spark, sf_dir):
    v = vectors(spark, sf_dir)
    pairs = v.select("vec_id", "h").join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("h").alias("other")), "vec_id")
    return pairs.select("vec_id", F.lower(F.lpad(F.hex("h"), 14, "0")).alias("dhash"), X.hamming("h", "other").alias("distance"))


@query("""
WITH o AS (SELECT vec_id, label, embedding AS e, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings)
SELECT vec_id, len(list_filter(list_zip(e, p), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE) > 0.1))::INTEGER AS n_changed,
  len(list_filter(list_zip(e, p), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE) > 0.1)) / 64.0::DOUBLE AS share FROM o WHERE p IS NOT NULL
""")
def cell_diff(spark, sf_dir):
    rows = scans.previous(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), ["label"], ["vec_id"], {"embedding": "p"}).where("p is not null")
    return rows.select("vec_id", X.changed_cells("embedding", "p", 0.1).alias("n_changed"), X.changed_share("embedding", "p", 0.1).alias("share"))


@query(f"""
WITH t AS (SELECT conv_id, turn, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (turn * 7919 % 13) AS ts FROM conversations),
m AS (SELECT *, row_number() OVER w - 1 AS i, lag(ts) OVER w AS before, lag(turn) OVER w AS same FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, ts))
SELECT conv_id, count(*) AS n, count(*) FILTER (turn <> i) = 0 AS contiguous, count(*) FILTER (ts < before - INTERVAL 5 MINUTE) AS n_back, count(*) FILTER (turn = same) AS n_repeated FROM m GROUP BY conv_id
""")
def sequence_checks(spark, sf_dir):
    minutes = F.expr("make_dt_interval(0, 0, cast(turn * 7919 % 13 as int), 0)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.expr("timestamp_ntz'2024-01-01 00:00:00'") + minutes).alias("ts"))
    return quality.sequence_report(rows, ["conv_id"], "turn", "ts", "5 minutes")


#: Conversations as transcripts, some with a loop of thirty turns that say the same (every tenth: the same blanks).
_LOOPED_SQL = """(SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT conv_id, 1000 + k, role, CASE WHEN conv_id % 10 = 5 THEN '  ' ELSE text || ' ' END FROM conversations, (SELECT unnest(range(1, 31)) AS k) WHERE turn = 0 AND conv_id % 5 = 0)"""
_STRIPPED_SQL = "trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def _looped(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.when(F.col("conv_id") % 10 == 5, "  ").otherwise(F.concat("text", F.lit(" ")))
    turns = F.explode(F.sequence(F.lit(1001).cast("bigint"), F.lit(1030).cast("bigint")))
    return rows.unionByName(rows.where("turn = 0 and conv_id % 5 = 0").select("conv_id", turns.alias("turn"), "role", said.alias("text")))


@query(f"""
WITH m AS (SELECT conv_id, t, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM (SELECT conv_id, turn, {_STRIPPED_SQL} AS t FROM {_LOOPED_SQL}))
SELECT conv_id, count(*) AS n, count(*) FILTER (t = b AND t <> '') AS n_repeats, count(*) > 20 AND count(*) FILTER (t = b AND t <> '') > count(*) * 0.35::DOUBLE AS looping FROM m GROUP BY conv_id
""")
def repeat_ratio(spark, sf_dir):
    return quality.repeat_ratio(_looped(spark, sf_dir), ["conv_id"], ["turn"], "text")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def last_wins_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return incremental.last_wins(rows, ["user_id"], ["ts", "event_id"]).drop("ts")


_NUMBERED_SQL = "(SELECT doc_id, lang, source, row_number() OVER (PARTITION BY {0} ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY {0}) AS n FROM documents)"


@query(f"SELECT source, doc_id FROM {_NUMBERED_SQL.format('source')} WHERE list_contains([least(floor(n * (2 * k + 1) / 6)::BIGINT, n - 1) for k in [0, 1, 2]], i)")
def per_group_even_pick(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return sampling.even_pick(docs, ["source"], ["doc_id"], 3)


@query(f"SELECT lang, doc_id FROM {_NUMBERED_SQL.format('lang')} WHERE n <= 25 OR list_contains([round_even(k * (n - 1) / 24.0::DOUBLE, 0)::BIGINT for k in range(0, 25)], i)")
def stride_sample(spark, sf_dir):
    return sampling.stride_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], ["doc_id"], 25)


@query("""
WITH g AS (SELECT lang, row_number() OVER (ORDER BY lang) AS g, count(*) OVER () AS all_groups FROM (SELECT DISTINCT lang FROM documents)),
q AS (SELECT lang, 101 // all_groups + CASE WHEN g <= 101 % all_groups THEN 1 ELSE 0 END AS quota FROM g),
d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id::VARCHAR), doc_id) AS i FROM documents)
SELECT lang, doc_id FROM d JOIN q USING (lang) WHERE i <= quota
""")
def hash_quota_sample(spark, sf_dir):
    return sampling.quota_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 101, "7")


@query("""
WITH z AS (SELECT lang || '/' || source AS stratum, count(*) AS size FROM documents GROUP BY 1),
a AS (SELECT *, least(3, size) AS least_n, sum(least(3, size)) OVER () AS given, sum(size - least(3, size)) OVER () AS pool FROM z),
b AS (SELECT *, greatest(400 - given, 0)::BIGINT AS rest, (size - least_n)::BIGINT AS room FROM a),
c AS (SELECT *, least(size, least_n + (rest * room) // pool::BIGINT) AS first_n, (rest * room) % pool::BIGINT AS remainder FROM b),
s AS (SELECT *, (least(400, sum(size) OVER ()) - sum(first_n) OVER ())::BIGINT AS short FROM c),
u AS (SELECT stratum, size, first_n, short, unnest(range(1, least(size - first_n, greatest(short, 1)) + 1)) AS round, remainder FROM s WHERE size > first_n),
t AS (SELECT stratum, count(*) AS extra FROM (SELECT *, row_number() OVER (ORDER BY round, remainder DESC, stratum) AS turn FROM u) WHERE turn <= short GROUP BY 1)
SELECT s.stratum, s.size, (s.first_n + coalesce(t.extra, 0))::BIGINT AS quota FROM s LEFT JOIN t USING (stratum)
""")
def stratified_allocation(spark, sf_dir):
    sizes = table(spark, sf_dir, "documents").groupBy(F.concat("lang", F.lit("/"), "source").alias("stratum")).agg(F.count("*").alias("size"))
    return sampling.allocation(sizes, "stratum", "size", 400, 3)


@query(f"SELECT event_id, printf('%02d:%02d:%02d', sec // 3600, sec % 3600 // 60, sec % 60) AS clock, printf('%dh%02dm', sec // 3600, sec % 3600 // 60) AS spoken, least(sec, 86400) AS clamped, '00:00:00' AS negative FROM {EV_SQL}")
def hms_format(spark, sf_dir):
    rows = events(spark, sf_dir)
    return rows.select("event_id", P.clock("sec").alias("clock"), P.spoken("sec").alias("spoken"), F.least("sec", F.lit(86400)).alias("clamped"), P.clock(F.lit(-5)).alias("negative"))


@query("""
WITH d AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'error' ELSE 'ok' END AS status, doc_id % 5 AS attempts FROM labels)
SELECT x.doc_id, coalesce(d.attempts, 0) AS attempts_so_far FROM documents x LEFT JOIN d USING (doc_id) WHERE d.status IS NULL OR (d.status = 'error' AND d.attempts < 3)
""")
def retriable_work(spark, sf_dir):
    done = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "error").otherwise("ok").alias("status"), (F.col("doc_id") % 5).alias("attempts"))
    return incremental.still_to_do(table(spark, sf_dir, "documents").select("doc_id"), done, "doc_id")


@query("SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-01-31' - INTERVAL 12 HOUR")
def stale_heartbeat(spark, sf_dir):
    return incremental.stale(table(spark, sf_dir, "events"), ["user_id"], "ts", F.expr("timestamp_ntz'2024-01-31 00:00:00'"), "12 hours")


@query("""
WITH o AS (SELECT user_id, event_type IN ('error', 'view') AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type IN ('error', 'view') ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, i, count(*) AS n FROM o WHERE bad GROUP BY ALL)
SELECT user_id, max(n) AS longest FROM r GROUP BY 1 HAVING max(n) >= 4
""")
def consecutive_failures(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("bad", F.col("event_type").isin("error", "view"))
    return folds.failure_runs(rows, ["user_id"], ["ts", "event_id"], "bad", 4)


@query("""
WITH p AS (SELECT strftime(ts, '%Y-%m-%d') AS period, count(*) AS n_done FROM events WHERE event_type <> 'error' GROUP BY 1)
SELECT period, n_done, (sum(n_done) OVER w)::BIGINT AS so_far, greatest(10000 - sum(n_done) OVER w, 0)::BIGINT AS remaining FROM p WINDOW w AS (ORDER BY period)
""")
def progress_rate(spark, sf_dir):
    return incremental.progress(table(spark, sf_dir, "events"), F.date_format("ts", "yyyy-MM-dd"), F.col("event_type") != "error", 10000)


@query(f"""
WITH s AS (SELECT conv_id, turn AS i, role, text, turn * 10 - CASE WHEN (conv_id + turn) % 23 = 0 THEN 12 ELSE 0 END AS start, turn * 10 + 8 AS "end" FROM {_LOOPED_SQL}),
v AS (SELECT conv_id, CASE WHEN conv_id % 8 = 0 THEN ['keyframes'] ELSE [] END AS undone, (max(i) + 1) * CASE WHEN conv_id % 6 = 0 THEN 15 ELSE 10 END AS duration FROM s GROUP BY 1),
l AS (SELECT conv_id, start, "end", {_STRIPPED_SQL} AS t, lag(start) OVER w AS before, lag({_STRIPPED_SQL}) OVER w AS same FROM s WHERE conv_id % 17 <> 0 WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
f AS (SELECT conv_id, count(*) AS n_segments, count(*) FILTER (start < before - 0.5) AS n_back, max("end") AS last_end, count(*) FILTER (t = same AND t <> '') AS n_repeats FROM l GROUP BY 1),
o AS (SELECT conv_id, count(*) AS n_moments, count(*) FILTER (start - conv_id % 30 < 0) AS n_outside FROM s WHERE role = 'user' GROUP BY 1),
k AS (SELECT conv_id, count(*) AS n_frames, count(*) - CASE WHEN conv_id % 7 = 0 THEN 1 ELSE 0 END AS n_files, count(*) FILTER (length(text) < 20) AS n_tiny,
  count(*) FILTER (start < before) AS n_unsorted FROM (SELECT *, lag(start) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM s WHERE role = 'assistant') GROUP BY conv_id),
z AS (SELECT conv_id, undone, duration, coalesce(n_segments, 0) AS n_segments, coalesce(n_back, 0) AS n_back, coalesce(last_end, 0) AS last_end, coalesce(n_repeats, 0) AS n_repeats, coalesce(n_moments, 0) AS n_moments,
  coalesce(n_outside, 0) AS n_outside, coalesce(n_frames, 0) AS n_frames, coalesce(n_files, 0) AS n_files, coalesce(n_tiny, 0) AS n_tiny, coalesce(n_unsorted, 0) AS n_unsorted
  FROM v LEFT JOIN f USING (conv_id) LEFT JOIN o USING (conv_id) LEFT JOIN k USING (conv_id)),
g AS (SELECT *, n_segments > 0 AND last_end < duration * 0.85 AS uncovered, n_segments > 20 AND n_repeats > n_segments * 0.35::DOUBLE AS loop FROM z)
SELECT conv_id, concat_ws(',', CASE WHEN len(undone) > 0 THEN 'undone' END, CASE WHEN n_segments = 0 THEN 'no_transcript' END, CASE WHEN n_back > 0 THEN 'back' END, CASE WHEN uncovered THEN 'uncovered' END,
  CASE WHEN loop THEN 'loop' END, CASE WHEN n_outside > 0 THEN 'outside' END, CASE WHEN n_moments = 0 THEN 'silent' END, CASE WHEN n_frames = 0 THEN 'no_frames' END, CASE WHEN n_frames BETWEEN 1 AND 2 THEN 'few_frames' END,
  CASE WHEN n_frames <> n_files THEN 'files_differ' END, CASE WHEN n_tiny > 0 THEN 'tiny_files' END, CASE WHEN n_unsorted > 0 THEN 'unsorted' END) AS issues,
  concat_ws(',', CASE WHEN n_frames < 3 OR n_frames <> n_files OR n_tiny > 0 OR n_unsorted > 0 OR len(undone) > 0 THEN 'keyframes' END, CASE WHEN n_outside > 0 THEN 'moments' END,
    CASE WHEN n_segments = 0 OR n_back > 0 OR uncovered OR loop THEN 'transcribe' END) AS redo FROM g
""")
def video_qa_redo(spark, sf_dir):
    late = F.when((F.col("conv_id") + F.col("turn")) % 23 == 0, 12).otherwise(0)
    rows = _looped(spark, sf_dir).select("conv_id", F.col("turn").alias("i"), "role", "text", (F.col("turn") * 10 - late).alias("start"), (F.col("turn") * 10 + 8).alias("end"))
    undone = F.when(F.col("conv_id") % 8 == 0, F.array(F.lit("keyframes"))).otherwise(F.array().cast("array<string>"))
    videos = rows.groupBy("conv_id").agg(((F.max("i") + 1) * F.when(F.col("conv_id") % 6 == 0, 15).otherwise(10)).alias("duration")).withColumn("undone", undone)
    said = quality.transcript_facts(rows.where("conv_id % 17 <> 0"), ["conv_id"], "start", "end", "text")
    moments = rows.where("role = 'user'").groupBy("conv_id").agg(F.count("*").alias("n_moments"), F.count_if(F.col("start") - F.col("conv_id") % 30 < 0).alias("n_outside"))
    w = Window.partitionBy("conv_id").orderBy("i")
    frames = rows.where("role = 'assistant'").withColumn("before", F.lag("start").over(w)).groupBy("conv_id").agg(
        F.count("*").alias("n_frames"), (F.count("*") - F.when(F.col("conv_id") % 7 == 0, 1).otherwise(0)).alias("n_files"),
        F.count_if(F.char_length("text") < 20).alias("n_tiny"), F.count_if(F.col("start") < F.col("before")).alias("n_unsorted"),
    )
    facts = videos.join(said, "conv_id", "left").join(moments, "conv_id", "left").join(frames, "conv_id", "left")
    found = quality.recording_gates(facts)
    return found.select("conv_id", F.array_join("issues", ",").alias("issues"), F.array_join("redo", ",").alias("redo"))


@query("SELECT conv_id, count(*) AS n_turns, count(*) FILTER (role = 'user') AS n_user, sum(length(text))::BIGINT AS n_chars, arg_min(left(text, 40), turn) AS title FROM conversations GROUP BY 1")
def video_manifest(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), F.count_if(F.col("role") == "user").alias("n_user"), F.sum(F.char_length("text")).cast("bigint").alias("n_chars"),
        F.min_by(F.left("text", F.lit(40)), "turn").alias("title"),
    )


@query("""
WITH b AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS bar_ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close,
  sum(regexp_extract(props, '"k": (\\d+)', 1)::BIGINT)::BIGINT AS volume, count(*) AS n_trades FROM events GROUP BY 1)
SELECT * FROM b WHERE bar_ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)
""")
def streaming_bars(spark, sf_dir):
    """The event file as a stream, worked off; closed bars from the sink."""
    from millrace.sources.scratch import scratch_dir
    from millrace.streaming import bars as live

    out = scratch_dir(spark)
    query_ = live.run_to_files(live.streaming_bars(live.event_stream(spark, f"{sf_dir}/event[s].parquet")), f"{out}/bars", f"{out}/checkpoint")
    query_.awaitTermination()
    return spark.read.parquet(f"{out}/bars")

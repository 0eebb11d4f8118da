"""Queries over records, jobs and files: crosschecks, repairs, budgets, states of stages, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import prices as P
from millrace.functions import text as X
from millrace.operators import bars as B
from millrace.operators import folds, incremental, joins, quality, sampling
from millrace.plans.market import _frames, _observed, _observed_sql, _ticks_sql, trades
from millrace.plans.market import _AGREE as AGREE
from millrace.plans.market import LEGS
from millrace.plans.registry import bars_sql, query
from millrace.plans.sequences import _V_SQL, vectors
from millrace.plans.texts import _LADDER_SQL, _line_table
from millrace.sources import dbn, readers, sinks
from millrace.sources.readers import table
from millrace.sources.scratch import scratch_dir, stored

_CHANGED_SQL = "len(list_filter(list_zip({0}, {1}), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE) > 0.1)) / 64.0::DOUBLE"


@query(f"""
WITH RECURSIVE {_V_SQL},
o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM v),
f AS (SELECT label, i, vec_id, h AS anchor, e AS cells, 0 AS run, NULL::VARCHAR AS reason, 0.0::DOUBLE AS share FROM o WHERE i = 1
  UNION ALL SELECT label, i, vec_id, CASE WHEN why IS NULL THEN anchor ELSE h END, CASE WHEN why IS NULL THEN cells ELSE e END, CASE WHEN why IS NULL THEN run ELSE run + 1 END, why, CASE WHEN why IS NULL THEN far ELSE 0 END
  FROM (SELECT x.*, CASE WHEN bit_count(xor(anchor, h)) > 28 THEN 'dhash' WHEN far > 0.9 THEN 'fine' END AS why
    FROM (SELECT o.label, o.i, o.vec_id, o.h, o.e, f.anchor, f.cells, f.run, {_CHANGED_SQL.format('o.e', 'f.cells')} AS far FROM f JOIN o ON o.label = f.label AND o.i = f.i + 1) x) y),
r AS (SELECT label, run, min(vec_id) AS first_pos, max(vec_id) AS last_pos, count(*) AS n_rows, max(share) AS max_share FROM f GROUP BY ALL),
s AS (SELECT label, run, reason FROM f WHERE reason IS NOT NULL)
SELECT r.label, r.run::BIGINT AS run, first_pos, last_pos, n_rows, max_share, coalesce(s.reason, 'eof') AS split_reason FROM r LEFT JOIN s ON s.label = r.label AND s.run = r.run + 1
""")
def state_clustering(spark, sf_dir):
    runs = folds.clustered_runs(vectors(spark, sf_dir), ["label"], ["vec_id"], "h", "embedding", 28, 0.1, 0.9)
    spans = runs.groupBy("label", "run").agg(F.min("vec_id").alias("first_pos"), F.max("vec_id").alias("last_pos"), F.count("*").alias("n_rows"), F.max("share").alias("max_share"))
    ends = runs.where("reason is not null").select("label", (F.col("run") - 1).alias("run"), "reason")  # why the run before ended
    return spans.join(ends, ["label", "run"], "left").withColumn("split_reason", F.coalesce("reason", F.lit("eof"))).drop("reason")


@query(f"""
WITH b AS {bars_sql('1 day')},
r AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'n/a' ELSE '$' || ((p_partkey % 400) * 1.25)::DECIMAL(9, 2)::VARCHAR END AS raw, p_partkey % 5 <> 0 AS has_bars FROM part),
v AS (SELECT *, TRY_CAST(replace(raw, '$', '') AS DOUBLE) AS parsed FROM r),
l AS (SELECT bar_ts, unnest([0, 1, 2, 3]) AS ord, unnest([open, high, low, close]) AS leg FROM b),
m AS (SELECT p_partkey, bar_ts, ord, leg, round(abs(parsed - leg) / 0.25, 2) AS delta FROM v, l WHERE parsed IS NOT NULL AND has_bars),
k AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY delta, bar_ts, ord) AS i FROM m),
e AS (SELECT min(low) AS lo, max(high) AS hi FROM b)
SELECT v.p_partkey, raw, parsed, parsed IS NOT NULL AND has_bars AND parsed BETWEEN lo AND hi AS in_range, CASE WHEN k.delta <= 40 THEN k.bar_ts END AS match_ts, CASE WHEN k.delta <= 40 THEN ['open', 'high', 'low', 'close'][ord + 1] END AS match_field,
  CASE WHEN parsed IS NULL THEN 'unparseable' WHEN NOT has_bars THEN 'no_bars' WHEN k.delta <= 40 THEN 'ohlc_match' WHEN parsed BETWEEN lo AND hi THEN 'in_range_no_match' ELSE 'out_of_range' END AS verdict
FROM v LEFT JOIN k ON k.p_partkey = v.p_partkey AND k.i = 1 CROSS JOIN e
""")
def level_crosscheck(spark, sf_dir):
    text = F.concat(F.lit("$"), ((F.col("p_partkey") % 400) * F.lit(1.25)).cast("decimal(9,2)").cast("string"))
    raw = F.when(F.col("p_partkey") % 11 == 0, "n/a").otherwise(text)
    levels = table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"), P.price(raw).alias("parsed"), (F.col("p_partkey") % 5 != 0).alias("has_bars"))
    found = quality.level_verdicts(levels, stored(B.bars(trades(spark, sf_dir), "D")), "p_partkey", "parsed", "has_bars", 40, 8)
    match = F.col("verdict") == "ohlc_match"
    return found.select("p_partkey", "raw", "parsed", F.coalesce("in_range", F.lit(False)).alias("in_range"), F.when(match, F.col("bar_ts")).alias("match_ts"), F.when(match, F.col("field")).alias("match_field"), "verdict")


_COMBO = "concat_ws('', " + ", ".join(f"CASE WHEN o.{x} = b.{x} THEN '{x[0].upper()}' END" for x in LEGS) + ")"


@query(f"""
WITH h AS (SELECT o.obs, b.bar, {_COMBO} AS legs FROM {_observed_sql(1)} o JOIN {_ticks_sql('1 day')} b ON {AGREE} >= 3),
u AS (SELECT obs FROM h GROUP BY 1 HAVING count(*) = 1)
SELECT legs, count(*) AS n FROM h JOIN u USING (obs) GROUP BY legs
""")
def leg_combinations(spark, sf_dir):
    hits = joins.k_of_n(_observed(spark, sf_dir, 1), _frames(spark, sf_dir)["D"], LEGS, 3, "obs", "bar")
    unique = hits.groupBy("obs").agg(F.count("*").alias("n"), F.max("agreeing").alias("agreeing")).where("n = 1")
    combo = F.array_join(F.transform(F.split("agreeing", ","), lambda x: F.upper(F.left(x, F.lit(1)))), "")
    return unique.groupBy(combo.alias("legs")).agg(F.count("*").alias("n"))


@query(f"""
WITH {_LADDER_SQL},
k AS (SELECT *, CASE WHEN regexp_full_match(line, '\\d+') THEN 'price' WHEN regexp_full_match(line, '\\d\\d:30') THEN 'time' END AS kind FROM l),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY l_orderkey, kind ORDER BY pos) AS island FROM k),
c AS (SELECT *, (kind IS NOT NULL AND count(*) OVER (PARTITION BY l_orderkey, kind, island) >= 4) OR line = 'Jan Feb 1 2 3 4 5' AS gone FROM i),
t AS (SELECT l_orderkey, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS stripped, string_agg(line, chr(10) ORDER BY pos) AS was, count(*) FILTER (gone) AS n_removed FROM c GROUP BY 1),
f AS (SELECT *, CASE WHEN l_orderkey % 2 = 0 THEN regexp_replace(stripped, '\\bPDH\\b', 'PHOW', 'g') ELSE stripped END AS text FROM t)
SELECT l_orderkey, text, n_removed, CASE WHEN l_orderkey % 2 = 0 THEN len(regexp_extract_all(stripped, '\\bPDH\\b')) ELSE 0 END AS n_repairs, text <> was AS changed,
  len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS n_lines FROM f
""")
def rederived_text(spark, sf_dir):
    """The text of a record is always strip(raw) and then the repairs of its scope: done twice, it is the same."""
    lines = _line_table(spark, sf_dir)
    kind = F.when(F.trim("line").rlike(X.AXIS_PRICE), "price").when(F.trim("line").rlike(X.AXIS_TIME), "time")
    marked = folds.line_runs(lines.withColumn("kind", kind), ["l_orderkey"], "pos", "kind", X.AXIS_RUN)
    gone = F.col("in_run") | X.inline_axis("line")
    text = lambda which: F.array_join(F.transform(F.array_sort(F.collect_list(which)), lambda x: x["line"]), "\n")
    raw = marked.groupBy("l_orderkey").agg(text(F.struct("pos", "line")).alias("was"), text(F.when(~gone, F.struct("pos", "line"))).alias("stripped"), F.count_if(gone).alias("n_removed"))
    fixed, n = quality.repaired(F.col("stripped"), X.token_pattern("PDH"), "PHOW")
    scope = F.col("l_orderkey") % 2 == 0
    found = raw.withColumn("text", F.when(scope, fixed).otherwise(F.col("stripped"))).withColumn("n_repairs", F.when(scope, n).otherwise(0).cast("bigint"))
    n_lines = F.size(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")).cast("bigint")
    return found.select("l_orderkey", "text", "n_removed", "n_repairs", (F.col("text") != F.col("was")).alias("changed"), n_lines.alias("n_lines"))


@query("""
WITH g AS (SELECT l_orderkey, list({'label': l_returnflag || ' R', 'value': l_quantity::BIGINT::VARCHAR} ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS levels,
  list(l_shipdate_text ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS notes FROM (SELECT *, 'R-' || l_linestatus || ' AR R' AS l_shipdate_text FROM lineitem) GROUP BY 1)
SELECT l_orderkey, array_to_string(list_transform(levels, lambda x: regexp_replace(x.label, '\\bR\\b', 'PR', 'g') || '=' || x.value), ';') AS labels,
  array_to_string(list_transform(notes, lambda x: regexp_replace(x, '\\bR\\b', 'PR', 'g')), ';') AS notes,
  (list_sum(list_transform(levels, lambda x: len(regexp_extract_all(x.label, '\\bR\\b')))) + list_sum(list_transform(notes, lambda x: len(regexp_extract_all(x, '\\bR\\b')))))::BIGINT AS n_repairs FROM g
""")
def nested_repair(spark, sf_dir):
    """A token replaced in the labels of nested levels and in annotations; values stay, replacements are counted."""
    level = F.struct(F.concat("l_returnflag", F.lit(" R")).alias("label"), F.col("l_quantity").cast("bigint").cast("string").alias("value"))
    note = F.concat(F.lit("R-"), "l_linestatus", F.lit(" AR R"))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", level.alias("level"), note.alias("note"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(order)).alias("all"))
    token, right = X.token_pattern("R"), "PR"
    labels = F.transform("all", lambda x: F.concat(F.regexp_replace(x["level"]["label"], token, right), F.lit("="), x["level"]["value"]))
    notes = F.transform("all", lambda x: F.regexp_replace(x["note"], token, right))
    n = F.aggregate("all", F.lit(0), lambda s, x: s + F.regexp_count(x["level"]["label"], F.lit(token)) + F.regexp_count(x["note"], F.lit(token)))
    return rows.select("l_orderkey", F.array_join(labels, ";").alias("labels"), F.array_join(notes, ";").alias("notes"), n.cast("bigint").alias("n_repairs"))


_STAGES = ("signup", "view", "click", "purchase")


@query("""
WITH m AS (SELECT user_id, event_type AS stage, ts, CASE WHEN value < 45 THEN 'done' WHEN value < 75 THEN 'running' ELSE 'failed' END AS status FROM events WHERE event_type <> 'error'),
k AS (SELECT user_id, stage, arg_max(status, (ts, status)) AS last, max(ts) AS ts, count(*) FILTER (status = 'failed') AS attempts FROM m GROUP BY ALL),
s AS (SELECT unnest(range(0, 4)) AS place, unnest(['signup', 'view', 'click', 'purchase']) AS stage),
a AS (SELECT u.user_id, s.place, s.stage, last, ts, coalesce(attempts, 0) AS attempts FROM (SELECT DISTINCT user_id FROM m) u CROSS JOIN s LEFT JOIN k ON k.user_id = u.user_id AND k.stage = s.stage),
o AS (SELECT *, CASE WHEN last IS NULL THEN 'pending' WHEN last = 'running' AND ts < TIMESTAMP '2024-01-31' - INTERVAL 10 DAY THEN 'pending' WHEN last = 'failed' AND attempts < 3 THEN 'pending' ELSE last END AS own FROM a),
r AS (SELECT *, coalesce(bool_and(own = 'done') OVER (PARTITION BY user_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS ready FROM o)
SELECT user_id, stage, CASE WHEN ready THEN own ELSE 'pending' END AS status, attempts, ready AND own = 'pending' AS next FROM r
""")
def stage_states(spark, sf_dir):
    status = F.when(F.col("value") < 45, "done").when(F.col("value") < 75, "running").otherwise("failed")
    marks = table(spark, sf_dir, "events").where("event_type <> 'error'").select("user_id", F.col("event_type").alias("stage"), "ts", status.alias("status"))
    return incremental.stage_states(marks, ["user_id"], _STAGES, F.expr("timestamp_ntz'2024-01-31 00:00:00'"), "10 days")


@query("""
WITH d AS (SELECT doc_id FROM labels WHERE quality = 1),
t AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM d)),
s AS (SELECT source, count(*) AS spent FROM documents WHERE doc_id IN (SELECT doc_id FROM d) GROUP BY 1)
SELECT doc_id, source FROM t LEFT JOIN s USING (source) WHERE i < 12 - coalesce(spent, 0)
""")
def budgeted_work(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    done = docs.join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    return incremental.within_budget(docs.join(done.select("doc_id"), "doc_id", "left_anti"), done, ["source"], ["doc_id"], 12)


@query("""
WITH j AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'live' WHEN 1 THEN 'concept' WHEN 2 THEN 'cs' ELSE 'misc' END || '_' || printf('%08d', page_id * 7919 % 100003) || '_' || page_id AS id FROM pages),
g AS (SELECT *, string_split(id, '_')[1] AS grp, CASE string_split(id, '_')[1] WHEN 'concept' THEN 0 WHEN 'cs' THEN 1 WHEN 'live' THEN 2 ELSE 9 END AS grp_rank FROM j)
SELECT id, grp, grp_rank::INTEGER AS grp_rank, row_number() OVER (ORDER BY grp_rank, id) - 1 AS turn FROM g
""")
def ranked_jobs(spark, sf_dir):
    kind = F.when(F.col("page_id") % 4 == 0, "live").when(F.col("page_id") % 4 == 1, "concept").when(F.col("page_id") % 4 == 2, "cs").otherwise("misc")
    jobs = table(spark, sf_dir, "pages").select(F.concat(kind, F.lit("_"), F.lpad((F.col("page_id") * 7919 % 100003).cast("string"), 8, "0"), F.lit("_"), F.col("page_id")).alias("id"))
    return incremental.ranked_jobs(jobs, "id", X.group_of("id"), {"concept": 0, "cs": 1, "live": 2})


@query(f"""
WITH p AS (SELECT doc_id, source, lang = 'fr' AS first FROM documents),
h AS (SELECT source, bool_or(first) AS has FROM p GROUP BY 1),
n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM p JOIN h USING (source) WHERE first OR NOT has)
SELECT source, doc_id FROM n WHERE list_contains([least(floor(n * (2 * k + 1) / 6)::BIGINT, n - 1) for k in [0, 1, 2]], i)
""")
def preferred_even_pick(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    pool = sampling.preferred(docs, ["source"], F.col("lang") == "fr").select("source", "doc_id")
    return sampling.even_pick(pool, ["source"], ["doc_id"], 3)


@query(r"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(CASE WHEN doc_id % 3 = 0 THEN upper(replace(text, 'ß', 'ss')) WHEN doc_id % 3 = 1 THEN E'\n Daily Bias Ñandú ' || chr(10) || text ELSE text END, chr(10)), lambda x: trim(x, E' \t\r\f\v')), lambda x: x <> '')[1] AS line FROM documents),
t AS (SELECT doc_id, line, (regexp_matches(line, '\p{Lu}') AND NOT regexp_matches(line, '[\p{Ll}\p{Lt}]')) OR (regexp_matches(line, '[\p{Lu}\p{Lt}]') AND NOT regexp_matches(line, '[\p{Lu}\p{Lt}\p{Ll}][\p{Lu}\p{Lt}]') AND NOT regexp_matches(line, '(^|[^\p{Lu}\p{Lt}\p{Ll}])\p{Ll}')) AS shaped FROM l)
SELECT sha256(line) AS title_sha, count(*) AS n, min(doc_id) AS first_doc FROM t WHERE shaped GROUP BY line
""".replace(r"E'\n Daily", "chr(10) || ' Daily").replace(r"E' \t\r\f\v'", "' ' || chr(9) || chr(13) || chr(12) || chr(11)"))
def title_shapes(spark, sf_dir):
    text = F.when(F.col("doc_id") % 3 == 0, F.upper(F.replace("text", F.lit("ß"), F.lit("ss")))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("\n Daily Bias Ñandú \n"), "text")).otherwise(F.col("text"))
    lines = table(spark, sf_dir, "documents").select("doc_id", X.first_line(text).alias("line"))
    found = lines.where(X.title_shaped("line")).groupBy("line").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    return found.select(F.sha2("line", 256).alias("title_sha"), "n", "first_doc")


@query("""
WITH s AS (SELECT o_custkey, min(date_diff('day', TIMESTAMP '1990-01-01', o_orderdate)) AS lo, max(date_diff('day', TIMESTAMP '1990-01-01', o_orderdate)) AS hi FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT o.o_orderkey, o.o_custkey, date_diff('day', TIMESTAMP '1990-01-01', o.o_orderdate) AS t FROM orders o JOIN s USING (o_custkey) WHERE date_diff('day', TIMESTAMP '1990-01-01', o.o_orderdate) BETWEEN lo - 1 AND hi + 1
""")
def guarded_values(spark, sf_dir):
    """Values that lie where they can have been seen, one beside it at most: the others were made up."""
    day = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("bigint")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", day.alias("t"))
    spans = rows.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    return rows.join(spans, "o_custkey").where("t between lo - 1 and hi + 1").select("o_orderkey", "o_custkey", "t")


@query("SELECT source, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), '7') GROUP BY source")
def substring_filter(spark, sf_dir):
    held = lambda c, needle: F.contains(F.lower(c), F.lit(needle.lower()))
    docs = table(spark, sf_dir, "documents").where(held("text", "LICENSE") | held("source", "7"))
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("SELECT count(*) AS n_rows, count(*) FILTER (embedding IS NULL) AS n_null, min(len(embedding))::INTEGER AS least, max(len(embedding))::INTEGER AS most FROM embeddings")
def array_shapes(spark, sf_dir):
    return readers.array_shapes(table(spark, sf_dir, "embeddings"), "embedding")


@query(f"""
WITH {_V_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM v),
c AS (SELECT * FROM o WHERE n <= 20 OR list_contains([round_even(k * (n - 1) / 19.0::DOUBLE, 0)::BIGINT for k in range(0, 20)], i)),
p AS (SELECT a.label, a.vec_id, a.n, sum(bit_count(xor(a.h, b.h)))::BIGINT AS total FROM c a JOIN c b ON a.label = b.label GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY total, vec_id DESC) AS i FROM p)
SELECT label, vec_id, total AS total_distance, n AS n_members FROM k WHERE i = 1
""")
def capped_medoids(spark, sf_dir):
    """Groups beyond the cap are represented by evenly spaced members."""
    return folds.medoids(vectors(spark, sf_dir).drop("embedding"), ["label"], "vec_id", "h", cap=20)


@query("""
WITH r AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN ' ok, as read' WHEN 1 THEN 'Bad: ' || event_type WHEN 2 THEN 'OKAY' WHEN 3 THEN 'not ok' ELSE '' END AS reply, value, event_type, props FROM events)
SELECT event_id, CASE WHEN starts_with(upper(ltrim(reply)), 'OK') THEN 'ok' WHEN starts_with(upper(ltrim(reply)), 'BAD') THEN 'bad' ELSE 'unclear' END AS verdict,
  CASE WHEN value < 2 THEN 'short' WHEN value < 10 THEN 'medium' ELSE 'held' END AS held,
  array_to_string(list_filter([reply, event_type, CASE WHEN event_id % 2 = 0 THEN props END, ''], lambda x: x IS NOT NULL AND x <> ''), chr(10)) AS joined FROM r
""")
def reply_verdicts(spark, sf_dir):
    turn = F.col("event_id") % 5
    reply = F.when(turn == 0, " ok, as read").when(turn == 1, F.concat(F.lit("Bad: "), "event_type")).when(turn == 2, "OKAY").when(turn == 3, "not ok").otherwise("")
    rows = table(spark, sf_dir, "events").withColumn("reply", reply)
    parts = X.joined_text(F.array("reply", "event_type"), F.array(F.when(F.col("event_id") % 2 == 0, F.col("props")), F.lit("")))
    return rows.select("event_id", X.reply_verdict("reply").alias("verdict"), X.duration_class("value").alias("held"), parts.alias("joined"))


@query("""
WITH i AS (SELECT user_id, max(ts) AS ts, (count(*))::VARCHAR || '-' || (epoch_us(max(ts)) // 1000000)::VARCHAR AS signature FROM events GROUP BY 1),
o AS (SELECT user_id, max(ts) FILTER (event_type <> 'error') AS ts, (count(*) FILTER (event_type <> 'error'))::VARCHAR || '-' || (epoch_us(max(ts) FILTER (event_type <> 'error')) // 1000000)::VARCHAR AS signature
  FROM events WHERE user_id % 7 <> 0 GROUP BY 1 HAVING count(*) FILTER (event_type <> 'error') > 0)
SELECT i.user_id, 'stale' AS why FROM i LEFT JOIN o USING (user_id) WHERE o.ts IS NULL OR i.ts > o.ts
UNION ALL SELECT i.user_id, 'changed' FROM i JOIN o USING (user_id) WHERE i.signature <> o.signature
""")
def stale_outputs(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    made = lambda x: x.groupBy("user_id").agg(F.max("ts").alias("ts"), F.count("*").alias("size")).withColumn("signature", readers.signature("size", "ts"))
    inputs, outputs = made(rows), made(rows.where("event_type <> 'error' and user_id % 7 <> 0"))
    stale = readers.stale_outputs(inputs, outputs, "user_id", "ts").select("user_id", F.lit("stale").alias("why"))
    return stale.unionByName(readers.changed_sources(inputs, outputs, "user_id", "signature").select("user_id", F.lit("changed").alias("why")))


@query("""
WITH r AS (SELECT event_type, count(*) FILTER (event_id % 4 <> 0) AS n_now, count(*) FILTER (event_id % 4 = 0) AS n_before, epoch_us(max(ts) FILTER (event_id % 4 <> 0)) - epoch_us(min(ts) FILTER (event_id % 4 <> 0)) AS us FROM events GROUP BY 1),
p AS (SELECT event_type, n_now, n_before, CASE WHEN n_now > 1 AND us > 0 THEN (n_now - 1) / (us / 3600000000.0::DOUBLE) END AS per_hour FROM r)
SELECT *, greatest(5000 - n_now - n_before, 0) / per_hour AS eta_hours FROM p
""")
def rate_and_eta(spark, sf_dir):
    return incremental.rate_and_eta(table(spark, sf_dir, "events"), ["event_type"], "ts", F.col("event_id") % 4 == 0, 5000)


@query(f"""
WITH b AS {bars_sql('1 hour', 'symbol')}
SELECT bar_ts AS ts_event, symbol, {', '.join(f"round({x} * 1000000000)::BIGINT / 1000000000::DOUBLE AS {x}" for x in LEGS)}, volume, 'pull' AS source FROM b
""")
def canonical_bars(spark, sf_dir):
    """Bars as a supplier has them (integer prices at 1e-9, other names) in canonical columns, with their source."""
    raw = B.bars(trades(spark, sf_dir), "1h", ["symbol"]).select(F.col("bar_ts").alias("ts_event"), "symbol", *[F.round(F.col(x) * 1_000_000_000).cast("bigint").alias(x) for x in LEGS], "volume")
    return readers.canonical_bars(raw, "pull")


@query("""
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || '[Unreadable] x' || chr(10) || '[unreadable]' ELSE text END AS text, CASE WHEN doc_id % 4 = 0 THEN ' ' WHEN doc_id % 4 = 1 THEN source END AS instrument FROM documents)
SELECT doc_id, len(list_filter(string_split(lower(text), chr(10)), lambda x: contains(x, '[unreadable]'))) AS n_unreadable, coalesce(trim(instrument) <> '', false) AS has_instrument FROM t
""")
def unreadable_lines(spark, sf_dir):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\n[Unreadable] x\n[unreadable]"))).otherwise(F.col("text"))
    instrument = F.when(F.col("doc_id") % 4 == 0, " ").when(F.col("doc_id") % 4 == 1, F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", X.unreadable_lines(text).cast("bigint").alias("n_unreadable"), X.has_instrument(instrument).alias("has_instrument"))


@query("""
WITH f AS (SELECT conv_id, count(*) FILTER (turn % 5 <> 3) AS n_frames, count(DISTINCT turn) FILTER (turn % 5 <> 3) AS n_distinct, max(turn) + 1 AS expected FROM conversations GROUP BY 1)
SELECT conv_id, n_frames, expected, abs(n_frames - expected) <= 2 AS counts_agree, n_frames = expected AS contiguous FROM f
""")
def frame_coverage(spark, sf_dir):
    """Frames found against frames expected: two may be missing or over; t must be 0..n-1 to be contiguous."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    expected = rows.groupBy("conv_id").agg((F.max("turn") + 1).alias("expected"))
    found = rows.where("turn % 5 <> 3").groupBy("conv_id").agg(F.count("*").alias("n_frames"), F.max("turn").alias("_last"), F.count_distinct("turn").alias("_distinct"))
    both = expected.join(found, "conv_id", "left").fillna(0, ["n_frames"])
    whole = (F.col("n_frames") == F.col("expected")) & (F.col("_distinct") == F.col("n_frames")) & (F.col("_last") == F.col("expected") - 1)
    return both.select("conv_id", "n_frames", "expected", (F.abs(F.col("n_frames") - F.col("expected")) <= 2).alias("counts_agree"), F.coalesce(whole, F.lit(False)).alias("contiguous"))


@query("""
SELECT 'strict' AS mode, user_id, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY user_id
UNION ALL SELECT 'skip', user_id, count(*), sum(event_id)::BIGINT FROM events WHERE event_id % 10 <> 0 GROUP BY user_id
UNION ALL SELECT 'torn_tail', user_id, count(*), sum(event_id)::BIGINT FROM events WHERE event_id NOT IN (SELECT max(event_id) FROM events GROUP BY event_id % 8) GROUP BY user_id
UNION ALL SELECT 'refused', NULL, 1, NULL
""")
def json_lines_modes(spark, sf_dir):
    """The events as JSON lines, read strictly, by skipping bad lines, and with the last line of each file torn off; a bad line in the middle is refused.

    Files are written, and the refusal is tried, when this is called.
    """
    base = scratch_dir(spark)
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    sinks.json_lines(rows, f"{base}/strict")
    lines = rows.select("event_id", (F.col("event_id") % 8).alias("file"), F.to_json(F.struct("event_id", "user_id")).alias("line"))
    cut = F.left("line", F.char_length("line") - 1)
    lines.select(F.when(F.col("event_id") % 10 == 0, cut).otherwise(F.col("line")).alias("value")).write.text(f"{base}/skip")
    ends = lines.groupBy("file").agg(F.max("event_id").alias("last"))
    torn = lines.join(ends, "file").select("file", "event_id", F.when(F.col("event_id") == F.col("last"), cut).otherwise(F.col("line")).alias("value"))
    torn.repartition("file").sortWithinPartitions("file", "event_id").select("file", "value").write.partitionBy("file").text(f"{base}/torn_tail")
    out = None
    for mode in ("strict", "skip", "torn_tail"):
        found = readers.json_lines(spark, f"{base}/{mode}", "event_id bigint, user_id bigint", mode)
        one = found.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")).select(F.lit(mode).alias("mode"), "user_id", "n", "ids")
        out = one if out is None else out.unionByName(one)
    try:
        readers.json_lines(spark, f"{base}/skip", "event_id bigint, user_id bigint", "torn_tail")
        refused = 0
    except ValueError:
        refused = 1
    return out.unionByName(spark.createDataFrame([("refused", None, refused, None)], out.schema))


@query("SELECT 'source=' || source AS video, count(*) AS n, min(doc_id) AS first_doc, starts_with(source, 'src1') OR starts_with(source, 'src4') AS chosen FROM documents GROUP BY source")
def partitioned_scan(spark, sf_dir):
    """All documents written in a folder per source and read back with the folder's name; ``chosen`` are the folders that a second reading by prefixes takes. It writes when called."""
    path = f"{scratch_dir(spark)}/sources"
    table(spark, sf_dir, "documents").select("doc_id", "source").write.partitionBy("source").json(path)
    every = readers.partitioned_lines(spark, path, "doc_id bigint", "*.json").groupBy("video").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    some = readers.partitioned_lines(spark, path, "doc_id bigint", "*.json", ("source=src1", "source=src4")).groupBy("video").agg(F.lit(True).alias("chosen"))
    return every.join(some, "video", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))


@query("SELECT source, count(*) AS n_before FROM documents GROUP BY source HAVING sum(n_chars) % 2 = 0")
def changed_files(spark, sf_dir):
    """Sources whose files have changed since their signatures were taken, by size and time of the files themselves: those with an even number of characters are appended to in between (when this is called)."""
    path = f"{scratch_dir(spark)}/files"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars")
    docs.write.partitionBy("source").json(path)

    def listing():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path)
        own = files.select(F.regexp_extract("path", r"source=([^/]+)/", 1).alias("source"), "length", "modificationTime")
        return own.groupBy("source").agg(readers.signature(F.sum("length"), F.max("modificationTime")).alias("mark"))

    before = stored(listing())
    counts = docs.groupBy("source").agg(F.count("*").alias("n_before"), F.sum("n_chars").alias("_chars"))
    even = counts.where("_chars % 2 = 0")
    docs.join(even.select("source"), "source", "left_semi").write.mode("append").partitionBy("source").json(path)
    return readers.changed_sources(listing(), before, "source", "mark").join(counts, "source").select("source", "n_before")


@query(r"""SELECT doc_id, sha256(text) AS before_sha, sha256(regexp_replace(text, '\bof\b', 'OF', 'g')) AS after_sha FROM documents WHERE text <> regexp_replace(text, '\bof\b', 'OF', 'g')""")
def repair_log(spark, sf_dir):
    """A repair's log with the values before and after, appended to a file and read again."""
    path = f"{scratch_dir(spark)}/repairs"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fixed = docs.withColumn("text", quality.repaired(F.col("text"), X.token_pattern("of"), "OF")[0])
    sinks.appended(sinks.repair_log(docs, fixed, "doc_id", "text"), path)
    log = spark.read.schema("doc_id bigint, before string, after string").json(path)
    return log.select("doc_id", F.sha2("before", 256).alias("before_sha"), F.sha2("after", 256).alias("after_sha"))


@query(f"SELECT bar_ts AS ts_event, symbol, open, high, low, close, volume FROM {bars_sql('1 hour', 'symbol', where='ts >= TIMESTAMP ' + repr('2024-01-03'))}")
def dbn_bars(spark, sf_dir):
    """Trades written as DBN files (when this is called), and bars of those from the third day on, which the reader chooses among raw records."""
    dbn.registered(spark)
    path = f"{scratch_dir(spark)}/trades"
    ts = F.col("ts").cast("timestamp")
    number = F.array_position(F.array(*[F.lit(x) for x in (*_STAGES, "error")]), F.col("symbol")).cast("bigint")
    raw = trades(spark, sf_dir).select(ts.alias("ts_recv"), ts.alias("ts_event"), "sequence", F.lit("T").alias("action"), F.round(F.col("price") * 1_000_000_000).cast("bigint").alias("price"), "size", "symbol", number.alias("instrument_id"), F.lit(1).alias("publisher_id"))
    raw.write.format("dbn").mode("append").save(path)
    read = spark.read.format("dbn").load(path).where("ts_recv >= timestamp'2024-01-03 00:00:00'").withColumn("price", P.fixed_point("price"))
    return B.bars(read, "1h", ["symbol"], ts="ts_recv").select(F.col("bar_ts").cast("timestamp_ntz").alias("ts_event"), "symbol", *LEGS, "volume")


@query(f"SELECT bar_ts AS ts_event, symbol, open, high, low, close, volume FROM {bars_sql('1 hour', 'symbol')}")
def trades_readback(spark, sf_dir):
    """Trades written and read with the checks of their reader, made into bars, which are written and read with theirs."""
    base = scratch_dir(spark)
    own = trades(spark, sf_dir)
    raw = own.select(
        F.col("ts").cast("timestamp").alias("ts_recv"), F.col("ts").cast("timestamp").alias("ts_event"), "sequence", F.lit("T").alias("action"), F.round(F.col("price") * 1_000_000_000).cast("bigint").alias("price"),
        "size", "symbol", F.lit(7).cast("bigint").alias("instrument_id"), F.lit(1).alias("publisher_id"),
    )
    sinks.parquet(raw, f"{base}/trades")
    read = readers.trades(spark, f"{base}/trades").withColumn("price", P.fixed_point("price"))
    hourly = B.bars(read, "1h", ["symbol"], ts="ts_recv")
    sinks.parquet(hourly.select(F.col("bar_ts").alias("ts_event"), "symbol", *LEGS, "volume"), f"{base}/bars")
    return readers.bars(spark, f"{base}/bars").withColumn("ts_event", F.col("ts_event").cast("timestamp_ntz"))


@query("""
SELECT source, source NOT LIKE '%3' AS readable, CASE WHEN source NOT LIKE '%3' THEN n ELSE -1 END AS n, CASE WHEN source NOT LIKE '%3' THEN first_doc ELSE -1 END AS first_doc FROM (SELECT source, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY source)
""")
def json_documents(spark, sf_dir):
    """One JSON document a folder; those cut short give nulls."""
    path = f"{scratch_dir(spark)}/documents"
    facts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    whole = F.concat(F.lit("{\n  "), F.substr(F.to_json(F.struct("n", "first_doc")), F.lit(2)))
    facts.select("source", F.when(F.endswith("source", F.lit("3")), F.left(whole, F.char_length(whole) - 3)).otherwise(whole).alias("value")).write.partitionBy("source").text(path)
    found = readers.json_document(spark, path, "source string, n bigint, first_doc bigint")
    return found.select("source", F.col("n").isNotNull().alias("readable"), F.coalesce("n", F.lit(-1)).alias("n"), F.coalesce("first_doc", F.lit(-1)).alias("first_doc"))


@query("SELECT source, 1::BIGINT AS n_files FROM (SELECT DISTINCT source FROM documents WHERE source NOT LIKE '%1')")
def media_listing(spark, sf_dir):
    """Files below a folder, one a source, but for those in the folder of outputs."""
    path = scratch_dir(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    for folder, part in (("raw", ~F.endswith("source", F.lit("1"))), ("derived", F.endswith("source", F.lit("1")))):
        docs.where(part).repartition("source").write.partitionBy("source").parquet(f"{path}/{folder}")
    found = readers.media_files(spark, path, ("parquet",))
    return found.groupBy(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source")).agg(F.count("*").alias("n_files"))


_GREY_SQL = "list_transform(embedding, lambda x: least(greatest(floor((x::DOUBLE + 3) * 40), 0), 255)::INTEGER)"


@query(f"""
WITH g AS (SELECT vec_id, {_GREY_SQL} AS q FROM embeddings WHERE vec_id % 9 <> 0)
SELECT vec_id, array_to_string([printf('%02x', list_sum([CASE WHEN q[r * 8 + c + 1] > q[r * 8 + c + 2] THEN (128 >> c) ELSE 0 END for c in range(0, 7)])::INTEGER) for r in range(0, 8)], '') AS dhash_hex,
  (list_sum([q[r * 8 + c + 1] * CASE WHEN c = 7 THEN 8 ELSE 4 END for r in range(0, 8) for c in range(0, 8)]) * 2.5)::DOUBLE AS fine_sum FROM g
UNION ALL SELECT vec_id, NULL, NULL FROM embeddings WHERE vec_id % 9 = 0
""".replace("list_sum([q[r * 8 + c + 1] * CASE WHEN c = 7 THEN 8 ELSE 4 END for r in range(0, 8) for c in range(0, 8)])", "list_sum(list_transform(range(0, 64), lambda i: q[i + 1] * CASE WHEN i % 8 = 7 THEN 8 ELSE 4 END))"))
def frame_hashes(spark, sf_dir):
    """Embeddings drawn as small grey frames (40 x 36), then hashed and reduced to their grid; some have no pixels."""
    from millrace.operators.frames import hashed

    grey = F.transform("embedding", lambda x: F.least(F.greatest(F.floor((x.cast("double") + 3) * 40), F.lit(0)), F.lit(255)))
    cell = lambda q, i: F.get(q, (F.floor(i / 180) * 8 + F.least(F.floor(i % 36 / 4), F.lit(7))).cast("int"))
    text = lambda q: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(1439)), lambda i: F.lpad(F.hex(cell(q, i)), 2, "0")), "")
    drawn = F.get(F.transform(F.array(grey), text), F.lit(0))  # the lambda has the grey values worked out once
    frames = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 9 != 0, F.unhex(drawn)).alias("px"))
    found = hashed(frames, "px", 40, 36)
    total = F.aggregate("fine", F.lit(0.0), lambda s, x: s + x)
    return found.select("vec_id", "dhash_hex", total.alias("fine_sum"))

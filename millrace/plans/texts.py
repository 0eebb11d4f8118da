"""Queries over documents, pages and nested records: cleaning, matching, coverage, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import replies
from millrace.functions import text as X
from millrace.operators import folds, joins, quality, stats
from millrace.plans.registry import query
from millrace.sources.readers import spread, table
from millrace.sources.scratch import stored

#: Aliases of a few things that the documents mention.
ALIASES = {
    "article": ("the", "of the", "der", "die"),
    "licence": ("licensed", "cc by-nc", "mit license"),
    "version": ("version 2.0", "4.0", "version 3"),
    "mail": ("example.com", "e-mail", "mail"),
}
VOCABULARY = ("THE", "OF", "AND", "WAS", "THAT", "DER", "UND", "QUE", "LES")
EXEMPT = ("IN", "IS", "A", "LE", "LO")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("SELECT d.doc_id, d.lang, coalesce(l.quality, -1) AS quality, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l USING (doc_id)")
def captions_left_join(spark, sf_dir):
    notes = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("there"))
    return documents(spark, sf_dir).select("doc_id", "lang").join(notes, "doc_id", "left").select("doc_id", "lang", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("there", F.lit(False)).alias("labelled"))


@query("""
SELECT 'left_only' AS "check", count(*) AS n FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)
UNION ALL SELECT 'right_only', count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)
UNION ALL SELECT 'left_repeated', count(*) FROM (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'right_repeated', count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'orphans', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")
def semi_anti_audit(spark, sf_dir):
    from millrace.sources.sinks import orphans

    keys = quality.dataset_report(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")
    lost = orphans(documents(spark, sf_dir).select("doc_id"), table(spark, sf_dir, "labels"), "doc_id").agg(F.count("*").alias("n"))
    return keys.unionByName(lost.select(F.lit("orphans").alias("check"), "n"))


_TOKENS_SQL = r"""
t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Z]{2,8}')) AS token FROM documents),
c AS (SELECT token, count(*) AS n_docs, min(doc_id) AS first_doc FROM t GROUP BY token)
"""
_VOCABULARY_SQL = "(SELECT unnest([" + ", ".join(repr(x) for x in VOCABULARY) + "]) AS term)"
_KNOWN_SQL = ", ".join(repr(x) for x in VOCABULARY + EXEMPT)


def _census(spark, sf_dir) -> DataFrame:
    """Upper-case tokens with the documents that hold them."""
    tokens = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z]{2,8}"), F.lit(0)))).alias("token")
    return documents(spark, sf_dir).select("doc_id", tokens).groupBy("token").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


def _terms(spark, words) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "term string")


@query(f"WITH {_TOKENS_SQL} SELECT token, n_docs, first_doc, string_agg(term, ',' ORDER BY term) AS near FROM c, {_VOCABULARY_SQL} WHERE token NOT IN ({_KNOWN_SQL}) AND damerau_levenshtein(token, term) <= 1 GROUP BY ALL")
def osa_suspects(spark, sf_dir):
    census = _census(spark, sf_dir).where(~F.col("token").isin(*VOCABULARY, *EXEMPT))
    pairs = joins.within_one_edit(census, "token", _terms(spark, VOCABULARY), "term")
    met = census.join(pairs, "token")
    return met.groupBy("token", "n_docs", "first_doc").agg(F.array_join(F.array_sort(F.collect_list("term")), ",").alias("near"))


@query(f"WITH {_TOKENS_SQL} SELECT token, n_docs FROM c WHERE token NOT IN ({_KNOWN_SQL}) ORDER BY n_docs DESC, token LIMIT 20")
def oov_topn(spark, sf_dir):
    unknown = _census(spark, sf_dir).join(F.broadcast(_terms(spark, VOCABULARY + EXEMPT).toDF("token")), "token", "left_anti")
    return unknown.select("token", "n_docs").orderBy(F.desc("n_docs"), "token").limit(20)


def _aliases(spark) -> DataFrame:
    return spark.createDataFrame([(n, a.lower()) for n, some in ALIASES.items() for a in some], "name string, alias string")


def _alias_sql(alias):
    safe = "".join("\\" + c if c in ".-+*?()[]" else c for c in alias)
    return f"regexp_matches(lower(text), '(^|[^a-z0-9]){safe}($|[^a-z0-9])')"


_DATED_SQL = r"(regexp_matches(lower(text), '\b(jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|jun(e)?|jul(y)?|aug(ust)?|sep(tember)?|oct(ober)?|nov(ember)?|dec(ember)?)\b[^\n]{0,18}\b(19|20)\d\d\b') OR regexp_matches(text, '\b(19|20)\d\d-\d\d-\d\d\b'))"


#: Documents as records: some with a bar header printed below their text, an instrument for those of even length, the text of some also as narration.
_RECORDS_SQL = """(SELECT doc_id, source, lang = 'en' AS chart, CASE WHEN doc_id % 3 = 0 THEN text || ' O1.5 H2 L1 C1.25' ELSE text END AS text, CASE WHEN n_chars % 2 = 0 THEN source ELSE '' END AS instrument,
  CASE WHEN doc_id % 4 = 0 THEN text ELSE '' END AS narration FROM documents)"""


def _records(spark, sf_dir) -> DataFrame:
    printed = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" O1.5 H2 L1 C1.25"))).otherwise(F.col("text"))
    return documents(spark, sf_dir).select(
        "doc_id", "source", (F.col("lang") == "en").alias("chart"), printed.alias("text"), F.when(F.col("n_chars") % 2 == 0, F.col("source")).otherwise("").alias("instrument"),
        F.when(F.col("doc_id") % 4 == 0, F.col("text")).otherwise("").alias("narration"),
    )


def _hit_sql(aliases, column="text"):
    return "(" + " OR ".join(_alias_sql(a).replace("lower(text)", f"lower({column})") for a in aliases) + ")"


@query(
    "\nUNION ALL ".join(
        f"""SELECT '{name}' AS concept, count(*) FILTER (hit AND chart) AS printed_chart, count(*) FILTER (hit AND NOT chart) AS printed_slide, count(DISTINCT CASE WHEN hit AND chart THEN source || text END) AS n_distinct,
  count(*) FILTER (hit AND dated) AS dated, count(*) FILTER (hit AND dated AND ohlc) AS via_ohlc, count(*) FILTER (hit AND dated AND NOT ohlc) AS via_title, count(*) FILTER (said) AS narrated, min(doc_id) FILTER (hit) AS first_doc
  FROM (SELECT doc_id, source, chart, text, {_hit_sql(aliases)} AS hit, {_hit_sql(aliases, "narration")} AS said, chart AND instrument <> '' AND {_DATED_SQL} AS dated,
    regexp_matches(text, '(?i)O\\s?([\\d,]+(?:\\.\\d+)?)\\s+H\\s?([\\d,]+(?:\\.\\d+)?)\\s+L\\s?([\\d,]+(?:\\.\\d+)?)\\s+C\\s?([\\d,]+(?:\\.\\d+)?)') AS ohlc FROM {_RECORDS_SQL})"""
        for name, aliases in ALIASES.items()
    )
)
def concept_coverage(spark, sf_dir):
    rows = spread(_records(spark, sf_dir)).withColumn("_text", F.lower("text")).withColumn("_narration", F.lower("narration"))
    dated = F.col("chart") & X.has_instrument("instrument") & X.has_date("text")
    rows = rows.select("doc_id", "chart", F.sha2(F.concat("source", "text"), 256).alias("same"), dated.alias("dated"), X.has_bar_header("text").alias("ohlc"), "_text", "_narration")
    rows = joins.alias_matches(rows, _aliases(spark), {"on": "_text", "heard": "_narration"})
    rows = rows.withColumns({c: F.array_distinct(F.col(c)["name"]) for c in ("on", "heard")})
    each = rows.select("*", F.explode(F.array_union("on", "heard")).alias("concept"))
    each = each.withColumn("hit", F.array_contains("on", F.col("concept"))).withColumn("said", F.array_contains("heard", F.col("concept")))
    hit, chart = F.col("hit"), F.col("chart")
    found = each.groupBy("concept").agg(
        F.count_if(hit & chart).alias("printed_chart"), F.count_if(hit & ~chart).alias("printed_slide"), F.count_distinct(F.when(hit & chart, F.col("same"))).alias("n_distinct"),
        F.count_if(hit & F.col("dated")).alias("dated"), F.count_if(hit & F.col("dated") & F.col("ohlc")).alias("via_ohlc"), F.count_if(hit & F.col("dated") & ~F.col("ohlc")).alias("via_title"),
        F.count_if("said").alias("narrated"), F.min(F.when(hit, F.col("doc_id"))).alias("first_doc"),
    )
    names = spark.createDataFrame([(n,) for n in ALIASES], "concept string")
    zero = {c: 0 for c in ("printed_chart", "printed_slide", "n_distinct", "dated", "via_ohlc", "via_title", "narrated")}
    return F.broadcast(names).join(found, "concept", "left").fillna(zero)


@query(
    "SELECT * FROM ("
    + "\nUNION ALL ".join(f"SELECT '{name}' AS concept, '{a}' AS alias, count(*) FILTER ({_alias_sql(a)}) AS n FROM documents" for name, aliases in ALIASES.items() for a in aliases)
    + ") WHERE n > 0"
)
def alias_usage(spark, sf_dir):
    rows = joins.alias_matches(spread(documents(spark, sf_dir).select(F.lower("text").alias("_text"))), _aliases(spark), {"found": "_text"})
    return rows.select(F.explode("found").alias("x")).groupBy(F.col("x.name").alias("concept"), "x.alias").agg(F.count("*").alias("n"))


_WORDS_SQL = "SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents"


@query(f"""
WITH t AS ({_WORDS_SQL}), b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM benchmark)
SELECT left(word, 1) AS initial, word, count(*) AS n_docs, min(doc_id) AS first_doc FROM t JOIN b USING (word) GROUP BY word
""")
def vocabulary_usage(spark, sf_dir):
    """A vocabulary that is a table (the words of all benchmark texts, thousands of aliases): in how many documents does each stand?"""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("alias")).distinct()
    rows = spread(documents(spark, sf_dir).select("doc_id", F.lower("text").alias("_text")))
    found = joins.alias_matches(rows, words.select(F.left("alias", F.lit(1)).alias("name"), "alias"), {"found": "_text"})
    return found.select("doc_id", F.explode("found").alias("x")).groupBy(F.col("x.name").alias("initial"), F.col("x.alias").alias("word")).agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


@query(f"""
WITH t AS ({_WORDS_SQL}), c AS (SELECT word, count(*) AS n, min(doc_id) AS first_doc FROM t WHERE length(word) > 3 GROUP BY word),
a AS (SELECT * FROM c WHERE n = 1), v AS (SELECT word FROM c WHERE n >= 20),
k AS (SELECT word, unnest(list_append(list_transform(range(1, length(word) + 1), lambda i: left(word, i - 1) || substr(word, i + 1)), word)) AS key FROM (SELECT word FROM a UNION ALL SELECT word FROM v)),
p AS (SELECT DISTINCT x.word AS token, y.word AS term FROM k x JOIN k y USING (key) JOIN v ON v.word = y.word JOIN a ON a.word = x.word)
SELECT token, first_doc, count(*) AS n_near, min(term) AS nearest FROM p JOIN a ON a.word = token WHERE damerau_levenshtein(token, term) <= 1 GROUP BY ALL
""")
def vocabulary_suspects(spark, sf_dir):
    """Words of one document that are one edit away from a word of the corpus's own vocabulary (in 20 documents or more)."""
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))).alias("token")
    census = stored(documents(spark, sf_dir).select("doc_id", words).where(F.char_length("token") > 3).groupBy("token").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")))
    rare = census.where("n = 1").select("token", "first_doc")
    pairs = joins.within_one_edit(rare, "token", census.where("n >= 20").select(F.col("token").alias("term")), "term")
    return rare.join(pairs, "token").groupBy("token", "first_doc").agg(F.count("*").alias("n_near"), F.min("term").alias("nearest"))


@query("""
SELECT CASE WHEN grouping(lang) = 1 THEN 'ALL' ELSE lang END AS lang, CASE WHEN grouping(source) = 1 THEN 'ALL' ELSE source END AS source, count(*) AS n
FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), (source), ())
""")
def class_confidence_crosstab(spark, sf_dir):
    return stats.crosstab(documents(spark, sf_dir), "lang", "source")


@query("""
SELECT lang, count(*) AS n, count(l.doc_id) AS n_labelled, count(*) FILTER (l.quality = 1) AS n_good, count(*) FILTER (l.quality = 1)::DOUBLE / nullif(count(l.doc_id), 0) AS good_rate,
  count(*) FILTER (n_chars < 100)::DOUBLE / count(*) AS short_share, sum(n_chars)::BIGINT AS n_chars FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY lang
""")
def rates_and_shares(spark, sf_dir):
    notes = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(1).alias("there"))
    rows = documents(spark, sf_dir).select("doc_id", "lang", "n_chars").join(notes, "doc_id", "left")
    return rows.groupBy("lang").agg(
        F.count("*").alias("n"), F.count("there").alias("n_labelled"), F.count_if(F.col("quality") == 1).alias("n_good"),
        (F.count_if(F.col("quality") == 1) / F.nullif(F.count("there"), F.lit(0))).alias("good_rate"),
        (F.count_if(F.col("n_chars") < 100) / F.count("*")).alias("short_share"), F.sum("n_chars").alias("n_chars"),
    )


@query("SELECT source, count(DISTINCT (lang, n_chars % 7)) AS n_pairs, count(DISTINCT text) AS n_texts, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs FROM documents GROUP BY source")
def distinct_tuples(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("digest", F.sha2("text", 256))
    return docs.groupBy("source").agg(
        F.count_distinct("lang", F.col("n_chars") % 7).alias("n_pairs"), F.count_distinct("digest").alias("n_texts"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs")
    )


@query("""
WITH s AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n, median(value) AS true_median, sum(value::DECIMAL(12, 2))::DOUBLE / count(*) AS mean FROM events GROUP BY 1)
SELECT event_type, n, v[round_even(0.5 * (n - 1), 0)::BIGINT + 1] AS p50, v[round_even(0.95 * (n - 1), 0)::BIGINT + 1] AS p95, v[n // 2 + 1] AS upper_median, v[floor(n * 0.95)::BIGINT + 1] AS cut_p95, true_median, mean FROM s
""")
def nearest_rank_percentiles(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    picks = {"p50": stats.nearest_rank(0.5), "p95": stats.nearest_rank(0.95), "upper_median": stats.UPPER_MEDIAN, "cut_p95": stats.truncated_rank(0.95)}
    means = events.groupBy("event_type").agg(F.median("value").alias("true_median"), (F.sum(F.col("value").cast("decimal(12,2)")).cast("double") / F.count("*")).alias("mean"))
    return stats.order_statistics(events, ["event_type"], "value", picks).join(means, "event_type")


@query("SELECT event_type, count(*) AS n, true AS p05, true AS p50, true AS p95, true AS other_order FROM events GROUP BY event_type")
def mergeable_quantiles(spark, sf_dir):
    """Sketches of each day, stored and merged by event type: are their quantiles within the stated rank error of the exact ones, and also if they are merged by weekday first?"""
    events = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), "value")
    picks = {"p05": 0.05, "p50": 0.5, "p95": 0.95}
    days = stored(stats.sketched(events, ["event_type", "day"], "value"))
    weekdays = stats.merged_sketches(days.withColumn("weekday", F.dayofweek("day")), ["event_type", "weekday"])
    one, two = (stats.sketch_quantiles(stats.merged_sketches(s, ["event_type"]), ["event_type"], picks) for s in (days, weekdays))
    near, again = (stats.rank_within(events, ["event_type"], "value", q, picks) for q in (one, two))
    other = again.select("event_type", (F.col("p05") & F.col("p50") & F.col("p95")).alias("other_order"))
    return one.select("event_type", "n").join(near, "event_type").join(other, "event_type")


@query("SELECT n_chars // 500 AS bin, count(*) AS n FROM documents GROUP BY 1")
def value_histogram(spark, sf_dir):
    return documents(spark, sf_dir).groupBy(F.expr("n_chars div 500").alias("bin")).agg(F.count("*").alias("n"))


@query("""
WITH p AS (SELECT source, lang, count(*) AS n, sum(n_chars) AS chars, count(*) FILTER (n_chars > 1000) AS long FROM documents GROUP BY ALL)
SELECT lang, count(*) AS n_sources, sum(n)::BIGINT AS n, sum(chars)::BIGINT AS chars, sum(long)::DOUBLE / sum(n)::DOUBLE AS long_rate, max(n) AS most FROM p GROUP BY lang
""")
def two_phase_report(spark, sf_dir):
    parts = documents(spark, sf_dir).groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") > 1000).alias("long"))
    merged = stats.merged_counts(parts, ["lang"], ["n", "chars", "long"])  # rates come from sums, never from rates
    shape = parts.groupBy("lang").agg(F.count("*").alias("n_sources"), F.max("n").alias("most"))
    return merged.join(shape, "lang").select("lang", "n_sources", "n", "chars", (F.col("long") / F.col("n")).alias("long_rate"), "most")


@query("SELECT lang, array_to_string(list_sort(list(doc_id))[1:3], ',') AS examples, count(*) AS n_all FROM documents GROUP BY lang")
def bounded_examples(spark, sf_dir):
    found = stats.first_examples(documents(spark, sf_dir).select("lang", "doc_id"), ["lang"], "doc_id", 3)
    return found.select("lang", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"), "n_all")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 15")
def topk_longest(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(15)


#: Documents under a heading: most have their source's name in capitals, some one that is no heading.
_HEADED_SQL = "(SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'notes of ' || source ELSE upper(source) END || chr(10) || text AS text FROM documents)"


@query(f"""
WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(12) || chr(11))), lambda x: x <> '') AS lines FROM {_HEADED_SQL}),
r AS (SELECT DISTINCT lines[1] AS title, doc_id, unnest(lines) AS line FROM d WHERE regexp_matches(lines[1], '\\p{{Lu}}') AND NOT regexp_matches(lines[1], '[\\p{{Ll}}\\p{{Lt}}]')),
m AS (SELECT title, count(DISTINCT doc_id) AS n_members FROM r GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3),
s AS (SELECT title, line, count(*) AS c FROM r GROUP BY ALL)
SELECT title, n_members, count(*) FILTER (c = n_members) AS n_core, count(*) FILTER (c < n_members) AS n_varying FROM s JOIN m USING (title) GROUP BY title, n_members
""")
def template_line_stability(spark, sf_dir):
    head = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("notes of "), "source")).otherwise(F.upper("source"))
    docs = documents(spark, sf_dir).select("doc_id", F.concat(head, F.lit("\n"), "text").alias("text"))
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.trim(x, F.lit(quality.BLANKS)))
    rows = docs.select("doc_id", X.first_line("text").alias("title"), F.explode(lines).alias("line"))
    return stats.stable_lines(rows.where(X.title_shaped("title") & (F.col("line") != "")), "title", "doc_id", "line", 3)


_LADDER_SQL = """
l AS (
  SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos,
    CASE WHEN l_linenumber = 7 THEN 'PDH' WHEN l_quantity > 45 THEN 'Jan Feb 1 2 3 4 5' WHEN l_quantity > 40 THEN lpad((l_quantity % 24)::BIGINT::VARCHAR, 2, '0') || ':30' ELSE l_quantity::BIGINT::VARCHAR END AS line
  FROM lineitem)
"""


def _line_table(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    q = F.col("l_quantity")
    clock = F.concat(F.lpad((q % 24).cast("bigint").cast("string"), 2, "0"), F.lit(":30"))
    line = F.when(F.col("l_linenumber") == 7, "PDH").when(q > 45, "Jan Feb 1 2 3 4 5").when(q > 40, clock).otherwise(q.cast("bigint").cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", (F.row_number().over(w) - 1).alias("pos"), line.alias("line"))


@query(f"""
WITH {_LADDER_SQL},
k AS (SELECT *, CASE WHEN regexp_full_match(line, '\\d+') THEN 'price' WHEN regexp_full_match(line, '\\d\\d:30') THEN 'time' END AS kind FROM l),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY l_orderkey, kind ORDER BY pos) AS island FROM k),
c AS (SELECT *, (kind IS NOT NULL AND count(*) OVER (PARTITION BY l_orderkey, kind, island) >= 4) OR line = 'Jan Feb 1 2 3 4 5' AS gone FROM i)
SELECT l_orderkey, coalesce(string_agg(line, ' ' ORDER BY pos) FILTER (NOT gone), '') AS cleaned, count(*) FILTER (gone) AS n_removed FROM c GROUP BY 1
""")
def ladder_strip(spark, sf_dir):
    lines = _line_table(spark, sf_dir)
    kind = F.when(F.trim("line").rlike(X.AXIS_PRICE), "price").when(F.trim("line").rlike(X.AXIS_TIME), "time")
    marked = folds.line_runs(lines.withColumn("kind", kind), ["l_orderkey"], "pos", "kind", X.AXIS_RUN)
    gone = F.col("in_run") | X.inline_axis("line")
    kept = F.array_sort(F.collect_list(F.when(~gone, F.struct("pos", "line"))))
    return marked.groupBy("l_orderkey").agg(F.array_join(F.transform(kept, lambda x: x["line"]), " ").alias("cleaned"), F.count_if(gone).alias("n_removed"))


@query(r"""
SELECT doc_id, len(regexp_extract_all(text, '\bthe\b')) AS n_repairs, sha256(regexp_replace(text, '\bthe\b', 'THE', 'g')) AS repaired_sha,
  len(regexp_extract_all(regexp_replace(text, '\bthe\b', 'THE', 'g'), '\bthe\b')) AS second_pass FROM documents
""")
def token_repair(spark, sf_dir):
    fixed, n = quality.repaired(F.col("text"), X.token_pattern("the"), "THE")
    rows = spread(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", n.cast("bigint").alias("n_repairs"), fixed.alias("fixed"))
    again = quality.repaired(F.col("fixed"), X.token_pattern("the"), "THE")[1]
    return rows.select("doc_id", "n_repairs", F.sha2("fixed", 256).alias("repaired_sha"), again.cast("bigint").alias("second_pass"))


@query("""
WITH v AS (SELECT d.lang, CASE WHEN quality = 1 AND toxic = 0 THEN 'faithful' WHEN quality = 1 THEN 'minor' WHEN toxic = 0 THEN 'wrong' WHEN quality = 0 THEN 'unusable' ELSE 'ungraded' END AS verdict
  FROM documents d LEFT JOIN labels l USING (doc_id)),
c AS (SELECT lang, verdict, count(*) AS n FROM v GROUP BY ALL)
SELECT lang, verdict, n, n::DOUBLE / (sum(n) OVER (PARTITION BY lang))::DOUBLE AS share FROM c
""")
def verdict_score(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    good, calm = F.col("quality") == 1, F.col("toxic") == 0
    verdict = F.when(good & calm, "faithful").when(good, "minor").when(calm, "wrong").when(F.col("quality") == 0, "unusable").otherwise("ungraded")
    counts = rows.groupBy("lang", verdict.alias("verdict")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))


@query("SELECT left(sha256(text), 12) AS sha, count(*) AS n, min(doc_id) AS first_doc, count(DISTINCT sha256(lower(text))) AS n_lower FROM documents GROUP BY 1")
def digest_determinism(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.groupBy(X.digest("text", 12).alias("sha")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.count_distinct(X.digest(F.lower("text"))).alias("n_lower"))


@query(r"""
WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'resources/case_studies/vol' || page_id % 9 || '/videos/' WHEN 1 THEN 'resources/live_trading_sessions/' ELSE 'videos/' END AS dir,
  CASE page_id % 3 WHEN 0 THEN 'case_study' WHEN 1 THEN 'live_session' ELSE 'concept' END AS category, regexp_replace(url, '[^A-Za-z0-9._-]', '-', 'g') AS stem FROM pages),
t AS (SELECT *, trim(regexp_replace(lower(trim(regexp_replace(regexp_replace(translate(stem, '_-', '  '), '(?i)(\bconcepts\b|\b\d{3,4}p\b|\b(?:full ?hd|hd|4k)\b)', ' ', 'g'), '\s+', ' ', 'g'))), '[^a-z0-9]+', '_', 'g'), '_') AS name FROM p)
SELECT page_id, dir || stem || '.mp4' AS path, category, CASE WHEN category = 'case_study' THEN 'vol' || page_id % 9 END AS volume,
  CASE category WHEN 'case_study' THEN 'cs_vol' || page_id % 9 || '_' || name WHEN 'live_session' THEN 'live_' || name ELSE 'concept_' || name END AS id FROM t
""")
def path_category(spark, sf_dir):
    third = F.col("page_id") % 3
    folder = F.when(third == 0, F.concat(F.lit("resources/case_studies/vol"), F.col("page_id") % 9, F.lit("/videos/"))).when(third == 1, "resources/live_trading_sessions/").otherwise("videos/")
    path = F.concat(folder, F.regexp_replace("url", "[^A-Za-z0-9._-]", "-"), F.lit(".mp4"))
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return rows.select("page_id", "path", X.path_category("path").alias("category"), X.path_volume("path").alias("volume"), X.media_id("path").alias("id"))


@query("""
WITH g AS (SELECT l_orderkey, list({'label': CASE WHEN l_linenumber % 3 = 0 THEN ' ' ELSE l_returnflag END, 'value': l_quantity::BIGINT::VARCHAR} ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS levels,
  min(l_linestatus) AS kind FROM lineitem GROUP BY 1),
f AS (SELECT *, list_filter(levels, lambda x: trim(x.label) <> '') AS kept FROM g)
SELECT l_orderkey, len(kept) AS n_levels, kind = 'O' OR len(kept) > 2 AS has_chart, concat_ws(',', CASE WHEN len(levels) >= 6 THEN 'levels' END, CASE WHEN kept[1].value = '50' THEN 'value' END) AS caps,
  array_to_string(list_transform(kept, lambda x: x.label || '=' || x.value), ';') AS flat FROM f
""")
def nested_chart_block(spark, sf_dir):
    label = F.when(F.col("l_linenumber") % 3 == 0, " ").otherwise(F.col("l_returnflag"))
    level = F.struct(label.alias("label"), F.col("l_quantity").cast("bigint").cast("string").alias("value"))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", level.alias("level"))
    chart = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["level"]).alias("levels"), F.min("l_linestatus").alias("kind"))
    kept = chart.withColumn("kept", F.filter("levels", lambda x: F.trim(x["label"]) != ""))
    caps = quality.named_where({"levels": F.size("levels") >= 6, "value": F.get("kept", F.lit(0))["value"] == "50"})
    flat = F.array_join(F.transform("kept", lambda x: F.concat(x["label"], F.lit("="), x["value"])), ";")
    has = (F.col("kind") == "O") | (F.size("kept") > 2)
    return kept.select("l_orderkey", F.size("kept").cast("bigint").alias("n_levels"), has.alias("has_chart"), F.array_join(caps, ",").alias("caps"), flat.alias("flat"))


@query("""
SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')) AS n_lines,
  len(list_filter(string_split(text, chr(10)), lambda x: contains(x, '|'))) AS n_tables, strlen(text)::BIGINT AS n_bytes FROM documents
""")
def line_counts(spark, sf_dir):
    lines = F.split("text", "\n", -1)
    return documents(spark, sf_dir).select(
        "doc_id", F.size(F.filter(lines, lambda x: F.trim(x) != "")).cast("bigint").alias("n_lines"),
        F.size(F.filter(lines, lambda x: F.contains(x, F.lit("|")))).cast("bigint").alias("n_tables"), F.octet_length("text").cast("bigint").alias("n_bytes"),
    )


@query("""
WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'no object' WHEN 1 THEN 'Sure: ' || props || ' done }' WHEN 2 THEN '{broken ' || props ELSE props END AS reply, props FROM events)
SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN props END AS found, event_id % 4 <> 0 AS complete FROM t
""")
def reply_objects(spark, sf_dir):
    turn = F.col("event_id") % 4
    reply = F.when(turn == 0, "no object").when(turn == 1, F.concat(F.lit("Sure: "), "props", F.lit(" done }"))).when(turn == 2, F.concat(F.lit("{broken "), "props")).otherwise(F.col("props"))
    rows = table(spark, sf_dir, "events").select("event_id", replies.json_object(reply).alias("found"))
    return rows.withColumn("complete", F.col("found").isNotNull() & F.coalesce(replies.complete("found", ["k"]), F.lit(False)))


@query("""
WITH s AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'done' ELSE 'running' END AS status FROM labels)
SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM s WHERE status = 'done')
""")
def complete_only(spark, sf_dir):
    from millrace.operators.incremental import complete_only as only

    stages = table(spark, sf_dir, "labels").select("doc_id", F.lit("extract").alias("stage"), F.when(F.col("quality") == 1, "done").otherwise("running").alias("status"))
    return only(documents(spark, sf_dir).select("doc_id", "n_chars"), stages, "doc_id", "extract")

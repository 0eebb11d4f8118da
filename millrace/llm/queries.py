"""The training-data operators over the whole tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.readers import spread, table

from . import bpe, class_lm, exact_topk, language_id, licences, merkle, near_dedup, ogg, packing, quality_fm, reply_trees, resampling, warc


def _crc(column: str, modulus: int):
    return F.crc32(F.col(column).cast("string")) % modulus


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", *columns))


def op1_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.features(documents(spark, sf_dir))


def op2_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    found = reply_trees.conversations_of(rows)
    said_turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return found.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(said_turns, ""), 256).alias("turns_sha256"),
        F.char_length("learned").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("learned"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), width=2, percent=80)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "lang").withColumn("held_out", _crc("doc_id", 4) == 2)
    models = language_id.fit(docs.where("not held_out"))
    found = language_id.identify(docs.select("doc_id", "text", "held_out"), models)
    return found.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), vocabulary())


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scanned(documents(spark, sf_dir)).drop("text")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = warc.written(table(spark, sf_dir, "pages"))
    return warc.read_archives(chunks).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", _crc("doc_id", 5) == 0)
    model = quality_fm.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").where(_crc("doc_id", 5) != 0))
    return quality_fm.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), vocabulary())


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "source", "lang", "n_chars")
    return merkle.proofs(docs, tampered=_crc("doc_id", 7) == 0, changed={"n_chars": F.col("n_chars") + 1})


def op12_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", F.coalesce(_crc("doc_id", 7) == 2, F.lit(False)))
    model, counts = class_lm.fit(docs.where("not held_out"))
    return class_lm.scored(docs, model, counts, ["doc_id", "held_out"])


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ogg_media, op2_reply_trees, op3_near_dedup, op4_language_id, op5_bpe, op6_exact_topk, op7_licence_scan, op8_warc,
        op9_quality_fm, op10_packing, op11_merkle_manifest, op12_class_lm, op13_importance_resampling,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN [words[1]]
    ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS shingle
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id
  GROUP BY 1, 2),
e AS (
  SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (
  SELECT doc_id AS id, doc_id AS seen FROM documents
  UNION SELECT r.id, x.b FROM reach r JOIN both_ways x ON x.a = r.seen)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.of AS component_id, d.doc_id = r.of AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(seen) AS of FROM reach GROUP BY id) r ON r.id = d.doc_id
""",
    "op2_reply_trees": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marks AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\<\[]', '', 'g')) AS body,
    length(role) + length(regexp_replace(role, '[^\\<\[|]', '', 'g')) AS head
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(head + body + 13)::BIGINT AS formatted_chars
FROM marks GROUP BY conv_id
""",
    "op6_exact_topk": """
WITH v AS (
  SELECT row_number() OVER () AS ask, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.ask, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY ask ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
""",
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < first_id THEN first_id END AS refers_to
FROM f
""",
}


def _licence_sql() -> str:
    """Every passage against every template of fitting size."""
    quoted = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in licences.TEMPLATES.items())
    t = licences.THRESHOLD
    grams = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
    words = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"
    return f"""
WITH t AS (SELECT name, {grams.format("w")} AS g FROM (SELECT name, {words.format("text")} AS w FROM (VALUES {quoted}) x(name, text))),
p AS (
  SELECT doc_id, unnest(list_distinct(list_concat([text], regexp_split_to_array(text, '\\n[ \\t\\r\\f\\v]*\\n'), string_split(text, chr(10))))) AS passage
  FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, {grams.format("w")} AS g FROM (SELECT doc_id, {words.format("passage")} AS w FROM p)),
m AS (
  SELECT doc_id, name, 2.0::DOUBLE * len(list_intersect(g.g, t.g)) / (len(g.g) + len(t.g)) AS dice
  FROM g JOIN t ON len(g.g) BETWEEN {t} / (2 - {t}) * len(t.g) - 1e-9 AND (2 - {t}) / {t} * len(t.g) + 1e-9),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, name) AS at, count(*) OVER (PARTITION BY doc_id) AS n FROM m WHERE dice >= {t} - 1e-12)
SELECT d.doc_id, k.name AS licence, k.dice, coalesce(k.n, 0)::BIGINT AS n_matches
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id AND k.at = 1
""".replace("\\n", "\n").replace("\\t", "\t").replace("\\r", "\r").replace("\\f", "\f").replace("\\v", "\v")


ORACLE_SQL["op7_licence_scan"] = _licence_sql()


def crc32_sql(value: str, table: str = "crc.t") -> str:
    """CRC-32 of a text's UTF-8 bytes over the table of ``CRC_SQL``."""
    data = f"list_transform(range(0, strlen({value})), lambda i: ('0x' || substr(hex(encode({value})), 2 * i + 1, 2))::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {data}), lambda c, b: xor(c >> 8, {table}[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT"


#: One row with the remainders of all bytes, from the polynomial.
_STEP = "CASE WHEN {0} % 2 = 1 THEN xor({0} >> 1, 3988292384::UBIGINT) ELSE {0} >> 1 END"
CRC_SQL = f"SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i::UBIGINT, [0::UBIGINT for k in range(8)]), lambda c, k: {_STEP.format('c')})) AS t"

_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = " || ".join(_FIELD.format(f) for f in merkle.FIELDS)
_UP = "list_transform(range(0, (len(h) + 1) // 2), lambda i: sha256(h[2 * i + 1] || coalesce(h[2 * i + 2], '')))"
_SIBLING = "CASE WHEN h[xor({0} >> level, 1) + 1] IS NULL THEN '-' ELSE (CASE WHEN ({0} >> level) % 2 = 1 THEN 'L' ELSE 'R' END) || h[xor({0} >> level, 1) + 1] END"

ORACLE_SQL["op11_merkle_manifest"] = f"""
WITH RECURSIVE crc AS ({CRC_SQL}),
d AS (SELECT row_number() OVER () AS uid, * FROM documents),
l AS (
  SELECT uid, doc_id, lang, sha256({_LEAF}) AS leaf, CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 7 = 0 THEN sha256({_LEAF.replace("n_chars", "(n_chars + 1)")}) END AS changed
  FROM d, crc),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, uid) - 1 AS pos FROM l),
t AS (
  SELECT lang, list(leaf ORDER BY pos) AS h, 0 AS level FROM p GROUP BY lang
  UNION ALL SELECT lang, {_UP}, level + 1 FROM t WHERE len(h) > 1),
g AS (SELECT lang, h[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM t WHERE len(h) = 1),
u AS (
  SELECT list(subroot ORDER BY place) AS h, 0 AS level FROM g HAVING count(*) > 0
  UNION ALL SELECT {_UP}, level + 1 FROM u WHERE len(h) > 1),
s AS (
  SELECT uid, level AS k, {_SIBLING.format("pos")} AS sib FROM p JOIN t ON t.lang IS NOT DISTINCT FROM p.lang AND len(h) > 1
  UNION ALL SELECT uid, 1000 + level, {_SIBLING.format("place")} FROM p JOIN g ON g.lang IS NOT DISTINCT FROM p.lang JOIN u ON len(h) > 1),
x AS (SELECT uid, list(sib ORDER BY k) AS sibs FROM s GROUP BY uid),
r AS (SELECT h[1] AS root FROM u WHERE len(h) = 1),
f AS (
  SELECT p.doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(coalesce(sibs, []), lambda v: substr(v, 2)), '')) AS proof_sha256,
    list_reduce(list_prepend(coalesce(changed, leaf), coalesce(sibs, [])), lambda a, v: sha256(CASE WHEN v[1] = 'L' THEN substr(v, 2) || a ELSE a || substr(v, 2) END)) AS folded_root
  FROM p JOIN g ON g.lang IS NOT DISTINCT FROM p.lang LEFT JOIN x USING (uid), r)
SELECT *, folded_root = root AS verified FROM f
"""

ORACLE_SQL["op13_importance_resampling"] = f"""
WITH crc AS ({CRC_SQL}),
w AS (
  SELECT 0 AS side, doc_id, row_number() OVER () AS uid, text FROM documents UNION ALL SELECT 1, NULL, row_number() OVER (), text FROM benchmark),
v AS (
  SELECT side, doc_id, uid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM w),
f AS (
  SELECT side, uid, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS feature FROM v),
d AS (SELECT DISTINCT feature FROM f),
b AS (SELECT feature, {crc32_sql("feature")} % 10000 AS bucket FROM d, crc),
c AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM f JOIN b USING (feature) GROUP BY 1),
n AS (SELECT sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM c),
g AS (
  SELECT bucket, floor(1000 * ln(((c.t + 1)::DOUBLE * (n.s + 10000)) / ((c.s + 1)::DOUBLE * (n.t + 10000))))::BIGINT AS gain FROM c, n),
m AS (SELECT uid, count(*) AS n_features, sum(gain)::BIGINT AS gain FROM f JOIN b USING (feature) JOIN g USING (bucket) WHERE side = 0 GROUP BY 1),
x AS (
  SELECT doc_id, uid, len(words) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features,
    coalesce((gain - (gain % n_features + n_features) % n_features) // n_features, 0)::BIGINT AS weight,
    ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM v LEFT JOIN m USING (uid) WHERE side = 0),
y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM x),
z AS (SELECT uid, row_number() OVER (ORDER BY score DESC, doc_id, uid) AS rank, count(*) OVER () AS n FROM y WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM y LEFT JOIN z USING (uid)
"""

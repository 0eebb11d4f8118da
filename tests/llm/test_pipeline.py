"""The corpus pipeline, stage by stage, and the registered queries."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import __spark_entry__  # noqa: E402
import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
import public_tokenizers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from millrace.llm import language_id, quality_fm  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    pieces = corpus_pipeline.run(spark, SF).toPandas()
    assert pieces.doc_id.nunique() == before
    assert (pieces.groupby("sequence_id").length.sum() <= 1024).all()


def test_stages_equal_brute_force(spark):
    """Each stage and the whole, row by row: with nulls, blanks, a very long text, ties, repeated rows and a near copy."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 1000 and (doc_id % 3 = 0 or lang <> 'en')")  # few and short, for the pairs written out
    some = docs.where("lang = 'en' and n_chars between 600 and 1000").orderBy("doc_id").first()
    words = some.text.split()
    extra = [
        (90001, None, "en"), (90002, "", "en"), (90003, " \n\t ", None), (90004, "12 34 !!", "en"), (90005, (some.text + " ") * 60, "en"), (90006, some.text, "en"),
        (90006, some.text, "en"), (90007, " ".join(words[:-2]), None), (90008, "zq" * 400, None),
    ]
    rows = spark.createDataFrame(extra, "doc_id bigint, text string, lang string").select("doc_id", "text", "lang", F.lit("web").alias("source"), F.char_length("text").cast("bigint").alias("n_chars"))
    docs = docs.unionByName(rows)
    labels = spark.read.parquet(f"{sf}/labels.parquet")

    held = (F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1000)) < 250).alias("held")
    drawn = docs.where("lang is not null").select("text", "lang", held).collect()  # few enough that all are drawn
    want = brute.languages([(r.text, r.lang) for r in drawn if not r.held], [(r.text, r.lang) for r in drawn if r.held], [r.asDict() for r in docs.collect()], language_id.shuffled)
    found = corpus_pipeline.language(spark, docs, sf)
    same = lambda a, b: sorted((r["doc_id"], r["text"]) for r in a) == sorted((r["doc_id"], r["text"]) for r in b)
    assert same(found.collect(), want) and len(want) < docs.count() - 4

    model = quality_fm.fit(found, labels)
    want = brute.quality(model, quality_fm.Features(), want)
    found = corpus_pipeline.quality(spark, found, sf)
    assert same(found.collect(), want)

    want = brute.near_duplicates(want)
    found = corpus_pipeline.near_duplicates(spark, found, sf)
    assert same(found.collect(), want)
    assert not {90005, 90006, 90007} & {r["doc_id"] for r in want}  # the long text repeats the one it is made of

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = [r.asDict() for r in corpus_pipeline.pack(spark, found, sf).collect()]
    brute.packed_well(pieces, want, lambda t: library.encode(t, add_special_tokens=False).ids)


def test_stages_on_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_names():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_columns_with_clashing_names_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for c in ("score", "rejected", "predicted", "id", "label", "lang_pred"):
        docs = docs.withColumn(c, F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns, name
        assert kept.where("score <> concat('score of ', doc_id) or rejected <> concat('rejected of ', doc_id)").isEmpty()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()

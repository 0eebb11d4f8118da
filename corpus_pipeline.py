"""Documents to training sequences: language, quality, near duplicates, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import language_id, near_dedup, packing, quality_fm
from millrace.llm.common import stored
from millrace.sources.readers import spread, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _kept(docs: DataFrame, judged: Callable[[DataFrame, str], DataFrame], condition: str) -> DataFrame:
    """The rows of ``docs`` that a judgement of their text keeps, unchanged: its columns cannot clash with theirs."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    found = judged(docs.toDF(*names), names[docs.columns.index("text")])
    return found.where(condition).select(*names).toDF(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those that the models reject go.

    Null, empty and blank texts and those without a letter go; ties go to the
    language that sorts first; repeated rows are judged alike, each once; very
    long texts are scored whole, in parts. Fitted on the rows of ``docs`` that
    have a ``lang``; without any, every document goes. An empty table stays empty.
    """
    models = language_id.fit(docs)
    return _kept(docs, lambda d, text: language_id.identify(d, models, text), "not rejected")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted good; those that the classifier rejects go.

    Null and empty texts have one defined score and stay or go together; repeated
    rows are judged alike; a score of exactly the threshold stays; very long texts
    are scored whole. Learned from ``labels`` of the documents at hand; without
    any usable label all stay. An empty table stays empty.
    """
    model = quality_fm.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _kept(docs, lambda d, text: quality_fm.score(d, model, text), "predicted = 1")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more): the one with the smallest id.

    Null, empty and blank texts are near nothing and stay; rows without an id
    stay; of rows with equal id and text one stays, and different texts of one id
    are documents of their own. An empty table stays empty.
    """
    return near_dedup.deduplicated(docs, width=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 1024.

    Null and empty texts are one closing token; repeated rows are packed once
    each; very long texts are cut at window ends. An empty table has no pieces.
    """
    return packing.packed(docs)


STAGES: list[tuple[str, Stage]] = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("packing", pack)]

#: Models, tokens and packing have no SQL form; tests/llm/test_pipeline.py holds every stage against a row-by-row version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again before the next."""
    docs = spread(table(spark, sf_dir, "documents"))
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

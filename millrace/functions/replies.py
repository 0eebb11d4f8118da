"""JSON out of replies that have text around it."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .prices import col


def first_object(text: str | None) -> str | None:
    """The first brace-balanced stretch that is a JSON object; braces inside strings do not count."""
    start = (text or "").find("{")
    decoder = json.JSONDecoder()
    while start >= 0:
        try:
            found, end = decoder.raw_decode(text, start)
        except ValueError:
            start = text.find("{", start + 1)
            continue
        return text[start:end] if isinstance(found, dict) else None
    return None


@F.pandas_udf(T.StringType())
def _first_object(texts: pd.Series) -> pd.Series:
    return texts.map(first_object)


def json_object(reply: Column | str) -> Column:
    """The first JSON object of a reply as text, null without one. Texts without a brace never reach Python."""
    return F.when(F.contains(col(reply), F.lit("{")), _first_object(col(reply)))


def complete(document: Column | str, required: list[str]) -> Column:
    """Does a JSON object have all required keys, none of them null?"""
    out = F.lit(True)
    for key in required:
        out &= F.get_json_object(col(document), f"$.{key}").isNotNull()
    return out

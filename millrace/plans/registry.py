"""The registry: a query is a function of (spark, sf_dir), with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Events as trades, and bars of them, in SQL.
TRADES_SQL = """(SELECT ts, event_id AS sequence, value AS price, regexp_extract(props, '"k": (\\d+)', 1)::BIGINT AS size, event_type AS symbol FROM events)"""


def bars_sql(width: str, by: str = "", ts: str = "ts", where: str = "true") -> str:
    lead = f"{by}, " if by else ""
    return f"""(SELECT time_bucket(INTERVAL '{width}', {ts}) AS bar_ts, {lead}first(price ORDER BY {ts}, sequence) AS open, max(price) AS high, min(price) AS low,
      last(price ORDER BY {ts}, sequence) AS close, sum(size)::BIGINT AS volume, count(*) AS n_trades
      FROM {TRADES_SQL} WHERE {where} GROUP BY ALL)"""

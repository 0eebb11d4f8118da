"""Session windows and joins of two live feeds, with bounded state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sessions(events: DataFrame, by: Sequence[str], gap: str, aggregates: dict[str, Column], ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Sessions of each group that are closed: rows no further apart than ``gap``, once the watermark has passed the last one by it.

    Adds session_start and last_seen. Open sessions are all the state there is; a
    row that arrives after its session's end has passed the watermark is dropped
    and counted (``dropped``). The sessions of one group meet in one task, as
    aggregates and not as rows.
    """
    window = F.session_window(ts, gap)
    found = events.withWatermark(ts, late).groupBy(*by, window.alias("w")).agg(*[a.alias(n) for n, a in aggregates.items()])
    return found.select(*by, F.col("w.start").alias("session_start"), (F.col("w.end") - F.expr(f"interval {gap}")).alias("last_seen"), *aggregates)


def joined(left: DataFrame, right: DataFrame, by: Sequence[str], left_ts: str, right_ts: str, before: str, how: str = "inner", late: str = "10 minutes") -> DataFrame:
    """Rows of ``left`` with the rows of ``right`` of the same keys that came at most ``before`` (and not after) them.

    Names of the two sides differ but for ``by``. Both sides are watermarked, so a
    row is kept only as long as a partner within the range can still come; with
    ``how`` left, rows without partner come out then. One key's open range meets
    in one task.
    """
    a = left.withWatermark(left_ts, late)
    b = right.withWatermark(right_ts, late).select(*[F.col(c).alias(f"_{c}") if c in by else F.col(c) for c in right.columns])
    near = (F.col(right_ts) <= F.col(left_ts)) & (F.col(right_ts) >= F.col(left_ts) - F.expr(f"interval {before}"))
    for c in by:
        near &= F.col(c) == F.col(f"_{c}")
    return a.join(b, near, "leftOuter" if how == "left" else how).drop(*[f"_{c}" for c in by])


def dropped(query: StreamingQuery) -> int:
    """Late rows that a query's operators have left out so far in this run, as far as its recent progress goes."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])


def state_rows(query: StreamingQuery) -> list[int]:
    """Rows of state after each batch of this run."""
    return [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress]

"""Trades to verified bars: building, splicing, checking, levels.

Bars are keyed by arrival time. A bar's open and close are the prices of its
first and last trade by (arrival, sequence); aggregation is partial before the
shuffle, so a hot bar costs one row a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import scans

#: Width and offset of each timeframe; weeks begin on Monday.
TIMEFRAMES = {"1m": ("1 minute", None), "5m": ("5 minutes", None), "15m": ("15 minutes", None), "60m": ("1 hour", None), "1h": ("1 hour", None), "D": ("1 day", None), "W": ("7 days", "4 days")}


def bar_start(ts: str, timeframe: str) -> Column:
    width, offset = TIMEFRAMES[timeframe]
    return F.window(ts, width, width, offset)["start"] if offset else F.window(ts, width)["start"]


def bars(trades: DataFrame, timeframe: str, by: Sequence[str] = (), ts: str = "ts", sequence: str = "sequence", price: str = "price", size: str = "size") -> DataFrame:
    """bar_ts, ``by``, open, high, low, close, volume, n_trades. Trades with a null time or price take no part."""
    order = F.struct(ts, sequence)
    used = trades.where(F.col(ts).isNotNull() & F.col(price).isNotNull())
    return used.groupBy(bar_start(ts, timeframe).alias("bar_ts"), *by).agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.sum(size).cast("bigint").alias("volume"),
        F.count("*").alias("n_trades"),
    )


def multi_timeframe(trades: DataFrame, timeframes: Sequence[str], **columns: str) -> DataFrame:
    """tf, bar_ts and the bar of every timeframe, the finest first: the trades are read once, coarser bars are made from the finest."""
    fine = bars(trades, timeframes[0], **columns)
    out = fine.select(F.lit(timeframes[0]).alias("tf"), "*")
    for tf in timeframes[1:]:
        out = out.unionByName(rolled_up(fine, tf, columns.get("by", ())).select(F.lit(tf).alias("tf"), "*"))
    return out


def rolled_up(fine: DataFrame, timeframe: str, by: Sequence[str] = ()) -> DataFrame:
    """Coarser bars from finer ones: the same answer as from trades, from far fewer rows."""
    return fine.groupBy(bar_start("bar_ts", timeframe).alias("start"), *by).agg(
        F.min_by("open", "bar_ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "bar_ts").alias("close"), F.sum("volume").alias("volume"), F.sum("n_trades").alias("n_trades"),
    ).withColumnRenamed("start", "bar_ts")


LEGS = ("open", "high", "low", "close")


def overlap_mismatches(a: DataFrame, b: DataFrame, key: str = "bar_ts", columns: Sequence[str] = (*LEGS, "volume")) -> DataFrame:
    """Shared bars with n_different: how many columns differ."""
    right = b.select(key, *[F.col(c).alias(f"other_{c}") for c in columns])
    differ = sum((F.when(F.col(c).eqNullSafe(F.col(f"other_{c}")), 0).otherwise(1) for c in columns), F.lit(0))
    return a.select(key, *columns).join(right, key).select(key, differ.alias("n_different"))


def overlap_report(a: DataFrame, b: DataFrame, key: str = "bar_ts") -> DataFrame:
    """n_shared, n_mismatched and ok: there are shared bars and none differs."""
    found = overlap_mismatches(a, b, key).agg(F.count("*").alias("n_shared"), F.count_if(F.col("n_different") > 0).alias("n_mismatched"))
    return found.select("n_shared", "n_mismatched", ((F.col("n_shared") > 0) & (F.col("n_mismatched") == 0)).alias("ok"))


def spliced(spine: DataFrame, extension: DataFrame, key: str = "bar_ts") -> DataFrame:
    """The spine and the extension's rows strictly after its end, under the spine's symbol. A one-row bound is joined, not collected."""
    end = spine.agg(F.max(key).alias("_end"), F.max_by("symbol", key).alias("_symbol"))
    tail = extension.crossJoin(F.broadcast(end)).where(F.col("_end").isNull() | (F.col(key) > F.col("_end")))
    tail = tail.withColumn("symbol", F.coalesce("_symbol", "symbol")).drop("_end", "_symbol")
    return spine.unionByName(tail.select(spine.columns))


def roll_violations(spine: DataFrame, extension: DataFrame, key: str = "bar_ts", instrument: str = "instrument_id") -> DataFrame:
    """Instruments after the seam that are not the spine's last one, with their number of bars."""
    end = spine.agg(F.max(key).alias("_end"), F.max_by(instrument, key).alias("_last"))
    after = extension.crossJoin(F.broadcast(end)).where((F.col(key) > F.col("_end")) & (F.col(instrument) != F.col("_last")))
    return after.groupBy(instrument).agg(F.count("*").alias("n_bars"))


def spliced_or_raise(spine: DataFrame, extension: DataFrame, key: str = "bar_ts") -> DataFrame:
    """``spliced``, once the seam is shown to hold no roll."""
    if not roll_violations(spine, extension, key).isEmpty():
        raise ValueError("instrument changes at the seam")
    return spliced(spine, extension, key)


def invariant_violations(frame: DataFrame, key: str = "bar_ts", symbol: str = "symbol") -> DataFrame:
    """rule, n: how many rows break each rule (all rules, also those that none breaks)."""
    envelope = (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))
    per_key = frame.groupBy(symbol, key).agg(
        F.count("*").alias("n"), F.count_if(envelope).alias("envelope"), F.count_if(F.coalesce("volume", F.lit(0)) <= 0).alias("no_volume")
    )
    found = per_key.agg(
        F.coalesce(F.sum("envelope"), F.lit(0)).alias("envelope"), F.coalesce(F.sum("no_volume"), F.lit(0)).alias("no_volume"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_key"), F.greatest(F.count_distinct(symbol) - 1, F.lit(0)).alias("extra_symbols"),
    )
    rules = ("envelope", "no_volume", "duplicate_key", "extra_symbols")
    return found.select(F.stack(F.lit(len(rules)), *[x for r in rules for x in (F.lit(r), F.col(r).cast("bigint"))]).alias("rule", "n"))


def out_of_order(frame: DataFrame, by: Sequence[str], position: str, ts: str) -> DataFrame:
    """Rows whose time is before that of the row before them."""
    w = Window.partitionBy(*by).orderBy(position)
    return frame.withColumn("_before", F.lag(ts).over(w)).where(F.col(ts) < F.col("_before")).drop("_before")


def previous_levels(daily: DataFrame, by: Sequence[str], key: str = "bar_ts") -> DataFrame:
    """Each day with the high, low and close of the bar before."""
    w = Window.partitionBy(*by).orderBy(key)
    return daily.select(*by, key, F.lag("high").over(w).alias("prev_high"), F.lag("low").over(w).alias("prev_low"), F.lag("close").over(w).alias("prev_close"))


def month_extremes(daily: DataFrame, by: Sequence[str], key: str = "bar_ts") -> DataFrame:
    """Highest and lowest daily close of each month."""
    month = F.date_format(key, "yyyy-MM").alias("month")
    return daily.groupBy(*by, month).agg(F.max("close").alias("highest_close"), F.min("close").alias("lowest_close"))


def moving_sums(frame: DataFrame, by: Sequence[str], key: str, value: str, widths: Sequence[int]) -> DataFrame:
    """For every width: sum and number of the last ``width`` values (the average is their ratio)."""
    out = frame
    for n in widths:
        w = Window.partitionBy(*by).orderBy(key).rowsBetween(-(n - 1), 0)
        out = out.withColumn(f"sum_{n}", F.sum(value).over(w)).withColumn(f"n_{n}", F.count(value).over(w))
    return out


def trade_statistics(trades: DataFrame, by: Sequence[str], r: str, order: Sequence[str]) -> DataFrame:
    """n, wins, total R and the deepest fall of running R below its highest value so far (start included)."""
    run = scans.running(scans.running(scans.placed(trades, by, order), by, order, r, "_run"), by, order, "_run", "_peak", "max")
    run = run.withColumn("_peak", F.greatest("_peak", F.lit(0).cast(run.schema["_run"].dataType)))
    return run.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(F.col(r) > 0).alias("wins"), F.sum(r).alias("total_r"), F.max(F.col("_peak") - F.col("_run")).alias("max_drawdown")
    )


def local_clock(ts: Column, zone: str = "America/Los_Angeles") -> Column:
    """UTC wall time to a zone's, daylight saving included."""
    return F.from_utc_timestamp(ts.cast("timestamp"), zone).cast("timestamp_ntz")


def higher_timeframe(low: DataFrame, high: DataFrame, by: Sequence[str], width: str, key: str = "bar_ts", columns: Sequence[str] = LEGS) -> DataFrame:
    """Every finer bar with the last coarser bar that had ended by then (as-of, by union and a running last)."""
    marked = high.select(*by, (F.col(key) + F.expr(f"interval {width}")).alias("_at"), F.lit(0).alias("_side"), F.struct(key, *columns).alias("_high"))
    own = low.select(*by, F.col(key).alias("_at"), F.lit(1).alias("_side"), F.struct(low.columns).alias("_low"))
    w = Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = marked.unionByName(own, allowMissingColumns=True).withColumn("_seen", F.last("_high", ignorenulls=True).over(w))
    return both.where("_side = 1").select("_low.*", F.col(f"_seen.{key}").alias("high_ts"), *[F.col(f"_seen.{c}").alias(f"high_{c}") for c in columns])

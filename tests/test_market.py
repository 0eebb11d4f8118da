"""Bars, splices, price readings and joins on hand-made rows; every gate with a fault it must see."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.functions import prices as P
from millrace.operators import bars as B
from millrace.operators import joins, quality, stats


def at(text):
    return dt.datetime.fromisoformat(f"2024-01-02 {text}")


TRADES = "ts timestamp_ntz, ts_event timestamp_ntz, sequence bigint, price double, size bigint"


@pytest.fixture(scope="module")
def trades(spark):
    rows = [
        (at("19:29:59.600000"), at("19:29:59.500000"), 1, 100.0, 5),
        (at("19:30:00.000100"), at("19:29:59.999600"), 2, 101.0, 12),
        (at("19:30:10"), at("19:30:10"), 3, 102.0, 1),
    ]
    return spark.createDataFrame(rows, TRADES)


def test_bars_are_keyed_by_arrival(trades):
    got = [tuple(r)[1:6] for r in B.bars(trades, "1m").orderBy("bar_ts").collect()]
    assert got == [(100.0, 100.0, 100.0, 100.0, 5), (101.0, 102.0, 101.0, 102.0, 13)]
    wrong = [tuple(r)[1:6] for r in B.bars(trades, "1m", ts="ts_event").orderBy("bar_ts").collect()]
    assert wrong[0] == (100.0, 101.0, 100.0, 101.0, 17)


def test_open_and_close_follow_the_sequence_in_ties(spark):
    rows = [(at("10:00:00"), None, 2, 7.0, 1), (at("10:00:00"), None, 1, 5.0, 1), (at("10:00:00"), None, 3, 6.0, 1), (None, None, 0, 9.0, 1)]
    for n in (1, 8):
        r = B.bars(spark.createDataFrame(rows, TRADES).repartition(n), "1m").first()
        assert (r.open, r.close, r.n_trades) == (5.0, 6.0, 3)


def test_weeks_begin_on_monday(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 10, 5), None, 1, 1.0, 1)], TRADES)
    assert B.bars(df, "W").first().bar_ts == dt.datetime(2024, 1, 8)


def test_coarse_bars_from_fine_ones(spark, trades):
    direct, rolled = B.bars(trades, "1h"), B.rolled_up(B.bars(trades, "1m"), "1h")
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, rolled.select(direct.columns).collect()))


BAR = "bar_ts timestamp_ntz, symbol string, open double, high double, low double, close double, volume bigint, instrument_id int, source string"


def bar(time, symbol="A", o=10.0, h=12.0, low=9.0, c=11.0, v=5, i=7, source="s"):
    return (at(time), symbol, o, h, low, c, v, i, source)


@pytest.mark.parametrize(
    ("extra", "rule"),
    [(bar("10:01:00", h=8.0), "envelope"), (bar("10:01:00", o=13.0), "envelope"), (bar("10:01:00", c=8.0), "envelope"), (bar("10:01:00", v=0), "no_volume"), (bar("10:00:00"), "duplicate_key"), (bar("10:01:00", symbol="B"), "extra_symbols")],
)
def test_each_invariant_sees_its_fault(spark, extra, rule):
    clean = {r.rule: r.n for r in B.invariant_violations(spark.createDataFrame([bar("10:00:00")], BAR)).collect()}
    assert set(clean.values()) == {0}
    got = {r.rule: r.n for r in B.invariant_violations(spark.createDataFrame([bar("10:00:00"), extra], BAR)).collect()}
    assert got == {**clean, rule: 1}


def test_splice_is_strict_and_guards_the_roll(spark):
    spine = spark.createDataFrame([bar("09:58:00"), bar("10:00:00")], BAR)
    tail = [bar("09:59:00", symbol="B"), bar("10:00:00", symbol="B"), bar("10:01:00", symbol="B", source="t"), bar("10:02:00", symbol="B", source="t")]
    got = B.spliced_or_raise(spine, spark.createDataFrame(tail, BAR)).orderBy("bar_ts").collect()
    assert [r.bar_ts for r in got] == [at("09:58:00"), at("10:00:00"), at("10:01:00"), at("10:02:00")]
    assert {r.symbol for r in got} == {"A"} and got[-1].source == "t"
    with pytest.raises(ValueError):
        B.spliced_or_raise(spine, spark.createDataFrame([bar("10:01:00", i=8)], BAR))


def test_overlap_report_needs_shared_bars(spark):
    a = spark.createDataFrame([bar("10:00:00")], BAR)
    assert B.overlap_report(a, a).first().ok
    assert not B.overlap_report(a, spark.createDataFrame([bar("10:05:00")], BAR)).first().ok
    assert B.overlap_report(a, spark.createDataFrame([bar("10:00:00", v=6)], BAR)).first().n_mismatched == 1


def test_out_of_order(spark):
    df = spark.createDataFrame([("A", 0, at("10:00:00")), ("A", 1, at("09:00:00"))], "s string, i int, ts timestamp_ntz")
    assert B.out_of_order(df, ["s"], "i", "ts").count() == 1


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "symbol"),
    [("NQ1!", "NQ"), ("NASDAQ 100 E-mini Futures", "NQ"), ("MES1!", "ES"), ("NQ.c.0", "NQ"), ("Wheat Futures", "WHEAT FUTURES"), ("Close", "CLOSE"), ("GBP/JPY", "GBPJPY"), ("6B", "6B")],
)
def test_symbols(spark, raw, symbol):
    assert one(spark, P.symbol(F.lit(raw))) == symbol


@pytest.mark.parametrize(
    ("label", "kind"), [("PDH", "method_term"), ("M", "other"), ("", "unlabelled"), (None, "unlabelled"), ("Monday Close", "method_term"), ("Swing Failure Pattern SFP", "other"), ("Yellow line", "method_term")]
)
def test_label_classes(spark, label, kind):
    assert one(spark, P.label_class(F.lit(label).cast("string"))) == kind


def test_prices_and_ticks(spark):
    for raw, value, ticks in (("25,138.10", 25138.10, None), ("$25,138.25", 25138.25, 100553), ("1_000", None, None), ("nan", None, None), ("", None, None), ("abc", None, None)):
        assert one(spark, P.price(F.lit(raw))) == value and one(spark, P.ticks(P.price(F.lit(raw)))) == ticks
    assert one(spark, P.bps(F.lit(0.0), F.lit(0.0))) == 0
    assert [one(spark, P.clock(F.lit(x))) for x in (-5, 0, 3661.9)] == ["00:00:00", "00:00:00", "01:01:01"]


LEGS = ("open", "high", "low", "close")


def quads(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} string, open bigint, high bigint, low bigint, close bigint")


def test_three_of_four_legs(spark):
    bars = quads(spark, [("b", 101541, 101660, 101517, 101578), ("far", 1, 2, 3, 4)], "bar")
    seen = quads(spark, [("o", 101542, 101660, 101517, 101578)], "obs")
    got = joins.k_of_n(seen, bars, LEGS, 3, "obs", "bar").collect()
    assert [(r.bar, r.n_agree, r.agreeing) for r in got] == [("b", 3, "high,low,close")]
    assert joins.k_of_n(seen, bars, LEGS, 4, "obs", "bar").count() == 0
    shifted = seen.select("obs", *[(F.col(x) + 1).alias(x) for x in LEGS])
    assert joins.k_of_n(shifted.withColumn("open", F.lit(101542)), bars, LEGS, 3, "obs", "bar").count() == 0
    nulls = quads(spark, [("n", None, None, 101517, 101578)], "obs")
    assert joins.k_of_n(nulls, bars, LEGS, 3, "obs", "bar").count() == 0
    found = joins.resolution(seen, {"D": bars}, LEGS, 3, "obs", "bar").first()
    assert (found.n_bars, found.resolution) == (1, "unique")


def test_three_of_four_plans_no_nested_loop(spark):
    bars = quads(spark, [("b", 1, 2, 3, 4)], "bar")
    plan = joins.k_of_n(bars.withColumnRenamed("bar", "obs"), bars, LEGS, 3, "obs", "bar")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("width", [None, 1.5, 7.0])
def test_nearest_against_brute_force(spark, width):
    import random

    rng = random.Random(1)
    own = [(i, rng.choice("ab"), rng.randrange(50) / 2 if i % 9 else None) for i in range(80)]
    marks = [(rng.choice("abc"), rng.randrange(50) / 2) for _ in range(12)] + [("a", None)]
    got = joins.nearest(spark.createDataFrame(own, "k int, g string, v double"), spark.createDataFrame(marks, "g string, m double"), "v", "m", ["g"], width).collect()
    assert len(got) == 80
    for r in got:
        below = [m for g, m in marks if g == r.g and m is not None and r.v is not None and m <= r.v]
        above = [m for g, m in marks if g == r.g and m is not None and r.v is not None and m >= r.v]
        assert (r.nearest_below, r.nearest_above) == (max(below, default=None), min(above, default=None))


def test_nearest_leg_ties_go_to_the_earlier_bar_and_field(spark):
    bars = spark.createDataFrame([(at("10:00:00"), 100.0, 110.0, 95.0, 105.0), (at("10:01:00"), 100.0, 110.0, 95.0, 105.0)], "bar_ts timestamp_ntz, open double, high double, low double, close double")
    prices = spark.createDataFrame([(1, 102.5), (2, 105.25), (3, 110.25)], "k int, p double")
    got = {r.k: (r.field, r.bar_ts, r.delta) for r in joins.nearest_leg(prices, bars, "k", "p", 0.25).collect()}
    assert got == {1: ("open", at("10:00:00"), 10.0), 2: ("close", at("10:00:00"), 1.0), 3: ("high", at("10:00:00"), 1.0)}


def test_overlap_has_open_ends_and_no_doubles(spark):
    spans = spark.createDataFrame([("v", -5.0, 35.0)], "video string, lo double, hi double")
    parts = spark.createDataFrame([("v", -6.0, -5.0, "a"), ("v", 35.0, 40.0, "b"), ("v", 34.9, 40.0, "c"), ("v", -20.0, 90.0, "d"), ("w", 0.0, 1.0, "e")], "video string, start double, end double, text string")
    got = joins.overlapping(parts, spans, ["video"], 7.0)
    assert sorted(r.text for r in got.collect()) == ["c", "d"]
    assert sorted(r.text for r in joins.overlapping(parts, spans, ["video"], 7.0, closed=True).collect()) == ["a", "b", "c", "d"]
    assert joins.text_in_order(got, ["video"], ["start"], "text").first().text == "d c"


def test_adjacency_does_not_bridge_gaps(spark):
    df = spark.createDataFrame([("v", 1, 10), ("v", 2, 20), ("v", 4, 40)], "video string, state_id int, x int")
    assert [(r.a_x, r.b_x) for r in joins.adjacent(df, ["video"], "state_id", ["x"]).collect()] == [(10, 20)]


LEVELS = "video string, state_id int, label string, price double"


@pytest.mark.parametrize(
    ("second", "kind"), [([("PDH", 101.0), ("PDL", 90.0)], "mixed"), ([("PDH", 101.0), ("PDL", 91.0)], "all_changed"), ([("PDH", 100.0), ("PDL", 90.0)], "none_changed"), ([("PDH", 101.0)], "too_few"), ([("PDH", 1.0), ("PDH", 2.0), ("PDL", 90.0)], "too_few")]
)
def test_pair_classes(spark, second, kind):
    rows = [("v", 1, "PDH", 100.0), ("v", 1, "PDL", 90.0), ("v", 4, "PDH", 1.0)] + [("v", 2, n, p) for n, p in second]
    once = joins.unique_labels(spark.createDataFrame(rows, LEVELS), ["video", "state_id"], "label", "price")
    pairs = joins.adjacent(once, ["video", "label"], "state_id", ["price"])
    assert [r["class"] for r in quality.pair_changes(pairs, ["video", "a_pos"], "a_price", "b_price").collect()] == [kind]


def test_collapse(spark):
    rows = [("v", 1, "PDH", 100.0), ("v", 1, "PDC", 100.0), ("v", 2, "PDH", 1.0), ("v", 2, "PDH", 1.0)]
    got = quality.collapsed(spark.createDataFrame(rows, LEVELS), ["video", "state_id"], "price", "label").collect()
    assert [(r.state_id, r.n_labels) for r in got] == [(1, 2)]


def test_percentiles_are_ranks(spark):
    df = spark.createDataFrame([("g", x) for x in (1, 2, 3, 10)] + [("g", None)], "g string, x int")
    picks = {"p50": stats.nearest_rank(0.5), "p95": stats.nearest_rank(0.95), "upper": stats.UPPER_MEDIAN, "cut": stats.truncated_rank(0.95)}
    r = stats.order_statistics(df, ["g"], "x", picks).first()
    assert (r.n, r.p50, r.p95, r.upper, r.cut) == (4, 3, 10, 3, 10)
    assert stats.order_statistics(df.limit(0), ["g"], "x", picks).count() == 0


def test_limit_histogram(spark):
    df = spark.createDataFrame([(x,) for x in (0.5, 1.0, 3.0, 50.0, 2000.0, None)], "d double")
    got = stats.limit_histogram(df, [], "d", P.TICK_LIMITS).orderBy("bucket").collect()
    assert [r.n for r in got] == [2, 0, 1, 0, 0, 1, 0, 1] and [r.upto for r in got] == [2, 2, 3, 3, 3, 4, 4, 5]


def test_drawdown_and_daylight_saving(spark):
    df = spark.createDataFrame([("a", i, float(r)) for i, r in enumerate((2, -1, -3, 5))], "k string, i int, r double")
    r = B.trade_statistics(df, ["k"], "r", ["i"]).first()
    assert (r.n, r.wins, r.total_r, r.max_drawdown) == (4, 2, 3.0, 4.0)
    z = spark.createDataFrame([(dt.datetime(2024, 3, 10, 9, 59),), (dt.datetime(2024, 3, 10, 10, 1),)], "ts timestamp_ntz")
    assert [r.x.hour for r in z.select(B.local_clock(F.col("ts")).alias("x")).collect()] == [1, 3]


def test_sketches_merge_in_any_order_within_their_error(spark):
    from pyspark.sql import functions as F

    from millrace.operators import stats

    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"), (F.col("id") % 17).alias("part"), F.when(F.col("id") % 11 > 0, F.pmod(F.xxhash64("id"), F.lit(5000)).cast("double")).alias("x"))
    picks = {"p1": 0.01, "p50": 0.5, "p99": 0.99}
    parts = stats.sketched(rows, ["g", "part"], "x")
    for merged in (parts, stats.merged_sketches(parts.withColumn("half", F.col("part") % 2), ["g", "half"]), parts.orderBy(F.desc("part"))):
        found = stats.sketch_quantiles(stats.merged_sketches(merged, ["g"]), ["g"], picks)
        assert {r.g: r.n for r in found.collect()} == {r.g: r.n for r in rows.groupBy("g").agg(F.count("x").alias("n")).collect()}
        assert all(all(r[c] for c in picks) for r in stats.rank_within(rows, ["g"], "x", found, picks).collect())
    off = stats.sketch_quantiles(stats.merged_sketches(parts, ["g"]), ["g"], {"p50": 0.7})
    assert not any(r.p50 for r in stats.rank_within(rows, ["g"], "x", off, {"p50": 0.5}).collect())
    assert stats.sketched(rows.where("x < 0"), ["g"], "x").count() == 0


def test_level_pairs_are_those_of_the_labels_one_by_one(spark, tmp_path):
    from pyspark.sql import functions as F

    from millrace.plans import market

    lines = [(1, 1, 5.0, 0.1, None), (1, 2, 5.0, 0.2, 0.3), (1, 3, 6.0, None, 0.3), (1, 3, 6.0, 0.1, 0.3), (1, 4, 1.0, 0.1, 0.3), (1, 5, None, None, 0.3), (2, 1, None, None, 1.0), (2, 2, 1.0, 1.0, None), (3, 1, 1.0, 1.0, 1.0)]
    rows = spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_quantity double, l_discount double, l_tax double")
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    levels = rows.select("l_orderkey", "l_linenumber", F.stack(F.lit(3), F.lit("qty"), "l_quantity", F.lit("discount"), "l_discount", F.lit("tax"), "l_tax").alias("label", "price"))
    once = joins.unique_labels(levels, ["l_orderkey", "l_linenumber"], "label", "price")
    want = joins.adjacent(once, ["l_orderkey", "label"], "l_linenumber", ["price"])
    columns = ["l_orderkey", "label", "a_pos", "a_price", "b_price"]
    got = sorted(market._level_pairs(spark, str(tmp_path)).select(columns).collect())
    assert got == sorted(want.select(columns).collect()) and len(got) == 3


@pytest.mark.parametrize("name", ["merged_consistency", "pair_change_class", "collapse_check"])
def test_tasks_grow_with_the_lines(spark, monkeypatch, name):
    """A task's aggregates and joins have so many lines, whatever the session's partitions (4 here)."""
    from millrace.plans import market
    from millrace.sources import readers

    monkeypatch.setattr(readers, "ROWS", 100, raising=False)
    plan = getattr(market, name)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_linenumber") and ", 60" in plan and "RepartitionByExpression" in plan

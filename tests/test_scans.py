"""Numbering and running values within groups: against whole-group windows, with one key for nearly all rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import bars, folds, quality, sampling, scans
from millrace.sources import scratch


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [("hot" if i % 9 else rng.choice([None, "a", "b"]), rng.choice([None, -5, 0, i, i * 37 % 1001, 10**6 * i]), i, rng.choice([None, rng.randint(-9, 9)])) for i in range(900)]
    return spark.createDataFrame(data, "k string, at bigint, id bigint, x bigint").cache()


def same(left, right):
    assert sorted(map(repr, left.collect())) == sorted(map(repr, right.collect()))


def test_scans_equal_windows(rows):
    w = Window.partitionBy("k").orderBy("at", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    for how, f in (("sum", F.sum), ("max", F.max), ("min", F.min)):
        same(scans.running(rows, ["k"], ["at", "id"], "x", "y", how), rows.withColumn("y", f("x").over(upto)))
    same(scans.previous(rows, ["k"], ["at", "id"], {"x": "p", "id": "q"}), rows.withColumn("p", F.lag("x").over(w)).withColumn("q", F.lag("id").over(w)))
    expected = rows.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy("k")))
    same(scans.numbered(rows, ["k"], ["at", "id"]), expected)
    all_ = Window.orderBy("at", "id")
    same(scans.numbered(rows, [], ["at", "id"]).select("id", "_i"), rows.select("id", (F.row_number().over(all_) - 1).alias("_i")))


def test_scans_of_texts_and_times(spark):
    texts = spark.createDataFrame([(x, i) for i, x in enumerate(["", "ab", "abcd", "abce", None, "zz", "é"])], "t string, i int")
    w = Window.orderBy("t")
    same(scans.numbered(texts, [], ["t"]).select("i", "_i"), texts.select("i", (F.row_number().over(w) - 1).alias("_i")))
    times = spark.range(50).select(F.expr("timestamp_ntz'1969-12-31 00:00:00' + make_dt_interval(0, 0, cast(id * 47 as int), 0)").alias("ts"), "id")
    same(scans.previous(times, [], ["ts"], {"id": "p"}), times.withColumn("p", F.lag("id").over(Window.orderBy("ts"))))


def test_nan_and_common_prefixes(spark):
    values = [-3.0, 1.0, 5.0, float("inf"), float("nan"), None, float("-inf"), float("nan")]
    rows = spark.createDataFrame([(x, i) for i, x in enumerate(values)], "x double, i int")
    w = Window.orderBy("x", "i")
    same(scans.numbered(rows, [], ["x", "i"]).select("i", "_i"), rows.select("i", (F.row_number().over(w) - 1).alias("_i")))
    same(scans.previous(rows, [], ["x", "i"], {"i": "p"}), rows.withColumn("p", F.lag("i").over(w)))
    names = spark.range(1000).select(F.format_string("live_%05d", "id").alias("key"), F.lit("g").alias("g"))
    where = scans.placed(names, ["g"], ["key"])
    assert where.select("_bin").distinct().count() > 1 and where.groupBy("_bin").count().agg(F.max("count")).first()[0] < 700
    tied = scans.placed(spark.range(1000).select(F.lit("g").alias("g"), F.lit(1).alias("at")), ["g"], ["at"])
    assert tied.select("_bin").distinct().count() > 1
    assert sorted(r._i for r in scans.numbered(tied, ["g"], ["at"]).collect()) == list(range(1000))


def test_no_row_is_ranked_in_a_window_of_one_key(rows):
    """Windows by the key alone see one row per bin; rows are only in windows by key and bin."""
    for found in (scans.numbered(rows, ["k"], ["at", "id"]), sampling.stride_sample(rows, ["k"], ["id"], 5)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert windows and all("_bin" in line or "_part" in line for line in windows)


def test_drawdown_of_one_key(spark):
    rows = spark.createDataFrame([("k", i * 3, (-1) ** i * i) for i in range(120)], "k string, at bigint, r bigint")
    run, peak, deepest = 0, 0, 0
    for i in range(120):
        run += (-1) ** i * i
        peak = max(peak, run)
        deepest = max(deepest, peak - run)
    got = bars.trade_statistics(rows, ["k"], "r", ["at"]).first()
    assert (got.n, got.total_r, got.max_drawdown) == (120, run, deepest)


def test_capped_medoids_take_evenly_spaced_members(spark):
    rng = random.Random(5)
    members = [("a", i, rng.getrandbits(50)) for i in range(700)] + [("b", i, rng.getrandbits(50)) for i in range(9)]
    df = spark.createDataFrame(members, "g string, t bigint, h bigint")
    for cap in (600, None):
        for r in folds.medoids(df, ["g"], "t", "h", cap=cap).collect():
            own = [(t, h) for g, t, h in members if g == r.g]
            if cap and len(own) > cap:
                own = [own[i] for i in sorted({round(k * (len(own) - 1) / (cap - 1)) for k in range(cap)})]
            totals = [(sum((h ^ o).bit_count() for _, o in own), -t) for t, h in own]
            assert (r.total_distance, -r.t) == min(totals) and r.n_members == (700 if r.g == "a" else 9)


def test_recording_gates(spark):
    facts = [
        ("fine", [], 100.0, 30, 0, 90.0, 0, 4, 0, 5, 5, 0, 0),
        ("bad", ["probe"], 100.0, 30, 2, 80.0, 12, 0, 1, 2, 3, 1, 1),
        ("none", [], 100.0, None, None, None, None, 1, 0, None, None, None, None),
        ("short", [], 100.0, 20, 0, 100.0, 19, 1, 0, 3, 3, 0, 0),
    ]
    schema = "id string, undone array<string>, duration double, n_segments bigint, n_back bigint, last_end double, n_repeats bigint, n_moments bigint, n_outside bigint, n_frames bigint, n_files bigint, n_tiny bigint, n_unsorted bigint"
    got = {r.id: (r.issues, r.redo) for r in quality.recording_gates(spark.createDataFrame(facts, schema)).collect()}
    assert got["fine"] == ([], []) and got["short"] == ([], [])  # up to twenty segments no loop is claimed
    assert got["bad"] == (["undone", "back", "uncovered", "loop", "outside", "silent", "few_frames", "files_differ", "tiny_files", "unsorted"], ["keyframes", "moments", "probe", "transcribe"])
    assert got["none"] == (["no_transcript", "no_frames"], ["keyframes", "transcribe"])


def test_intermediate_files_can_be_cleared(spark, monkeypatch):
    monkeypatch.setattr(scratch, "_MADE", {})
    path = scratch.scratch_dir(spark)
    spark.range(3).write.parquet(path)
    assert scratch.cleared(spark) == 1
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(path).count()

"""Folds, samples, text rules, resumable work: fixed cases and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import folds, incremental, quality, sampling, stats


def frame(spark, values, ddl="k string, t int, x double"):
    return spark.createDataFrame([("a", *v) if isinstance(v, tuple) else ("a", i, v) for i, v in enumerate(values)], ddl)


@pytest.mark.parametrize("partitions", [1, 8])
def test_runs_are_held_by_their_anchor(spark, partitions):
    df = frame(spark, [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]).repartition(partitions)
    got = folds.anchored_runs(df, ["k"], ["t"], "x", 2).orderBy("t").collect()
    assert [r.t for r in got if r.starts] == [0, 3]  # against the row before there would be one run


def test_two_criteria(spark):
    cells = [[0.0] * 8, [0.0] * 8, [7.0] + [0.0] * 7, [7.0] + [0.0] * 7]
    rows = [("a", 0, 0, cells[0]), ("a", 1, 31, cells[1]), ("a", 2, 31, cells[2]), ("a", 3, -1, cells[3])]
    df = spark.createDataFrame(rows, "k string, t int, h bigint, c array<double>")
    got = folds.clustered_runs(df, ["k"], ["t"], "h", "c").orderBy("t").collect()
    assert [(r.run, r.reason) for r in got] == [(0, None), (1, "dhash"), (2, "fine"), (3, "dhash")]
    spans = folds.run_spans(spark.createDataFrame([("a", 0, 1), ("a", 0, 2)], "k string, run bigint, t int"), ["k"], "t").first()
    assert (spans.first_pos, spans.last_pos, spans.n_rows) == (1, 2, 2)


def test_restarting_windows(spark):
    got = folds.restarting_windows(frame(spark, [(x, 0.0) for x in (10, 100, 905, 1000, 1815)]), ["k"], ["t"], "t", 900).collect()
    assert {r.t: r.window_start for r in got} == {10: 10, 100: 10, 905: 10, 1000: 1000, 1815: 1000}


def test_thinning_with_priority(spark):
    rows = [(0, "drift"), (3, "llm"), (5, "drift"), (12, "gap"), (14, "llm"), (20, "drift")]
    df = frame(spark, rows, "k string, t int, source string").withColumn("first", F.col("source") == "llm")
    assert sorted((r.t, r.source) for r in folds.thinned(df, ["k"], ["t"], "t", "first", 6).collect()) == [(3, "llm"), (14, "llm"), (20, "drift")]


def brute_thinned(rows, gap):
    out = []
    for t, p in rows:
        if not out or t - out[-1][0] >= gap:
            out.append((t, p))
        elif p and not out[-1][1]:
            out[-1] = (t, p)
    return out


def test_thinning_and_windows_against_brute_force(spark):
    rng = random.Random(2)
    rows = sorted({rng.randrange(900) for _ in range(250)})
    rows = [(t, rng.random() < 0.3) for t in rows]
    df = frame(spark, rows, "k string, t int, p boolean")
    assert [(r.t, r.p) for r in folds.thinned(df, ["k"], ["t"], "t", "p", 6).orderBy("t").collect()] == brute_thinned(rows, 6)
    start, want = None, {}
    for t, _ in rows:
        start = t if start is None or t - start >= 20 else start
        want[t] = start
    assert {r.t: r.window_start for r in folds.restarting_windows(df, ["k"], ["t"], "t", 20).collect()} == want


def test_drift(spark):
    df = frame(spark, [(0, 0.0), (3, 9.0), (6, 2.0), (7, 9.0), (9, 20.0), (14, 20.0)])
    assert [r.t for r in folds.drift_kept(df, ["k"], ["t"], "t", "x").orderBy("t").collect() if r.kept] == [0, 7, 14]


@pytest.mark.parametrize(("picks", "end", "want"), [([100], 150, [45, 90, 145]), ([90], 90, [45]), ([45], 45, [])])
def test_gap_fill(spark, picks, end, want):
    df = spark.createDataFrame([("a", t, end) for t in picks], "k string, t int, end int")
    assert sorted(r.t for r in folds.gap_points(df, ["k"], "t", "end", 45).collect()) == want


def test_first_labelled_offer_wins(spark):
    df = frame(spark, [(1, "", 0), (1, "A", 1), (1, "B", 2), (2, "", 3), (2, "", 4)], "k string, slot int, label string, i int")
    assert sorted((r.slot, r.label, r.i) for r in folds.upserted_candidates(df, ["k"], "slot", "label", ["i"]).collect()) == [(1, "A", 1), (2, "", 3)]


def test_greedy_groups_look_at_anchors(spark):
    df = frame(spark, [(0, 0), (1, 0xF), (2, 0x1F)], "k string, t int, h bigint")
    assert [r.recur_group for r in folds.greedy_groups(df, ["k"], ["t"], "h").orderBy("t").collect()] == [0, 0, 1]


def test_medoid(spark):
    rng = random.Random(3)
    rows = [(g, t, rng.getrandbits(63) & 0xFFF) for g in "ab" for t in range(40)]
    df = spark.createDataFrame(rows, "k string, t int, h bigint")
    for r in folds.medoids(df, ["k"], "t", "h").collect():
        own = [(t, h) for g, t, h in rows if g == r.k]
        sums = {t: sum((h ^ x).bit_count() for _, x in own) for t, h in own}
        assert (r.t, r.total_distance) == (max(t for t, s in sums.items() if s == min(sums.values())), min(sums.values()))
    same = frame(spark, [(0, 5), (1, 5)], "k string, t int, h bigint")
    assert folds.medoids(same, ["k"], "t", "h").first().t == 1  # ties go to the later one


def test_medoid_of_a_large_group(spark):
    rng = random.Random(4)
    rows = [("a", t, rng.getrandbits(63) & 0xFFFFF) for t in range(700)]
    sums = {t: sum((h ^ x).bit_count() for _, _, x in rows) for _, t, h in rows}
    least = min(sums.values())
    df = spark.createDataFrame(rows, "k string, t int, h bigint")
    r = folds.medoids(df, ["k"], "t", "h").first()
    assert (r.t, r.total_distance, r.n_members) == (max(t for t, s in sums.items() if s == least), least, 700)
    few = [round(k * 699 / 599) for k in range(600)]  # the definition's evenly spaced ones
    sums = {t: sum((rows[t][2] ^ rows[x][2]).bit_count() for x in few) for t in few}
    r = folds.medoids(df, ["k"], "t", "h", cap=600).first()
    assert (r.t, r.total_distance, r.n_members) == (max(t for t, s in sums.items() if s == min(sums.values())), min(sums.values()), 700)


def stripped(spark, text):
    df = spark.createDataFrame([("d", text)], "k string, text string").select("k", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    kind = F.when(F.trim("line").rlike(X.AXIS_PRICE), "price").when(F.trim("line").rlike(X.AXIS_TIME), "time")
    rows = folds.line_runs(df.withColumn("kind", kind), ["k"], "pos", "kind", X.AXIS_RUN).withColumn("gone", F.col("in_run") | X.inline_axis("line")).orderBy("pos").collect()
    return "\n".join(r.line for r in rows if not r.gone), sum(r.gone for r in rows)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("PDC\n26,037.25\nThursday", ("PDC\n26,037.25\nThursday", 0)),
        ("1\n2\n3.5\n4,000\nPDH", ("PDH", 4)),
        ("1\n2\n3", ("1\n2\n3", 0)),
        ("01:30 PM\n03:00 PM\n04:30 PM\n06:00 PM", ("", 4)),
        ("1\n2\n01:30\n02:30", ("1\n2\n01:30\n02:30", 0)),
        ("Jan Feb Mar Apr May Jun Jul", ("", 1)),
        ("1 2 3 4 5", ("1 2 3 4 5", 0)),
        ("Mon 29 Dec '25", ("Mon 29 Dec '25", 0)),
    ],
)
def test_axis_ladders(spark, text, want):
    assert stripped(spark, text) == want


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("a", "b", "near"), [("HCOW", "HOCW", True), ("BWH", "PWH", True), ("LOW", "LCOW", True), ("PWH", "PWH", True), ("ABC", "CAB", False), ("", "A", True), ("AB", "BA", True), ("ABCD", "BADC", False)])
def test_one_edit(spark, a, b, near):
    assert one(spark, X.within_one_edit(F.lit(a), F.lit(b))) is near


@pytest.mark.parametrize(("text", "hit"), [("B&R", True), ("xb&r", False), ("b&r2", False), ("a b&r.", True)])
def test_alias_bounds(spark, text, hit):
    assert one(spark, F.lit(text).rlike(X.alias_pattern(["b&r"]))) is hit


def test_repair_is_idempotent(spark):
    fixed, n = quality.repaired(F.lit("RHOW x RHOWS"), X.token_pattern("RHOW"), "PHOW")
    assert (one(spark, fixed), one(spark, n)) == ("PHOW x RHOWS", 1)
    assert one(spark, quality.repaired(fixed, X.token_pattern("RHOW"), "PHOW")[1]) == 0


@pytest.mark.parametrize(
    ("path", "category", "volume", "name"),
    [("resources/case_studies/vol7/videos/X.mp4", "case_study", "vol7", "cs_vol7_x"), ("resources/live_trading_sessions/Y.mp4", "live_session", None, "live_y"), ("videos/Z 1080p.mp4", "concept", None, "concept_z")],
)
def test_paths(spark, path, category, volume, name):
    p = F.lit(path)
    assert (one(spark, X.path_category(p)), one(spark, X.path_volume(p)), one(spark, X.media_id(p))) == (category, volume, name)


def test_cells(spark):
    a, b = F.array(*map(F.lit, (1.0, 2.0, 3.0))), F.array(*map(F.lit, (1.0, 9.0, 9.0)))
    assert one(spark, X.changed_share(a, b, 6.0)) == pytest.approx(1 / 3)  # a difference of exactly 6 is no change
    assert one(spark, X.mean_change(a, b)) == pytest.approx(13 / 3)
    grid = F.array(*[F.lit(float(8 - i % 8)) for i in range(64)])
    assert one(spark, X.gradient_hash(grid)) == (1 << 56) - 1 and one(spark, X.hamming(F.lit(-1), F.lit(0))) == 64


def test_allocation(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 2)], "c string, n bigint")
    assert {r.c: r.quota for r in sampling.allocation(sizes, "c", "n", 30, 3).collect()} == {"a": 24, "b": 4, "c": 2}
    assert {r.c: r.quota for r in sampling.allocation(sizes, "c", "n", 500, 3).collect()} == {"a": 100, "b": 10, "c": 2}
    assert {r.c: r.quota for r in sampling.allocation(sizes, "c", "n", 4, 3).collect()} == {"a": 3, "b": 3, "c": 2}


@pytest.mark.parametrize(("n", "k", "want"), [(100, 5, [0, 25, 50, 74, 99]), (100, 1, [0]), (4, 9, [0, 1, 2, 3]), (7, 0, [])])
def test_strides(spark, n, k, want):
    df = spark.range(n).select(F.lit("g").alias("g"), F.col("id"))
    assert sorted(r.id for r in sampling.stride_sample(df, ["g"], ["id"], k).collect()) == want


def test_strides_against_the_definition(spark):
    df = spark.range(317).select(F.lit("g").alias("g"), F.col("id"))
    for k in (2, 3, 50, 151, 300, 316):
        assert sorted(r.id for r in sampling.stride_sample(df, ["g"], ["id"], k).collect()) == sorted({round(i * 316 / (k - 1)) for i in range(k)})


def test_quota_sample_is_stable(spark):
    df = spark.range(50).select((F.col("id") % 3).alias("g"), "id")
    a = sorted(r.id for r in sampling.quota_sample(df, ["g"], "id", 7).collect())
    assert a == sorted(r.id for r in sampling.quota_sample(df.repartition(5), ["g"], "id", 7).collect()) and len(a) == 7


def test_last_wins_and_work_left(spark):
    rows = spark.createDataFrame([("a", 0, "error"), ("b", 1, "ok"), ("a", 2, "ok")], "id string, line int, status string")
    assert sorted((r.id, r.status) for r in incremental.last_wins(rows, ["id"], ["line"]).collect()) == [("a", "ok"), ("b", "ok")]
    done = spark.createDataFrame([("ok", "ok", 1), ("retry", "error", 2), ("given_up", "error", 3)], "id string, status string, attempts int")
    want = spark.createDataFrame([(x,) for x in ("new", "ok", "retry", "given_up")], "id string")
    assert sorted(r.id for r in incremental.still_to_do(want, done, "id").collect()) == ["new", "retry"]


def test_repeats_are_judged_above_twenty_rows(spark):
    df = frame(spark, [(i, "same" if i % 21 < 9 else f"t{i}") for i in range(21)], "k string, t int, text string")
    r = quality.repeat_ratio(df, ["k"], ["t"], "text").first()
    assert (r.n, r.n_repeats, r.looping) == (21, 8, True)
    r = quality.repeat_ratio(frame(spark, [(i, "same") for i in range(20)], "k string, t int, text string"), ["k"], ["t"], "text").first()
    assert not r.looping


def test_failures_in_a_row(spark):
    df = frame(spark, [(i, i not in (3, 9)) for i in range(25)], "k string, t int, bad boolean")
    assert folds.failure_runs(df, ["k"], ["t"], "bad", 10).first().longest == 15
    assert folds.failure_runs(df, ["k"], ["t"], "bad", 16).count() == 0


def test_residuals(spark):
    changes = spark.createDataFrame([("a", i) for i in range(40)], "k string, t int")
    starts = spark.createDataFrame([("a", i) for i in range(38)], "k string, t int")
    r = quality.residual_boundaries(changes, starts, ["k"], "t").first()
    assert (r.n_changes, r.n_residual, r.ok) == (40, 2, True)
    assert not quality.residual_boundaries(changes, starts.where("t < 30"), ["k"], "t").first().ok


def test_stable_lines(spark):
    rows = [("T", m, line) for m in (1, 2, 3) for line in ("head", "body")] + [("T", 1, "extra"), ("U", 1, "x")]
    r = stats.stable_lines(spark.createDataFrame(rows, "g string, m int, line string"), "g", "m", "line", 3).collect()
    assert [(x.g, x.n_members, x.n_core, x.n_varying) for x in r] == [("T", 3, 2, 1)]

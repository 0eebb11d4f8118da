"""Folds in chunks against folds row by row: hot groups, many groups, folds that never agree, ties, nulls, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import chunks, folds


def anchored(rows, limit):
    """(k, t) to (run, starts), row by row."""
    out, anchor, run, key = {}, None, -1, object()
    for k, t, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        if k != key:
            key, anchor, run = k, None, -1
        starts = anchor is None or (x is not None and abs(x - anchor) > limit)
        if starts:
            anchor, run = x, run + 1
        out[k, t] = (run, starts)
    return out


def frame(spark, rows):
    shuffled = list(rows)
    random.Random(1).shuffle(shuffled)
    return spark.createDataFrame(shuffled, "k string, t bigint, x double")


@pytest.mark.parametrize("kind", ["hot", "many", "constant", "drifting", "mixed"])
def test_runs_equal_a_fold_row_by_row(spark, kind):
    rng = random.Random(kind)
    if kind == "hot":
        rows = [("a", t, rng.gauss(0, 5)) for t in range(6000)]
    elif kind == "many":
        rows = [(rng.choice([None, *"abcdefgh"]), t, rng.choice([None, rng.gauss(0, 5)])) for t in range(3000)]
    elif kind == "constant":  # the first anchor holds for all chunks
        rows = [("a", t, 1.0 + t % 3) for t in range(4000)]
    elif kind == "drifting":  # runs that differ stay apart: anchors follow each other at a fixed distance
        rows = [("a", t, float(t)) for t in range(4000)]
    else:
        rows = [("a", t, rng.gauss(0, 5)) for t in range(2000)] + [("b", t, 0.0) for t in range(2000)] + [(f"c{t % 50}", t, rng.gauss(0, 5)) for t in range(500)]
    found = chunks.folded(frame(spark, rows), ["k"], ["t"], ["x"], None, anchored_step(6.0), "starts boolean", ("starts", "run"), chunks=9)
    assert {(r.k, r.t): (r.run, r.starts) for r in found.collect()} == anchored(rows, 6.0)


def anchored_step(limit):
    def step(anchor, row):
        x = row[0]
        if anchor is None or (x is not None and abs(x - anchor) > limit):
            return x, (True,)
        return anchor, (False,)

    return step


def test_a_fold_that_never_forgets_is_exact(spark):
    """A running sum: every chunk's state depends on all before it."""
    rows = [("a", t, float(t % 7)) for t in range(2000)]
    got = chunks.folded(frame(spark, rows), ["k"], ["t"], ["x"], 0.0, lambda s, row: (s + row[0], (s + row[0],)), "total double", chunks=7).collect()
    total, want = 0.0, {}
    for _, t, x in rows:
        total += x
        want[t] = total
    assert {r.t: r.total for r in got} == want


def test_one_hot_group_takes_several_tasks(spark, monkeypatch):
    rows = spark.range(200_000).select(F.lit("a").alias("k"), F.col("id").alias("t"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 10).alias("x"))
    asked = []
    inner = chunks.linked
    monkeypatch.setattr(chunks, "linked", lambda found, known: asked.append([c.number for c in found]) or inner(found, known))
    found = chunks.folded(rows, ["k"], ["t"], ["x"], None, anchored_step(40.0), "starts boolean", ("starts", "run"), chunks=8).cache()
    assert len(asked[0]) > 4 and len(asked) <= 3  # chunks of one group, agreed after one trial of likely states
    want = anchored([(r.k, r.t, r.x) for r in rows.collect()], 40.0)
    assert found.count() == len(want) and all(want[r.k, r.t] == (r.run, r.starts) for r in found.collect())


def test_places_and_empty_frames(spark):
    rows = [("a", t, 0.0) for t in range(50)]
    got = chunks.folded(frame(spark, rows), [], ["t"], ["x"], None, lambda s, row: (0, (row[-1],)), "p bigint", place=True, chunks=4).orderBy("t").collect()
    places = [r.p for r in got]
    assert places == sorted(set(places)) and len(places) == 50
    none = chunks.folded(frame(spark, rows).where("false"), ["k"], ["t"], ["x"], None, anchored_step(1.0), "starts boolean", ("starts", "run"))
    assert none.collect() == [] and none.columns == ["k", "t", "x", "run", "starts"]


def test_greedy_groups_equal_trying_every_anchor(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(40)]
    hashes = [rng.choice(base) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (1 << 64) - 1 for _ in range(600)]
    rows = [(rng.choice("ab"), t, (h ^ 1 << 63) - (1 << 63)) for t, h in enumerate(hashes)] + [("a", 700, None)]
    df = spark.createDataFrame(rows, "k string, t int, h bigint")
    for most in (0, 4, 20):
        want, anchors = {}, {"a": [], "b": []}
        for k, t, h in rows:
            near = None if h is None else next((i for i, x in enumerate(anchors[k]) if ((h ^ x) & (1 << 64) - 1).bit_count() <= most), len(anchors[k]))
            if near == len(anchors[k]):
                anchors[k].append(h)
            want[k, t] = near
        assert {(r.k, r.t): r.recur_group for r in folds.greedy_groups(df, ["k"], ["t"], "h", most).collect()} == want

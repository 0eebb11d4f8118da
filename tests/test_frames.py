"""Pixels to hashes and grids; JSON out of replies."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import replies
from millrace.operators import frames, incremental


def test_hashes_against_loops(spark):
    rng = np.random.default_rng(1)
    px = rng.integers(0, 256, (3, 160, 288), dtype=np.uint8)
    rows = [("v", t, bytearray(px[t].tobytes())) for t in range(3)] + [("v", 3, None)]
    got = {r.t: r for r in frames.hashed(spark.createDataFrame(rows, "video string, t int, px binary")).collect()}
    for t in range(3):
        bits = 0
        for r in range(8):
            means = [px[t, r * 20 : r * 20 + 20, c * 32 : c * 32 + 32].mean() for c in range(9)]
            for c in range(8):
                bits = bits << 1 | int(means[c] > means[c + 1])
        assert got[t].dhash_hex == f"{bits:016x}" and got[t].dhash & (1 << 64) - 1 == bits
        assert got[t].fine[37] == pytest.approx(px[t, 8:16, 8:16].mean(), abs=1e-3) and len(got[t].fine) == 720
    assert got[3].dhash is None


def test_grid_must_divide():
    with pytest.raises(ValueError):
        frames.box_means(np.zeros((1, 10, 10), np.uint8), (3, 3))


@pytest.mark.parametrize(("text", "want"), [('x {"a": "}"} y', '{"a": "}"}'), ("{bad {\"a\": 1}", '{"a": 1}'), ("none", None), (None, None), ("{", None)])
def test_first_object(text, want):
    assert replies.first_object(text) == want


def test_required_keys(spark):
    df = spark.createDataFrame([('{"a": 1, "b": null}',)], "j string")
    assert df.select(replies.complete("j", ["a"]).alias("x")).first().x and not df.select(replies.complete("j", ["a", "b"]).alias("x")).first().x


def test_complete_only(spark):
    records = spark.createDataFrame([("v", 1), ("w", 2)], "video string, n int")
    stages = spark.createDataFrame([("v", "extract", "done"), ("w", "extract", "running"), ("w", "probe", "done")], "video string, stage string, status string")
    assert [r.n for r in incremental.complete_only(records, stages, "video", "extract").collect()] == [1]
    assert records.withColumn("x", F.lit(1)).count() == 2

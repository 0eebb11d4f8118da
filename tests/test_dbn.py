"""DBN files: written and read, by ranges, under zstandard, with refusals and raw comparisons."""

import datetime as dt
import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from millrace import schemas
from millrace.sources import dbn

UTC = dt.timezone.utc


@pytest.fixture
def trades(spark):
    rng = random.Random(1)
    rows = []
    for i in range(500):
        t = dt.datetime(2024, 1, 1, tzinfo=UTC) + dt.timedelta(seconds=i * 600, microseconds=rng.randrange(10**6))
        number = rng.randrange(1, 4)
        rows.append((t, t - dt.timedelta(milliseconds=3), i, "T", rng.randrange(-(10**12), 10**12), rng.randrange(1, 2**32), f"S{number}" if number < 3 else None, number, 7))
    return spark.createDataFrame(rows, schemas.TRADES)


def plain(df):
    return sorted(map(repr, df.collect()))


def test_round_trip_in_ranges(spark, tmp_path, trades, monkeypatch):
    dbn.registered(spark)
    path = str(tmp_path / "t")
    trades.repartition(3).write.format("dbn").mode("append").save(path)
    assert len(list((tmp_path / "t").glob("part-*.dbn"))) == 3 and not list((tmp_path / "t").glob(".*"))
    assert plain(spark.read.format("dbn").load(path)) == plain(trades)
    trades.limit(10).coalesce(1).write.format("dbn").mode("overwrite").save("file://" + path)
    assert plain(spark.read.format("dbn").load("file://" + path)) == plain(trades.limit(10))
    one = next((tmp_path / "t").glob("*.dbn"))
    monkeypatch.setattr(dbn, "RANGE", 4)
    reader = dbn._Reader(str(one))
    parts = reader.partitions()
    assert [p.n for p in parts] == [4, 4, 2] and sum(b.num_rows for p in parts for b in reader.read(p)) == 10


def test_compressed_files(spark, tmp_path, trades):
    dbn.registered(spark)
    trades.coalesce(1).write.format("dbn").mode("append").save(str(tmp_path / "t"))
    file = next((tmp_path / "t").glob("*.dbn"))
    file.with_suffix(".dbn.zst").write_bytes(zstandard.compress(file.read_bytes()))
    file.unlink()
    assert plain(spark.read.format("dbn").load(str(tmp_path / "t"))) == plain(trades)


def test_comparisons_reach_raw_records(spark, tmp_path, trades):
    dbn.registered(spark)
    trades.coalesce(1).write.format("dbn").mode("append").save(str(tmp_path / "t"))
    cut = dt.datetime(2024, 1, 2, 3, tzinfo=UTC)
    condition = (F.col("ts_recv") >= F.lit(cut)) & (F.col("instrument_id") == 2) & (F.col("size") > 1)
    assert plain(spark.read.format("dbn").load(str(tmp_path / "t")).where(condition)) == plain(trades.where(condition)) != []
    reader = dbn._Reader(str(tmp_path / "t"))
    left = list(reader.pushFilters([dbn.GreaterThanOrEqual(("ts_recv",), cut), dbn.EqualTo(("instrument_id",), 2), dbn.GreaterThan(("size",), 1)]))
    assert len(left) == 3 and len(reader.tests) == 2
    got = [x for p in reader.partitions() for b in reader.read(p) for x in b.column("instrument_id").to_pylist()]
    assert len(got) == trades.where((F.col("ts_recv") >= F.lit(cut)) & (F.col("instrument_id") == 2)).count() and set(got) == {2}


def test_refusals(spark, tmp_path, trades):
    dbn.registered(spark)
    head, one = dbn.Header.made({1: "A"}), np.zeros(1, dbn.RECORD)
    one["length"], one["action"], one["instrument_id"] = 12, b"T", 1
    bad = one.copy()
    bad["action"] = b"C"
    files = {"quotes": dbn.Header.made({}, schema=1), "torn": head + one.tobytes()[:-1], "cancel": head + bad.tobytes(), "other": b"nothing of the kind", "empty": b""}
    for name, data in files.items():
        (tmp_path / f"{name}.dbn").write_bytes(data)
        with pytest.raises(Exception, match="schema|within a record|only trades|not a DBN|required|index"):
            spark.read.format("dbn").load(str(tmp_path / f"{name}.dbn")).collect()
    (tmp_path / "good.dbn").write_bytes(head + one.tobytes())
    assert spark.read.format("dbn").load(str(tmp_path / "good.dbn")).first().symbol == "A"
    with pytest.raises(Exception, match="only trades"):
        trades.withColumn("action", F.lit("A")).write.format("dbn").mode("append").save(str(tmp_path / "new"))
    assert not list((tmp_path / "new").glob("*.dbn")) if (tmp_path / "new").exists() else True


def test_symbols_by_date(tmp_path):
    header = dbn.Header(dbn.TRADES, 0, [(1, 20240101, 20240103, "OLD"), (1, 20240103, 20250101, "NEW")])
    records = np.zeros(3, dbn.RECORD)
    records["length"], records["action"], records["instrument_id"] = 12, b"T", 1
    records["ts_event"] = [np.datetime64(d, "ns").astype(np.int64) for d in ("2024-01-02T23:59:59", "2024-01-03", "2025-01-01")]
    assert dbn.batch_of(records, header).column("symbol").to_pylist() == ["OLD", "NEW", None]

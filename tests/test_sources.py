"""Readers, sinks and the live feed on small files."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import bars as B
from millrace.sources import readers, sinks
from millrace.sources.versions import Conflict, Manifest, Versions, upsert
from millrace.streaming import bars as live

SF = "/root/testdata/sf0.001"
SCHEMA = "id string, n int"


def lines(path, *rows):
    path.write_text("".join(r if r.startswith("{tor") else r + "\n" for r in rows))
    return str(path)


GOOD = [json.dumps({"id": "a", "n": 1}), json.dumps({"id": "b", "n": 2})]


def test_only_a_torn_tail_is_forgiven(spark, tmp_path):
    torn = lines(tmp_path / "t.jsonl", *GOOD, '{torn": ')
    assert readers.json_lines(spark, torn, SCHEMA).count() == 2
    middle = lines(tmp_path / "m.jsonl", GOOD[0], '{"id": "x", "n": tor', GOOD[1])
    with pytest.raises(ValueError):
        readers.json_lines(spark, middle, SCHEMA)
    assert readers.json_lines(spark, middle, SCHEMA, "skip").count() == 2
    with pytest.raises(Exception):  # noqa: B017
        readers.json_lines(spark, middle, SCHEMA, "strict").collect()


def test_folders_become_a_column(spark, tmp_path):
    for v in ("live_a", "cs_b"):
        (tmp_path / v).mkdir()
        lines(tmp_path / v / "records.jsonl", *GOOD)
    got = readers.partitioned_lines(spark, str(tmp_path), SCHEMA, "records.jsonl", ("live",))
    assert {r.video for r in got.collect()} == {"live_a"} and got.count() == 2


def test_corrupt_document_is_null(spark, tmp_path):
    (tmp_path / "d.json").write_text("{ not json")
    assert readers.json_document(spark, str(tmp_path / "d.json"), SCHEMA).first().id is None


def test_bars_need_an_instant_and_trades_only(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01' ts_event").write.parquet(str(tmp_path / "ok"))
    spark.sql("select timestamp_ntz'2024-01-01' ts_event").write.parquet(str(tmp_path / "bad"))
    assert readers.bars(spark, str(tmp_path / "ok")).count() == 1
    with pytest.raises(ValueError):
        readers.bars(spark, str(tmp_path / "bad"))
    spark.createDataFrame([(None, None, 1, a, 1, 1, "NQ", 7, 1) for a in "TT"], readers.schemas.TRADES).write.parquet(str(tmp_path / "trades"))
    assert readers.trades(spark, str(tmp_path / "trades")).count() == 2
    spark.createDataFrame([(None, None, 1, "A", 1, 1, "NQ", 7, 1)], readers.schemas.TRADES).write.mode("append").parquet(str(tmp_path / "trades"))
    with pytest.raises(ValueError):
        readers.trades(spark, str(tmp_path / "trades"))


def test_media_files(spark, tmp_path):
    for p in ("in/a.mp4", "in/b.txt", "derived/c.mp4"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(b"12")
    got = readers.media_files(spark, str(tmp_path)).collect()
    assert [r.path.rsplit("/", 1)[1] for r in got] == ["a.mp4"] and got[0].size == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    sinks.parquet(df, str(tmp_path / "p"))
    with pytest.raises(Exception):  # noqa: B017
        sinks.parquet(df, str(tmp_path / "p"))
    for _ in range(2):
        sinks.appended(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2 and spark.read.json(str(tmp_path / "log")).count() == 4
    log = sinks.repair_log(df, df.withColumn("n", F.when(F.col("k") == "a", 9).otherwise(F.col("n"))), "k", "n").collect()
    assert [(r.k, r.before, r.after) for r in log] == [("a", 1, 9)]
    assert json.loads(sinks.report(df, "k", "n").first().report) == {"a": 1, "b": 2}
    assert [r.k for r in sinks.orphans(df, df.limit(1).where("k = 'a'"), "k").collect()] in (["b"], ["a", "b"])


def test_live_bars_equal_batch_bars(spark, tmp_path):
    stream = live.streaming_bars(live.event_stream(spark, f"{SF}/event[s].parquet"))
    live.run_to_files(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {tuple(r) for r in B.bars(readers.trades_of_events(readers.table(spark, SF, "events")), "1h").collect()}
    assert got < batch and len(batch - got) <= 2  # what the watermark has not passed is still open
    again = live.run_to_files(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    again.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(got)


UPSERTS = [[("a", 1, "x"), ("b", 1, "y")], [("a", 2, "z"), ("c", 1, "u")], [("b", 0, "late"), ("d", 5, "w")]]


def upserts(spark, tmp_path, step=lambda name: None, batches=UPSERTS):
    """Feeds the batches one file after the other, going on after each failure; gives the rows after every run."""
    schema = "id string, at int, v string"
    for i, rows in enumerate(batches):
        folder = tmp_path / f"part{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder))
        (tmp_path / "in").mkdir(exist_ok=True)
        next(folder.glob("*.parquet")).rename(tmp_path / "in" / f"{i}.parquet")
        while True:
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            try:
                live.upserted(stream, "id", "at", str(tmp_path / "out"), str(tmp_path / "cp"), 4, step).awaitTermination()
                break
            except Exception as e:
                assert "lost" in str(e)
                yield sorted((r.id, r.v) for r in Versions(spark, str(tmp_path / "out")).read(schema).collect())
        yield sorted((r.id, r.v) for r in Versions(spark, str(tmp_path / "out")).read(schema).collect())


def test_live_upsert(spark, tmp_path):
    seen = list(upserts(spark, tmp_path))
    assert seen == [[("a", "x"), ("b", "y")], [("a", "z"), ("b", "y"), ("c", "u")], [("a", "z"), ("b", "y"), ("c", "u"), ("d", "w")]]
    table = Versions(spark, str(tmp_path / "out"))
    assert table.numbers() == [1, 2, 3]
    assert sorted(r.v for r in table.read("id string, at int, v string", 1).collect()) == ["x", "y"]  # readers keep their version
    assert table.vacuum() >= 1 and table.read("id string, at int, v string").count() == 4 and table.numbers() == [3]


@pytest.mark.parametrize("where", ["read", "write", "publish", "done"])
def test_a_driver_lost_between_any_two_steps_loses_no_row(spark, tmp_path, where):
    met = []

    def step(name):
        met.append(name)
        if name == where and met.count(name) % 2:  # the first time, and again after each batch
            raise RuntimeError("lost")

    seen = list(upserts(spark, tmp_path, step))
    whole = [[], [("a", "x"), ("b", "y")], [("a", "z"), ("b", "y"), ("c", "u")], [("a", "z"), ("b", "y"), ("c", "u"), ("d", "w")]]
    assert all(rows in whole for rows in seen) and [whole.index(r) for r in seen] == sorted(whole.index(r) for r in seen) and seen[-1] == whole[-1]
    assert Versions(spark, str(tmp_path / "out")).numbers() == [1, 2, 3] and met.count(where) >= 3


def test_one_of_two_writers_of_a_version_starts_anew(spark, tmp_path):
    table = Versions(spark, str(tmp_path))
    rows = spark.createDataFrame([("a", 1)], "id string, x int").withColumn("_part", F.lit(0))
    other = spark.createDataFrame([("b", 2)], "id string, x int").withColumn("_part", F.lit(0))
    merge = lambda df: df.withColumn("_part", F.lit(0))
    first = []

    def step(name):
        if name == "publish" and not first:
            first.append(upsert(table, other, "two", 0, merge))

    assert upsert(table, rows, "one", 0, merge, step).version == 2
    assert sorted(r.id for r in table.read("id string, x int").collect()) == ["a", "b"] and table.manifest().batches == {"one": 0, "two": 0}
    with pytest.raises(Conflict):
        table.publish(Manifest(2))
    assert upsert(table, rows, "one", 0, merge).version == 2  # given again, left alone

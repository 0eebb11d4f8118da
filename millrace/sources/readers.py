"""Readers: bars, trades, JSON documents and lines, media files, test tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import schemas

CORRUPT = "_corrupt_record"
#: Rows that a task is given where it holds about one group a row.
ROWS = 500_000


def bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars from Parquet; raises unless they have a time column with a zone (an instant)."""
    found = spark.read.parquet(path)
    if "ts_event" not in found.columns or not isinstance(found.schema["ts_event"].dataType, T.TimestampType):
        raise ValueError("bars need ts_event as an instant")
    return found


def trades(spark: SparkSession, path: str) -> DataFrame:
    """Trades from Parquet; raises if any row is another action."""
    found = spark.read.schema(schemas.TRADES).parquet(path)
    if not found.where("action is distinct from 'T'").isEmpty():
        raise ValueError("only trades are expected")
    return found


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file; a corrupt one gives a row of nulls."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def json_lines(spark: SparkSession, path: str, schema: str, mode: str = "torn_tail") -> DataFrame:
    """JSON lines. mode: strict (any bad line raises), skip (bad lines go) or torn_tail.

    torn_tail drops a bad last line of a file, as an interrupted append leaves
    it, and raises for any other. Lines are placed by their block of the file and
    their order in it, so no file is read whole by one task.
    """
    if mode == "strict":
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if mode == "skip":
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    if mode != "torn_tail":
        raise ValueError(f"unknown mode {mode}")
    parsed_schema = T._parse_datatype_string(schema).add(CORRUPT, T.StringType())
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), (F.col("_metadata.file_block_start") + F.col("_metadata.file_block_length")).alias("_until"), F.monotonically_increasing_id().alias("_line"))
    parsed = lines.where(F.trim("value") != "").withColumn("_row", F.from_json("value", parsed_schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    # A file's last line is the last one of its last block: lines are numbered in order within a block, and a block is one task's.
    place = F.struct("_until", "_line")
    ends = parsed.groupBy("_file").agg(F.max(place).alias("_end"), F.max(F.when(F.col(f"_row.{CORRUPT}").isNotNull(), place)).alias("_bad"), F.count(F.col(f"_row.{CORRUPT}")).alias("_n"))
    if not ends.where("_n > 1 or _bad <> _end").isEmpty():
        raise ValueError("a line other than a file's last one is corrupt")
    names = [f.name for f in parsed_schema if f.name != CORRUPT]
    return parsed.where(F.col(f"_row.{CORRUPT}").isNull()).select(*[F.col(f"_row.{n}").alias(n) for n in names])


def partitioned_lines(spark: SparkSession, root: str, schema: str, file: str, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """The same file of every folder under ``root``, with the folder's name as ``video``; only folders with one of the prefixes if any are given."""
    found = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).option("pathGlobFilter", file).json(root)
    rows = found.withColumn("video", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))
    if not prefixes:
        return rows
    wanted = F.lit(False)
    for p in prefixes:
        wanted |= F.startswith("video", F.lit(p))
    return rows.where(wanted)


def media_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("mp4", "mov", "mkv", "webm"), without: str = "derived") -> DataFrame:
    """path, size and time of media files below ``root``, outside the output folder; contents are not read."""
    glob = "*.{" + ",".join(extensions) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return found.select("path", F.col("length").alias("size"), "modificationTime").where(~F.contains("path", F.lit(f"/{without}/")))


def stale_outputs(inputs: DataFrame, outputs: DataFrame, key: str, ts: str) -> DataFrame:
    """Keys whose input is newer than their output, or that have none."""
    made = outputs.select(key, F.col(ts).alias("_made"))
    return inputs.join(made, key, "left").where(F.col("_made").isNull() | (F.col(ts) > F.col("_made"))).drop("_made")


def signature(size: Column | str, modified: Column | str) -> Column:
    """Size and whole second of the last change, as size-seconds: another signature means another file."""
    return F.concat_ws("-", F.col(size) if isinstance(size, str) else size, F.unix_seconds((F.col(modified) if isinstance(modified, str) else modified).cast("timestamp")))


def changed_sources(listing: DataFrame, known: DataFrame, key: str, mark: str) -> DataFrame:
    """Keys whose signature differs from the one that their output was made from; new keys are no change."""
    made = known.select(key, F.col(mark).alias("_made"))
    return listing.join(made, key).where(F.col(mark) != F.col("_made")).drop("_made")


def array_shapes(rows: DataFrame, column: str) -> DataFrame:
    """n_rows, n_null, least and most elements of an array column: its shape, without its values leaving the scan."""
    n = F.size(column)
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(F.col(column).isNull()).alias("n_null"), F.min(F.when(F.col(column).isNotNull(), n)).alias("least"), F.max(F.when(F.col(column).isNotNull(), n)).alias("most"))


def canonical_bars(rows: DataFrame, source: str, fixed_point: bool = True) -> DataFrame:
    """ts_event, symbol, open, high, low, close, volume, source: canonical names and types, prices from integer fixed point, with where they come from."""
    from millrace.functions.prices import fixed_point as floating

    price = (lambda c: floating(c).alias(c)) if fixed_point else (lambda c: F.col(c).cast("double").alias(c))
    legs = [price(c) for c in ("open", "high", "low", "close")]
    return rows.select(F.col("ts_event").cast("timestamp_ntz"), F.col("symbol").cast("string"), *legs, F.col("volume").cast("bigint"), F.lit(source).alias("source"))


def spread(scan: DataFrame) -> DataFrame:
    """A scan over at least as many partitions as the cluster has cores, for work that outweighs a shuffle of its rows.

    Only scans with fewer partitions (few or unsplittable files) are dealt anew,
    so large inputs never are. For plain scans: a plan with shuffles would run
    its stages to count partitions.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def tasks(scan: DataFrame) -> int:
    """Tasks that have about ``ROWS`` rows of a plain scan each (counted from the files' footers), but no fewer than there are cores."""
    return max(scan.sparkSession.sparkContext.defaultParallelism, -(-scan.count() // ROWS))


def dealt(scan: DataFrame, by: Sequence[str]) -> DataFrame:
    """A plain scan's rows by key over ``tasks``, for aggregates whose groups are nearly as many as rows.

    What a task's tables of groups hold then stays the same however large the
    scan is, and none are built of what one file's split happens to have.
    """
    return scan.repartition(tasks(scan), *by)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades_of_events(events: DataFrame) -> DataFrame:
    """Events as trades: ts, sequence, price, size, symbol."""
    size = F.get_json_object("props", "$.k").cast("bigint")
    return events.select("ts", F.col("event_id").alias("sequence"), F.col("value").alias("price"), size.alias("size"), F.col("event_type").alias("symbol"))

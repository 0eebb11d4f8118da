"""Trades in DBN files as a Spark data source: ``spark.read.format("dbn").load(path)`` and ``df.write.format("dbn")``.

A file is a header (with the schema of its records and the symbols of its
instruments by date) and records of one size, so plain files are read in ranges of
records, many tasks a file; files under zstandard are read by a task each. Files of another
schema are refused when a reading is planned, records of another action
when they are read. Comparisons of times, instruments and publishers are tried on the raw
records first (Spark checks them again).

Paths may be of any file system that pyarrow knows (local, HDFS, object stores);
writers put part files beside their place and move them on commit.
"""

from __future__ import annotations

import datetime as dt
import struct
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from millrace import schemas

#: Fixed values of the format: magic, numbers of schemas and symbol types, sizes of names in versions 1 and 2, the undefined number.
MAGIC, TRADES, INSTRUMENT_ID, RAW_SYMBOL = b"DBN", 4, 0, 1
NAME = {1: 22, 2: 71, 3: 71}
NONE_64 = (1 << 64) - 1
#: A trade: header (length in words of four bytes, type, publisher, instrument, event time) and body.
RECORD = np.dtype(
    [
        ("length", "u1"), ("rtype", "u1"), ("publisher_id", "<u2"), ("instrument_id", "<u4"), ("ts_event", "<u8"), ("price", "<i8"), ("size", "<u4"),
        ("action", "S1"), ("side", "S1"), ("flags", "u1"), ("depth", "u1"), ("ts_recv", "<u8"), ("ts_in_delta", "<i4"), ("sequence", "<u4"),
    ]
)
SCHEMA = schemas.TRADES
_UTC = dt.timezone.utc
#: Records of a partition, and of a batch.
RANGE, BATCH = 1 << 21, 1 << 16
COLUMNS = {"ts_recv": "ts_recv", "ts_event": "ts_event", "instrument_id": "instrument_id", "publisher_id": "publisher_id"}
COMPARE = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}


@dataclass
class Header:
    """What readers need of a file's head: where records begin, and symbols of instruments as (id, from, until, symbol) with days as yyyymmdd."""

    schema: int
    begins: int
    symbols: list[tuple[int, int, int, str]]

    @classmethod
    def parse(cls, data: bytes) -> Header:
        version = data[3]
        if data[:3] != MAGIC or version not in NAME:
            raise ValueError("not a DBN file of a known version")
        (length,) = struct.unpack_from("<I", data, 4)
        body, name = data[8 : 8 + length], NAME[version]
        (schema,) = struct.unpack_from("<H", body, 16)
        at = 100
        text = lambda at, n: body[at : at + n].split(b"\0")[0].decode()
        (definition,) = struct.unpack_from("<I", body, at)
        at += 4 + definition
        for _ in range(3):  # symbols asked for, found in part, not found
            (n,) = struct.unpack_from("<I", body, at)
            at += 4 + n * name
        (n,) = struct.unpack_from("<I", body, at)
        at += 4
        symbols = []
        for _ in range(n):
            raw = text(at, name)
            (m,) = struct.unpack_from("<I", body, at + name)
            at += name + 4
            for _ in range(m):
                first, until = struct.unpack_from("<II", body, at)
                number = text(at + 8, name)
                at += 8 + name
                if number.isdigit():
                    symbols.append((int(number), first, until, raw))
        return cls(schema, 8 + length, symbols)

    @staticmethod
    def made(symbols: dict[int, str], dataset: str = "XXXX.TEST", schema: int = TRADES) -> bytes:
        """The head of a file of version 2 whose instruments have one symbol each at all times."""
        name = lambda x: x.encode()[: NAME[2] - 1].ljust(NAME[2], b"\0")
        body = dataset.encode().ljust(16, b"\0") + struct.pack("<HQQQBBBH", schema, 0, NONE_64, 0, RAW_SYMBOL, INSTRUMENT_ID, 0, NAME[2]) + bytes(53)
        body += struct.pack("<I", 0)
        body += struct.pack("<I", len(symbols)) + b"".join(name(s) for s in symbols.values()) + struct.pack("<II", 0, 0)
        body += struct.pack("<I", len(symbols)) + b"".join(name(s) + struct.pack("<III", 1, 0, 99991231) + name(str(i)) for i, s in symbols.items())
        return MAGIC + bytes([2]) + struct.pack("<I", len(body)) + body


@dataclass
class Range(InputPartition):
    path: str
    header: Header
    first: int
    n: int  # records; 0: all there are


def _files(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return system, [info]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [f for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and f.base_name.endswith((".dbn", ".dbn.zst")) and f.base_name[0] not in "._"]
    return system, sorted(found, key=lambda f: f.path)


def _opened(system: fs.FileSystem, path: str):
    return system.open_input_stream(path, compression="zstd" if path.endswith(".zst") else None)


def _head(system: fs.FileSystem, path: str) -> Header:
    with _opened(system, path) as f:
        start = f.read(8)
        return Header.parse(start + f.read(struct.unpack_from("<I", start, 4)[0] if len(start) == 8 else 0))


def batch_of(records: np.ndarray, header: Header) -> pa.RecordBatch:
    """Records as rows: times in microseconds, symbols by instrument and day of the event."""
    if (records["length"] != RECORD.itemsize // 4).any() or (records["rtype"] != 0).any():
        raise ValueError("a record is no trade message")
    if (records["action"] != b"T").any():
        raise ValueError("only trades are expected")
    days = records["ts_event"].astype("datetime64[ns]").astype("datetime64[D]")
    day = (days.astype("datetime64[Y]").astype(int) + 1970) * 10_000 + (days.astype("datetime64[M]").astype(int) % 12 + 1) * 100 + (days - days.astype("datetime64[M]")).astype(int) + 1
    symbol = np.full(len(records), None, object)
    for number, first, until, name in header.symbols:
        symbol[(records["instrument_id"] == number) & (day >= first) & (day < until)] = name
    time = lambda c: pa.array((records[c] // 1000).astype(np.int64)).cast(pa.timestamp("us", "UTC"))
    plain = lambda c, kind=np.int64: pa.array(records[c].astype(kind))
    columns = {
        "ts_recv": time("ts_recv"), "ts_event": time("ts_event"), "sequence": plain("sequence"), "action": pa.array(["T"] * len(records), pa.string()), "price": plain("price"),
        "size": plain("size"), "symbol": pa.array(symbol, pa.string()), "instrument_id": plain("instrument_id"), "publisher_id": plain("publisher_id", np.int32),
    }
    return pa.RecordBatch.from_pydict(columns)


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.tests = path, []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in COMPARE and len(f.attribute) == 1 and f.attribute[0] in COLUMNS and f.value is not None:
                value = f.value
                if f.attribute[0].startswith("ts_"):
                    if value.tzinfo is None:
                        yield f
                        continue
                    value = int(np.datetime64(value.astimezone(_UTC).replace(tzinfo=None), "us").astype(np.int64))
                self.tests.append((type(f), f.attribute[0], value))
            yield f  # checked again

    def partitions(self):
        system, files = _files(self.path)
        out = []
        for info in files:
            header = _head(system, info.path)
            if header.schema != TRADES:
                raise ValueError(f"only the trades schema is read, {info.base_name} has schema {header.schema}")
            if info.path.endswith(".zst"):
                out.append(Range(info.path, header, 0, 0))
                continue
            size = info.size - header.begins
            if size % RECORD.itemsize:
                raise ValueError(f"{info.base_name} ends within a record")
            n = size // RECORD.itemsize
            out += [Range(info.path, header, a, min(RANGE, n - a)) for a in range(0, n, RANGE)]
        return out or [Range("", Header(TRADES, 0, []), 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = _files(self.path)
        left = partition.n or None
        stream = _opened(system, partition.path) if left is None else system.open_input_file(partition.path)
        with stream as f:
            if left is None:
                f.read(partition.header.begins)
            else:
                f.seek(partition.header.begins + partition.first * RECORD.itemsize)
            while left is None or left:
                data = f.read(min(BATCH, left or BATCH) * RECORD.itemsize)
                if not data:
                    break
                if len(data) % RECORD.itemsize:
                    raise ValueError(f"{partition.path} ends within a record")
                records = np.frombuffer(data, RECORD)
                left = None if left is None else left - len(records)
                for kind, column, value in self.tests:
                    own = (records[column] // 1000).astype(np.int64) if column.startswith("ts_") else records[column].astype(np.int64)
                    records = records[COMPARE[kind](own, value)]
                if len(records):
                    yield batch_of(records, partition.header)


class _Writer(DataSourceArrowWriter):
    """A file for each task; symbols of a task's instruments are gathered in its head, so its records wait in a spool file on the task's disk."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite
        self.run = uuid.uuid4().hex

    def _system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def write(self, iterator) -> WriterCommitMessage:
        import shutil
        import tempfile

        symbols: dict[int, str] = {}
        with tempfile.TemporaryFile() as spool:
            for batch in iterator:
                out = np.zeros(batch.num_rows, RECORD)
                out["length"], out["action"], out["side"] = RECORD.itemsize // 4, b"T", b"N"
                if batch.num_rows and set(batch.column("action").to_pylist()) != {"T"}:
                    raise ValueError("only trades are expected")
                for c in ("publisher_id", "instrument_id", "price", "size", "sequence"):
                    out[c] = batch.column(c).to_numpy(zero_copy_only=False)
                for c in ("ts_event", "ts_recv"):
                    out[c] = batch.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False).astype(np.uint64) * 1000
                for number, name in set(zip(batch.column("instrument_id").to_pylist(), batch.column("symbol").to_pylist(), strict=True)):
                    if symbols.setdefault(number, name) != name:
                        raise ValueError(f"instrument {number} has several symbols")
                spool.write(out.tobytes())
            spool.seek(0)
            system, root = self._system()
            system.create_dir(root, recursive=True)
            name = f"part-{uuid.uuid4().hex}.dbn"
            with system.open_output_stream(f"{root}/.{self.run}-{name}") as f:
                f.write(Header.made({i: s for i, s in symbols.items() if s is not None}))
                shutil.copyfileobj(spool, f, 1 << 20)
        return _Written(name)

    def commit(self, messages) -> None:
        system, root = self._system()
        new = [m.name for m in messages if m is not None]
        old = [f.path for f in _files(self.path)[1]] if self.overwrite else []
        for name in new:
            system.move(f"{root}/.{self.run}-{name}", f"{root}/{name}")
        for path in old:
            system.delete_file(path)

    def abort(self, messages) -> None:
        system, root = self._system()
        for m in messages:
            if m is not None:
                system.delete_file(f"{root}/.{self.run}-{m.name}")


@dataclass
class _Written(WriterCommitMessage):
    name: str


class DbnTrades(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dbn"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool):
        return _Writer(self.options["path"], overwrite)


def registered(spark: SparkSession) -> SparkSession:
    """Makes the format known to a session, and its comparisons of raw records.

    Workers of data sources are not given the package's archive, so this module is sent by value.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DbnTrades)
    return spark

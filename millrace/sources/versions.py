"""Tables in numbered versions: files are written once, one rename publishes a version, readers hold on to theirs.

A table is a folder: ``data/`` has the files of every write in a folder of their
own, ``versions/`` a manifest for each version, which names the folder of each
part of the table. A writer that is lost at any point leaves the last version as it
was, and files that no version names. A manifest is written beside its place and
renamed into it, which fails where another writer has been first. That rename
must be atomic, as it is on HDFS and on local disks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

PART = "_part"


class Conflict(RuntimeError):
    """Another writer has published the version that was to be written."""


@dataclass
class Manifest:
    """A version: its number, the last batch that it holds of each source, and the folder of each part of the table."""

    version: int = 0
    batches: dict[str, int] = field(default_factory=dict)
    parts: dict[str, str] = field(default_factory=dict)


class Versions:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path("versions").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.hadoop.Path(f"{self.root}/{name}")

    def numbers(self) -> list[int]:
        """All versions there are, ascending."""
        if not self.fs.exists(self._path("versions")):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path("versions"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> Manifest:
        """A version's manifest, by default the last one's; that of an empty table if there is none."""
        found = self.numbers()
        if version is None and not found:
            return Manifest()
        at = found[-1] if version is None else version
        stream = self.fs.open(self._path(f"versions/{at:020d}.json"))
        try:
            return Manifest(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def read(self, schema: T.StructType | str, version: int | None = None, parts: Iterable[str] | None = None) -> DataFrame:
        """The rows of a version (the last one as it is now), or of some of its parts. Later versions change nothing about them."""
        held = self.manifest(version).parts
        folders = [f"{self.root}/data/{held[p]}" for p in (held if parts is None else parts) if p in held]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def written(self, rows: DataFrame) -> str:
        """Writes ``rows`` (with a column _part) into files of their own that no version names yet; says where."""
        name = uuid.uuid4().hex
        rows.write.partitionBy(PART).option("compression", "zstd").parquet(f"{self.root}/data/{name}")
        return name

    def publish(self, manifest: Manifest) -> None:
        """Makes ``manifest`` the version of its number, or raises ``Conflict`` where there is one."""
        beside = self._path(f"versions/.{manifest.version}-{uuid.uuid4().hex}")
        out = self.fs.create(beside, False)
        try:
            out.write(bytearray(json.dumps(vars(manifest)).encode()))
        finally:
            out.close()
        target = self._path(f"versions/{manifest.version:020d}.json")
        plain = self.spark.sparkContext._gateway.new_array(getattr(self.hadoop, "Options$Rename"), 0)  # without overwriting
        try:
            self.hadoop.FileContext.getFileContext(target.toUri(), self.conf).rename(beside, target, plain)
        except Exception as e:
            self.fs.delete(beside, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {manifest.version} exists") from e
            raise

    def vacuum(self, keep: int = 1) -> int:
        """Deletes the data that none of the last ``keep`` versions names, and older manifests; says how many folders that were. Not while a writer is at work."""
        numbers = self.numbers()
        named = {f.split("/")[0] for n in numbers[-keep:] for f in self.manifest(n).parts.values()}
        for n in numbers[:-keep]:
            self.fs.delete(self._path(f"versions/{n:020d}.json"), False)
        gone = [s.getPath() for s in self.fs.listStatus(self._path("data")) if s.getPath().getName() not in named] if self.fs.exists(self._path("data")) else []
        for path in gone:
            self.fs.delete(path, True)
        return len(gone)


def upsert(versions: Versions, rows: DataFrame, source: str, batch: int, merge: Callable[[DataFrame], DataFrame], step: Callable[[str], None] = lambda name: None) -> Manifest:
    """Merges a batch of a source (with a column _part) into the parts that it touches and publishes the result.

    A batch that a version already holds is left alone, so it may be given again
    after a failure; where another writer publishes first, the batch is merged into
    that version anew. ``step`` is told what is about to happen.
    """
    touched = sorted(str(r[0]) for r in rows.select(PART).distinct().collect())  # one row a part
    plain = T.StructType([f for f in rows.schema.fields if f.name != PART])
    while True:
        step("read")
        now = versions.manifest()
        if now.batches.get(source, -1) >= batch:
            return now
        known = versions.read(plain, now.version, touched) if now.version else rows.drop(PART).limit(0)
        step("write")
        folder = versions.written(merge(known.unionByName(rows.drop(PART))))
        step("publish")
        new = Manifest(now.version + 1, {**now.batches, source: batch}, {**now.parts, **{p: f"{folder}/{PART}={p}" for p in touched}})
        try:
            versions.publish(new)
        except Conflict:
            continue
        step("done")
        return new

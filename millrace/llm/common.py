"""What the training-data operators share: the shared folder, Arrow mapping, words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from millrace.sources.scratch import scratch_dir

#: Bytes of text that one step inside a task works on at a time.
BLOCK_BYTES = 1 << 20


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = scratch_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys that may be sent to every executor (some 60 MB at most); more are joined by shuffling both sides.
SENT_KEYS = 500_000


def by_keys(df: DataFrame, keys: DataFrame, on: str, how: str) -> DataFrame:
    """left_semi or left_anti join with a table of keys: broadcast if they are counted as few, else an ordinary join.

    Rows of ``df`` carry whole texts, so not shuffling them is worth a count.
    """
    few = keys.count() <= SENT_KEYS
    return df.join(F.broadcast(keys) if few else keys, on, how)


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of ``column`` each; a row is never cut."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts, cuts[1:], strict=False):
        if end > start:
            yield batch.slice(start, end - start)


def with_columns(
    df: DataFrame,
    text: str,
    make: Callable[[], Callable[[pa.RecordBatch], dict[str, object]]],
    added: str,
) -> DataFrame:
    """``df`` with the columns of the DDL ``added``, computed by Arrow blocks.

    ``make`` runs once in each task and returns the function that maps a block
    to its new columns. Columns of ``df`` that have an added name are replaced.
    """
    new = T._parse_datatype_string(added)
    kept = [c for c in df.columns if c.lower() not in {f.name.lower() for f in new}]
    df = df.select(*[df[f"`{c}`"] for c in kept])
    schema = T.StructType([*df.schema.fields, *new.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        f, names = make(), [x.name for x in new]
        kinds = dict(zip(names, to_arrow_schema(new).types, strict=True))
        for batch in batches:
            for block in blocks(batch, text):
                got = f(block)
                yield pa.RecordBatch.from_arrays(
                    [*block.columns, *(pa.array(got[x], type=kinds[x]) for x in names)],
                    names=[*block.schema.names, *names],
                )

    return df.mapInArrow(run, schema)


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, then the runs of ``[^\\x20\\x09-\\x0D]`` in UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(found: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, in order."""
    return np.fromiter(map(xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (multiply, xor-shift)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of a whole text.

    With fewer words than ``width`` the whole sequence is one shingle; without
    words (null or blank text) the set is empty.
    """
    h = word_hashes(words(text))
    if not len(h):
        return h
    n = max(1, len(h) - width + 1)
    out = np.full(n, np.uint64(min(width, len(h))))
    for j in range(min(width, len(h))):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(out)

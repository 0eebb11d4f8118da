"""Packing token sequences by non-negative least squares.

Every document gives whole windows and one remainder below the window. The
histogram of remainder lengths is the only thing the driver sees: at most
``window`` lengths in ``spread`` buckets (64, or as many as the cluster has cores, up to 4096). Shallow combinations that fill a
window exactly (k pieces of one length and one of another) form the columns of a
non-negative least squares problem; its repeat counts, rounded to what the
histogram holds, say how many sequences of each combination are built. What
remains is packed greedily end to end and cut at window ends, so only the last
sequence is padded.

A remainder's place follows from its rank within its length: the rank in its
bucket plus the counts of the buckets before. So no length is gathered in one
task, however many documents share it.

Defined cases: null and empty texts are the closing id alone; repeated rows are
packed once each; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import loaded
from .common import blocks, stored

WINDOW = 1024
PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def combinations(window: int, depth: int = 8) -> list[tuple[int, int, int]]:
    """(a, k, b): k pieces of length a and, unless b is 0, one of length b fill the window."""
    out = set()
    for k in range(1, depth + 1):
        for a in range(1, window // k + 1):
            b = window - k * a
            if b == a:
                out.add((a, k + 1, 0))
            elif k > 1 or a < b or b == 0:
                out.add((a, k, b))
    return sorted(x for x in out if x[0] < window)


def non_negative_least_squares(columns: list[tuple[int, int, int]], histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 of least squared error of the lengths used against the histogram (accelerated projected gradient)."""
    if not columns:
        return np.zeros(0)
    a, k, b = (np.array(x) for x in zip(*columns, strict=True))
    size, h = len(histogram), histogram.astype(np.float64).copy()
    h[0] = 0

    def used(x: np.ndarray) -> np.ndarray:
        out = np.bincount(a, k * x, minlength=size) + np.bincount(b, x, minlength=size)
        out[0] = 0  # length 0 stands for no second piece
        return out

    def back(r: np.ndarray) -> np.ndarray:
        return k * r[a] + np.where(b > 0, r[b], 0)

    v = np.ones(len(a))
    for _ in range(30):
        v = back(used(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.02 * np.linalg.norm(back(used(v))))
    x = y = np.zeros(len(a))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(used(y) - h))
        t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        x, y = new, new + (was - 1) / t * (new - x)
    return x


@dataclass
class Plan:
    """Where the remainder of each (length, rank) goes.

    Slots are sorted by length and first rank; ``planned[length]`` ranks have a
    slot, later ones stand end to end from ``chain[length]`` on, in sequences
    from ``first_chain`` on.
    """

    window: int
    planned: np.ndarray
    chain: np.ndarray
    first_chain: int
    length: np.ndarray
    rank: np.ndarray
    base: np.ndarray
    each: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, histogram: np.ndarray, window: int) -> Plan:
        """Solve, round and lay out. histogram[l]: remainders of length l < window."""
        present = histogram > 0
        columns = [c for c in combinations(window) if present[c[0]] and (c[2] == 0 or present[c[2]])]
        x = non_negative_least_squares(columns, histogram)
        left, slots, base, start = histogram.astype(np.int64).copy(), [], 0, np.zeros(window, np.int64)
        for i in np.argsort(-x, kind="stable"):
            a, k, b = columns[i]
            n = int(min(np.floor(x[i] + 0.5), left[a] // k, left[b] if b else left[a] // k))
            if n <= 0:
                continue
            slots.append((a, start[a], base, k, 0))
            start[a] += n * k
            left[a] -= n * k
            if b:
                slots.append((b, start[b], base, 1, a * k))
                start[b] += n
                left[b] -= n
            base += n
        order = np.arange(window)[::-1]  # the longest first
        chain = np.zeros(window, np.int64)
        chain[order] = np.cumsum(np.r_[0, (left * np.arange(window))[order]])[:-1]
        s = np.array(sorted(slots), np.int64).reshape(-1, 5)
        return cls(window, start, chain, base, *(s[:, j] for j in range(5)))

    def slots(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """sequence and offset of each remainder; has it a slot? Without one: its position in the chain."""
        fixed = rank < self.planned[length]
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        if fixed.any():
            l, r = length[fixed], rank[fixed]
            wide = np.int64(1) << 48
            at = np.searchsorted(self.length * wide + self.rank, l * wide + r, "right") - 1
            k = r - self.rank[at]
            sequence[fixed] = self.base[at] + k // self.each[at]
            offset[fixed] = self.offset[at] + k % self.each[at] * l
        free = ~fixed
        position = self.chain[length[free]] + (rank[free] - self.planned[length[free]]) * length[free]
        sequence[free], offset[free] = self.first_chain + position // self.window, position % self.window
        return sequence, offset, fixed


def tokens(docs: DataFrame, path: str, closing: int, window: int, key: str, text: str) -> DataFrame:
    """A row per document: whole windows as checksums, and the ids of the remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, task = loaded(path), TaskContext.get()
        end, unique, full = np.array([closing], "<u4").tobytes(), (task.partitionId() if task else 0) << 38, 0
        row, width = 0, 4 * window
        for batch in batches:
            for block in blocks(batch, "text"):
                out: dict[str, list] = {x: [] for x in ("uid", "doc_tokens", "windows", "first", "rest", "rest_crc", "rest_ids")}
                found, bounds = bpe.block(block.column("text"))
                data = memoryview(found.tobytes())
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    ids = bytes(data[4 * a : 4 * b]) + end
                    whole = len(ids) // width
                    rest = ids[whole * width :]
                    for name, x in (
                        ("uid", unique + row), ("doc_tokens", len(ids) // 4), ("first", unique + full),
                        ("windows", [zlib.crc32(ids[i * width : (i + 1) * width]) for i in range(whole)]),
                        ("rest", len(rest) // 4), ("rest_crc", zlib.crc32(rest)), ("rest_ids", rest),
                    ):
                        out[name].append(x)
                    row, full = row + 1, full + whole
                kinds = {"windows": pa.list_(pa.int64()), "rest": pa.int32(), "rest_ids": pa.binary()}
                yield pa.RecordBatch.from_arrays(
                    [block.column("doc_id"), *(pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items())], names=["doc_id", *out]
                )

    source = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, "doc_id bigint, uid bigint, doc_tokens bigint, windows array<bigint>, first bigint, rest int, rest_crc bigint, rest_ids binary")


def packed(docs: DataFrame, path: str | None = None, closing: int = 0, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents; sequences of whole windows have negative numbers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    rows = stored(tokens(docs, path, closing, window, key, text))
    own = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = rows.select("doc_id", "doc_tokens", "first", F.posexplode("windows").alias("i", "ids_crc32")).select(
        "doc_id", (F.col("i").cast("bigint") * window).alias("start"), F.lit(window).cast("bigint").alias("length"), "ids_crc32",
        "doc_tokens", (-1 - F.col("first") - F.col("i")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"),
    )
    spread = min(4096, max(64, spark.sparkContext.defaultParallelism))
    salt = F.pmod(F.xxhash64("uid"), F.lit(spread)).cast("int")
    rests = rows.where("rest > 0").withColumn("bucket", salt)
    # At most (window - 1) * spread rows, whatever the input.
    counts = rests.groupBy("rest", "bucket").count().toPandas()
    grid = np.zeros((window, spread), np.int64)
    grid[counts["rest"].to_numpy(), counts["bucket"].to_numpy()] = counts["count"].to_numpy()
    before = np.cumsum(grid, axis=1) - grid
    sent = spark.sparkContext.broadcast((Plan.of(grid.sum(1), window), before))
    ranked = rests.select(
        "doc_id", "doc_tokens", "rest", "bucket", "rest_crc", "rest_ids",
        F.row_number().over(Window.partitionBy("rest", "bucket").orderBy("uid")).alias("turn"),
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, ahead = sent.value
        for batch in batches:
            doc, total, rest, bucket, crc, turn = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("doc_id", "doc_tokens", "rest", "bucket", "rest_crc", "turn"))
            docs_of, ids = batch.column("doc_id"), batch.column("rest_ids")
            rest = rest.astype(np.int64)
            sequence, offset, fixed = plan.slots(rest, ahead[rest, bucket] + turn.astype(np.int64) - 1)
            one = fixed | (offset + rest <= window)
            at = np.flatnonzero(one)
            parts = [(at, (total - rest)[at], rest[at], crc[at], sequence[at], offset[at])]
            split: list[tuple[int, ...]] = []
            for i in np.flatnonzero(~one).tolist():
                data, done = ids[i].as_py(), 0
                while done < rest[i]:
                    n = int(min(rest[i] - done, window - (offset[i] + done) % window))
                    where = int(offset[i] + done)
                    split.append((i, int(total[i] - rest[i]) + done, n, zlib.crc32(data[4 * done : 4 * (done + n)]), int(sequence[i]) + where // window, where % window))
                    done += n
            if split:
                parts.append(tuple(np.array(x, np.int64) for x in zip(*split, strict=True)))
            row, start, length, checks, seq, off = (np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays(
                [docs_of.take(pa.array(row)), pa.array(start), pa.array(length), pa.array(checks), pa.array(total[row].astype(np.int64)), pa.array(seq), pa.array(off)], names=own
            )

    return whole.select(own).unionByName(ranked.mapInArrow(place, PIECE))

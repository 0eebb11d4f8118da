"""Importance resampling towards a target corpus, by bags of hashed word n-grams.

Documents are drawn without replacement in proportion to how much likelier the
target's bag of n-grams makes them than the corpus's own: a document's weight is
the mean gain of its features, Gumbel noise of its key turns the draw into a
ranking.

Segment deduplication: n-grams never skip a newline's neighbours, and corpora
repeat lines. Texts are cut into lines; the features of each distinct line are
hashed once and stored, weighted by the line's occurrences in the corpus's
counts, and its gain is summed once and joined back to the documents that hold
it. The n-grams that span a line break are made from the words at the lines'
ends and added separately. A line that many documents share is one row on one side
of that join, whose other side adaptive execution splits.

Defined cases: a text that is null or has no word has no feature and weight 0;
repeated rows are documents of their own (equal keys have equal noise, and stand
in any order where all is equal); a null key takes part with an empty one; very
long texts are hashed line by line; an empty target or corpus has counts of 0,
an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.scans import numbered

from .common import blocks, stored

BUCKETS = 10_000
#: A-Z become a-z, digits and letters stay, as do all bytes beyond ASCII; newlines cut lines, anything else is a blank.
_TABLE = bytes(b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b == 0x0A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_LINES = "h1 bigint, h2 bigint, n bigint, n_features bigint, buckets binary"


def plain(text: str | None) -> bytes:
    """A text with words parted by blanks and lines by newlines."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE) if text else b""


def singles(words: list[bytes]) -> list[int]:
    return list(map(crc32, words))


def pairs(words: list[bytes], sums: list[int]) -> Iterator[int]:
    """Checksums of words joined with their successors by a blank, continued from the words' own."""
    return map(crc32, words[1:], map(crc32, repeat(b" "), sums))


def line_features(lines: list[bytes], buckets: int = BUCKETS) -> list[np.ndarray]:
    """The buckets of all runs of one or two words of each line."""
    found, sizes = [], []
    for line in lines:
        words = line.split()
        sums = singles(words)
        found += sums
        found += pairs(words, sums)
        sizes.append(max(0, 2 * len(words) - 1))
    flat = (np.array(found, np.uint32) % buckets).astype(np.uint16)
    return np.split(flat, np.cumsum(sizes)[:-1]) if sizes else []


def crossings(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """The buckets of the pairs of words that a line break parts; lines without words part nothing."""
    lines = [x for x in plain(text).split(b"\n") if x and not x.isspace()]
    found = [crc32(b.split(None, 1)[0], crc32(b" ", crc32(a.rsplit(None, 1)[-1]))) for a, b in pairwise(lines)]
    return (np.array(found, np.uint32) % buckets).astype(np.uint16)


def _identity(line):
    return F.xxhash64(line), F.xxhash64(F.lit(1), line)


def distinct_lines(docs: DataFrame, text: str, buckets: int = BUCKETS) -> DataFrame:
    """A row for each distinct line with words: its 128-bit identity, occurrences in all texts, number of features, and their buckets."""
    h1, h2 = _identity(F.col("line"))
    lines = docs.select(F.explode(F.split(text, "\n")).alias("line")).where("line <> ''").groupBy("line").agg(F.count("*").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "line"):
                found = line_features([plain(x) for x in block.column("line").to_pylist()], buckets)
                sizes = [len(x) for x in found]
                out = pa.RecordBatch.from_arrays(
                    [block.column("h1"), block.column("h2"), block.column("n"), pa.array(sizes, pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())],
                    names=["h1", "h2", "n", "n_features", "buckets"],
                )
                yield out.filter(pa.array(np.array(sizes) > 0))

    return lines.select("line", h1.alias("h1"), h2.alias("h2"), "n").mapInArrow(run, _LINES)


def _summed(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        for block in blocks(batch, "buckets"):
            found = np.frombuffer(b"".join(block.column("buckets").to_pylist()), np.uint16)
            times = np.repeat(block.column("n").to_numpy(), block.column("n_features").to_numpy())
            total += np.bincount(found, times, buckets).astype(np.int64)  # exact below 2**53 a block
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])


def bucket_counts(parts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs; ``parts`` has n (times), n_features and buckets. As many numbers as buckets reach the driver."""
    rows = parts.select("n", "n_features", "buckets").mapInArrow(lambda b: _summed(b, buckets), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    out[[r.bucket for r in rows]] = [r.n for r in rows]
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's add-one ratio between target and corpus."""
    n, s, t = len(corpus), corpus.astype(float), target.astype(float)
    return np.floor(1000 * np.log(((t + 1) * (s.sum() + n)) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def _gained(parts: DataFrame, gains: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep``, gain (of all features of the row) and n_features."""
    sent = parts.sparkSession.sparkContext.broadcast(gains)  # as many numbers as buckets
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in parts.select(*keep).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "buckets"):
                sizes = block.column("n_features").to_numpy()
                upto = np.r_[0, np.cumsum(sent.value[np.frombuffer(b"".join(block.column("buckets").to_pylist()), np.uint16)])]
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([*(block.column(c) for c in keep), pa.array(upto[ends] - upto[ends - sizes]), pa.array(sizes)], names=[*keep, "gain", "n_features"])

    return parts.select(*keep, "n_features", "buckets").mapInArrow(run, ", ".join([*kept, "gain bigint", "n_features bigint"]))


def _segmented(docs: DataFrame, key: str, text: str, buckets: int) -> DataFrame:
    """uid, key, lines (identities and occurrences) and the crossing pairs of each document, stored."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(key).cast("bigint").alias("key"), F.coalesce(text, F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                found = [crossings(x, buckets) for x in block.column("text").to_pylist()]
                sizes = pa.array([len(x) for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [block.column("uid"), block.column("key"), block.column("lines"), pa.array([1] * len(found), pa.int64()), sizes, pa.array([x.tobytes() for x in found], pa.binary())],
                    names=["uid", "key", "lines", "n", "n_features", "buckets"],
                )

    lines = F.transform(F.filter(F.split("text", "\n"), lambda x: x != ""), lambda x: F.struct(*[h.alias(f"h{i + 1}") for i, h in enumerate(_identity(x))]))
    cut = rows.withColumn("lines", lines)
    return stored(cut.mapInArrow(run, "uid bigint, key bigint, lines array<struct<h1: bigint, h2: bigint>>, n bigint, n_features bigint, buckets binary"))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, key: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """Every document's ``key``, n_features, weight, score and rank (null where it is not drawn).

    Of the documents with ``least_words`` words or more, ``percent`` in a hundred
    with the highest scores are drawn, ties to the smaller key.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are kept in 16 bits")
    parts = _segmented(docs, key, text, buckets)
    lines = stored(distinct_lines(docs.select(F.coalesce(text, F.lit("")).alias("text")), "text", buckets))
    wanted = target.select(F.coalesce(target_text, F.lit("")).alias("text"))
    aimed = distinct_lines(wanted, "text", buckets), _segmented(wanted.select("text", F.lit(0).alias("k")), "k", "text", buckets)
    gains = gains_of(bucket_counts(lines, buckets) + bucket_counts(parts, buckets), bucket_counts(aimed[0], buckets) + bucket_counts(aimed[1], buckets))
    held = parts.select("uid", F.explode("lines").alias("line")).select("uid", "line.*")
    of_lines = held.join(_gained(lines, gains, ["h1", "h2"]), ["h1", "h2"]).select("uid", "gain", "n_features")
    across = _gained(parts, gains, ["uid", "key"])
    sums = across.unionByName(of_lines, allowMissingColumns=True).groupBy("uid").agg(F.max("key").alias("key"), F.sum("gain").alias("gain"), F.sum("n_features").alias("n_features"))
    weight = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(0)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")
    scored = stored(sums.select("uid", "key", "n_features", weight.cast("bigint").alias("weight")).withColumn("score", F.col("weight") + noise))
    enough = scored.where(F.expr(f"(n_features + 1) div 2 >= {least_words}")).select("uid", (-F.col("score")).alias("_down"), "key")
    drawn = numbered(enough, [], ["_down", "key", "uid"]).where(F.col("_i") < F.expr(f"_n * {percent} div 100")).select("uid", (F.col("_i") + 1).cast("bigint").alias("rank"))
    return scored.join(drawn, "uid", "left").select(F.col("key").alias(key), "n_features", "weight", "score", "rank")

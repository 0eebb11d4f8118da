"""A factorisation machine that scores text quality.

Features of a text: hashed words, hashed word endings (the last bytes as
written), structure statistics in one-hot bins, and metadata of the text itself
(its size, the share of each kind of byte). The machine's pairwise part is
low-rank and is scored in time linear in the features:
``1/2 * sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2)``.

Defined cases: null and empty texts have the features of an empty text and so
one defined score; repeated rows score alike; rows whose labels contradict one
another are not learned from, and of rows with one key the text that sorts first
is; with no usable label the score is 0.5. Extra
columns pass through; columns named like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import blocks, with_columns

WORDS, ENDS, BINS = 1 << 14, 1 << 11, 16
#: Structure statistics: each has BINS one-hot features. Shares of the bytes of each class, then what words are like.
BYTES = ("lower", "upper", "digit", "punctuation", "blank", "line", "control", "beyond_ascii")
STATISTICS = ("log_bytes", "word_bytes", *BYTES, "distinct", "same_as_before", "one_byte", "no_letter", "begins_upper", "ends_punctuated")
SIZE = WORDS + ENDS + BINS * len(STATISTICS)


def _class_table() -> np.ndarray:
    """Byte to the number of its class in ``BYTES``."""
    table = np.full(256, BYTES.index("beyond_ascii"))
    table[:128] = BYTES.index("punctuation")
    table[[*range(32), 127]] = BYTES.index("control")
    table[[9, 11, 12, 13, 32]] = BYTES.index("blank")
    table[10] = BYTES.index("line")
    for chars, kind in (("abcdefghijklmnopqrstuvwxyz", "lower"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "upper"), ("0123456789", "digit")):
        table[[ord(c) for c in chars]] = BYTES.index(kind)
    return table


class Features:
    """Feature numbers and values of texts."""

    def __init__(self) -> None:
        self.classes = _class_table()

    def one(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        data = (text or "").encode("utf-8", "surrogatepass")
        raw = data.split()
        n, size = len(raw), max(1, len(data))
        shares = np.bincount(self.classes, np.bincount(np.frombuffer(data, np.uint8), minlength=256), minlength=len(BYTES)) / size
        lower = data.lower().split()
        h = np.fromiter(map(xxh3_64_intdigest, lower), np.uint64, n)
        ends = np.fromiter(map(xxh3_64_intdigest, [w[-2:] for w in raw]), np.uint64, n)
        per_word = max(1, n)
        own, counts = np.unique((h % np.uint64(WORDS)).astype(np.int64), return_counts=True)
        tail, tails = np.unique((ends % np.uint64(ENDS)).astype(np.int64), return_counts=True)
        first, last = (self.classes[np.frombuffer(bytes([w[k] for w in raw]), np.uint8)] for k in (0, -1))
        stats = np.array([
            np.log2(size) / 20,
            min(1.0, sum(map(len, raw)) / per_word / 24),
            *np.sqrt(shares),  # the root spreads small shares over the bins
            len(set(lower)) / per_word,
            float((h[1:] == h[:-1]).mean()) if n > 1 else 0.0,
            sum(1 for w in raw if len(w) == 1) / per_word,
            sum(1 for w in lower if w.upper() == w and w[0] < 128) / per_word,
            float((first == BYTES.index("upper")).sum()) / per_word,
            float((last == BYTES.index("punctuation")).sum()) / per_word,
        ])
        at = np.minimum((np.clip(stats, 0, 1) * BINS).astype(np.int64), BINS - 1)
        return (
            np.concatenate([own, WORDS + tail, WORDS + ENDS + BINS * np.arange(len(STATISTICS)) + at]),
            np.concatenate([np.sqrt(counts / per_word), np.sqrt(tails / per_word), np.ones(len(STATISTICS))]),
        )

    def many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature numbers and values of all texts, and where each text's begin (all have some)."""
        found = [self.one(t) for t in texts]
        starts = np.cumsum([0, *(len(i) for i, _ in found)])[:-1]
        return np.concatenate([i for i, _ in found]), np.concatenate([x for _, x in found]), starts


@dataclass
class FactorisationMachine:
    """Weights; ``linear[SIZE]``, ``factors[SIZE, rank]``."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log odds of each text, and its factor sums."""
        vx = self.factors[index] * value[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        pairs = 0.5 * ((sums**2).sum(1) - np.add.reduceat((vx**2).sum(1), starts))
        return self.bias + np.add.reduceat(self.linear[index] * value, starts) + pairs, sums

    @classmethod
    def fit(
        cls, texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray,
        rank: int = 6, epochs: int = 12, size: int = 64, rate: float = 0.02, decay: float = 1e-3, seed: int = 7,
    ) -> FactorisationMachine:
        """Logistic loss, mini-batches, Adam; the same rows give the same weights."""
        rng = np.random.default_rng(seed)
        theta = np.concatenate([np.zeros((SIZE, 1)), rng.normal(0, 0.05, (SIZE, rank))], 1)
        model, m, s, step = cls(0.0, theta[:, 0], theta[:, 1:]), np.zeros_like(theta), np.zeros_like(theta), 0
        if not len(labels):
            return cls(0.0, np.zeros(SIZE), np.zeros((SIZE, rank)))
        share = min(0.999, max(0.001, float(labels.mean())))
        model.bias = float(np.log(share / (1 - share)))
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), size):
                own = order[at : at + size]
                index, value = (np.concatenate([texts[k][j] for k in own]) for j in (0, 1))
                lengths = [len(texts[k][0]) for k in own]
                y, sums = model.margins(index, value, np.cumsum([0, *lengths])[:-1])
                slope = (1 / (1 + np.exp(-y)) - labels[own]) / len(own)
                each = np.repeat(slope, lengths) * value
                grad = np.empty_like(theta)
                grad[:, 0] = np.bincount(index, each, minlength=SIZE)
                pull = np.repeat(sums, lengths, axis=0) - model.factors[index] * value[:, None]
                for f in range(rank):
                    grad[:, f + 1] = np.bincount(index, each * pull[:, f], minlength=SIZE)
                step += 1
                m = 0.9 * m + 0.1 * grad
                s = 0.999 * s + 0.001 * grad**2
                theta -= rate * (m / (1 - 0.9**step) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8) + decay * theta)
                model.bias -= rate * float(slope.sum())
        return model


def fit(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", bound: int = 4000
) -> FactorisationMachine:
    """Fit on about ``bound`` labelled documents at most, chosen by a hash of their key.

    Only feature vectors of that sample reach the driver.
    """
    agreed = labels.where(F.col(label).isNotNull()).groupBy(key).agg(F.min(label).alias("y"), F.max(label).alias("most")).where("y = most")
    n = agreed.count()
    share = min(1.0, bound / max(1, n))
    chosen = agreed.where(F.pmod(F.xxhash64(key, F.lit(29)), F.lit(1 << 20)) < share * (1 << 20)).select(key, "y")
    # Size bounded by ``bound``, so it may be sent to all executors.
    drawn = docs.select(key, text).join(F.broadcast(chosen), key).select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col("y").cast("double").alias("y"))
    # A key counts once, however many rows have it; rows of a task are combined before the shuffle.
    sample = drawn.groupBy("k", "y").agg(F.min("text").alias("text")).select("k", "text", "y")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features()
        for batch in batches:
            for block in blocks(batch, "text"):
                found = [f.one(t) for t in block.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [block.column("k"), block.column("y"), pa.array([i.astype(np.int32).tobytes() for i, _ in found], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in found], pa.binary())],
                    names=["k", "y", "i", "x"],
                )

    kind = sample.schema["k"].dataType.simpleString()
    rows = sample.mapInArrow(featurise, f"k {kind}, y double, i binary, x binary").toPandas().sort_values(["k", "i"], kind="stable")
    texts = [(np.frombuffer(i, np.int32).astype(np.int64), np.frombuffer(x, np.float32).astype(np.float64)) for i, x in zip(rows["i"], rows["x"], strict=True)]
    return FactorisationMachine.fit(texts, rows["y"].to_numpy(np.float64))


def score(docs: DataFrame, model: FactorisationMachine, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``threshold`` on). No shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # SIZE x (rank + 1) numbers

    def make():
        f, own = Features(), sent.value

        def run(block: pa.RecordBatch) -> dict[str, object]:
            y, _ = own.margins(*f.many(block.column(text).to_pylist()))
            p = 1 / (1 + np.exp(-np.clip(y, -30, 30)))
            return {"score": p, "predicted": (p >= threshold).astype(np.int32)}

        return run

    return with_columns(docs, text, make, "score double, predicted int")

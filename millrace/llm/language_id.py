"""Language identification with interpolated Kneser-Ney character models.

One character model of order four per language, fitted on a bounded sample of
labelled documents. All models share sorted arrays of packed n-grams (a
collision-free 64-bit hash: four code units of 16 bits); an n-gram lists only the
languages that have seen it, so models grow with what was fitted and not with the
square of the languages. A distinct n-gram of a text is looked up once per order
for all languages. The
chosen language has the lowest cross-entropy per character; texts whose
cross-entropy lies too near to that of shuffled calibration texts are rejected.
A language with few held-back texts is calibrated on those and on its fitted
texts, each scored by the others; so every language rejects, however rare it is.

Defined cases: a text that is null or has no letter (marks alone are none) gets ``und``, score 0 and
``rejected`` true; with no labelled document at all every text does. Ties go to
the language that sorts first. Repeated rows are scored alike, each once. Extra
columns pass through; columns named like an added one are replaced.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, with_columns

ORDER = 4
SPACE = 32
#: Held-back texts below which fitted texts calibrate too, and how many of these at most.
FEW, LEFT_OUT = 5, 20
#: The score is the chosen language's share of the likelihoods of this many characters (or of all, if fewer): more would always give 1.
CERTAIN = 200
ADDED = "lang_pred string, score double, cross_entropy double, rejected boolean"


def _unit_table() -> np.ndarray:
    """Code point (below 2**16) to the unit that models see: a lower-case letter or a space."""
    table = np.full(1 << 16, SPACE, np.uint64)
    for cp in range(1 << 16):
        c = chr(cp)
        if c.isalpha() or unicodedata.category(c)[0] == "M":
            low = c.lower()
            table[cp] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else cp
    return table


class Units:
    """Turns texts into one array of units, a row per kept character."""

    def __init__(self) -> None:
        self.table = _unit_table()
        self.letter = np.array([chr(cp).isalpha() for cp in range(1 << 16)])

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed n-grams (order four) of all texts, their text's number, and letters per text.

        Runs of anything but letters and marks count as one space. Letters beyond
        the basic plane share one unit.
        """
        lengths = np.array([len(t) if t else 0 for t in texts], np.int64)
        cp = np.frombuffer("".join(t for t in texts if t).encode("utf-32-le", "surrogatepass"), np.uint32)
        basic = np.minimum(cp, 0xFFFF)
        c, letter = self.table[basic], self.letter[basic]
        beyond = np.flatnonzero(cp >= 1 << 16)
        if len(beyond):
            found, which = np.unique(cp[beyond], return_inverse=True)
            c[beyond] = np.array([0xFFFF if chr(x).isalpha() else SPACE for x in found], np.uint64)[which]
            letter[beyond] = c[beyond] != SPACE
        of = np.repeat(np.arange(len(texts)), lengths)
        first = np.ones(len(c), bool)
        first[1:] = of[1:] != of[:-1]
        blank = c == SPACE
        after_blank = first.copy()
        after_blank[1:] |= blank[:-1]
        letters = np.bincount(of[letter], minlength=len(texts))
        kept = ~(blank & after_blank)
        c, of = c[kept], of[kept]
        starts = np.searchsorted(of, np.arange(len(texts)))
        at = np.arange(len(c)) - starts[of] if len(c) else np.zeros(0, np.int64)
        packed = c.copy()
        for j in range(1, ORDER):
            before = np.full(len(c), np.uint64(SPACE))
            if len(c) > j:
                before[j:] = np.where(at[j:] >= j, c[:-j], np.uint64(SPACE))
            packed |= before << np.uint64(16 * j)
        return packed, of, letters


def _tail(keys: np.ndarray, n: int) -> np.ndarray:
    """The last ``n`` units of packed n-grams."""
    return keys & np.uint64((1 << (16 * n)) - 1)


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the sorted ``keys``, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class KneserNey:
    """Interpolated Kneser-Ney of one language over packed n-grams."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, alphabet: int) -> None:
        self.alphabet, self.levels = alphabet, {}
        k, c = keys, counts.astype(np.float64)
        for n in range(ORDER, 0, -1):
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            ctx, inverse = np.unique(k >> np.uint64(16), return_inverse=True)
            total, kinds = np.bincount(inverse, c), np.bincount(inverse)
            self.levels[n] = (k, np.maximum(c - d, 0) / total[inverse], ctx, d * kinds / total)
            # Continuation counts: distinct left units of each shorter n-gram.
            k, c = np.unique(_tail(k, n - 1), return_counts=True) if n > 1 else (k, c)
            c = c.astype(np.float64)

    def back_off(self, n: int, contexts: np.ndarray) -> np.ndarray:
        """The weight of the order below after ``contexts`` (1 if unseen)."""
        _, _, ctx, weight = self.levels[n]
        at, seen = _at(ctx, contexts)
        return np.where(seen, weight[at] if len(weight) else 1.0, 1.0)

    def probability(self, n: int, keys: np.ndarray) -> np.ndarray:
        """P(last unit | the n-1 before it)."""
        if n == 0:
            return np.full(len(keys), 1.0 / self.alphabet)
        k, p, _, _ = self.levels[n]
        at, seen = _at(k, keys)
        own = np.where(seen, p[at] if len(p) else 0.0, 0.0)
        return own + self.back_off(n, keys >> np.uint64(16)) * self.probability(n - 1, _tail(keys, n - 1))


class Listed:
    """Sorted keys, each with the languages that have a value for it."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """``parts``: for each language its distinct keys and their values."""
        keys = np.concatenate([k for k, _ in parts])
        order = np.argsort(keys, kind="stable")  # languages stay in order within a key
        keys = keys[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        self.keys, self.offsets = keys[starts], np.append(starts, len(keys))
        self.who = np.repeat(np.arange(len(parts), dtype=np.uint16), [len(k) for k, _ in parts])[order]
        self.values = np.concatenate([v for _, v in parts]).astype(np.float32)[order]

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.offsets, self.who, self.values))

    def found(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of ``wanted``, languages and values, of all that is listed."""
        at, seen = _at(self.keys, wanted)
        rows = np.flatnonzero(seen)
        first = self.offsets[at[rows]]
        sizes = self.offsets[at[rows] + 1] - first
        ends = np.cumsum(sizes)
        flat = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)
        return np.repeat(rows, sizes), self.who[flat], self.values[flat]


@dataclass
class LanguageModels:
    """The models of all languages in shared sorted arrays.

    ``grams[n]`` lists the n-grams with the log probability that each language
    gives those it has seen; ``contexts[n]`` the log weights of backing off.
    ``limits`` are the calibrated cross-entropies.
    """

    languages: list[str]
    grams: dict[int, Listed] = field(default_factory=dict)
    contexts: dict[int, Listed] = field(default_factory=dict)
    unseen: float = 0.0
    limits: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def of_counts(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> LanguageModels:
        names = sorted(counts)
        if not names:
            return cls([])
        alphabet = len(np.unique(np.concatenate([_tail(k, 1) for k, _ in counts.values()]))) + 1
        out = cls(names, unseen=-float(np.log(alphabet)))
        grams, contexts = {n: [] for n in range(1, ORDER + 1)}, {n: [] for n in range(1, ORDER + 1)}
        for name in names:
            model = KneserNey(*counts[name], alphabet)
            for n in grams:
                own, _, ctx, weight = model.levels[n]
                grams[n].append((own, np.log(np.maximum(model.probability(n, own), 1e-12))))
                contexts[n].append((ctx, np.log(weight)))
        out.grams = {n: Listed(parts) for n, parts in grams.items()}
        out.contexts = {n: Listed(parts) for n, parts in contexts.items()}
        return out

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (*self.grams.values(), *self.contexts.values()))

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """Log P of n-grams in each language: that of the longest one it knows, after the weights of longer contexts; from short to long."""
        out = np.full((len(keys), len(self.languages)), self.unseen, np.float32)
        for n in range(1, ORDER + 1):
            own = _tail(keys, n)
            rows, who, weights = self.contexts[n].found(own >> np.uint64(16))
            out[rows, who] += weights
            rows, who, logs = self.grams[n].found(own)
            out[rows, who] = logs
        return out

    def entropies(self, units: Units, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nats per character (texts x languages), characters and letters of each text."""
        keys, of, letters = units(texts)
        n = np.bincount(of, minlength=len(texts))
        total = np.zeros((len(texts), max(1, len(self.languages))))
        if len(keys) and self.languages:
            some = np.flatnonzero(n)
            step = max(1 << 12, (1 << 20) // len(self.languages))  # positions at a time, so that memory is bounded for texts of any length
            for start in range(0, len(keys), step):
                part = of[start : start + step]
                heads = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                distinct, which = np.unique(keys[start : start + step], return_inverse=True)
                logs = self.log_probabilities(distinct)[which]
                total[part[heads]] -= np.add.reduceat(logs, heads, axis=0, dtype=np.float64)
            total[some] /= n[some, None]
        return total, n, letters

    def measured(self, texts: list[str], languages: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropies of texts by the model of their own language, as they are and with their characters shuffled; have they letters?"""
        units, at = Units(), np.array([self.languages.index(x) for x in languages], np.int64)
        own = np.arange(len(texts))
        plain, _, letters = self.entropies(units, texts)
        mixed, _, _ = self.entropies(units, [shuffled(t) for t in texts])
        return plain[own, at], mixed[own, at], letters > 0

    def calibrated(self, found: dict[str, tuple[np.ndarray, np.ndarray]], strictness: float) -> LanguageModels:
        """Sets the rejection limits from the cross-entropies of texts that were not fitted on, as they are and shuffled, by language.

        Shuffled texts have a language's letters but nothing else of it. The limit
        lies ``strictness`` of the way from the former's median cross-entropy (a
        language's own) to the latter's; texts of n characters get
        sqrt(1 + 20 / n) times that distance, as few characters prove little. A
        language without any measure gets the median of the others' limits, or, if
        there is none, a guess among all letters.
        """
        mean, width = np.full(len(self.languages), np.inf), np.zeros(len(self.languages))
        for i, name in enumerate(self.languages):
            plain, mixed = found.get(name, (np.zeros(0), np.zeros(0)))
            if len(plain):
                mean[i] = np.median(plain)
                width[i] = strictness * max(0.0, float(np.median(mixed) - mean[i]))
        known = np.isfinite(mean)
        width[~known] = np.median(width[known]) if known.any() else 0.0
        mean[~known] = np.median(mean[known]) if known.any() else -self.unseen
        self.limits = (mean, width)
        return self

    def labels(self, units: Units, texts: list[str | None]) -> dict[str, object]:
        h, n, letters = self.entropies(units, texts)
        if not self.languages:
            return {"lang_pred": ["und"] * len(texts), "score": np.zeros(len(texts)),
                    "cross_entropy": [None] * len(texts), "rejected": [True] * len(texts)}
        best = h.argmin(1)
        least = h[np.arange(len(texts)), best]
        odds = np.exp(-(h - least[:, None]) * np.minimum(n, CERTAIN)[:, None])
        known = letters > 0
        rejected = ~known
        if self.limits is not None:
            mean, width = self.limits
            rejected |= least > mean[best] + width[best] * np.sqrt(1 + 20 / np.maximum(n, 1))
        return {
            "lang_pred": [self.languages[b] if k else "und" for b, k in zip(best, known, strict=True)],
            "score": np.where(known, 1 / odds.sum(1), 0.0),
            "cross_entropy": [float(x) if k else None for x, k in zip(least, known, strict=True)],
            "rejected": rejected,
        }


def shuffled(text: str) -> str:
    """The characters of a text in an order that depends on it alone."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.random.default_rng(len(points)).permutation(points).tobytes().decode("utf-32-le", "surrogatepass")


def left_out(texts: list[str], alphabet: int) -> list[tuple[float, float]]:
    """Cross-entropies of texts of one language, each by a model of the others, as they are and shuffled; a single text is taken as two halves."""
    units = Units()
    if len(texts) == 1:
        half = len(texts[0]) // 2
        texts = [texts[0][:half], texts[0][half:]]
    texts = [t for t in texts if units([t])[2][0]]
    keys = [units([t])[0] for t in texts]
    out = []
    for i, t in enumerate(texts if len(texts) > 1 else []):
        model = KneserNey(*np.unique(np.concatenate(keys[:i] + keys[i + 1 :]), return_counts=True), alphabet)
        out.append(tuple(float(-np.log(np.maximum(model.probability(ORDER, k), 1e-12)).mean()) for k in (keys[i], units([shuffled(t)])[0])))
    return out


def labelled_sample(docs: DataFrame, lang: str, per_language: int, key: Column, languages: int, documents: int) -> DataFrame:
    """About ``per_language`` rows of each of the ``languages`` most frequent labels at most, or an equal share of ``documents`` rows, by a hash of ``key``: the bound of what is fitted on."""
    docs = docs.where(F.col(lang).isNotNull())
    counts = docs.groupBy(F.col(lang).alias("_lang")).count().orderBy(F.desc("count"), "_lang").limit(languages)
    each = F.least(F.lit(per_language), F.lit(documents) / F.count("*").over(Window.partitionBy()))  # one row a language
    share = counts.select("_lang", F.least(F.lit(1.0), each / F.col("count")).alias("_share"))
    drawn = docs.join(F.broadcast(share), F.col(lang) == F.col("_lang"))  # as many rows as languages
    return drawn.where(F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 20)) < F.col("_share") * (1 << 20)).drop("_lang", "_share")


def fit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    per_language: int = 300,
    held_back: int = 100,
    strictness: float = 0.5,
    key: str = "doc_id",
    languages: int = 500,
    documents: int = 20_000,
) -> LanguageModels:
    """Fit the models on about ``per_language`` documents of each language.

    ``held_back`` further documents of each calibrate the rejection; of labels
    only the ``languages`` most frequent are learned, and with many of them each
    has a like share of ``documents`` in all. These bound what is fitted on and
    with it the models' size. Texts stay in tasks: n-gram counts and two numbers a calibration text
    reach the driver. Of languages with few of these, up to ``LEFT_OUT`` fitted
    documents calibrate as well. A language whose only documents are held back
    has no model.
    """
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key"))  # no other column can clash with those added
    sample = labelled_sample(rows, "lang", per_language + held_back, F.col("key"), languages, documents).select(
        "lang", "text", (F.pmod(F.xxhash64(F.col("key"), F.lit(23)), F.lit(1000)) < 1000 * held_back // (per_language + held_back)).alias("back")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units()
        for batch in batches:
            for block in blocks(batch, "text"):
                keys, of, _ = units(block.column("text").to_pylist())
                own = np.array([x if x is not None else "" for x in block.column("lang").to_pylist()], object)
                for name in set(own):
                    k, c = np.unique(keys[(own == name)[of]], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))],
                        names=["lang", "gram", "n"],
                    )

    grams = (
        sample.where(~F.col("back")).select("lang", "text").mapInArrow(count, "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    found = grams.toArrow()  # bounded by the fitted sample
    names = found.column("lang").combine_chunks().dictionary_encode()
    of, keys, n = names.indices.to_numpy(), found.column("gram").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.lexsort((keys, of))
    edges = np.searchsorted(of[order], np.arange(len(names.dictionary) + 1))
    counts = {name: (keys[order[a:b]], n[order[a:b]]) for name, a, b in zip(names.dictionary.to_pylist(), edges[:-1], edges[1:], strict=True)}
    models = LanguageModels.of_counts(counts)
    if not models.languages:
        return models
    sent = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the fitted sample
    usable = sample.where(F.col("text").isNotNull() & F.col("lang").isin(models.languages))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                names = block.column("lang").to_pylist()
                plain, mixed, some = sent.value.measured(block.column("text").to_pylist(), names)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(plain), pa.array(mixed), pa.array(some)], names=["lang", "plain", "mixed", "some"])

    measures = usable.where("back").select("lang", "text").mapInArrow(measure, "lang string, plain double, mixed double, some boolean").where("some").toPandas()
    measures = measures.sort_values(["lang", "plain", "mixed"])
    few = [x for x in models.languages if (measures["lang"] == x).sum() < FEW]
    if few:
        alphabet = round(float(np.exp(-models.unseen)))

        def by_the_others(rows: pd.DataFrame) -> pd.DataFrame:
            found = np.array(left_out(rows.sort_values("text")["text"].tolist(), alphabet)).reshape(-1, 2)
            return pd.DataFrame({"lang": [rows["lang"].iloc[0]] * len(found), "plain": found[:, 0], "mixed": found[:, 1]})

        # At most LEFT_OUT texts a language.
        turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text"))
        own = usable.where(~F.col("back") & F.col("lang").isin(few)).select("lang", "text", turn.alias("turn")).where(F.col("turn") <= LEFT_OUT).drop("turn")
        more = own.groupBy("lang").applyInPandas(by_the_others, "lang string, plain double, mixed double").toPandas()
        measures = pd.concat([measures[["lang", "plain", "mixed"]], more])
    return models.calibrated({name: (x["plain"].to_numpy(), x["mixed"].to_numpy()) for name, x in measures.groupby("lang")}, strictness)


def identify(docs: DataFrame, models: LanguageModels, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score, cross_entropy and rejected. No shuffle; memory bounded by blocks of text."""
    sent = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the fitted sample

    def make():
        units, own = Units(), sent.value
        return lambda block: own.labels(units, block.column(text).to_pylist())

    return with_columns(docs, text, make, ADDED)

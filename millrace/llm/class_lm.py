"""Brown class-based bigram model: words in classes, found by exchange.

The probability of a word after another is that of its class after the other's
class, times that of the word within its class. Classes are found by the exchange
algorithm: a word moves to the class that raises the class bigram likelihood of
the training texts most. As in distributed word clustering, words look for their
best class in parallel against the counts at the beginning of a round, half of
them a round, and counts are taken anew after it; a round that does not raise the
likelihood is undone, and fewer words move in the next.

Counts are of all training texts: words in a table of any size, bigrams of the
most frequent words, 2**14 at most, that occur twice or more. So their ids can be sent
to every task, and a word's neighbours fit in a row, however large the corpus. All
rarer words form one class with those never seen, and the end of a text is a class
of its own.

Within the rare class a word has its share of the counts, and unseen words that of
words seen once (Good-Turing). Transitions are interpolated with the class's own
frequency (Witten-Bell). All probabilities over the known words, the end and one
unseen word sum to 1.

Scoring streams over whole texts; rare tokens are summed up per text and word and
joined with the table of counts. Defined cases: a text that is null or blank has
the end only; repeated rows are scored alike, each once; without training texts
everything is unseen and has probability 1; ties between classes go to the
present class, then to the smaller number. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, stored, words

#: The end of a text as a token: no word holds a blank.
END = " "
#: Words with an id at most. Words of like counts (within a twelfth of a doubling) have one all or none.
FREQUENT = 1 << 14
#: Bigrams that a task adds up before it hands them on.
HELD = 1 << 21
CLASSES, ROUNDS = 64, 12


@dataclass
class Model:
    """Everything that a task needs: bounded by FREQUENT words and the square of the classes.

    Ids are places in ``names``; id len(names) stands for rare and unseen words
    and the next one for the end.
    """

    names: dict[bytes, int]
    counts: np.ndarray  # of ids
    classes: np.ndarray  # of ids
    follow: np.ndarray  # log10 P(class | class before)
    within: np.ndarray  # log10 P(word | class) of ids; 0 for rare ones, whose counts are joined
    tokens: int
    known: int
    single: int  # tokens of words seen once
    rare: int  # tokens of rare words

    @property
    def size(self) -> int:
        return len(self.names)

    def ids(self, text: str | None) -> tuple[np.ndarray, list[bytes]]:
        """Ids of a text's tokens with the end, and its words."""
        found = words(text)
        rare = self.size
        out = np.fromiter(map(self.names.get, found, repeat(rare)), np.int32, len(found))
        return np.append(out, np.int32(rare + 1)), found


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """word, n: the tokens of all texts, ends included; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def made():
            return pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "surrogatepass") for w in held], pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for block in blocks(batch, text):
                for x in block.column(text).to_pylist():
                    held.update(words(x))
                    held[END.encode()] += 1
                if len(held) > HELD // 8:
                    yield made()
                    held.clear()
        yield made()

    return stored(docs.select(text).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")))


def _pairs(sent: Broadcast, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        base, end = model.size + 2, model.size + 1
        waiting, n_waiting = [], 0

        def made():
            keys, counts = np.unique(np.concatenate(waiting), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array((keys // base).astype(np.int32)), pa.array((keys % base).astype(np.int32)), pa.array(counts)], names=["a", "b", "n"])

        for batch in batches:
            for block in blocks(batch, text):
                for x in block.column(text).to_pylist():
                    ids = model.ids(x)[0].astype(np.int64)
                    waiting.append(np.r_[end, ids[:-1]] * base + ids)
                    n_waiting += len(ids)
                if n_waiting > HELD:
                    yield made()
                    waiting, n_waiting = [], 0
        if n_waiting:
            yield made()

    return run


def _table(neighbours: DataFrame, classes: np.ndarray, n: int) -> np.ndarray:
    """The counts of class bigrams: n * n numbers reach the driver."""
    sent = neighbours.sparkSession.sparkContext.broadcast(classes)  # at most FREQUENT + 2 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * n, np.int64)
        for batch in batches:
            after = batch.column("after")
            own = np.repeat(sent.value[batch.column("word").to_numpy()], pc.list_value_length(after).to_numpy()).astype(np.int64)
            flat = after.flatten()
            cells = own * n + sent.value[flat.field("w").to_numpy()]
            total += np.bincount(cells, flat.field("n").to_numpy(), n * n).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "n"])

    rows = neighbours.select("word", "after").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(n * n)
    out[[r.cell for r in rows]] = [r.n for r in rows]
    return out.reshape(n, n)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(table: np.ndarray) -> float:
    """The part of the log likelihood of a class bigram model that classes change."""
    return float(xlogx(table).sum() - xlogx(table.sum(0)).sum() - xlogx(table.sum(1)).sum())


def best_classes(table: np.ndarray, own: np.ndarray, after: np.ndarray, before: np.ndarray, itself: np.ndarray, free: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of some words the class among the first ``free`` that raises the likelihood most if it alone moves there, and by how much.

    ``after`` and ``before`` (words x classes) count the classes after and before
    a word, without itself; ``itself`` is how often it follows itself. Only cells
    of the class joined change, and only where the word has neighbours.
    """
    m, at = len(own), np.arange(len(own))
    gain = np.zeros((m, free))
    for counts, others, cells in ((after, before, table), (before, after, table.T)):
        w, c = np.nonzero(counts)
        if not len(w):
            continue
        k, mine = counts[w, c], c == own[w]
        old = cells[:free, c].T.copy()  # of every class joined; without the word itself:
        old[mine] -= others[w[mine], :free]
        old[np.arange(len(w)), own[w]] -= k + np.where(mine, itself[w], 0)
        starts = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        gain[w[starts]] += np.add.reduceat(xlogx(old + k[:, None]) - xlogx(old), starts, axis=0)
    # The joined class's cell with itself takes all parts at once.
    a, b, i = after[:, :free], before[:, :free], itself[:, None]
    loop = np.repeat(table.diagonal()[None, :free], m, axis=0)
    loop[at, own] -= after[at, own] + before[at, own] + itself
    gain += xlogx(loop + a + b + i) - xlogx(loop + a) - xlogx(loop + b) + xlogx(loop)
    for sums, counts in ((table.sum(1), after), (table.sum(0), before)):
        joined = counts.sum(1) + itself
        rest = np.repeat(sums[None, :free], m, axis=0)
        rest[at, own] -= joined
        gain -= xlogx(rest + joined[:, None]) - xlogx(rest)
    best = gain.argmax(1)
    rise = gain[at, best] - gain[at, own]
    stay = rise <= 1e-9
    return np.where(stay, own, best), np.where(stay, 0.0, rise)


def _class_counts(side: pa.ListArray, word: np.ndarray, classes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes beside each word (words x classes), without itself, and how often it stands beside itself."""
    of = np.repeat(np.arange(len(word)), pc.list_value_length(side).to_numpy())
    flat = side.flatten()
    w, k = flat.field("w").to_numpy(), flat.field("n").to_numpy()
    own = w == word[of]
    itself = np.bincount(of[own], k[own], len(word))
    return np.bincount(of[~own] * n + classes[w[~own]], k[~own], len(word) * n).reshape(len(word), n), itself


def _moves(neighbours: DataFrame, classes: np.ndarray, table: np.ndarray, free: int, turn: int, share: int) -> list:
    """Words, one in ``share`` by a hash, that would move, and where to: at most FREQUENT rows reach the driver."""
    sent = neighbours.sparkSession.sparkContext.broadcast((classes, table))  # at most FREQUENT numbers and the square of the classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, table = sent.value
        n = len(table)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                word = part.column("word").to_numpy()
                after, itself = _class_counts(part.column("after"), word, classes, n)
                before, _ = _class_counts(part.column("before"), word, classes, n)
                to, _ = best_classes(table, classes[word], after, before, itself, free)
                moved = to != classes[word]
                yield pa.RecordBatch.from_arrays([pa.array(word[moved]), pa.array(to[moved].astype(np.int32))], names=["word", "class"])

    movable = neighbours.where((F.col("word") < len(classes) - 2) & (F.pmod(F.xxhash64("word", F.lit(turn)), F.lit(share)) == 0))
    return movable.select("word", "after", "before").mapInArrow(run, "word int, class int").collect()


def exchanged(neighbours: DataFrame, classes: np.ndarray, free: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes after exchange, their bigram counts, and the likelihood after each round that was kept."""
    n = free + 2
    table = _table(neighbours, classes, n)
    course, share = [likelihood(table)], 2
    for turn in range(rounds):
        moves = _moves(neighbours, classes, table, free, turn, share)
        if not moves:  # nobody of these wants to; does anybody?
            if share == 1:
                break
            share = 1
            continue
        trial = classes.copy()
        trial[[m.word for m in moves]] = [m["class"] for m in moves]
        counts = _table(neighbours, trial, n)
        now = likelihood(counts)
        if now <= course[-1]:  # too many moved at once
            share *= 2
            continue
        classes, table = trial, counts
        course.append(now)
        if now - course[-2] < 1e-4 * abs(now):
            break
    return classes, table, course


def transitions(table: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """log10 P(class | class before), interpolated with the class's own frequency; ``alive`` says which classes have words."""
    own = (table.sum(0) + alive) / (table.sum() + alive.sum())
    kinds = np.maximum((table > 0).sum(1, keepdims=True), 1)
    return np.log10(np.maximum((table + kinds * own) / (table.sum(1, keepdims=True) + kinds), 1e-300))


def fit(docs: DataFrame, text: str = "text", classes: int = CLASSES, rounds: int = ROUNDS, frequent: int = FREQUENT) -> tuple[Model, DataFrame]:
    """The model of some texts and the table of their words' counts (word, n)."""
    spark = docs.sparkSession
    counts = word_counts(docs, text)
    total = counts.agg(F.sum("n").alias("tokens"), F.count("*").alias("known"), F.sum(F.when(F.col("n") == 1, 1)).alias("single")).first()
    tokens = total.tokens or 0
    size_class = F.floor(F.log2("n") * 12)
    several = counts.where((F.col("n") > 1) & (F.col("word") != END))
    least, room = 0, frequent
    for r in several.groupBy(size_class.alias("k")).agg(F.count("*").alias("m")).orderBy(F.desc("k")).collect():  # some hundred rows
        least, room = r.k, room - r.m
        if room < 0:
            least += 1
            break
    top = sorted((-r.n, r.word) for r in several.where(size_class >= least).collect())  # at most ``frequent`` rows
    names = {w.encode("utf-8", "surrogatepass"): i for i, (_, w) in enumerate(top)}
    size, free = len(names), classes
    n_end = (counts.where(F.col("word") == END).first() or {"n": 0})["n"] if tokens else 0
    seen = np.array([-n for n, _ in top], np.int64)
    rare = tokens - n_end - int(seen.sum())
    # Frequent words are dealt over the classes in order of their counts; then come the rare words' and the end's.
    start = np.append(np.arange(size) % free, [free, free + 1]).astype(np.int32)
    model = Model(names, np.append(seen, [rare, n_end]), start, np.zeros((free + 2, free + 2)), np.zeros(size + 2), tokens, total.known or 0, total.single or 0, rare)
    if not tokens:
        return model, counts
    sent = spark.sparkContext.broadcast(model)  # at most FREQUENT words
    pairs = docs.select(text).mapInArrow(_pairs(sent, text), "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    pairs = stored(pairs)
    side = lambda of, w, name: pairs.groupBy(F.col(of).alias("word")).agg(F.collect_list(F.struct(F.col(w).alias("w"), "n")).alias(name))  # noqa: E731  at most FREQUENT + 2 a row
    empty = F.array().cast("array<struct<w: int, n: bigint>>")
    both = side("a", "b", "after").join(side("b", "a", "before"), "word", "full").select("word", *[F.coalesce(c, empty).alias(c) for c in ("after", "before")])
    found, table, _ = exchanged(stored(both), start, free, rounds)
    mass = np.bincount(found, model.counts, free + 2)
    alive = mass > 0
    alive[free] = True  # there is always an unseen word
    model.classes, model.follow = found, transitions(table, alive)
    model.within = np.log10(np.maximum(model.counts, 1) / np.maximum(mass[found], 1))
    model.within[size] = 0.0
    return model, counts


def scored(docs: DataFrame, model: Model, counts: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, n_tokens, n_known, train_tokens, base_score and score of every row.

    base_score is the add-one unigram's. Both are log10 probabilities of the
    tokens of a text with its end.
    """
    spark = docs.sparkSession
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(text).alias("text"))
    sent = spark.sparkContext.broadcast(model)  # at most FREQUENT words and the square of the classes
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*names).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        end = model.size + 1
        unigram = np.log10((model.counts + 1) / (model.tokens + model.known + 1))
        unigram[model.size] = 0.0
        for batch in batches:
            for block in blocks(batch, "text"):
                sums, uids, rare, times = [], [], [], []
                for uid, x in zip(block.column("uid").to_pylist(), block.column("text").to_pylist(), strict=True):
                    ids, found = model.ids(x)
                    c = model.classes[ids]
                    seen = ids != model.size
                    follow = model.follow[np.r_[model.classes[end], c[:-1]], c].sum()
                    known = seen & (model.counts[ids] > 0)
                    sums.append((len(ids), int(known.sum()), float(unigram[ids].sum()), float(follow + model.within[ids].sum())))
                    tally = Counter(compress(found, (~seen).tolist()))
                    uids += [uid] * len(tally)
                    rare += tally
                    times += tally.values()
                n, m = block.num_rows, len(rare)
                none = lambda c: pa.nulls(m, block.column(c).type)
                columns = [pa.chunked_array([block.column("uid"), pa.array(uids, pa.int64())]).combine_chunks()]
                columns += [pa.chunked_array([block.column(c), none(c)]).combine_chunks() for c in names]
                for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64())):
                    columns.append(pa.array([s[i] for s in sums] + [None] * m, kind))
                columns += [pa.array([None] * n + rare, pa.binary()).cast(pa.string()), pa.array([None] * n + times, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["uid", *names, "n_tokens", "n_known", "base", "model", "word", "times"])

    made = stored(rows.mapInArrow(run, ", ".join(["uid bigint", *kept, "n_tokens bigint, n_known bigint, base double, model double, word string, times bigint"])))
    c = F.coalesce("n", F.lit(0)).cast("double")
    unseen = max(model.single, 1)
    base = F.log10((c + 1.0) / float(model.tokens + model.known + 1))
    own: Column = F.log10(F.when(c > 0, c).otherwise(float(unseen)) / float(model.rare + unseen))
    rare = made.where("word is not null").select("uid", "word", "times").join(counts, "word", "left")
    rare = rare.select("uid", F.when(F.col("n") > 0, F.col("times")).otherwise(0).alias("n_known"), (base * F.col("times")).alias("base"), (own * F.col("times")).alias("model"))
    whole = made.where("word is null").drop("word", "times")
    sums = whole.unionByName(rare, allowMissingColumns=True).groupBy("uid").agg(
        *[F.first(n, ignorenulls=True).alias(n) for n in names], F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("model").alias("score")
    )
    return sums.select(
        *[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "n_tokens", F.col("n_known").cast("bigint").alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score",
    )

"""Merkle manifest, class-based language model, importance resampling: brute force and corner cases."""

import math
import random
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import class_lm, merkle, resampling

ROWS = "doc_id bigint, source string, lang string, n_chars bigint, text string, uid string, tree string, key string, word string, n int, pos int, parent int, level int"
EXTRA = ("u", "t", "k", "w", 1, 2, 3, 4)  # columns named like the operators' own


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def levels(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def brute_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, h(*map(field, r[:5])), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (sorted(groups[g], key=lambda x: x[:3]), levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])])) for g in order}
    top = levels([trees[g][1][-1][0] for g in order])
    out = []
    for at, g in enumerate(order):
        members, own = trees[g]
        for pos, (_, _, leaf, r) in enumerate(members):
            folded, proof = leaf, []
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                folded = h(*map(field, (r[0], r[1], r[2], None if r[3] is None else r[3] + 1, r[4])))
            for tree, place in ((own, pos), (top, at)):
                for level in tree[:-1]:
                    i = place ^ 1
                    sibling = level[i] if i < len(level) else ""
                    folded = h(sibling, folded) if i < place else h(folded, sibling)
                    proof += [sibling] if sibling else []
                    place //= 2
            out.append((r[0], leaf, own[-1][0], top[-1][0], h(*proof), folded, folded == top[-1][0]))
    return sorted(map(repr, out))


def manifest(spark, rows):
    docs = spark.createDataFrame([(*r, *EXTRA) for r in rows], ROWS)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    found = merkle.proofs(docs, tampered=tampered, changed={"n_chars": F.col("n_chars") + 1})
    return sorted(repr(tuple(r)) for r in found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def test_manifest_of_several_steps(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(900), rng.choice("ab"), "en" if i % 3 else rng.choice([None, "de", "é", ""]), rng.choice([None, i]), rng.choice([None, "", "text ü" * (i % 4)])) for i in range(1100)]
    rows += [rows[5], rows[5], (None, None, None, None, None), (7, "s", "lonely", 3, "x" * 200_000)]
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    assert manifest(spark, rows) == brute_manifest(rows)
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before


@pytest.mark.parametrize("n", [0, 1, 2, 3, 257])
def test_manifest_of_one_group(spark, n):
    rows = [(i, "s", None, 1, f"t{i}") for i in range(n)]
    assert manifest(spark, rows) == brute_manifest(rows) and len(brute_manifest(rows)) == n


def test_manifest_of_many_groups_climbs_the_crown_in_steps(spark):
    rows = [(i, "s", f"l{i % 600:03}", 1, "t") for i in range(1300)]
    assert manifest(spark, rows) == brute_manifest(rows)


def test_climb_over_three_steps():
    """A tree of 70,000 leaves, step by step, folds to the root of the plain levels."""
    leaves = [f"{i:064x}" for i in range(70_000)]
    whole, hashes, n = levels(leaves)[-1][0], leaves, len(leaves)
    paths = {j: [] for j in (0, 255, 256, 65_535, 65_536, 69_999)}
    step = 0
    while n > 1:
        blocks = [merkle.climbed(hashes[i : i + 256], n) for i in range(0, n, 256)]
        for j, path in paths.items():
            path += blocks[j >> (8 * step + 8)][0][(j >> (8 * step)) % 256]
        hashes, n, step = [top for _, top in blocks], -(-n // 256), step + 1
    for j, path in paths.items():
        folded = leaves[j]
        for sibling, first in path:
            folded = h(sibling.hex(), folded) if first else h(folded, sibling.hex())
        assert folded == whole == hashes[0]


def lm_rows(seed, n):
    rng = random.Random(seed)
    nouns, verbs = [f"noun{i}" for i in range(30)], [f"Verb{i}" for i in range(30)]
    line = lambda: " ".join(x for _ in range(rng.randrange(1, 12)) for x in (rng.choice(nouns), rng.choice(verbs)))
    rows = [(i, line() + rng.choice(["", f" junk{rng.random()}", "\t\x0bÉ é\n"])) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (3, "noun1 verb1"), (3, "noun1 verb1"), (None, "noun2"), (n + 3, "noun1 verb2 " * 40_000)]


def tokens(text):
    return [*(text or "").encode().lower().split(), b" "]


def train(i):
    return i is None or zlib.crc32(str(i).encode()) % 7 != 2


@pytest.mark.parametrize("frequent", [1 << 18, 40])
def test_class_model_counts_and_scores(spark, frequent):
    """Counts and base scores against brute force; scores against a walk through the fitted model, rare words joined or not."""
    rows = lm_rows(4, 120)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, word string, uid int")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    docs = docs.withColumn("held_out", held)
    model, counts = class_lm.fit(docs.where("not held_out"), classes=6, rounds=6, frequent=frequent)
    assert model.size <= frequent
    c = Counter(w for i, t in rows if train(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    assert (model.tokens, model.known) == (n, v)
    single = sum(1 for x in c.values() if x == 1)
    rare = {w: k for w, k in c.items() if w != b" " and w not in model.names}
    want = []
    for i, t in rows:
        score, before = 0.0, model.classes[model.size + 1]
        for w in tokens(t):
            at = model.size + 1 if w == b" " else model.names.get(w, model.size)
            score += model.follow[before, model.classes[at]] + model.within[at]
            if at == model.size:
                score += math.log10((c[w] or max(1, single)) / (sum(rare.values()) + max(1, single)))
            before = model.classes[at]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))
        want.append((i, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(base, 4), round(float(score), 4)))
    got = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in class_lm.scored(docs, model, counts, ["doc_id"]).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_class_model_is_a_distribution(spark):
    docs = spark.createDataFrame(lm_rows(5, 60), "doc_id bigint, text string")
    model, counts = class_lm.fit(docs, classes=5, rounds=4, frequent=40)
    rare = {r.word: r.n for r in counts.collect() if r.word != " " and r.word.encode() not in model.names}
    unseen = max(1, model.single)
    inside = np.append(10.0 ** model.within, 0)[: model.size + 2]
    within_rare = [k / (model.rare + unseen) for k in [*rare.values(), unseen]]
    for before in range(len(model.follow)):
        known = sum(10 ** model.follow[before, model.classes[i]] * inside[i] for i in range(model.size + 2) if i != model.size)
        assert known + 10 ** model.follow[before, model.classes[model.size]] * sum(within_rare) == pytest.approx(1)


def test_exchange_finds_classes_and_beats_the_unigram(spark):
    rows = [r for r in lm_rows(6, 300) if r[1] and "junk" not in r[1] and "É" not in r[1] and len(r[1]) < 1000]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model, counts = class_lm.fit(docs.where("doc_id % 5 > 0"), classes=2, rounds=20)
    kinds = {k: {int(model.classes[i]) for w, i in model.names.items() if w.startswith(k)} for k in (b"noun", b"verb")}
    assert len(kinds[b"noun"]) == len(kinds[b"verb"]) == 1 and kinds[b"noun"] != kinds[b"verb"]
    sums = class_lm.scored(docs.where("doc_id % 5 = 0"), model, counts, ["doc_id"]).agg(F.sum("score"), F.sum("base_score")).first()
    assert sums[0] > sums[1] + 20


def test_gain_of_a_move_equals_the_likelihood_after_it():
    rng = np.random.default_rng(3)
    words, free = 20, 4
    n = free + 2
    bigrams = rng.integers(0, 5, (words + 2, words + 2))
    classes = np.append(rng.integers(0, free, words), [free, free + 1])

    def table(of):
        t = np.zeros((n, n))
        np.add.at(t, (of[:, None].repeat(len(of), 1), of[None].repeat(len(of), 0)), bigrams)
        return t

    now = class_lm.likelihood(table(classes))
    own = np.arange(words)
    side = lambda counts: np.stack([np.bincount(classes, np.where(np.arange(words + 2) == w, 0, counts[w]), n) for w in own])
    to, rise = class_lm.best_classes(table(classes), classes[own], side(bigrams), side(bigrams.T), bigrams[own, own].astype(float), free)
    for w in own:
        rises = []
        for c in range(free):
            trial = classes.copy()
            trial[w] = c
            rises.append(class_lm.likelihood(table(trial)) - now)
        assert rise[w] == pytest.approx(max(rises), abs=1e-6) and rises[to[w]] == pytest.approx(max(rises), abs=1e-6)


def test_class_model_without_training_texts(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    model, counts = class_lm.fit(docs.where("false"))
    got = {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in class_lm.scored(docs, model, counts, ["doc_id"]).collect()}
    assert got == {1: (3, 0, 0, 0.0, 0.0), 2: (1, 0, 0, 0.0, 0.0)}
    model, counts = class_lm.fit(docs)
    assert class_lm.scored(docs.where("false"), model, counts, ["doc_id"]).collect() == []


def brute_resampled(rows, target, percent=25):
    def words(t):
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or "")
        return "".join(x if x.isascii() and (x.isdigit() or "a" <= x <= "z") or not x.isascii() else " " for x in low).split(" ")

    def features(t):
        w = [x for x in words(t) if x]
        return [zlib.crc32(x.encode()) % 10000 for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]]

    s, t = Counter(x for r in rows for x in features(r[1])), Counter(x for r in target for x in features(r))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000))))
    out = []
    for i, text in rows:
        f = features(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        x = int(sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((x + 0.5) / 2**32)))])
    able = sorted((r for r in out if (r[1] + 1) // 2 >= 20), key=lambda r: (-r[3], r[0] is not None, r[0]))
    for k, r in enumerate(able[: len(able) * percent // 100], 1):
        r.append(k)
    return sorted(repr(tuple(r) if len(r) == 5 else (*r, None)) for r in out)


def test_resampling_equals_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["Apple", "pear", "é", "x1", "über", "naïve", "3", "日本", "zoo"]
    line = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(9)))
    lines = [line() for _ in range(20)] + ["", " ", "--", "a,b;c\x0bd", "end.", "same line here"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 12)))) for i in range(200)]
    rows += [(3, rows[3][1]), (3, rows[3][1]), (500, None), (501, ""), (502, "\n\n"), (503, "word"), (None, rows[4][1]), (504, "same line here\n" * 3000), (505, "very long " * 50_000)]
    target = ["Apple pear\nzoo", None, "", "same line here"]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id bigint, text string, uid int, line string, n int")
    aims = spark.createDataFrame([(x, 1) for x in target], "text string, key int")
    got = resampling.resampled(docs, aims).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_resampled(rows, target)


def test_resampling_of_empty_tables(spark):
    docs = spark.createDataFrame([(i, "one two three " * 9) for i in range(8)], "doc_id bigint, text string")
    none = docs.where("false")
    assert resampling.resampled(none, docs).collect() == []
    got = resampling.resampled(docs, none.select("text")).collect()
    assert len(got) == 8 and sorted(r.rank for r in got if r.rank) == [1, 2]


def test_distinct_lines_are_hashed_once(spark):
    docs = spark.createDataFrame([("a b\nc",), ("a b\nd",), ("a b",)], "text string")
    found = {(r.n, r.n_features) for r in resampling.distinct_lines(docs, "text").collect()}
    assert found == {(3, 3), (1, 1)} and resampling.distinct_lines(docs, "text").count() == 3

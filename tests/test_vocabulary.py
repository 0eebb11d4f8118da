"""Vocabularies that are tables: aliases by one automaton, tokens one edit away by shared deletions."""

import random
import re
import time

from pyspark.sql import functions as F

from millrace.operators import joins


def osa(a, b):
    """Optimal string alignment distance, by the book."""
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def edits(rng, s):
    i = rng.randrange(len(s) + 1)
    kind = rng.randrange(4)
    if kind == 0:
        return s[:i] + rng.choice("abß") + s[i:]
    if kind == 1:
        return s[:i] + s[i + 1 :]
    if kind == 2:
        return s[:i] + rng.choice("abß") + s[i + 1 :]
    return s[:i] + s[i + 1 : i + 2] + s[i : i + 1] + s[i + 2 :]


def test_one_edit_equals_all_pairs(spark):
    rng = random.Random(5)
    terms = ["", "a", "ab", "ba", "abc", "cab"] + ["".join(rng.choice("abcß") for _ in range(n)) for n in (5, 8, 30, 31, 32, 33, 34, 35, 60, 200) for _ in range(4)]
    tokens = list({edits(rng, rng.choice(terms)) for _ in range(300)} | {edits(rng, edits(rng, t)) for t in terms} | set(terms))
    left = spark.createDataFrame([(t,) for t in [*tokens, *tokens[:5], None]], "token string")
    right = spark.createDataFrame([(t,) for t in [*terms, terms[3], None]], "term string")
    got = joins.within_one_edit(left, "token", right, "term")
    assert {(r.token, r.term) for r in got.collect()} == {(a, b) for a in tokens for b in set(terms) if osa(a, b) <= 1}
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and got.count() == got.distinct().count()


def test_very_long_tokens_have_few_keys(spark):
    one = spark.createDataFrame([("x" * 60_000,)], "token string")
    other = spark.createDataFrame([("x" * 59_999,), ("y" * 59_999,)], "term string")
    assert [len(r.term) for r in joins.within_one_edit(one, "token", other, "term").collect()] == [59_999]


def test_aliases_equal_searching_for_each(spark, monkeypatch):
    rng = random.Random(6)
    alphabet = "ab 1-é&."
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    aliases = sorted({(rng.choice("xyz"), word(rng.randrange(1, 4))) for _ in range(60)} | {("x", "ab"), ("y", "ab"), ("z", "")})
    texts = [None, "", *(word(rng.randrange(1, 40)) for _ in range(200)), "ab " * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    names = spark.createDataFrame([*aliases, aliases[0]], "name string, alias string")
    want = {i: [(n, a) for n, a in aliases if a and t and re.search(f"(?<![a-z0-9]){re.escape(a)}(?![a-z0-9])", t)] for i, t in enumerate(texts)}
    for size in (200_000, 7):  # one automaton, and many
        monkeypatch.setattr(joins, "AUTOMATON", size)
        found = joins.alias_matches(df, names, {"found": "t"})
        assert found.columns == ["i", "found"]
        assert {r.i: [tuple(x) for x in r.found] for r in found.collect()} == want
    assert joins.alias_matches(df, names.where("false"), {"found": "t"}).select(F.max(F.size("found"))).first()[0] == 0


def test_the_cost_of_aliases_does_not_grow_with_their_number(spark):
    texts = spark.range(4000).select(F.repeat(F.concat(F.lit("some words and w"), F.col("id").cast("string"), F.lit(" ")), 40).alias("t")).cache()
    texts.count()
    took = {}
    for n in (20, 2000):
        names = spark.range(n).select(F.lit("n").alias("name"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("alias"))
        for _ in range(2):  # the first run starts workers
            start = time.perf_counter()
            hits = joins.alias_matches(texts, names, {"found": "t"}).select(F.sum(F.size("found"))).first()[0]
            took[n] = time.perf_counter() - start
        assert hits == n
    assert took[2000] < 4 * took[20] + 1  # a search for each would take a hundred times as long

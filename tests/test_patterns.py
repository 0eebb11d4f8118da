"""Row patterns against a backtracking search: leftmost, longest, not overlapping, in chunks."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import patterns
from millrace.operators.patterns import Step


def ends(rows, pattern, i):
    """All places behind a match that begins at i."""
    found, todo = set(), {(i, 0, 0)}
    seen = set()
    while todo:
        at, e, c = todo.pop()
        if (at, e, c) in seen:
            continue
        seen.add((at, e, c))
        if e == len(pattern):
            found.add(at)
            continue
        s = pattern[e]
        if c >= s.least:
            todo.add((at, e + 1, 0))
        if at < len(rows) and s.name in rows[at] and (s.most is None or c < s.most):
            todo.add((at + 1, e, c + 1))
    return {x for x in found if x > i}


def searched(rows, pattern):
    out, i = [], 0
    while i < len(rows):
        found = ends(rows, pattern, i)
        if found:
            out.append((i, max(found) - 1))
            i = max(found)
        else:
            i += 1
    return out


PATTERNS = {
    "plain": [Step("a"), Step("b")],
    "repeats": [Step("a", 2, None), Step("b", 1, 3), Step("c")],
    "optional": [Step("a", 0, 2), Step("b", 0, None), Step("c", 1, 2)],
    "overlapping": [Step("a", 1, None), Step("a", 1, 1), Step("b", 0, 1)],
    "tail": [Step("c"), Step("a", 0, None), Step("b", 0, 1)],
}


@pytest.mark.parametrize("name", list(PATTERNS))
def test_automaton_equals_a_search(name):
    rng = random.Random(name)
    for n in (0, 1, 2, 5, 9, 14) * 60:
        rows = ["".join(x for x in "abc" if rng.random() < 0.5) for _ in range(n)]
        automaton, state, got = patterns._Automaton(PATTERNS[name]), ((), ()), []
        for i, r in enumerate(rows):
            state, certain = automaton.read(state, (i, *(s.name in r for s in PATTERNS[name])))
            got += certain
        assert got + automaton.rest(state) == searched(rows, PATTERNS[name]), rows


def test_matches_in_chunks(spark):
    rng = random.Random(4)
    rows = [(g, i, "".join(x for x in "abc" if rng.random() < 0.4)) for g, n in (("hot", 1500), ("b", 40), (None, 30), ("c", 1)) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, at int, kinds string")
    conditions = {x: F.when(F.col("kinds") != "", F.contains("kinds", F.lit(x))) for x in "abc"}  # null where there are none
    for name in ("repeats", "optional", "tail"):
        got = {}
        for r in patterns.matches(df, ["g"], "at", conditions, PATTERNS[name]).collect():
            got.setdefault(r.g, []).append((r.first, r.last))
        want = {g: searched([k for x, _, k in sorted((r for r in rows if r[0] == g), key=lambda r: r[1])], PATTERNS[name]) for g in ("hot", "b", None, "c")}
        assert {g: sorted(m) for g, m in got.items()} == {g: m for g, m in want.items() if m}
    assert patterns.matches(df.where("false"), ["g"], "at", conditions, PATTERNS["plain"]).collect() == []
    with pytest.raises(ValueError):
        patterns.matches(df, ["g"], "at", conditions, [Step("a", 0, None)])

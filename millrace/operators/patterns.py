"""Patterns over ordered rows: a sequence of named conditions with repeats, matched by an automaton.

The automaton reads each group once, row by row and in chunks that are worked on
in parallel (``chunks.py``): between matches it forgets what came before, so
chunks agree soon. Of all threads in one state only the one that began first is
kept, since they have the same future, so the state has as many threads as the
pattern has counted steps.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.chunks import folded


@dataclass(frozen=True)
class Step:
    """Between ``least`` and ``most`` rows in a row (None: any number) for which the condition ``name`` holds."""

    name: str
    least: int = 1
    most: int | None = 1


class _Automaton:
    """States are (step, rows so far in it); a count that nothing depends on any more stays."""

    def __init__(self, steps: Sequence[Step]) -> None:
        self.steps = list(steps)
        if not self.steps or all(s.least == 0 for s in self.steps):
            raise ValueError("a pattern must need a row")

    def counted(self, e: int, c: int) -> int:
        s = self.steps[e]
        return min(c, max(s.least, 1)) if s.most is None else c

    def entered(self, after: int, holds: tuple) -> list[tuple[int, int]]:
        """States that a row can enter behind step ``after``, past steps that need no row."""
        out = []
        for e in range(after + 1, len(self.steps)):
            if holds[e] and self.steps[e].most != 0:
                out.append((e, self.counted(e, 1)))
            if self.steps[e].least > 0:
                break
        return out

    def next(self, state: tuple[int, int], holds: tuple) -> list[tuple[int, int]]:
        e, c = state
        s = self.steps[e]
        out = [(e, self.counted(e, c + 1))] if holds[e] and (s.most is None or c < s.most) else []
        return out + self.entered(e, holds) if c >= s.least else out

    def accepts(self, state: tuple[int, int]) -> bool:
        e, c = state
        return c >= self.steps[e].least and all(s.least == 0 for s in self.steps[e + 1 :])

    def read(self, state: Any, row: tuple) -> tuple[Any, list]:
        """The state after a row (threads, open matches) and the matches that are certain by it."""
        threads, matches = state
        position, holds = row[0], tuple(bool(x) for x in row[1:])
        moved: dict[tuple[int, int], Any] = {}
        for at, start in threads:
            for to in self.next(at, holds):
                if to not in moved or start < moved[to]:
                    moved[to] = start
        for to in self.entered(-1, holds):
            moved.setdefault(to, position)
        open_ = dict(matches)
        for at, start in moved.items():
            if self.accepts(at):
                open_[start] = position
        # What begins inside an open match can never stand: the match, or an earlier one that swallows it, does.
        for start, end in sorted(open_.items()):
            if start in open_:
                open_ = {s: e for s, e in open_.items() if not start < s <= end}
                moved = {at: s for at, s in moved.items() if not start < s <= end}
        first = min(moved.values(), default=None)
        certain = [(s, e) for s, e in sorted(open_.items()) if first is None or s < first]
        return (tuple(sorted(moved.items())), tuple(sorted((s, e) for s, e in open_.items() if first is not None and s >= first))), certain

    @staticmethod
    def rest(state: Any) -> list:
        """The matches that stand if no row follows: open ones never overlap."""
        return list(state[1])


def matches(frame: DataFrame, by: Sequence[str], position: str, conditions: dict[str, Column], pattern: Sequence[Step]) -> DataFrame:
    """``by``, first, last: where the pattern matches, as positions of its first and last row.

    Rows are read in the order of ``position``, which is unique within a group and not
    null. A match begins as early as it can and is as long as it can be from there;
    the next one begins behind it. A condition that is null does not hold.
    """
    automaton = _Automaton(pattern)
    kind = frame.schema[position].dataType.simpleString()
    names = [f"_c{i}" for i in range(len(automaton.steps))]
    rows = frame.select(*by, F.col(position).alias("_at"), *[F.coalesce(conditions[s.name], F.lit(False)).alias(n) for s, n in zip(automaton.steps, names, strict=True)])

    def step(state, row):
        state, certain = automaton.read(state, row)
        return state, ([{"first": a, "last": b} for a, b in certain], [{"first": a, "last": b} for a, b in automaton.rest(state)])

    pairs = f"array<struct<first: {kind}, last: {kind}>>"
    found = folded(rows, by, ["_at"], ["_at", *names], ((), ()), step, f"_certain {pairs}, _rest {pairs}")
    certain = found.select(*by, F.explode("_certain").alias("m"))
    last = found.groupBy(*by).agg(F.max_by("_rest", "_at").alias("_rest")).select(*by, F.explode("_rest").alias("m"))
    return certain.unionByName(last).select(*by, "m.first", "m.last")

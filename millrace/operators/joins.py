"""Joins by several keys, by nearness, by overlap, by adjacency.

Each is an equi-join at heart: combinations of legs, time bins or offsets are
made into keys first, so none plans a nested loop over two large sides.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import accumulate, combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text as X
from millrace.operators.scans import magnitude_bin


def k_of_n(left: DataFrame, right: DataFrame, legs: Sequence[str], k: int, left_key: str, right_key: str, by: Sequence[str] = ()) -> DataFrame:
    """Pairs that agree in at least ``k`` of the legs: left_key, right_key, ``by``, n_agree, agreeing.

    Every combination of k legs is a key of its own, so pairs meet in a hash
    join; a null leg agrees with nothing. Pairs that meet in several combinations
    are one.
    """
    sets = list(combinations(legs, k))

    def keyed(df: DataFrame, key: str, side: str) -> DataFrame:
        options = [
            F.when(F.greatest(*[F.col(x).isNull().cast("int") for x in s]) == 0 if len(s) > 1 else F.col(s[0]).isNotNull(), F.struct(F.lit(i).alias("combo"), F.array(*[F.col(x) for x in s]).alias("values")))
            for i, s in enumerate(sets)
        ]
        rows = df.select(*by, F.col(key).alias(side), *[F.col(x).alias(f"{side}_{x}") for x in legs], F.explode(F.filter(F.array(*options), lambda x: x.isNotNull())).alias("c"))
        return rows.select(*by, side, *[f"{side}_{x}" for x in legs], "c.combo", "c.values")

    met = keyed(left, left_key, "_l").join(keyed(right, right_key, "_r"), [*by, "combo", "values"])
    agree = [F.when(F.col(f"_l_{x}") == F.col(f"_r_{x}"), F.lit(x)) for x in legs]
    pairs = met.select(F.col("_l").alias(left_key), F.col("_r").alias(right_key), *by, F.array_compact(F.array(*agree)).alias("a")).distinct()
    return pairs.select(left_key, right_key, *by, F.size("a").alias("n_agree"), F.array_join("a", ",").alias("agreeing"))


def resolution(observed: DataFrame, frames: dict[str, DataFrame], legs: Sequence[str], k: int, key: str, bar_key: str) -> DataFrame:
    """A row per distinct observation: legs, n_rows, first_key, n_bars and resolution (unique, ambiguous or none)."""
    distinct = observed.groupBy(*legs).agg(F.count("*").alias("n_rows"), F.min(key).alias("first_key"))
    every = None
    for name, bars in frames.items():
        hits = k_of_n(distinct, bars, legs, k, "first_key", bar_key).select("first_key", F.lit(name).alias("tf"), F.col(bar_key).cast("string").alias("bar"))
        every = hits if every is None else every.unionByName(hits)
    n = every.groupBy("first_key").agg(F.count("*").alias("n_bars"))
    out = distinct.join(n, "first_key", "left").withColumn("n_bars", F.coalesce("n_bars", F.lit(0).cast("bigint")))
    return out.withColumn("resolution", F.when(F.col("n_bars") == 0, "none").when(F.col("n_bars") == 1, "unique").otherwise("ambiguous"))


def nearest(left: DataFrame, right: DataFrame, left_value: str, right_value: str, by: Sequence[str] = (), bin_width: float | None = None) -> DataFrame:
    """``left`` with nearest_below and nearest_above (values of ``right`` at or around its own) and distance.

    Both sides are put in one order and look to the last value before and the
    first after; no pair is made. Equal values count on both sides. The order is
    kept within bins of values (of ``bin_width``, or by magnitude), so neither a
    hot group nor the lack of groups puts all rows in one task: every bin gets the
    last value before it and the first after it, from one pass over the bins' own
    smallest and largest values.
    """
    slot = (lambda v: F.floor(F.col(v) / bin_width)) if bin_width else (lambda v: magnitude_bin(F.col(v), 256))
    marks = right.where(F.col(right_value).isNotNull()).select(*by, slot(right_value).alias("_bin"), F.col(right_value).alias("_v")).distinct()
    rows = left.select(*by, slot(left_value).alias("_bin"), F.col(left_value).alias("_v"), F.struct(*left.columns).alias("_row"))
    bins = marks.groupBy(*by, "_bin").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    empty = rows.where(F.col("_bin").isNotNull()).select(*by, "_bin").distinct()
    bins = bins.unionByName(empty, allowMissingColumns=True).groupBy(*by, "_bin").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    w = Window.partitionBy(*by).orderBy("_bin")
    before = F.last("_hi", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("_lo", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    borders = bins.select(*by, "_bin", F.array(before, after).alias("_b")).select(*by, "_bin", F.explode(F.array_compact("_b")).alias("_v"))
    marks = marks.unionByName(borders)
    both = rows.unionByName(marks.withColumn("_mark", F.col("_v")), allowMissingColumns=True)
    w = Window.partitionBy(*by, "_bin").orderBy(F.col("_v").asc_nulls_first())
    below = F.last("_mark", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    above = F.first("_mark", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    found = both.select("_row", "_v", below.alias("nearest_below"), above.alias("nearest_above")).where("_row is not null")
    near = F.least(F.col("_v") - F.col("nearest_below"), F.col("nearest_above") - F.col("_v"))
    fine = F.col("_v").isNotNull()
    return found.select("_row.*", F.when(fine, F.col("nearest_below")).alias("nearest_below"), F.when(fine, F.col("nearest_above")).alias("nearest_above"), F.when(fine, near).alias("distance"))


def overlapping(points: DataFrame, spans: DataFrame, by: Sequence[str], bin_width: float, start: str = "start", end: str = "end", lo: str = "lo", hi: str = "hi", closed: bool = False) -> DataFrame:
    """Segments (start, end) joined with spans (lo, hi) that they overlap.

    Open comparisons unless ``closed``: end > lo and start < hi. Both sides are
    dealt over bins of ``bin_width`` as join keys; a pair counts in the first bin
    that both cover, so it comes once.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_width), F.floor(F.greatest(F.col(a), F.col(b)) / bin_width)))
    left = points.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select("*", bins(start, end).alias("_bin"))
    right = spans.where(F.col(lo).isNotNull() & F.col(hi).isNotNull()).select("*", bins(lo, hi).alias("_bin"))
    first = F.col("_bin") == F.floor(F.greatest(F.col(start), F.col(lo)) / bin_width)
    meets = (F.col(end) >= F.col(lo)) & (F.col(start) <= F.col(hi)) if closed else (F.col(end) > F.col(lo)) & (F.col(start) < F.col(hi))
    return left.join(right, [*by, "_bin"]).where(first & meets).drop("_bin")


def text_in_order(rows: DataFrame, by: Sequence[str], order: Sequence[str], text: str, out: str = "text") -> DataFrame:
    """``by`` and the texts in order, joined by single spaces."""
    parts = F.array_sort(F.collect_list(F.struct(*order, text)))
    joined = F.array_join(F.transform(parts, lambda p: p[text]), " ")
    return rows.groupBy(*by).agg(F.trim(F.regexp_replace(joined, r"\s+", " ")).alias(out), F.count("*").alias("n_parts"))


def adjacent(frame: DataFrame, by: Sequence[str], position: str, columns: Sequence[str], tasks: int | None = None) -> DataFrame:
    """Pairs of rows whose positions differ by one; a gap makes no pair. tasks: how many join, else the session's number."""
    left = frame.select(*by, F.col(position).alias("a_pos"), *[F.col(c).alias(f"a_{c}") for c in columns])
    right = frame.select(*by, (F.col(position) - 1).alias("a_pos"), *[F.col(c).alias(f"b_{c}") for c in columns])
    if tasks:
        left, right = (side.repartition(tasks, *by, "a_pos") for side in (left, right))
    return left.join(right, [*by, "a_pos"])


def at_offsets(frame: DataFrame, by: Sequence[str], position: str, value: str, width: int) -> DataFrame:
    """Every row with the value at each offset from -width to width, where there is one."""
    wanted = frame.select(*by, position, F.explode(F.sequence(F.lit(-width), F.lit(width))).alias("offset"))
    there = frame.select(*by, F.col(position).alias("_at"), F.col(value).alias("found"))
    return wanted.withColumn("_at", F.col(position) + F.col("offset")).join(there, [*by, "_at"]).drop("_at")


def unique_labels(rows: DataFrame, by: Sequence[str], label: str, value: str) -> DataFrame:
    """Labels that occur once in their group and have a value."""
    found = rows.where(F.trim(label) != "").groupBy(*by, F.trim(label).alias(label)).agg(F.count("*").alias("_n"), F.max(value).alias(value))
    return found.where(F.col("_n") == 1).where(F.col(value).isNotNull()).drop("_n")


def nearest_leg(prices: DataFrame, bars: DataFrame, key: str, price: str, tick: float, by: Sequence[str] = (), bin_width: float | None = None) -> DataFrame:
    """Each price with the nearest leg of all bars: field, bar_ts, leg_price and delta (ticks, rounded to cents first).

    Ties go to the earlier bar, then open, high, low, close. Legs are reduced to
    one row per price before the search: distinct prices below and above stand
    for all others.
    """
    fields = ("open", "high", "low", "close")
    legs = bars.select(*by, "bar_ts", F.posexplode(F.array(*fields)).alias("ord", "leg_price"))
    first = legs.groupBy(*by, "leg_price").agg(F.min(F.struct("bar_ts", "ord")).alias("first"))
    around = nearest(prices.select(*by, key, price), first, price, "leg_price", by, bin_width)
    sides = around.select(*by, key, price, F.explode(F.array_distinct(F.array("nearest_below", "nearest_above"))).alias("leg_price")).where("leg_price is not null")
    met = sides.join(first, [*by, "leg_price"])
    delta = F.round(F.abs(F.col(price) - F.col("leg_price")) / tick, 2)
    best = met.select(*by, key, price, F.struct(delta.alias("delta"), F.col("first.bar_ts").alias("bar_ts"), F.col("first.ord").alias("ord"), "leg_price").alias("m"))
    out = best.groupBy(*by, key, price).agg(F.min("m").alias("m"))
    names = F.array(*[F.lit(f) for f in fields])
    return out.select(*by, key, price, F.get(names, F.col("m.ord")).alias("field"), F.col("m.bar_ts").alias("bar_ts"), F.col("m.leg_price").alias("leg_price"), F.col("m.delta").alias("delta"))


#: Aliases that one automaton holds; a larger vocabulary takes several, each in a pass of its own over the texts.
AUTOMATON = 200_000
_WORDLIKE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def alias_matches(frame: DataFrame, aliases: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds, for each column of lower-case text, which aliases stand in it untouched by letters or digits.

    aliases: name, alias (lower-case; empty ones never match). ``columns`` maps a
    new column to its text, which is dropped; it holds a name and alias for each
    match, each once, in the order of names and aliases, and is empty for null texts.
    All aliases are looked for in one pass of an automaton, so the cost does
    not grow with their number. The vocabulary is counted before it is sent.
    """
    known = aliases.select("name", "alias").where("alias <> ''").distinct()
    slices = -(-known.count() // AUTOMATON) or 1
    out = frame
    for k in range(slices):
        part = known if slices == 1 else known.where(F.pmod(F.xxhash64("name", "alias"), F.lit(slices)) == k)
        out = _matched(out, sorted((r.name, r.alias) for r in part.collect()), {f"_{name}{k}": text for name, text in columns.items()})
    joined = {name: F.array_sort(F.concat(*[F.col(f"_{name}{k}") for k in range(slices)])) for name in columns}
    return out.select(*[c for c in frame.columns if c not in columns.values()], *[c.alias(name) for name, c in joined.items()])


def _matched(frame: DataFrame, terms: list[tuple[str, str]], columns: dict[str, str]) -> DataFrame:
    new = T.StructType([T.StructField(name, T._parse_datatype_string("array<struct<name: string, alias: string>>")) for name in columns])
    sent = frame.sparkSession.sparkContext.broadcast(terms)  # AUTOMATON terms or so

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        numbers: dict[str, list[int]] = {}
        for i, (_, alias) in enumerate(sent.value):
            numbers.setdefault(alias, []).append(i)
        automaton = ahocorasick.Automaton()
        for alias, own in numbers.items():
            automaton.add_word(alias, (len(alias), own))
        automaton.make_automaton()
        made = [pa.array([t[j] for t in sent.value], pa.string()) for j in (0, 1)]

        def hits(text: str | None) -> list[int]:
            found: set[int] = set()
            for end, (n, own) in automaton.iter(text) if text and numbers else ():
                start, after = end - n + 1, end + 1
                if (not start or text[start - 1] not in _WORDLIKE) and (after == len(text) or text[after] not in _WORDLIKE):
                    found.update(own)
            return sorted(found)

        for batch in batches:
            arrays = []
            for text in columns.values():
                found = [hits(x) for x in batch.column(text).to_pylist()]
                flat = pa.array([i for own in found for i in own], pa.int32())
                offsets = pa.array([0, *accumulate(map(len, found))], pa.int32())
                arrays.append(pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([m.take(flat) for m in made], ["name", "alias"])))
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *columns])

    return frame.mapInArrow(run, T.StructType([*frame.schema.fields, *new.fields]))


#: Longer strings are keyed by their ends instead of their deletions.
SHORT, ENDS = 32, 12


def _edit_keys(x: Column) -> Column:
    """Keys of which two strings have one in common if one edit turns one into the other.

    Short strings: themselves and all strings with one character less (a
    substitution or a swap leaves one of these in common too). Longer ones: their first
    and last characters, of which an edit changes one only. Lengths at the border have both.
    """
    n = F.char_length(x)
    without = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("-"), F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, n)))
    short = F.when(n <= SHORT + 1, F.array_append(F.when(n > 0, F.array_distinct(without)).otherwise(F.array().cast("array<string>")), F.concat(F.lit("-"), x)))
    long_ = F.when(n >= SHORT, F.array(F.concat(F.lit("<"), F.substring(x, F.lit(1), F.lit(ENDS))), F.concat(F.lit(">"), F.substring(x, n - ENDS + 1, F.lit(ENDS)))))
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(short, none), F.coalesce(long_, none))


def within_one_edit(left: DataFrame, token: str, right: DataFrame, term: str) -> DataFrame:
    """Pairs of distinct ``token`` and ``term``: at most one insertion, deletion, substitution or swap of neighbours apart.

    An equi-join on deletion neighbourhoods finds the candidates, an exact check
    decides. Nulls match nothing.
    """
    sides = [f.select(F.col(c).alias(n)).where(F.col(n).isNotNull()).distinct().select(n, F.explode(F.array_distinct(_edit_keys(F.col(n)))).alias("_key")) for f, c, n in ((left, token, "_a"), (right, term, "_b"))]
    near = F.abs(F.char_length("_a") - F.char_length("_b")) <= 1
    met = sides[0].join(sides[1], "_key").where(near).select("_a", "_b").distinct()
    return met.where(X.within_one_edit("_a", "_b")).select(F.col("_a").alias(token), F.col("_b").alias(term))

"""MinHash near-duplicate detection with tensored banding.

A document's MinHash values form two collections of ``m`` small hashes (each of
``h`` values). The ``m * m`` table keys are the pairs of one hash from either
collection, so ``m * m`` tables of ``2 * h`` values cost ``2 * m * h`` values a
document, about the square root of what independent tables would. Two
documents of similarity s share a key with probability
``(1 - (1 - s**h)**m)**2``: 0.9998 at 0.8 for m = 9, h = 2.

Candidates are confirmed on full shingle sets. A bucket is not paired out:
every member meets the bucket's first member. Where confirmed links leave
members of a bucket in different components, an exact prefix-filtered join
(``open_pairs``) finds every pair across them that can still reach the
similarity. No key is capped, and equal sets are one class from the start,
however many copies they have. A bucket whose two small hashes are both shared
by more than ``HOT`` classes is split into ``PARTS`` parts by a hash of the
member: members meet the first of their part, and the parts' firsts meet the
bucket's first, so no task sorts such a bucket whole.

Defined cases: a null or blank text has an empty set and is linked with
nothing; with fewer words than the shingle width the whole sequence is one
shingle; rows with a null key have no component (null) and are kept; repeated
rows share their component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from millrace.operators.scans import numbered

from .common import blocks, by_keys, mixed, shingle_set, stored

GROUPS, PER_GROUP = 9, 2
#: Classes that share a small hash beyond which the buckets made of it are split, and into how many parts.
HOT, PARTS = 1 << 20, 64
#: Open members that share a shingle beyond which that shingle's part of the last join is split as well.
SHARED = 10_000


def sketches(docs: DataFrame, key: str, text: str, width: int, m: int, h: int, seed: int = 11) -> DataFrame:
    """id, n_shingles, k1, k2 (128 bits of the whole set) and the small hashes g0 .. g(2m-1)."""
    n_groups = 2 * m
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 1 << 63, n_groups * h, np.uint64) * np.uint64(2) + np.uint64(1)
    salts = rng.integers(0, 1 << 63, n_groups * h, np.uint64)
    names = ["n_shingles", "k1", "k2", *(f"g{i}" for i in range(n_groups))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                sets = [shingle_set(t, width) for t in block.column("text").to_pylist()]
                size = np.array([len(s) for s in sets], np.int64)
                out = np.zeros((len(sets), 2 + n_groups), np.int64)
                some = np.flatnonzero(size)
                if len(some):
                    marks = [xxh3_128_digest(sets[i].tobytes()) for i in some]
                    out[some, :2] = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2)
                    every = np.concatenate([sets[i] for i in some])
                    starts = np.cumsum(np.r_[0, size[some]])[:-1]
                    with np.errstate(over="ignore"):
                        for g in range(n_groups):
                            acc = np.full(len(some), np.uint64(g))
                            for j in range(g * h, (g + 1) * h):
                                acc = mixed(acc * np.uint64(31) + np.minimum.reduceat(every * factors[j] + salts[j], starts))
                            out[some, 2 + g] = acc.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [block.column("id"), pa.array(size), *(pa.array(np.ascontiguousarray(out[:, i])) for i in range(out.shape[1]))],
                    names=["id", *names],
                )

    source = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    return source.mapInArrow(run, "id bigint, " + ", ".join(f"{x} bigint" for x in names))


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """id and the full set of each text, as an array of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                sets = [shingle_set(t, width).view(np.int64) for t in block.column("text").to_pylist()]
                offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([block.column("id"), pa.ListArray.from_arrays(offsets, values)], names=["id", "shingles"])

    return docs.select("id", "text").mapInArrow(run, "id bigint, shingles array<bigint>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(left, "a").join(right, "b")
        .where(100 * common >= percent * (F.size("sa") + F.size("sb") - common))
        .select("a", "b")
    )


def components(links: DataFrame) -> DataFrame:
    """id, label: the smallest id reachable over undirected links (a, b).

    Labels go to neighbours and then jump along labels until nothing changes;
    each round is stored, so a lost executor costs one round at most.
    """
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct()
    edges = stored(both)
    labels = stored(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        up = labels.select(F.col("id").alias("to"), F.col("label").alias("up"))
        new = stored(step.join(up, "to").select("id", F.least("to", "up").alias("label"), "was"))
        labels = new.select("id", "label")
        if new.where("label <> was").isEmpty():
            return labels


def linked(reps: DataFrame, texts: DataFrame, width: int, percent: int, m: int) -> DataFrame:
    """id, label for every representative (id, n_shingles, g*) that is linked with another."""
    least = -(-percent // (100 - percent)) if percent < 100 else 1 << 62  # smaller sets link with equal ones only
    keys = [(F.xxhash64(F.lit(i * m + j), F.col(f"g{i}"), F.col(f"g{m + j}")), i, m + j) for i in range(m) for j in range(m)]
    able = reps.where(F.col("n_shingles") >= least)
    crowded = _crowded(able, m)
    if crowded is None:
        entries = able.select("id", F.col("n_shingles").cast("int").alias("n"), F.explode(F.array(*[k for k, _, _ in keys])).alias("key"))
        bucket, part = ["key"], F.lit(0).alias("part")
    else:
        able = able.join(crowded, "id", "left")
        own = F.pmod(F.xxhash64("id", F.lit(41)), F.lit(PARTS)).cast("int") + 1
        both = lambda i, j: F.coalesce(F.array_contains("hot", F.lit(i)) & F.array_contains("hot", F.lit(j)), F.lit(False))
        each = F.array(*[F.struct(k.alias("key"), F.when(both(i, j), own).otherwise(0).alias("part")) for k, i, j in keys])
        entries = able.select("id", F.col("n_shingles").cast("int").alias("n"), F.explode(each).alias("e")).select("id", "n", "e.key", "e.part")
        bucket, part = ["key", "part"], F.col("part")
    w = Window.partitionBy(*bucket).orderBy("id")
    members = stored(
        entries.select("key", part, "id", "n", F.first("id").over(w).alias("hub"), F.first("n").over(w).alias("hub_n"), F.lead("id").over(w).alias("next"))
        .where("id <> hub or next is not null or part > 0")
        .select("key", "part", "id", "n", "hub", "hub_n")
    )
    if crowded is not None:
        firsts = Window.partitionBy("key").orderBy("id")  # at most PARTS rows
        tops = members.where("part > 0 and id = hub").select("key", "part", "id", "n", F.first("id").over(firsts).alias("hub"), F.first("n").over(firsts).alias("hub_n"))
        members = stored(members.unionByName(tops.where("id <> hub")))

    def near_in_size(x: str, y: str):
        return 100 * F.least(x, y) >= percent * F.greatest(x, y)

    candidates = stored(members.select("id").distinct())
    sets = stored(shingle_sets(by_keys(texts, candidates, "id", "left_semi"), width))
    pairs = members.where("id <> hub").where(near_in_size("n", "hub_n")).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    labels = components(stored(confirmed(pairs, sets, percent)))
    more = confirmed(open_pairs(members, labels, sets, percent), sets, percent)
    of = labels.withColumnRenamed("label", "of")
    crossing = more.join(of.withColumnRenamed("id", "a").withColumnRenamed("of", "x"), "a", "left").join(of.withColumnRenamed("id", "b").withColumnRenamed("of", "y"), "b", "left")
    crossing = stored(crossing.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).distinct())
    if crossing.isEmpty():
        return labels
    # Components of components: only what the new links touch gets another label.
    joined = components(crossing).select(F.col("id").alias("was"), F.col("label").alias("now"))
    every = labels.unionByName(joined.select(F.col("was").alias("id"), F.col("was").alias("label")).join(labels, "id", "left_anti"))
    return stored(every.join(joined, every["label"] == joined["was"], "left").select("id", F.coalesce("now", "label").alias("label")))


def _crowded(reps: DataFrame, m: int) -> DataFrame | None:
    """id, hot: the numbers of those small hashes of each class that more than ``HOT`` classes share; None if there are none."""
    if reps.count() <= HOT:
        return None
    small = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"g{t}").alias("g")) for t in range(2 * m)])).alias("x")
    spread = reps.select("id", small).select("id", "x.t", "x.g")
    many = stored(spread.groupBy("t", "g").count().where(F.col("count") > HOT).select("t", "g"))
    if many.isEmpty():
        return None
    # At most 2 * m values for every HOT classes: some 2 MB for a billion classes.
    return spread.join(F.broadcast(many), ["t", "g"]).groupBy("id").agg(F.collect_set("t").alias("hot"))


def open_pairs(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs that may still be linked across the components that share a bucket.

    In a bucket whose members (its hub has met them all) lie in several
    components, those outside the largest one are minor. Every minor is joined
    with all members of such buckets on a shingle of both prefixes, under one
    order in which shingles that few minors have come first: sets that reach the
    similarity share one there, and the rest of both after it must be able to
    hold the overlap that is needed. So a member far from all others, whose first
    shingles are its own, makes no pair at all, however large its bucket.
    """
    rest = members.where("id <> hub or part > 0").select("key", "id").distinct().join(labels, "id", "left")  # in split buckets no member has met all
    rest = rest.select("key", "id", F.coalesce("label", "id").alias("label"))
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    per_key = rest.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    rest = rest.join(per_key, "key").join(sizes, "label", "left").withColumn("size", F.coalesce("size", F.lit(1)))
    rest = stored(rest)
    top = rest.groupBy("key").agg(F.max(F.struct("size", "label")).alias("top")).select("key", F.col("top.label").alias("top"))
    per_id = rest.join(top, "key").groupBy("id").agg(F.first("label").alias("label"), F.max(F.col("label") != F.col("top")).alias("minor"))
    own = stored(sets.join(per_id, "id").select("id", "label", "minor", "shingles"))
    spread = own.select("id", "label", "minor", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    common = spread.where("minor").groupBy("s").agg(F.count("*").alias("f"))
    ranked = spread.join(common, "s", "left").groupBy("id", "label", "minor", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "s"))).alias("all"))
    prefix = F.slice("all", F.lit(1), F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    heads = stored(ranked.select("id", "label", "minor", "n", F.posexplode(prefix).alias("at", "x")).where("x.f > 0").select("id", "label", "minor", "n", "at", F.col("x.s").alias("s"), F.col("x.f").alias("f")))
    # Of a shingle that many share, every part holds all minors and a share of the members.
    much, every = F.col("f") > SHARED, F.sequence(F.lit(1), F.lit(PARTS))
    left = heads.where("minor").select("s", F.explode(F.when(much, every).otherwise(F.array(F.lit(0)))).alias("part"), *[F.col(c).alias(f"a_{c}") for c in ("id", "label", "n", "at")])
    part = F.when(much, F.pmod(F.xxhash64("id", F.lit(43)), F.lit(PARTS)).cast("int") + 1).otherwise(0)
    right = heads.select("s", part.alias("part"), *[F.col(c).alias(f"b_{c}") for c in ("id", "label", "n", "at", "minor")])
    once = ~F.col("b_minor") | (F.col("a_id") < F.col("b_id"))
    # 100 * overlap >= percent * union  <=>  (100 + percent) * overlap >= percent * (sum of the sizes)
    room = (100 + percent) * (1 + F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at")) - 1)
    fits = (100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")) & (room >= percent * (F.col("a_n") + F.col("b_n")))
    met = left.join(right, (left["s"] == right["s"]) & (left["part"] == right["part"]) & (F.col("a_label") != F.col("b_label")) & once & fits)
    return met.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, m: int = GROUPS, h: int = PER_GROUP
) -> DataFrame:
    """key, n_shingles, component_id (smallest key reachable) and kept (key = component_id), a row per document."""
    every = stored(sketches(docs, key, text, width, m, h))
    names = [f"g{i}" for i in range(2 * m)]
    classes = every.where("n_shingles > 0 and id is not null").groupBy("k1", "k2").agg(
        F.min("id").alias("rep"), F.first("n_shingles").alias("n_shingles"), *(F.first(x).alias(x) for x in names)
    )
    classes = stored(classes)
    texts = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    labels = linked(classes.withColumnRenamed("rep", "id"), texts, width, percent, m)
    of_class = classes.select("k1", "k2", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    of_class = of_class.select("k1", "k2", F.coalesce("label", "rep").alias("of"))
    found = every.select("id", "n_shingles", "k1", "k2").join(of_class, ["k1", "k2"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("of")).otherwise(F.col("id"))
    own = F.when(F.col("id").isNull(), F.lit(None)).otherwise(own)
    return found.select(F.col("id").alias(key), "n_shingles", own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component.

    Rows with a null key stay. Where keys repeat, rows are told apart by key and
    text: of equal ones one stays, and different texts of one key are documents
    of their own. Empty and blank texts are linked with nothing and stay, but for
    repeated rows.
    """
    keys = docs.select(F.col(key).alias("k")).where("k is not null")
    if keys.groupBy("k").count().where("count > 1").isEmpty():
        found = near_duplicates(docs, key, text, **options)
        return by_keys(docs, stored(found.where("not kept").select(key).distinct()), key, "left_anti").select(docs.columns)
    names = [f"_c{i}" for i in range(len(docs.columns))]  # no column of docs can clash with those added
    k, t = (names[docs.columns.index(x)] for x in (key, text))
    plain = docs.toDF(*names)
    rows = plain.where(F.col(k).isNotNull()).withColumn("_sha", F.sha2(F.coalesce(t, F.lit("")), 256)).withColumn("_row", F.monotonically_increasing_id())
    rows = stored(numbered(stored(rows), [], [k, "_sha", "_row"]))
    found = stored(near_duplicates(rows, "_i", t, **options))
    first = rows.groupBy(k, "_sha").agg(F.min("_i").alias("_i"))
    stays = rows.join(found.where("kept").select("_i"), "_i", "left_semi").join(first.select("_i"), "_i", "left_semi")
    return stays.select(*names).unionByName(plain.where(F.col(k).isNull())).toDF(*docs.columns)

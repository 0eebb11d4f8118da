"""Exact top-k by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Vectors of equal length are dealt over shards of a bounded size; they are
shuffled once for a search and only queries travel to shards. A task reads one
shard at a time: its vectors first, which get a sorted list per dimension, then
the queries as a stream, so memory is bounded by a shard. A query reads the
lists from their good ends (the low end where its weight is negative) in growing
steps, scores what it has not met before, and stops once no unmet vector can
reach the k-th score: the bound is the score of a vector that has, in every
dimension, the value last read.

Shards are searched in rounds (as many as the cluster has cores, then seven times
as many, and so on by eights). After a round a query knows the k-th score so far; later shards stop at it and return
nothing below it, so a query's winners grow with the number of rounds and not
with that of shards.

Scores are exact integers: sums of products are formed in the narrowest of
float32 (below 2**24), float64 (below 2**53), 64-bit integers (below 2**63) and
Python's integers that certainly holds them.

Defined cases: vectors that are null, empty, or hold null or non-finite
components, and rows with a null key, take no part; a query meets the vectors of
its own length, with any key but its own; ties go to the smaller key; with fewer
than k such rows all are returned; repeated rows are repeated candidates. Rows of
one key that ask are queries of their own, each with its own ranks; equal ones
have equal results. A component of 2**63 or more once scaled, and a returned score
beyond a long, fail with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Components of a shard at most; and how many each must have before shards are made for the sake of parallelism.
MOST, LEAST = 1 << 22, 1 << 18
FOUND = "ask bigint, query_id bigint, vec_id bigint, score bigint"


def exact_type(vectors: np.ndarray, weights: np.ndarray) -> type:
    """The narrowest type whose integers hold every sum of products of a vector and a weight."""
    reach = [max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0 for x in (vectors, weights)]
    most = reach[0] * reach[1] * max(1, vectors.shape[1])
    for bits, kind in ((24, np.float32), (53, np.float64), (63, np.int64)):
        if most < 1 << bits:
            return kind
    return object


class SortedLists:
    """The vectors of one shard, and for each dimension their order."""

    def __init__(self, keys: np.ndarray, vectors: np.ndarray) -> None:
        self.keys, self.whole = keys, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").T.astype(np.int32)  # ascending, a row per dimension
        self.typed(np.int64)
        self.read = self.scored = 0  # list places read and vectors scored, over all queries

    def typed(self, kind: type) -> None:
        """Work in the type ``kind`` from now on."""
        if getattr(self, "kind", None) is not kind:
            self.kind, self.vectors = kind, self.whole.astype(kind)
            self.values = np.take_along_axis(self.vectors, self.order.T, axis=0).T.copy()

    def search(self, own: int, weights: np.ndarray, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Keys and scores of the k best (score, then smaller key) from ``floor`` on, without vectors of the key ``own``."""
        n = len(self.keys)
        from_top, from_end = np.flatnonzero(weights > 0), np.flatnonzero(weights < 0)
        met, scores, other = np.zeros(n, bool), np.zeros(n, self.kind), self.keys != own
        at, step = 0, max(k, n // 128)
        if not len(from_top) and not len(from_end):
            met[:] = True  # all scores are 0
        while not met.all():
            to = min(n, at + step)
            seen = met.copy()
            seen[self.order[from_top, n - to : n - at].ravel()] = True
            seen[self.order[from_end, at:to].ravel()] = True
            new = np.flatnonzero(seen != met)
            scores[new] = self.vectors[new] @ weights
            met, at, step = seen, to, step * 2
            bound = weights[from_top] @ self.values[from_top, n - at] + weights[from_end] @ self.values[from_end, at - 1]
            if floor is not None and floor > bound:
                break
            held = scores[met & other]
            if len(held) >= k and np.partition(held, -k)[-k] > bound:
                break
        self.read += at
        self.scored += int(met.sum())
        held = np.flatnonzero(met & other if floor is None else met & other & (scores >= floor))
        if len(held) > k:
            least = np.partition(scores[held], -k)[-k]
            held = held[scores[held] >= least]
        best = held[np.lexsort((self.keys[held], -scores[held]))[:k]] if self.kind is not object else np.array(sorted(held, key=lambda i: (-scores[i], self.keys[i]))[:k], np.int64)
        return self.keys[best], scores[best]


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """Slices of a batch with one shard and one kind (vectors or queries) each."""
    shard, asks = batch.column("shard").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
    edges = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (asks[1:] != asks[:-1]), True])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(shard[a]), bool(asks[a]), batch.slice(a, b - a)


def _search(k: int):
    """Winners of queries in partitions that hold, shard by shard, vectors and then queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys, parts, lists = None, [], [], None
        for batch in batches:
            for at, asks, part in _runs(batch):
                ids, rows = part.column("id").to_numpy(), part.column("v").flatten().to_numpy().reshape(part.num_rows, -1)
                if not asks:
                    if at != shard:
                        shard, keys, parts, lists = at, [], [], None
                    keys.append(ids.copy())
                    parts.append(rows.copy())
                    continue
                if at != shard:  # a shard that no vector fell into
                    continue
                if lists is None:
                    lists = SortedLists(np.concatenate(keys), np.concatenate(parts))
                    keys, parts = [], []
                kind = exact_type(lists.whole, rows)
                lists.typed(kind)
                found = [lists.search(own, w, k, floor) for own, w, floor in zip(ids, rows.astype(kind), part.column("floor").to_pylist(), strict=True)]
                scores = [int(s) if kind is object else s for _, own in found for s in own.tolist()]
                if kind is object and any(not -(1 << 63) <= s < 1 << 63 for s in scores):
                    raise OverflowError("an inner product is beyond a long")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(part.column("ask").to_numpy(), [len(x) for x, _ in found])),
                        pa.array(np.repeat(ids, [len(x) for x, _ in found])),
                        pa.array(np.concatenate([x for x, _ in found])),
                        pa.array(np.array(scores, np.int64)),
                    ],
                    names=["ask", "query_id", "vec_id", "score"],
                )

    return run


def quantised(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """id, v: floor(scale * component), of the rows that take part; fails where that is no long."""
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("x")).where("id is not null and x is not null")
    floor = lambda c: F.when(F.abs(c * scale) < float(1 << 63), F.floor(c * scale)).otherwise(F.raise_error(F.lit("a scaled component is beyond a long")).cast("bigint"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(fine & (F.size("x") > 0)).select("id", F.transform("x", floor).alias("v"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows of every query. ``is_query`` is a condition on ``id``."""
    spark = vectors.sparkSession
    rows = stored(quantised(vectors, key, vector, scale).withColumn("number", F.monotonically_increasing_id())).withColumn("dims", F.size("v"))
    # Shards of each length. D lengths take D * D / 2 components at least, so this table is small beside any vectors.
    spread = F.least(F.ceil(F.col("n") * F.col("dims") / LEAST), F.lit(spark.sparkContext.defaultParallelism))
    shards = F.greatest(F.ceil(F.col("n") * F.col("dims") / MOST), spread, F.lit(1)).cast("int")
    sizes = rows.groupBy("dims").agg(F.count("*").alias("n")).select("dims", shards.alias("shards"))
    most = sizes.agg(F.max("shards")).first()[0] or 0
    rows = rows.join(F.broadcast(sizes), "dims")
    # Rows, not keys, are dealt and ask: a key may hold many rows.
    dealt = rows.select("dims", F.pmod(F.xxhash64("id", "number"), "shards").cast("int").alias("turn"), "id", "v")
    asking = rows.where(is_query).select("dims", "shards", F.col("number").alias("ask"), "id", "v")
    best, low, high = None, 0, min(spark.sparkContext.defaultParallelism, most)
    while low < high or best is None:
        asks = asking
        if best is not None:
            floors = best.groupBy("ask").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") == k)
            asks = asking.join(floors.select("ask", "floor"), "ask", "left")
        else:
            asks = asks.withColumn("floor", F.lit(None).cast("bigint"))
        asks = asks.where(F.col("shards") > low).select(
            "dims", F.explode(F.sequence(F.lit(low), F.least(F.col("shards"), F.lit(high)) - 1)).alias("turn"), F.lit(True).alias("asks"), "ask", "id", "v", "floor"
        )
        here = dealt.where(F.col("turn").between(low, high - 1)).select("dims", "turn", F.lit(False).alias("asks"), F.lit(0).cast("bigint").alias("ask"), "id", "v", F.lit(None).cast("bigint").alias("floor"))
        shard = (F.col("dims").cast("bigint") * (1 << 31) + F.col("turn")).alias("shard")
        both = here.unionByName(asks).select(shard, "asks", "ask", "id", "v", "floor").repartition("shard").sortWithinPartitions("shard", "asks")
        found = both.mapInArrow(_search(k), FOUND)
        if best is not None:
            found = found.unionByName(best.select("ask", "query_id", "vec_id", "score"))
        order = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
        best = found.select("ask", "query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
        low, high = high, min(most, 8 * high)
        if low < high:
            best = stored(best)
    return best.drop("ask")

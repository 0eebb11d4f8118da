"""A Merkle manifest of a dataset, proven leaf by leaf with a recursive query.

Every row is a leaf; leaves of one group (a language) ascend by key and are hashed
in pairs, level by level, to the group's subroot; subroots ascend by group and
give the root alike. Digests are lower-case hex text.

Levels are built eight at a time: 256 neighbours of a level are one row of one
task, which hashes them up to their common ancestor. What is stored are the nodes
of every eighth level, each with the siblings on its way to its parent, the node
eight levels up (or the end of its tree): rows linked by parent. A recursive
query then climbs from every leaf at once: it joins the row that a leaf has
reached with its parent, appends the siblings to the proof and folds the hash
with them, so a leaf of a tree of n takes log256(n) joins and not log2(n).

Upper nodes have all leaves beneath them: a node is therefore stored once for
each block of 256 leaves below it (n / 256 rows a level in all), and the climb
joins by group and block, so that no row serves more than 256 leaves and no key of
the join is hot.

Defined cases: null fields are hashed as ``-``, null groups are a group of their
own, which comes first; a null key sorts first and is not tampered with; equal keys
are told apart by their leaf, and equal rows are leaves of their own; a group of
one leaf has it as its subroot, a single group's subroot is the root; an empty
table has no rows; texts of any length are hashed where they lie. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.scans import numbered

from .common import stored

#: Levels of a stored step, and the level at which the tree of subroots begins.
STEP, CROWN = 8, 1000
WIDE = 1 << STEP
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODES = "tree string, pos bigint, n bigint, n_leaves bigint, hash string, key bigint, changed string, siblings array<struct<hash: binary, first: boolean>>, top string"
_FOLD = "aggregate({0}.siblings, {1}, (acc, s) -> sha2(if(s.first, concat(lower(hex(s.hash)), acc), concat(acc, lower(hex(s.hash)))), 256))"
_GATHER = "aggregate({0}.siblings, {1}, (acc, s) -> concat(acc, s.hash))"


def leaf(fields: list[Column]) -> Column:
    """The digest of a row: each field as its number of bytes, a colon and its value, or a dash."""
    parts = [F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*parts), 256)


def climbed(hashes: list[str], n: int, levels: int = STEP) -> tuple[list[list[tuple[bytes, bool]]], str]:
    """The siblings of each of some neighbouring nodes on their way up, with whether they come first, and the node they end in.

    ``n`` is the number of nodes of the whole level. Where a node has no sibling,
    the empty string stands for it.
    """
    paths: list[list[tuple[bytes, bool]]] = [[] for _ in hashes]
    for k in range(levels):
        if n <= 1:
            break
        for j, path in enumerate(paths):
            i = (j >> k) ^ 1
            path.append((bytes.fromhex(hashes[i]) if i < len(hashes) else b"", i < j >> k))
        hashes = [sha256("".join(hashes[i : i + 2]).encode()).hexdigest() for i in range(0, len(hashes), 2)]
        n = (n + 1) // 2
    return paths, hashes[0]


def _step(rows: DataFrame) -> DataFrame:
    """One stored step of all trees: ``rows`` has tree, pos, n (nodes of the level), n_leaves, hash, key and changed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, members in zip(batch.column("tree").to_pylist(), batch.column("members").to_pylist(), strict=True):
                paths, top = climbed([m["hash"] for m in members], members[0]["n"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([tree] * len(members), pa.string()),
                        *(pa.array([m[c] for m in members], pa.int64()) for c in ("pos", "n", "n_leaves")),
                        pa.array([m["hash"] for m in members], pa.string()),
                        pa.array([m["key"] for m in members], pa.int64()),
                        pa.array([m["changed"] for m in members], pa.string()),
                        pa.array([[{"hash": h, "first": f} for h, f in p] for p in paths], pa.list_(pa.struct([("hash", pa.binary()), ("first", pa.bool_())]))),
                        pa.array([top, *[None] * (len(members) - 1)], pa.string()),
                    ],
                    names=["tree", "pos", "n", "n_leaves", "hash", "key", "changed", "siblings", "top"],
                )

    block = F.shiftright("pos", STEP).alias("block")
    # At most 256 members a row.
    grouped = rows.groupBy("tree", block).agg(F.array_sort(F.collect_list(F.struct("pos", "n", "n_leaves", "hash", "key", "changed"))).alias("members"))
    return stored(grouped.select("tree", "members").mapInArrow(run, _NODES))


def steps(rows: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The stored steps of all trees from their lowest level up, and each tree's end: tree, n_leaves, hash."""
    most = rows.agg(F.max("n")).first()[0] or 0
    found, ends = [], []
    while True:
        found.append(_step(rows))
        tops = found[-1].where("top is not null")
        most = -(-most // WIDE)
        up = tops.select(
            "tree", F.shiftright("pos", STEP).alias("pos"), F.expr(f"(n + {WIDE - 1}) div {WIDE}").alias("n"), "n_leaves", F.col("top").alias("hash"), F.lit(None).cast("bigint").alias("key"), F.lit(None).cast("string").alias("changed")
        )
        ends.append(up.where("n = 1").select("tree", "n_leaves", "hash"))
        if most <= 1:
            break
        rows = up.where("n > 1")
    out = ends[0]
    for more in ends[1:]:
        out = out.unionByName(more)
    return found, out


def _blocks(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(first, last)).alias("share")


def _parent(level: int, base: int, end: int | None) -> Column:
    return F.when(F.col("n") > WIDE, F.lit(base + level + STEP)).otherwise(F.lit(end)).cast("int").alias("parent")


def proofs(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, tampered: Column | None = None, changed: dict[str, Column] | None = None) -> DataFrame:
    """``key``, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    Rows that ``tampered`` holds for are folded with the leaf that they have where
    ``changed`` replaces some fields; all others with their own.
    """
    spark = docs.sparkSession
    own = leaf([F.col(f) for f in fields])
    false = leaf([(changed or {}).get(f, F.col(f)) for f in fields])
    tree = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))  # sorts as the group does, null first
    rows = docs.select(tree.alias("tree"), F.col(key).cast("bigint").alias("key"), own.alias("hash"), F.when(F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False), false).alias("changed"))
    leaves = numbered(rows, ["tree"], ["key", "hash"]).select("tree", F.col("_i").cast("bigint").alias("pos"), F.col("_n").cast("bigint").alias("n"), F.col("_n").cast("bigint").alias("n_leaves"), "hash", "key", "changed")
    own_steps, ends = steps(leaves)
    ends = stored(ends)
    crown = numbered(ends, [], ["tree"]).withColumnRenamed("tree", "group")
    crown = stored(crown.select("group", F.col("_i").cast("bigint").alias("pos"), F.col("_n").cast("bigint").alias("n"), "n_leaves", "hash"))
    top_steps, root = steps(crown.select(F.lit("").alias("tree"), "pos", "n", "n_leaves", "hash", F.lit(None).cast("bigint").alias("key"), F.lit(None).cast("string").alias("changed")))
    root = root.first()
    root = root.hash if root else None
    last_block = F.shiftright(F.col("n_leaves") - 1, STEP)
    none = F.lit(None).cast("string").alias("subroot")
    nodes = None
    for r, part in enumerate(own_steps[1:], 1):
        beneath = STEP * (r - 1)
        first = F.shiftleft("pos", beneath)
        part = part.select("tree", _blocks(first, F.least(F.shiftleft(F.col("pos") + 1, beneath) - 1, last_block)), F.lit(STEP * r).alias("level"), _parent(STEP * r, 0, CROWN), "siblings", none)
        nodes = part if nodes is None else nodes.unionByName(part)
    for r, part in enumerate(top_steps):
        up = part.select(F.col("pos").alias("_at"), "siblings", "n")
        whose = crown.select(F.col("group").alias("tree"), F.shiftright("pos", STEP * r).alias("_at"), "n_leaves", F.col("hash").alias("subroot"))
        part = whose.join(up, "_at").select("tree", _blocks(F.lit(0).cast("bigint"), last_block), F.lit(CROWN + STEP * r).alias("level"), _parent(STEP * r, CROWN, None), "siblings", "subroot" if not r else none)
        nodes = part if nodes is None else nodes.unionByName(part)
    start = own_steps[0].select("tree", F.shiftright("pos", STEP).alias("share"), "key", F.col("hash").alias("leaf"), F.coalesce("changed", "hash").alias("folded"), "siblings", _parent(0, 0, CROWN))
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # every leaf is a row of the recursion
    try:
        climb = stored(
            spark.sql(
                f"""
                WITH RECURSIVE climb AS (
                  SELECT tree, share, key, leaf, CAST(NULL AS STRING) AS subroot, {_FOLD.format("s", "folded")} AS folded, {_GATHER.format("s", "X''")} AS proof, parent FROM {{start}} s
                  UNION ALL
                  SELECT c.tree, c.share, c.key, c.leaf, coalesce(c.subroot, n.subroot), {_FOLD.format("n", "c.folded")}, {_GATHER.format("n", "c.proof")}, n.parent
                  FROM climb c JOIN {{nodes}} n ON n.tree = c.tree AND n.share = c.share AND n.level = c.parent)
                SELECT key, leaf, subroot, folded, sha2(lower(hex(proof)), 256) AS proof FROM climb WHERE parent IS NULL""",
                start=start,
                nodes=stored(nodes),
            )
        )
    finally:
        spark.conf.set(limit, before)
    return climb.select(F.col("key").alias(key), "leaf", "subroot", F.lit(root).cast("string").alias("root"), F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.lit(root)).alias("verified"))

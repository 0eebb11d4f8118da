"""Reply trees: root-to-leaf branches, ranked by score, formatted as conversations.

Pointer doubling by self-joins: a node that knows an ancestor learns that
ancestor's ancestor, so a tree of depth d needs about log2(d) joins, and nodes
that have reached their root leave the next one. Leaves are ranked by their
branch's mean score; only chosen leaves are expanded to paths, again by doubling,
so the rows made are the rows that are formatted.

The template marks each turn as ``<|role|>``, a line feed, the text, ``<|end|>``
and a line feed. Inside texts ``\\``, ``<`` and ``[`` are written ``\\\\``,
``\\l`` and ``\\b`` (in roles ``|`` also, as ``\\p``), so no control string of
this or another template survives in a text, and reading restores it exactly.

Defined cases: null role and text are empty; rows with a null conversation form
one of their own (key null); turns that tie stand by role and text, repeated rows
are repeated turns; a parent that does not exist makes its child a root; nodes on
a cycle have no root and are left out. One conversation becomes one value, so it
must fit in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

END = "<|end|>\n"


def escaped(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))
    return F.replace(out, F.lit("|"), F.lit("\\p")) if role else out


def restored(text: Column) -> Column:
    """Undoes ``escaped``: pairs of backslashes split the text, so the marks between them are unambiguous."""
    part = lambda x: F.replace(F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")), F.lit("\\p"), F.lit("|"))
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def _next_round(state: DataFrame) -> DataFrame:
    """Every unfinished node takes over what its pointer knows."""
    known = state.select("tree", F.col("node").alias("ptr"), F.col("ptr").alias("next"), F.col("root").alias("its"), F.col("total").alias("more"), F.col("depth").alias("on"))
    moved = state.where("root is null").join(known, ["tree", "ptr"])
    return moved.select("tree", "node", F.col("next").alias("ptr"), F.col("its").alias("root"), (F.col("total") + F.col("more")).alias("total"), (F.col("depth") + F.col("on")).alias("depth"))


def branches(nodes: DataFrame, top: int = 1) -> DataFrame:
    """tree, root, leaf, rank, place, node: the ``top`` branches of each root, a row per node, from the root (place 0) on.

    nodes: tree, node (unique in its tree), parent (null: root), score.
    """
    base = stored(nodes.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")))
    there = base.select("tree", F.col("node").alias("parent"), F.lit(True).alias("exists"))
    linked = stored(base.join(there, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("exists"), F.col("parent")).alias("up"), "score"))
    state = linked.select("tree", "node", F.col("up").alias("ptr"), F.when(F.col("up").isNull(), F.col("node")).alias("root"), F.col("score").alias("total"), F.lit(1).cast("bigint").alias("depth"))
    done, jumps = [state.where("root is not null")], [linked.where("up is not null").select("tree", "node", "up")]
    most = base.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    open_ = stored(state.where("root is null"))
    while not open_.isEmpty() and 1 << len(jumps) <= 2 * most:  # a longer walk can only be a cycle
        new = stored(_next_round(done[0].unionByName(open_) if len(done) == 1 else _all(done, open_)))
        done.append(new.where("root is not null"))
        open_ = new.where("root is null")
        last = jumps[-1]
        jumps.append(stored(last.join(last.select("tree", F.col("node").alias("up"), F.col("up").alias("far")), ["tree", "up"]).select("tree", "node", F.col("far").alias("up"))))
    rooted = _all(done[1:], done[0])
    parents = linked.where("up is not null").select("tree", F.col("up").alias("node")).distinct()
    leaves = rooted.join(parents, ["tree", "node"], "left_anti")
    best = Window.partitionBy("tree", "root").orderBy(F.desc(F.col("total") / F.col("depth")), "node")
    paths = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    paths = stored(paths.select("tree", "root", F.col("node").alias("leaf"), "rank", (F.col("depth") - 1).alias("place"), "node"))
    for j, jump in enumerate(jumps):
        up = paths.where(F.col("place") >= 1 << j).join(jump, ["tree", "node"])
        up = up.select("tree", "root", "leaf", "rank", (F.col("place") - (1 << j)).alias("place"), F.col("up").alias("node"))
        paths = paths.unionByName(up)
        if j % 3 == 2:
            paths = stored(paths)
    return paths


def _all(frames: list[DataFrame], first: DataFrame) -> DataFrame:
    for x in frames:
        first = first.unionByName(x)
    return first


def formatted(turns: DataFrame, by: list[str]) -> DataFrame:
    """``by``, formatted and spans (start and end of each text under the loss mask): one row per conversation.

    turns: ``by``, place, role, text. Assistant texts are under the mask.
    """
    head = F.concat(F.lit("<|"), escaped(F.col("role"), True), F.lit("|>\n"))
    rows = turns.select(*by, "place", "role", head.alias("head"), escaped(F.col("text")).alias("body"))
    rows = rows.withColumn("turn", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy(*by).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.char_length("turn")).over(before), F.lit(0)) + F.char_length("head"))
    span = F.when(F.col("role") == "assistant", F.struct(F.col("start"), (F.col("start") + F.char_length("body")).alias("end")))
    grouped = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("place", "turn", span.alias("span")))).alias("all"))
    return grouped.select(
        *by,
        F.array_join(F.transform("all", lambda x: x["turn"]), "").alias("formatted"),
        F.filter(F.transform("all", lambda x: x["span"]), lambda x: x.isNotNull()).alias("spans"),
    )


def read_back(conversations: DataFrame) -> DataFrame:
    """Adds turns (array of role and text) and learned (the texts under the mask, joined), from formatted and spans alone."""
    part = lambda x: F.substring_index(x, "|>\n", 1)
    turns = F.transform(
        F.filter(F.split("formatted", r"<\|end\|>\n", -1), lambda x: x != ""),
        lambda x: F.struct(
            restored(F.substr(part(x), F.lit(3))).alias("role"),
            restored(F.substr(x, F.char_length(part(x)) + 4)).alias("text"),
        ),
    )
    masked = F.transform("spans", lambda s: restored(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return conversations.withColumn("turns", turns).withColumn("learned", F.array_join(masked, ""))


def conversations_of(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", top: int = 1) -> DataFrame:
    """conv, branch rank, formatted, spans, turns and learned of a table whose turns answer one another in order."""
    clean = rows.select(F.col(conv).alias("tree"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    null_tree = F.col("tree").isNull()  # joins need a value: nulls become one tree beside all others
    clean = clean.select(F.struct(null_tree.alias("missing"), F.coalesce("tree", F.lit(0)).alias("id")).alias("tree"), "turn", "role", "text")
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    nodes = stored(clean.select("tree", F.row_number().over(order).cast("bigint").alias("node"), "role", "text"))
    tree = nodes.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.char_length("text").alias("score"))
    paths = branches(tree, top).join(nodes, ["tree", "node"])
    found = read_back(formatted(paths.select("tree", "root", "leaf", "rank", "place", "role", "text"), ["tree", "root", "leaf", "rank"]))
    key = F.when(~F.col("tree.missing"), F.col("tree.id"))
    return found.select(key.alias(conv), "rank", "formatted", "spans", "turns", "learned")

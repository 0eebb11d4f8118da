"""Folds over ordered groups, chunk by chunk in parallel.

A fold whose state depends on earlier decisions looks sequential, but most folds
forget: whichever state they enter a stretch with, they soon make the same
decisions. Rows are therefore cut into chunks of the order (group, order columns)
by sampled ranges, whatever the groups' sizes, and every chunk is folded from its
own start. Only a chunk's first group can have begun before it. Then

* the driver links chunks by what they hand on: the state after their last row,
  which is known where the last group began inside the chunk;
* a chunk that lies wholly inside a group is folded from likely states as well (what
  the chunk before hands on by its own start), beside its own run: where both agree,
  the rest is known. A state that is not known yet is tried in all later chunks of
  its group at once, so a state that stays the same for long takes one round; this is
  repeated until every chunk's state is known, so the result is exact also where
  runs never agree;
* in the end, the rows from a chunk's start to where its own run agrees with the
  true one are folded again.

The driver sees one summary a chunk: keys, a state and a count.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.scans import bins_of
from millrace.sources.scratch import stored

Step = Callable[[Any, tuple], tuple[Any, tuple]]


@dataclass
class Chunk:
    """What is known of a chunk from its own start."""

    number: int
    first: bytes  # keys of its first and last group
    last: bytes
    alone: bool  # there is one group only
    out: bytes  # state after the last row
    counted: int  # of the last group's rows, how many count


def _rows(batch: pa.RecordBatch, columns: list[str], place: bool) -> Iterator[tuple]:
    parts = [batch.column(c).to_pylist() for c in columns]
    if place:
        parts.append([c << 40 | r for c, r in zip(batch.column("_chunk").to_pylist(), batch.column("_row").to_pylist(), strict=True)])
    return zip(*parts, strict=True)


def _same(a: Any, b: Any) -> bool:
    return a == b or a is b


def linked(chunks: list[Chunk], known: dict[tuple[int, bytes], tuple[bytes, int]]) -> tuple[dict[int, tuple[bytes, int]], dict[int, list[bytes]]]:
    """The states that chunks which continue a group begin with, and how much was counted before them; and what must be tried where, if anything."""
    begin: dict[int, tuple[bytes, int]] = {}
    wanted: dict[int, list[bytes]] = {}
    out, total, lost, before = b"", 0, False, None
    for c in chunks:
        if before is None or before.last != c.first:  # a group begins with the chunk
            out, total, lost = c.out, c.counted, False
        elif not c.alone:
            if not lost:
                begin[c.number] = (out, total)
            out, total, lost = c.out, c.counted, False
        else:
            found = known.get((c.number, out))
            if found is None:  # tried here and in all later chunks that the group fills
                wanted.setdefault(c.number, []).append(out)
                lost = True
            elif not lost:
                begin[c.number] = (out, total)
                out, total = found[0], total + found[1]
        before = c
    return begin, wanted


def folded(frame: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], start: Any, step: Step, added: str, counted: tuple[str, str] | None = None, place: bool = False, chunks: int | None = None) -> DataFrame:
    """``frame`` with the columns of the DDL ``added``: ``step(state, row)`` gives the next state and the row's new values.

    ``row`` holds ``columns`` and, with ``place``, a number that is unique and rises
    in the order. ``state`` begins as ``start`` in every group; it must be a plain
    value that determines all later decisions. ``counted`` names a boolean among
    the added columns and a further column: how often it has been true in the
    group so far, less one. Rows that tie in ``order`` have one fixed order.
    An empty frame stays empty.
    """
    by, order, columns = list(by), list(order), list(columns)
    new = T._parse_datatype_string(added)
    names = [f.name for f in new]
    counts = names.index(counted[0]) if counted else None
    helpers = T._parse_datatype_string("_chunk int, _row bigint, _first boolean, _count bigint, _summary binary")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in [*frame.schema, *new, *helpers]])

    def own_start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fields = to_arrow_schema(schema)
        chunk, first_key, key, groups_met, state, n, at = TaskContext.get().partitionId(), None, None, 0, start, 0, 0
        for batch in batches:
            size = batch.num_rows
            groups = zip(*[batch.column(c).to_pylist() for c in by], strict=True) if by else iter([()] * size)
            whole = pa.RecordBatch.from_arrays([*batch.columns, pa.array([chunk] * size, pa.int32()), pa.array(range(at, at + size), pa.int64())], names=[*batch.schema.names, "_chunk", "_row"])
            out, first, count = [], [], []
            for group, row in zip(groups, _rows(whole, columns, place), strict=True):
                if group != key or not groups_met:
                    key, state, n = group, start, 0
                    groups_met += 1
                    first_key = key if groups_met == 1 else first_key
                state, values = step(state, row)
                n += bool(counts is not None and values[counts])
                out.append(values)
                first.append(groups_met == 1)
                count.append(n)
            made = list(zip(*out, strict=True)) if out else [[] for _ in names]
            arrays = [*whole.columns[: len(batch.columns)], *(pa.array(v, fields.field(x).type) for v, x in zip(made, names, strict=True)), *whole.columns[len(batch.columns) :]]
            arrays += [pa.array(first, pa.bool_()), pa.array(count, pa.int64()), pa.nulls(size, pa.binary())]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, fields, strict=True)], schema=fields)
            at += size
        if at:
            said = pickle.dumps((pickle.dumps(first_key), pickle.dumps(key), groups_met == 1, pickle.dumps(state), n))
            row = {"_chunk": chunk, "_row": at, "_summary": said}
            yield pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], f.type) for f in fields], schema=fields)

    n_chunks = chunks or bins_of(frame)
    told = frame.withColumn("_tie", F.monotonically_increasing_id())
    dealt = told.repartitionByRange(n_chunks, *by, *order, "_tie").sortWithinPartitions(*by, *order, "_tie").drop("_tie")
    done = stored(dealt.mapInArrow(own_start, schema))
    rows = done.where("_summary is null").drop("_summary")
    summaries = sorted((r._chunk, pickle.loads(r._summary)) for r in done.where("_summary is not null").select("_chunk", "_summary").collect())  # one a chunk
    found = [Chunk(number, *said) for number, said in summaries]
    own = {c.number: c for c in found}

    def tried(wanted: dict[int, list[bytes]]) -> list:
        """(chunk, state at its start, state at its end, counted) for the states wanted, in chunks that one group fills."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            results, chunk, runs, plain, n_plain = [], None, {}, start, 0

            def close():
                for begin, (state, n) in runs.items():
                    results.append((chunk, begin, pickle.dumps(state), n))

            for batch in batches:
                for number, row in zip(batch.column("_chunk").to_pylist(), _rows(batch, columns, place), strict=True):
                    if number != chunk:
                        close()
                        chunk, plain, n_plain = number, start, 0
                        runs = {s: (pickle.loads(s), 0) for s in wanted[chunk]}
                    if not runs:
                        continue
                    plain, values = step(plain, row)
                    n_plain += bool(counts is not None and values[counts])
                    for begin, (state, n) in list(runs.items()):
                        state, values = step(state, row)
                        n += bool(counts is not None and values[counts])
                        if _same(state, plain):  # from here on both runs are one
                            results.append((chunk, begin, own[chunk].out, n + own[chunk].counted - n_plain))
                            del runs[begin]
                        else:
                            runs[begin] = (state, n)
            close()
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in results], k) for i, k in enumerate(kinds)], names=["chunk", "begin", "out", "n"])

        part = rows.where(F.col("_chunk").isin(list(wanted))).select("_chunk", "_row", *dict.fromkeys(columns))
        part = part.repartition(n_chunks, "_chunk").sortWithinPartitions("_chunk", "_row")
        return part.mapInArrow(run, "chunk int, begin binary, out binary, n bigint").collect()

    known: dict[tuple[int, bytes], tuple[bytes, int]] = {}
    likely = {c.number: [b.out] for b, c in zip(found, found[1:], strict=False) if c.alone and b.last == c.first}
    while True:
        begin, wanted = linked(found, known)
        if not wanted:
            break
        for number, states in likely.items():
            wanted[number] = list(dict.fromkeys([*wanted.get(number, []), *states]))
        likely = {}
        for r in tried(wanted):
            known[r.chunk, bytes(r.begin)] = (bytes(r.out), r.n)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, state, plain, n, n_plain, agreed = None, None, start, 0, 0, False
        for batch in batches:
            made = [batch.column(x).to_pylist() for x in names]
            count = batch.column("_count").to_pylist()
            for i, (number, row) in enumerate(zip(batch.column("_chunk").to_pylist(), _rows(batch, columns, place), strict=True)):
                if number != chunk:
                    chunk, plain, n_plain, agreed = number, start, 0, False
                    state, n = pickle.loads(begin[chunk][0]), begin[chunk][1]
                if agreed:
                    count[i] += n - n_plain
                    continue
                plain, values = step(plain, row)
                n_plain += bool(counts is not None and values[counts])
                state, values = step(state, row)
                n += bool(counts is not None and values[counts])
                for column, v in zip(made, values, strict=True):
                    column[i] = v
                count[i] = n
                agreed = _same(state, plain)
            swapped = {**dict(zip(names, made, strict=True)), "_count": count}
            yield pa.RecordBatch.from_arrays([pa.array(swapped[f.name], f.type) if f.name in swapped else batch.column(f.name) for f in batch.schema], schema=batch.schema)

    out = rows
    if begin:
        later = F.col("_first") & F.col("_chunk").isin(list(begin))
        part = rows.where(later).repartition(n_chunks, "_chunk").sortWithinPartitions("_chunk", "_row")
        out = rows.where(~later).unionByName(part.mapInArrow(again, rows.schema))
    extra = [(F.col("_count") - 1).alias(counted[1])] if counted else []
    return out.select(*frame.columns, *extra, *names)

"""Work under watch: stages that fall silent, keys that keep failing, states of stages, as their marks arrive.

Keyed state and event-time timers (RocksDB keeps the state, so it outgrows
memory, and checkpoints of it are incremental). What is emitted depends on the
marks and on the watermark alone, not on how they were cut into batches.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_large_state(spark: SparkSession) -> SparkSession:
    """Keyed state of any kind needs the RocksDB store; set for the queries that start from now on.

    The workers that prepare such queries are not given the package's archive, so this module is sent by value.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set(PROVIDER, ROCKS)
    return spark


class _Silence(StatefulProcessor):
    """Emits a key's last mark once it has been silent for some time: by a timer, or by the mark that comes after the silence."""

    def __init__(self, silence_ms: int) -> None:
        self.silence = silence_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at bigint, told boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        at, told = self.seen.get() if self.seen.exists() else (None, False)
        before = at
        for now in sorted(r.at for r in rows):
            if at is not None and now <= at:
                continue
            if at is not None and now - at >= self.silence and not told:
                yield Row(key=key[0], last_seen=at)
            at, told = now, False
        if before != at:
            if before is not None:
                self.handle.deleteTimer(before + self.silence)
            self.handle.registerTimer(at + self.silence)
            self.seen.update((at, told))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at, told = self.seen.get()
        if not told and expiredTimerInfo.getExpiryTimeInMs() >= at + self.silence:
            self.seen.update((at, True))
            yield Row(key=key[0], last_seen=at)


class _Failures(StatefulProcessor):
    """Ends a key with its n-th failure in a row: emitted once, later marks are ignored.

    All that is known of a key is one value and one timer, since each call to the state costs more than a mark does.
    """

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def init(self, handle) -> None:
        self.handle = handle
        # n: failures in a row up to the settled marks; due: the timer; at, id, failed: marks that are not settled, as one before them may still come
        self.state = handle.getValueState("state", "n int, ended boolean, due bigint, at array<bigint>, id array<bigint>, failed array<boolean>")

    def _went_on(self, key, new, now: int, fired: bool) -> Iterator[Row]:
        n, ended, due, *open_ = self.state.get() or (0, False, None, [], [], [])
        if ended:
            return
        rest, next_, run = [], None, None
        for at, id_, failed in sorted([*zip(*open_), *new]):
            if at < now:  # settled
                n = n + 1 if failed else 0
                if n == self.limit:
                    ended = True
                    yield Row(key=key, ended_at=at, by_id=id_)
                    break
            else:
                rest.append((at, id_, failed))
                run = (n if run is None else run) + 1 if failed else 0
                if run == self.limit and next_ is None:
                    next_ = at + 1  # as soon as the watermark has passed what ends the key as far as is known
        if ended or not rest:
            rest, next_ = [], None
        elif next_ is None:
            next_ = rest[-1][0] + 1  # else the marks would stay
        if next_ != due:
            if due is not None and not fired:
                self.handle.deleteTimer(due)
            if next_ is not None:
                self.handle.registerTimer(next_)
        self.state.update((n, ended, next_, *(map(list, zip(*rest)) if rest else ([], [], []))))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        yield from self._went_on(key[0], [(r.at, r.id, r.failed) for r in rows], timerValues.getCurrentWatermarkInMs(), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._went_on(key[0], [], timerValues.getCurrentWatermarkInMs(), True)


class _Stages(StatefulProcessor):
    """The state of each stage of a key: its last mark, its failures; a running stage falls back to pending when it has been silent too long.

    All that is known of a key is one value and one timer, for the running stage that is lost first.
    """

    def __init__(self, stages: Sequence[str], silence_ms: int, limit: int) -> None:
        self.stages, self.silence, self.limit = list(stages), silence_ms, limit

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "version bigint, due bigint, stage array<string>, at array<bigint>, status array<string>, failed array<int>")

    def _went_on(self, key, rows, now: int, fired: bool) -> Iterator[Row]:
        number, due, *known = self.state.get() or (0, None, [], [], [], [])
        marks = {stage: mark for stage, *mark in zip(*known)}
        for r in rows:
            at, last, failed = marks.get(r.stage, (None, None, 0))
            if at is None or (r.at, r.status) > (at, last):
                at, last = r.at, r.status
            marks[r.stage] = (at, last, failed + (r.status == "failed"))
        next_ = min((at + self.silence for at, last, _ in marks.values() if last == "running" and at + self.silence > now), default=None)
        if next_ != due:
            if due is not None and not fired:
                self.handle.deleteTimer(due)
            if next_ is not None:
                self.handle.registerTimer(next_)
        self.state.update((number + 1, next_, list(marks), *map(list, zip(*marks.values()))))
        ready = True
        for stage in self.stages:
            at, last, failed = marks.get(stage, (None, None, 0))
            lost = last is None or last == "running" and at + self.silence <= now or last == "failed" and failed < self.limit
            own = "pending" if lost else last
            yield Row(key=key, version=number + 1, stage=stage, status=own if ready else "pending", attempts=failed, next=ready and own == "pending")
            ready = ready and own == "done"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        yield from self._went_on(key[0], rows, timerValues.getCurrentWatermarkInMs(), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._went_on(key[0], [], max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()), True)


def _watched(marks: DataFrame, key: str, ts: str, late: str, columns: Sequence[Column], processor: StatefulProcessor, added: str) -> DataFrame:
    with_large_state(marks.sparkSession)
    rows = marks.withWatermark(ts, late).select(F.col(key).alias("key"), ts, F.unix_millis(ts).alias("at"), *columns)
    kind = marks.schema[key].dataType.simpleString()
    found = rows.groupBy("key").transformWithState(processor, f"key {kind}, {added}", "Append", "EventTime")
    return found.withColumnRenamed("key", key)


def _ms(frame: DataFrame, interval: str) -> int:
    return frame.sparkSession.sql(f"SELECT unix_millis(timestamp_seconds(0) + interval {interval}) AS ms").first().ms


def silent(marks: DataFrame, key: str, silence: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """``key``, last_seen: every silence of at least ``silence``, told once: as soon as the watermark shows it or the next mark does.

    Marks older than a key's last one change nothing.
    """
    found = _watched(marks, key, ts, late, [], _Silence(_ms(marks, silence)), "last_seen bigint")
    return found.withColumn("last_seen", F.timestamp_millis("last_seen"))


def ended(marks: DataFrame, key: str, failed: Column, number: str, limit: int = 10, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """``key``, ended_at, by_id: keys that failed ``limit`` times in a row, with the mark that ended them.

    Marks of a key count in the order of (``ts``, ``number``); they wait in state until
    the watermark has passed them, so the order of arrival does not matter.
    """
    columns = [F.col(number).cast("bigint").alias("id"), failed.alias("failed")]
    found = _watched(marks, key, ts, late, columns, _Failures(limit), "ended_at bigint, by_id bigint")
    return found.withColumn("ended_at", F.timestamp_millis("ended_at"))


def stages(marks: DataFrame, key: str, order: Sequence[str], silence: str, limit: int = 3, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """``key``, version, stage, status, attempts, next: all stages of a key whenever a mark or a silence changes them; the last version counts.

    marks: ``key``, stage, ``ts``, status (running, done or failed). The rules are those
    of ``incremental.stage_states`` with the watermark as the present time.
    """
    columns = [F.col("stage"), F.col("status")]
    return _watched(marks.where(F.col("stage").isin(list(order))), key, ts, late, columns, _Stages(order, _ms(marks, silence), limit), "version bigint, stage string, status string, attempts bigint, next boolean")


def latest(versions: DataFrame, key: str) -> DataFrame:
    """The last version of each key's stages, of all that has been emitted."""
    last = F.max_by(F.struct("status", "attempts", "next"), "version").alias("_s")
    return versions.groupBy(key, "stage").agg(last).select(key, "stage", "_s.*")

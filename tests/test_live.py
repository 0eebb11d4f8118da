"""Live feeds in several batches, with a restart between them: sessions, joins, timers, late rows, bounded state."""

import datetime as dt
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from millrace import schemas
from millrace.streaming import bars as live
from millrace.streaming import sessions, watch

START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


@pytest.fixture
def feed(spark, tmp_path):
    """put(rows) adds a file of (id, minutes, user, type); run(make) works off what is there, going on from the run before."""
    n = []

    def put(rows):
        n.append(0)
        folder = tmp_path / f"part{len(n):03}"
        spark.createDataFrame([(i, at(m), u, kind, 1.0, "") for i, m, u, kind in rows], schemas.EVENTS).coalesce(1).write.parquet(str(folder))
        (tmp_path / "in").mkdir(exist_ok=True)
        for f in folder.glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{len(n):03}.parquet")

    def run(make, name):
        made = make(live.event_stream(spark, str(tmp_path / "in"), 1))
        query = live.run_to_files(made, str(tmp_path / name / "out"), str(tmp_path / name / "checkpoint"))
        query.awaitTermination()
        return query, spark.read.schema(made.schema).parquet(str(tmp_path / name / "out")).collect()

    return put, run


def batches(seed, n=400, files=4, users=5):
    rng = random.Random(seed)
    rows = [(i, sum(rng.choice([1, 2, 40, 100]) for _ in range(1)) + i * 7, rng.randrange(users), rng.choice(["view", "error", "purchase"])) for i in range(n)]
    rows.sort(key=lambda r: r[1])
    return [rows[k * n // files : (k + 1) * n // files] for k in range(files)]


def brute_sessions(rows, gap):
    out, open_ = [], {}
    for _, m, u, _ in sorted(rows, key=lambda r: r[1]):
        if u in open_ and m - open_[u][1] <= gap:
            open_[u][1:] = [m, open_[u][2] + 1]
        else:
            out += [(u, *open_[u])] if u in open_ else []
            open_[u] = [m, m, 1]
    return out, [(u, *s) for u, s in open_.items()]


def test_sessions_with_a_restart_and_late_rows(feed):
    put, run = feed
    parts = batches(1)
    make = lambda e: sessions.sessions(e, ["user_id"], "90 minutes", {"n": F.count("*")})
    for rows in parts[:2]:
        put(rows)
    first, _ = run(make, "s")
    for rows in parts[2:]:
        put(rows)
    second, got = run(make, "s")
    rows = [r for p in parts for r in p]
    end = max(r[1] for r in rows) + 10_000
    put([(9000, end, 99, "view")])  # closes all that is open
    put([(9001, 5, 0, "view"), (9002, end + 1, 99, "view")])  # the first of these is late
    third, got = run(make, "s")
    closed, still = brute_sessions(rows, 90)
    want = sorted((u, at(a), at(b), n) for u, a, b, n in closed + still)
    assert sorted((r.user_id, r.session_start, r.last_seen, r.n) for r in got) == want
    assert sessions.dropped(first) == sessions.dropped(second) == 0 and sessions.dropped(third) == 1
    assert max(sessions.state_rows(second)) > 1 and sessions.state_rows(third)[-1] == 1  # the open session of the last user


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_of_two_feeds_with_a_restart(feed, how):
    put, run = feed
    parts = batches(2)

    def make(e):
        bought = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), "ts")
        viewed = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view"), F.col("ts").alias("seen"))
        return sessions.joined(bought, viewed, ["user_id"], "ts", "seen", "45 minutes", how)

    for rows in parts[:2]:
        put(rows)
    run(make, "j")
    for rows in parts[2:]:
        put(rows)
    rows = [r for p in parts for r in p]
    end = max(r[1] for r in rows) + 10_000
    put([(9000, end, 99, "view"), (9001, end, 98, "purchase")])
    query, got = run(make, "j")
    want = []
    for i, m, u, kind in rows:
        near = [j for j, k, v, other in rows if kind == "purchase" and other == "view" and v == u and m - 45 <= k <= m]
        want += [(u, i, j) for j in near] or ([(u, i, None)] if how == "left" and kind == "purchase" else [])
    assert sorted(map(repr, ((r.user_id, r.purchase, r.view) for r in got))) == sorted(map(repr, want))
    states = sessions.state_rows(query)
    assert states[-1] <= 4 < max(states)  # what can find no partner any more is gone


def test_silences_and_failures_do_not_depend_on_batches(feed):
    put, run = feed
    parts = batches(3)
    rows = sorted((r for p in parts for r in p), key=lambda r: (r[1], r[0]))
    end = rows[-1][1] + 10_000
    failed = F.col("event_type").isin("error", "view")
    for rows_ in parts[:2]:
        random.Random(1).shuffle(rows_)
        put(rows_)
    quiet, end_ = lambda e: watch.silent(e, "user_id", "100 minutes"), lambda e: watch.ended(e, "user_id", failed, "event_id", 5)
    run(quiet, "q"), run(end_, "f")
    for rows_ in [*parts[2:], [(9000, end, 99, "view")]]:
        put(rows_)
    (_, silences), (_, ends) = run(quiet, "q"), run(end_, "f")
    want, last, n, over = [], {}, {}, {}
    for i, m, u, kind in rows:
        if u in last and m - last[u] >= 100:
            want.append((u, at(last[u])))
        last[u] = m
        n[u] = n.get(u, 0) + 1 if kind != "purchase" else 0
        if n[u] == 5:
            over.setdefault(u, (at(m), i))
    want += [(u, at(m)) for u, m in last.items()]
    assert sorted((r.user_id, r.last_seen) for r in silences) == sorted(want)
    assert {r.user_id: (r.ended_at, r.by_id) for r in ends} == over and len(ends) == len(over)


def test_a_failure_counts_as_soon_as_the_watermark_has_passed_it(feed):
    put, run = feed
    put([(1, 0, 1, "error"), (2, 1, 1, "error"), (3, 500, 1, "error"), (4, 400, 2, "view")])  # the third is not passed yet
    _, got = run(lambda e: watch.ended(e, "user_id", F.col("event_type") == "error", "event_id", 2), "f")
    assert [(r.user_id, r.by_id) for r in got] == [(1, 2)]


def test_a_stage_that_falls_silent_is_pending_again(feed, spark):
    put, run = feed
    kinds = {"view": ("probe", "done"), "error": ("fetch", "running"), "purchase": ("fetch", "failed")}
    stage = F.create_map(*[F.lit(x) for k, v in kinds.items() for x in (k, v[0])])[F.col("event_type")]
    status = F.create_map(*[F.lit(x) for k, v in kinds.items() for x in (k, v[1])])[F.col("event_type")]
    make = lambda e: watch.stages(e.where("user_id < 90").select("user_id", "ts", stage.alias("stage"), status.alias("status")).unionByName(e.where("user_id > 90").select("user_id", "ts", F.lit("probe").alias("stage"), F.lit("done").alias("status"))), "user_id", ["probe", "fetch", "keep"], "900 seconds", 2)
    put([(1, 0, 1, "view"), (2, 1, 1, "error"), (3, 0, 2, "error"), (4, 0, 3, "view"), (5, 1, 3, "purchase")])
    _, got = run(make, "t")
    now = lambda rows: {(r.user_id, r.stage): (r.status, r.attempts, r.next) for r in watch.latest(spark.createDataFrame(rows), "user_id").collect()}
    seen = now(got)
    assert seen[1, "fetch"] == ("running", 0, False) and seen[1, "probe"] == ("done", 0, False) and seen[1, "keep"] == ("pending", 0, False)
    assert seen[2, "probe"] == ("pending", 0, True) and seen[2, "fetch"] == ("pending", 0, False)
    assert seen[3, "fetch"] == ("pending", 1, True)
    put([(6, 2, 3, "purchase"), (7, 3, 95, "view")])
    put([(8, 60, 95, "view")])  # the watermark passes 900 seconds of silence
    _, got = run(make, "t")
    seen = now(got)
    assert seen[1, "fetch"] == ("pending", 0, True) and seen[3, "fetch"] == ("failed", 2, False)


class State:
    """One key's state and timers, as a processor sees them, with every call counted."""

    def __init__(self):
        self.value, self.timers, self.calls, self.now = None, set(), 0, 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):
        return self.now

    def getExpiryTimeInMs(self):
        return self.now

    def work(self, processor, rows, now):
        """A batch: its marks, then the timers that the watermark has passed."""
        self.now = now
        out = list(processor.handleInputRows((1,), iter(rows), self)) if rows else []
        for at in sorted(t for t in self.timers if t <= now):
            out += processor.handleExpiredTimer((1,), self, self)
            self.timers.remove(at)
        return out


@pytest.mark.parametrize("seed", range(20))
def test_failures_need_one_timer_and_no_more_calls_for_more_marks(seed):
    rng = random.Random(seed)
    marks = [Row(at=rng.randrange(300), id=i, failed=rng.random() < 0.6) for i in range(120)]
    state, processor, found, seen, want = State(), watch._Failures(6), [], [], None
    processor.init(state)
    for step in range(12):
        before, now = state.calls, step * 30
        rows = [m for m in marks if m not in seen and m.at >= now - 30 and (m.at < now + 60 or rng.random() < 0.1)]  # what is late is dropped, some come early
        seen += rows
        got = state.work(processor, rows, now)
        n = 0
        for m in sorted((m for m in seen if m.at < now), key=lambda m: (m.at, m.id)):
            n = n + 1 if m.failed else 0
            if n == 6 and want is None:
                want = (m.at, m.id, step)
        found += [(r.ended_at, r.by_id, step) for r in got]
        assert len(state.timers) <= 1 and state.calls - before <= 9
    assert found == ([want] if want else [])
    assert not state.timers and not any(state.value[3:])


@pytest.mark.parametrize("seed", range(20))
def test_stages_need_one_timer_and_no_more_calls_for_more_marks(seed):
    rng = random.Random(seed)
    order = ["probe", "fetch", "keep"]
    state, processor, seen = State(), watch._Stages(order, 50, 2), []
    processor.init(state)
    for step in range(12):
        before, now = state.calls, step * 30
        rows = [Row(at=max(0, now + rng.randrange(-30, 60)), stage=rng.choice(order), status=rng.choice(["running", "done", "done", "failed"])) for _ in range(rng.choice([0, 1, 4, 40]) if step < 8 else 0)]
        seen += rows
        got = state.work(processor, rows, now)
        want, ready = {}, True
        for stage in order:
            marks = [(m.at, m.status) for m in seen if m.stage == stage]
            failed = sum(s == "failed" for _, s in marks)
            at, last = max(marks, default=(0, "pending"))
            own = "pending" if last == "running" and at + 50 <= now or last == "failed" and failed < 2 else last
            want[stage] = (own if ready else "pending", failed, ready and own == "pending")
            ready = ready and own == "done"
        if got:
            assert {r.stage: (r.status, r.attempts, r.next) for r in got[-3:]} == want and got[-1].version == max(r.version for r in got)
            said = want
        assert not seen or said == want  # whatever changes is told at once
        assert len(state.timers) <= 1 and state.calls - before <= 8
    assert not state.timers

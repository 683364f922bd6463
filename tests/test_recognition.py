"""State machines over streams against plain replays, in one run and restarted from their checkpoint."""

import random

import pytest

from pagemill.plans import streams
from pagemill.streaming import recognition as R

SCHEMA = "session long, event_id long, at_ms long, kind string, page_number long"


def replay(events):
    out = []
    for session in {e[0] for e in events}:
        file, running, queue, states = 0, None, [], {}
        for _, i, at, kind, page in sorted((e for e in events if e[0] == session), key=lambda e: (e[2], e[1])):
            said = lambda p, state, ok=True: out.append((session, file, i, at, p, state, ok))  # noqa: E731, B023
            if kind == "open":
                for p in ([] if running is None else [running]) + queue:
                    said(p, "cancelled")
                file, running, queue, states = file + 1, None, [], {}
            elif kind == "ask":
                ok = states.get(page) not in ("queued", "running")
                said(page, "queued", ok)
                if ok:
                    states[page] = "queued"
                    queue.append(page)
            else:
                ok = running == page
                said(page, kind, ok)
                if ok:
                    states[page], running = kind, None
            if running is None and queue:
                running = queue.pop(0)
                states[running] = "running"
                said(running, "running")
    return sorted(out)


def events_of(n, seed=1):
    rnd = random.Random(seed)
    return [(rnd.randrange(4), i, 1000 * i, rnd.choices(("open", "ask", "done", "error"), (1, 6, 5, 2))[0], rnd.randrange(4)) for i in range(n)]


def run(spark, at, out, make, schema=SCHEMA, files=1):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(str(at))
    with R.stateful(spark):
        make(stream).writeStream.format("parquet").option("path", str(out / "rows")).option("checkpointLocation", str(out / "log")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(out / "rows"))


def put(spark, at, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(at))


def test_recognition_is_a_replay_and_restarts(spark, tmp_path):
    events = events_of(400)
    for a in range(0, 200, 100):
        put(spark, tmp_path / "in", events[a : a + 100])
    got = run(spark, tmp_path / "in", tmp_path / "out", R.recognition)
    assert sorted(tuple(r) for r in got.collect()) == replay(events[:200])
    # A new run over the same checkpoint goes on with the queues and pages in flight.
    for a in range(200, 400, 100):
        put(spark, tmp_path / "in", events[a : a + 100])
    got = run(spark, tmp_path / "in", tmp_path / "out", R.recognition)
    want = replay(events)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert {r[5] for r in want if r[6]} == {"queued", "running", "done", "error", "cancelled"} and {r[5] for r in want if not r[6]} >= {"queued", "done"}
    busy = {}
    for session, _, _, _, page, state, ok in sorted(want, key=lambda r: (r[0], r[2], r[5] == "running")):
        if ok and state == "running":
            assert busy.setdefault(session, None) is None
            busy[session] = page
        elif ok and state in ("done", "error", "cancelled") and busy.get(session) == page:
            busy[session] = None


def test_debounced_edits_wait_for_a_pause(spark, tmp_path):
    from pyspark.sql import functions as F

    rnd = random.Random(2)
    at, events = dict.fromkeys(range(3), 0), []
    for i in range(300):
        s = rnd.randrange(3)
        at[s] = max(at.values()) + rnd.choice((10, 90, 200, 700))
        events.append((s, i, at[s], "edit", 0))
    events.append((9, 999, max(at.values()) + 100_000, "edit", 0))
    for a in range(0, 301, 60):
        put(spark, tmp_path / "in", events[a : a + 60])
    make = lambda df: R.debounced(df.withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", "1 second"), 500)
    got = sorted(tuple(r) for r in run(spark, tmp_path / "in", tmp_path / "out", make).collect())
    want = []
    for s in range(3):
        own = [e for e in events if e[0] == s]
        want += [(s, e[1], e[2], e[2] + 500) for e, after in zip(own, [*own[1:], None]) if after is None or after[2] - e[2] >= 500]
    assert got == sorted(want) and len(got) < 250


@pytest.mark.parametrize("old", list(R.ALLOWED))
def test_states_that_may_follow(old):
    assert all(to in R.ALLOWED for to in R.ALLOWED[old])


def test_query_over_the_event_table(spark):
    d = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{d}/events.parquet").selectExpr("user_id", "event_id", "unix_millis(cast(ts as timestamp))").collect()
    kind = lambda k: "open" if k == 0 else "ask" if k < 6 else "done" if k < 10 else "error"
    want = replay([(u, i, at, kind(i % 11), i % 3) for u, i, at in events])
    assert sorted(tuple(r) for r in streams.recognition_steps(spark, d).collect()) == want


def test_a_batch_fetches_and_puts_back_a_session_once():
    from pyspark.sql import Row

    class Held:
        value, calls = None, []

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

    class Handle:
        def getValueState(self, name, schema):
            return Held()

    events, own, got = [e for e in events_of(400) if e[0] == 1], R.Recognition(), []
    own.init(Handle())
    for part in (events[:50], events[50:]):
        rows = [Row(session=1, event_id=i, at_ms=at, kind=kind, page_number=page) for _, i, at, kind, page in part]
        got += own.handleInputRows((1,), iter(rows[::-1]), None)
    assert sorted(tuple(r) for r in got) == replay(events) and Held.calls == ["get", "update"] * 2

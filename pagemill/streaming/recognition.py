"""Recognition and previews as state machines over event streams: queues, one page in flight, cancellation, debouncing.

State lives in Spark's store (a value for each session), so a restarted stream goes on where it
stopped. Rows of a session are taken by time and number within each batch; a batch never holds rows that
are older than those of the batch before by more than the watermark's delay.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STEPS = "session long, file long, event_id long, at_ms long, page_number long, state string, accepted boolean"
#: What may follow what; a page without a state may only be queued.
ALLOWED = {None: ("queued",), "queued": ("running", "cancelled"), "running": ("done", "error", "cancelled"), "done": ("queued",), "error": ("queued",), "cancelled": ("queued",)}
_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """Streams that begin inside keep their state in a store that has lists, maps and timers."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


def _in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(["at_ms", "event_id"], kind="stable")


class Recognition(StatefulProcessor):
    """One session's recognition: a queue of pages without repeats, one page in flight, and a state for each page of the open file.

    A session's state is one value, fetched once and put back once for all of its rows in a batch, as each access is a
    round trip between Python and the store; its rows come one after another, not as a table of their own.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "file long, running long, queue array<long>, pages array<long>, states array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        file, running, queue, pages, names = self.held.get() or (0, -1, (), (), ())
        queue, states, out = list(queue), dict(zip(pages, names, strict=True)), []

        def move(page: int, to: str) -> bool:
            if to not in ALLOWED[states.get(page)]:
                return False
            states[page] = to
            return True

        for e in sorted(rows, key=lambda e: (e.at_ms, e.event_id)):
            page = e.page_number
            told = lambda page, state, ok=True: out.append(Row(session=key[0], file=file, event_id=e.event_id, at_ms=e.at_ms, page_number=page, state=state, accepted=ok))  # noqa: E731, B023
            if e.kind == "open":
                # What was asked of the file before is called off; its pages are forgotten.
                for p in ([running] if running >= 0 else []) + queue:
                    told(p, "cancelled", move(p, "cancelled"))
                file, running, queue = file + 1, -1, []
                states.clear()
            elif e.kind == "ask":
                ok = move(page, "queued")
                told(page, "queued", ok)
                queue += [page] * ok
            else:
                # A result of a page that isn't in flight, as after a new file, changes nothing.
                ok = page == running and move(page, e.kind)
                told(page, e.kind, ok)
                running = -1 if ok else running
            if running < 0 and queue:
                running = queue.pop(0)
                told(running, "running", move(running, "running"))
        self.held.update((file, running, queue, list(states), list(states.values())))
        yield from out

    def close(self) -> None:
        pass


def recognition(events: DataFrame) -> DataFrame:
    """events: streaming (session, event_id, at_ms, kind, page_number); kind is open, ask, done or error. A row for each step that a page takes or that isn't allowed."""
    return events.groupBy("session").transformWithState(Recognition(), STEPS, "Append", "None")


class Debounce(StatefulProcessor):
    """The last edit of a session before each pause: a timer runs from every edit and starts anew with the next."""

    def __init__(self, pause_ms: int):
        self.pause_ms = pause_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "event_id long, at_ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, out = (self.last.get() if self.last.exists() else None), []
        if last is not None:
            self.handle.deleteTimer(last[1] + self.pause_ms)
        for e in _in_order(rows).itertuples():
            if last is not None and e.at_ms - last[1] >= self.pause_ms:
                out.append((key[0], *last, last[1] + self.pause_ms))
            last = (int(e.event_id), int(e.at_ms))
        self.last.update(last)
        self.handle.registerTimer(last[1] + self.pause_ms)
        yield pd.DataFrame(out, columns=["session", "event_id", "at_ms", "runs_ms"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()
        self.last.clear()
        yield pd.DataFrame([(key[0], *last, last[1] + self.pause_ms)], columns=["session", "event_id", "at_ms", "runs_ms"])

    def close(self) -> None:
        pass


def debounced(events: DataFrame, pause_ms: int) -> DataFrame:
    """events: streaming (session, event_id, at_ms, at) with a watermark on `at`. Rows (session, event_id, at_ms, runs_ms): the edits that a pause follows, as soon as the watermark has passed it."""
    return events.groupBy("session").transformWithStateInPandas(Debounce(pause_ms), "session long, event_id long, at_ms long, runs_ms long", "Append", "EventTime")

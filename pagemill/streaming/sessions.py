"""Edits and pages as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edit_steps(events: DataFrame, gap_ms: int) -> DataFrame:
    """events: streaming (session, event_id, k, at timestamp). One row for each closed step, as in `edits.history`.

    State is the open step of each session; it closes with another key, with a gap, or at the end of
    the watermark's delay.
    """
    schema = "session long, k string, started_ms long, ended_ms long, changes long"

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        out = []
        now = list(state.get) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], *now)], columns=[c.split()[0] for c in schema.split(", ")])
            return
        rows = pd.concat(list(batches)).sort_values(["at_ms", "event_id"])
        for k, at in zip(rows["k"], rows["at_ms"], strict=True):
            if now and now[0] == k and at - now[2] < gap_ms:
                now[2], now[3] = int(at), now[3] + 1
            else:
                if now:
                    out.append((key[0], *now))
                now = [k, int(at), int(at), 1]
        state.update(tuple(now))
        state.setTimeoutTimestamp(max(now[2] + gap_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    ready = events.withColumn("at_ms", F.unix_millis("at"))
    return ready.groupBy("session").applyInPandasWithState(run, schema, "k string, started long, ended long, changes long", "append", "EventTimeTimeout")


def pages_done(pages: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """pages: streaming (doc_id, page_number, at). Each page once, as soon as it comes; what is remembered goes with the watermark."""
    return pages.withWatermark("at", delay).dropDuplicatesWithinWatermark(["doc_id", "page_number"])


def progress(done: DataFrame) -> DataFrame:
    """Pages done and the last one seen of each document."""
    return done.groupBy("doc_id").agg(F.count(F.lit(1)).alias("done"), F.max("page_number").alias("last_page"))

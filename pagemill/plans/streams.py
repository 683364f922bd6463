"""Queries that run a stream to its end over stored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources import views as V
from ..streaming import recognition, sessions
from ..streaming.tables import drained


@query(f"WITH {V.ITEMS} SELECT doc_id, count(DISTINCT page_number) AS done, max(page_number) AS last_page FROM text_items GROUP BY doc_id")
def stream_page_progress(spark: SparkSession, d: str) -> DataFrame:
    """Pages come line by line, each at its own time, some lines late; every page counts once."""
    docs = V.read(spark, d, "documents")
    stream = spark.readStream.schema(docs.schema).parquet(f"{d}/documents.parque[t]")
    lines = stream.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where("trim(line) != ''")
    at = F.timestamp_seconds(1_767_225_600 + F.col("line_no") - F.when(F.col("line_no") % 7 == 3, 5).otherwise(0))
    pages = lines.select("doc_id", (F.floor(F.col("line_no") / V.LINES_A_PAGE) + 1).alias("page_number"), at.alias("at"))
    return sessions.progress(drained(sessions.pages_done(pages), "append"))


@query("""SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n, floor(sum(value) * 1e4 + 0.5) / 1e4 AS total FROM events GROUP BY ALL""")
def stream_daily_edits(spark: SparkSession, d: str) -> DataFrame:
    """A tumbling window over the edit stream; the table has the latest figures of each window."""
    events = V.read(spark, d, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/events.parque[t]").withColumn("at", F.col("ts").cast("timestamp"))
    days = stream.withWatermark("at", "1 day").groupBy(F.window("at", "1 day").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    latest = drained(days.select("user_id", F.col("w.start").alias("start"), "n", "total"), "update", ["user_id", "start"])
    return latest.select("user_id", F.col("start").cast("timestamp_ntz").alias("day"), "n", (F.floor(F.col("total") * 1e4 + 0.5) / 1e4).alias("total"))


PAUSE_MS, DELAY_MS = 3_600_000, 60_000


def _events(spark: SparkSession, d: str) -> DataFrame:
    events = V.read(spark, d, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/events.parque[t]").withColumn("at", F.col("ts").cast("timestamp"))
    return stream.select(F.col("user_id").alias("session"), "event_id", F.unix_millis("at").alias("at_ms"), "at")


@query(f"""WITH {V.EDITS}, n AS (SELECT *, lead(at_ms) OVER (PARTITION BY session ORDER BY at_ms, event_id) AS after, max(epoch_us(ts) // 1000) OVER () AS latest FROM (SELECT *, (SELECT max(ts) FROM events) AS ts FROM edit_log))
SELECT session, event_id, at_ms, at_ms + {PAUSE_MS} AS runs_ms FROM n WHERE after - at_ms >= {PAUSE_MS} OR (after IS NULL AND at_ms + {PAUSE_MS} <= latest - {DELAY_MS})""")
def stream_debounced(spark: SparkSession, d: str) -> DataFrame:
    """Edits that a pause of an hour follows, told by timers; of the last ones those whose pause the watermark has passed."""
    with recognition.stateful(spark):
        return drained(recognition.debounced(_events(spark, d).withWatermark("at", "1 minute"), PAUSE_MS), "append")


@query()
def recognition_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps of pages through recognition in each session of the event stream: new files, asked pages, results, each known by the event's number."""
    k = F.col("event_id") % 11
    kind = F.when(k == 0, "open").when(k < 6, "ask").when(k < 10, "done").otherwise("error")
    events = _events(spark, d).select("session", "event_id", "at_ms", kind.alias("kind"), (F.col("event_id") % 3).alias("page_number"))
    with recognition.stateful(spark):
        return drained(recognition.recognition(events), "append")

"""Streams over the event log and the registry: windows with late data, the status machine, work loops."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.registry import EVENT_STATUS


def windowed_counts(events: DataFrame, late: str = "1 hour", size: str = "15 minutes", slide: str | None = None) -> DataFrame:
    """Events per window and type; a window is final once the watermark has passed it."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return e.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("window.start", "window.end", "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    s = e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return s.select("session_window.start", "session_window.end", "user_id", "n")


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.dropDuplicatesWithinWatermark(["event_id"])


def step(state: tuple[str | None, int], status: str, force: bool = False) -> tuple[str | None, int]:
    """One event of the status machine on (status, error_count)."""
    now, errors = state
    if status == "downloaded":
        return ("downloaded", 0) if now is None or force else state
    if status == "error":
        return "error", errors + 1
    return state if now is None else (status, 0)


def status_stream(events: DataFrame) -> DataFrame:
    """The status machine as a stream: user_id, status, error_count after each batch of a key's events."""

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (None, 0)
        rows = pd.concat(list(pdfs)).sort_values("event_id")
        for kind in rows["event_type"]:
            if kind in EVENT_STATUS:
                now = step(now, EVENT_STATUS[kind])
        state.update(now)
        if now[0] is not None:
            yield pd.DataFrame({"user_id": [key[0]], "status": [now[0]], "error_count": [now[1]]})

    return events.select("user_id", "event_id", "event_type").groupBy("user_id").applyInPandasWithState(run, "user_id bigint, status string, error_count int", "status string, error_count int", "update", GroupStateTimeout.NoTimeout)


def work_loop(queue: DataFrame, work: Callable[[DataFrame], DataFrame], report: Callable[[DataFrame], None], checkpoint: str, every: str = "5 seconds") -> StreamingQuery:
    """Poll a queue of papers: work on each batch and report; a batch that fails is reported as errors and the loop goes on."""

    def batch(df: DataFrame, _: int) -> None:
        try:
            report(work(df))
        except Exception as e:  # noqa: BLE001 - any failure of a stage becomes an error row
            report(df.select("filename", F.lit("error").alias("status"), F.lit(str(e)[:500]).alias("last_error")))

    return queue.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def stalled(progress: DataFrame, minutes: int) -> DataFrame:
    """Progress rows (at, done) at which nothing was done for the given minutes."""
    from pyspark.sql import Window

    w = Window.orderBy("at")
    p = progress.withColumn("moved", F.coalesce(F.col("done") != F.lag("done").over(w), F.lit(True)))
    p = p.withColumn("since", F.last(F.when(F.col("moved"), F.col("at")), ignorenulls=True).over(w))
    return p.where(F.unix_timestamp("at") - F.unix_timestamp("since") >= minutes * 60).select("at", "done", "since")

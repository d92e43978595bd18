"""Progress and runs as aggregates that hold for tables and for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_progress(events: DataFrame, key: str = "run_id") -> DataFrame:
    """Where each upload stands: its last event by time; an error puts progress back to 0."""
    last = events.groupBy(key).agg(F.max_by(F.struct("stage", "progress"), F.struct("at", "progress")).alias("e"), F.count(F.lit(1)).alias("events"))
    return last.select(key, F.col("e.stage").alias("stage"), F.when(F.col("e.stage") == "ERROR", 0).otherwise(F.col("e.progress")).alias("progress"), "events")


def run_totals(events: DataFrame) -> DataFrame:
    """Counters and status of runs (run_id, type, conflict, severity), for tables and, in update or complete mode, for streams.

    An abort keeps what there is. Of abort, error and complete the first in this order is the
    status, whichever came last, so a stream says what a table says.
    """
    result = F.col("type") == "result"
    status = F.when(F.bool_or(F.col("type") == "abort"), "aborted").when(F.bool_or(F.col("type") == "error"), "failed").when(F.bool_or(F.col("type") == "complete"), "completed").otherwise("running")
    return events.groupBy("run_id").agg(F.count_if(result).alias("results"), F.count_if(result & F.col("conflict")).alias("conflicts"), F.count_if(result & (F.col("severity") == "Error")).alias("errors"), status.alias("status"))


def windowed_counts(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """Events by kind in windows of event time; with `late`, a watermark for streams."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))

"""Where each upload stands, as a batch and as a stream: both fold the same events to the same status.

An upload reports sixteen steps in a fixed order, or an error, which ends it. Events may come late and in any order, so
nothing depends on the order in which they come: what is kept of a run is the time of each step, of the error and of
the last event.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# The steps of a successful upload, with their percentages.
STEPS = (
    ("UPLOAD_RECEIVED", 5), ("UPLOAD_VALIDATED", 10), ("DB_CREATE_STARTED", 15), ("DB_CREATE_COMPLETED", 20), ("PARSING_STARTED", 25), ("PARSING_COMPLETED", 35), ("CLAUSE_EXTRACTION_STARTED", 40), ("CLAUSE_EXTRACTION_PROGRESS", 50),
    ("TOC_REMOVAL_STARTED", 55), ("TOC_REMOVAL_COMPLETED", 60), ("PARTY_IDENTIFICATION_STARTED", 65), ("PARTY_IDENTIFICATION_COMPLETED", 75), ("DB_SAVE_STARTED", 80), ("DB_SAVE_PROGRESS", 85), ("DB_SAVE_PROGRESS", 90), ("PROCESSING_COMPLETED", 100),
)
ERROR = "ERROR"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATUS = "run_id string, stage string, progress int, status string, events long, missing int, in_order boolean"
STATE = "events long, last long, error long, times array<long>"


def step_of(stage: Column, progress: Column) -> Column:
    """The place of an event among the steps, from 0: stage and percentage together tell, as saving reports twice. Null for others."""
    return reduce(lambda c, k: c.when((stage == k[1][0]) & (progress == k[1][1]), k[0]), enumerate(STEPS), F.when(F.lit(False), 0))


def told(events: int, last: int, error: int | None, times: list[int | None], aborted: bool) -> tuple:
    """stage, progress, status, events, missing and in_order of a run; the plain form of `_told`."""
    seen = [k for k, t in enumerate(times) if t is not None]
    far = seen[-1] if seen else -1
    status = "failed" if error is not None else "completed" if far == len(STEPS) - 1 else "aborted" if aborted else "running"
    stage, progress = STEPS[far] if far >= 0 else (None, 0)
    ordered = all(times[a] <= times[b] for a, b in zip(seen, seen[1:], strict=False))
    return (ERROR, 0, status, events, far + 1 - len(seen), ordered) if error is not None else (stage, progress, status, events, far + 1 - len(seen), ordered)


def upload_status(events: DataFrame, silence: int = 300, delay: str = "60 seconds") -> DataFrame:
    """run_id, stage, progress, status, events, missing, in_order of events (run_id, stage, progress, at).

    The stage is the furthest step reached; an error puts progress back to 0 and the run has failed, whatever else it reports.
    All sixteen steps are counted: `missing` says how many before the furthest never came, `in_order` whether times rise with
    the steps. A run that is not over and silent for `silence` seconds is aborted: so is one
    whose client went away. Other stages count as events alone. Streams give a row whenever a run
    changes, and forget a run when it has been silent for so long; `at` has a watermark of `delay`.
    On a table, now is the last event of all, less that delay.
    """
    if events.isStreaming:
        return _streamed(events.withWatermark("at", delay), silence)
    step, micros = step_of(F.col("stage"), F.col("progress")), F.unix_micros(F.col("at").cast("timestamp"))
    rows = events.select("run_id", step.alias("step"), (F.col("stage") == ERROR).alias("bad"), micros.alias("t"))
    now = F.lit(rows.agg(F.max("t")).first()[0]).cast("long") - F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {delay}"))
    runs = rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("events"), F.max("t").alias("last"), F.min(F.when(F.col("bad"), F.col("t"))).alias("error"),
        F.array(*[F.min(F.when(F.col("step") == k, F.col("t"))) for k in range(len(STEPS))]).alias("times"),
    )
    seen = F.filter(F.transform("times", lambda t, k: F.when(t.isNotNull(), k)), lambda k: k.isNotNull())
    known = F.filter("times", lambda t: t.isNotNull())
    far = F.coalesce(F.array_max(seen), F.lit(-1))
    name = F.get(F.array(*[F.lit(s) for s, _ in STEPS]), far)
    percent = F.coalesce(F.get(F.array(*[F.lit(p) for _, p in STEPS]), far), F.lit(0))
    failed = F.col("error").isNotNull()
    status = F.when(failed, "failed").when(far == len(STEPS) - 1, "completed").when(F.col("last") + silence * 1_000_000 <= now, "aborted").otherwise("running")
    return runs.select(
        F.col("run_id").cast("string").alias("run_id"), F.when(failed, ERROR).when(far >= 0, name).alias("stage"), F.when(failed, 0).otherwise(percent).alias("progress"), status.alias("status"),
        "events", (far + 1 - F.size(seen)).alias("missing"), (F.array_sort(known) == known).alias("in_order"),
    )


class _Uploads(StatefulProcessor):
    """Keeps a run's times, and a timer for its silence."""

    def __init__(self, silence: int) -> None:
        self.silence = silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("run", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        events, last, error, times = self.state.get() if self.state.exists() else (0, 0, None, [None] * len(STEPS))
        times = list(times)
        for row in rows:
            events, last = events + 1, max(last, row["micros"])
            if row["stage"] == ERROR:
                error = min(x for x in (error, row["micros"]) if x is not None)
            if row["step"] is not None:
                k = row["step"]
                times[k] = row["micros"] if times[k] is None else min(times[k], row["micros"])
        self.state.update((events, last, error, times))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last // 1000 + self.silence * 1000)
        yield Row(run_id=key[0], **dict(zip(("stage", "progress", "status", "events", "missing", "in_order"), told(events, last, error, times, False), strict=True)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.state.exists():
            events, last, error, times = self.state.get()
            now = told(events, last, error, list(times), True)
            if now[2] == "aborted":
                yield Row(run_id=key[0], **dict(zip(("stage", "progress", "status", "events", "missing", "in_order"), now, strict=True)))
        self.state.clear()

    def close(self) -> None:
        pass


def _streamed(events: DataFrame, silence: int) -> DataFrame:
    """Needs the RocksDB state store: set spark.sql.streaming.stateStore.providerClass to PROVIDER."""
    rows = events.select(F.col("run_id").cast("string").alias("run_id"), "at", "stage", step_of(F.col("stage"), F.col("progress")).alias("step"), F.unix_micros(F.col("at").cast("timestamp")).alias("micros"))
    return rows.groupBy("run_id").transformWithState(statefulProcessor=_Uploads(silence), outputStructType=STATUS, outputMode="Update", timeMode="EventTime")

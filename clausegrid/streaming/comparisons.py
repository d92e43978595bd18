"""Comparison runs as events: status, results in order, complete, for tables and for streams of requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clausegrid.functions.text import strip

MOST_TARGETS = 100
EVENT = "run_id string, seq long, type string, message string, index long, conflict boolean, severity string, total long, conflicts_found long, errors long"


def request_fault(prompt: Column, source: Column, targets: Column, most: int = MOST_TARGETS) -> Column:
    """Why a request (prompt, source, array of targets) is refused, else null: blank prompt or source, no target, or too many."""
    blank = lambda c: c.isNull() | (strip(c) == "")
    n = F.coalesce(F.size(targets), F.lit(0))
    return F.when(blank(prompt), "blank prompt").when(blank(source), "blank source").when(n < 1, "no target").when(n > most, "too many targets")


def target_rows(requests: DataFrame) -> DataFrame:
    """(run_id, index, total, prompt, source, target) of requests (run_id, prompt, source, targets); the index counts from 0."""
    rows = requests.select("run_id", "prompt", "source", F.size("targets").cast("long").alias("total"), F.posexplode("targets").alias("index", "target"))
    return rows.withColumn("index", F.col("index").cast("long"))


def events_of(results: DataFrame) -> DataFrame:
    """The events of runs whose results are (run_id, index, total, conflict, severity): one of status, seq 0, one of each result, seq by its index, one of complete, with what was counted.

    A result that failed has the severity Error. A run's events are numbered without gaps, so that whoever gets them can order them and see
    that none is missing. Counts are summed up, so one long run is no more work for a task than any other.
    """
    runs = results.groupBy("run_id").agg(F.max("total").alias("total"), F.count_if("conflict").alias("conflicts_found"), F.count_if(F.col("severity") == "Error").alias("errors"))
    none = lambda kind: F.lit(None).cast(kind)
    begin = runs.select("run_id", F.lit(0).cast("long").alias("seq"), F.lit("status").alias("type"), F.concat(F.lit("Starting "), "total", F.lit(" comparisons")).alias("message"), none("long").alias("index"), none("boolean").alias("conflict"), none("string").alias("severity"), "total", none("long").alias("conflicts_found"), none("long").alias("errors"))
    each = results.select("run_id", (F.col("index") + 1).alias("seq"), F.lit("result").alias("type"), none("string").alias("message"), "index", "conflict", "severity", "total", none("long").alias("conflicts_found"), none("long").alias("errors"))
    end = runs.select("run_id", (F.col("total") + 1).alias("seq"), F.lit("complete").alias("type"), F.lit("All comparisons completed").alias("message"), none("long").alias("index"), none("boolean").alias("conflict"), none("string").alias("severity"), "total", "conflicts_found", "errors")
    return begin.unionByName(each).unionByName(end)


def refusals(requests: DataFrame) -> DataFrame:
    """One event of type error for each request with a fault, in the columns of events_of."""
    rows = requests.filter("fault IS NOT NULL").select(F.col("run_id"), F.lit(0).cast("long").alias("seq"), F.lit("error").alias("type"), F.col("fault").alias("message"))
    for field in EVENT.split(", ")[4:]:
        name, kind = field.split()
        rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows


def compared(requests: DataFrame, compare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All events of requests (run_id, prompt, source, targets); `compare` adds conflict and severity to target_rows."""
    checked = requests.withColumn("fault", request_fault(F.col("prompt"), F.col("source"), F.col("targets")))
    good = checked.filter("fault IS NULL").select("run_id", "prompt", "source", "targets")
    return events_of(compare(target_rows(good))).unionByName(refusals(checked))


def write_events(requests: DataFrame, path: str, checkpoint: str, compare: Callable[[DataFrame], DataFrame], **trigger) -> StreamingQuery:
    """Starts a stream that compares requests as they come and adds their events to the table at `path`.

    A batch goes into a folder that bears its id and is written over as a whole, so a batch that is
    run again after a failure adds nothing twice. All targets of a request come in its row, hence in one batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        compared(batch, compare).select(*[c.split()[0] for c in EVENT.split(", ")]).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return requests.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).foreachBatch(write).start()


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{EVENT}, batch long").option("basePath", path).parquet(path)


def complete_runs(events: DataFrame) -> DataFrame:
    """run_id, type of the last event, n events and whether they are whole: numbered from 0 without gap or repeat, status first, complete or error last."""
    runs = events.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"), F.count_distinct("seq").alias("seqs"), F.max_by("type", "seq").alias("type"), F.min_by("type", "seq").alias("first"))
    whole = (F.col("n") == F.col("last") + 1) & (F.col("seqs") == F.col("n")) & F.col("type").isin("complete", "error") & F.col("first").isin("status", "error")
    return runs.select("run_id", "type", "n", whole.alias("whole"))

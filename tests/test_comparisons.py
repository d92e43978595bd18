"""Comparison runs as events, in batch and in streams that are lost and run again."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from clausegrid.streaming import comparisons as M

SCHEMA = "run_id string, prompt string, source string, targets array<string>"
REQUESTS = [("a", "p", "s", ["x", "conflict", ""]), ("b", "p", "s", ["fail"]), ("c", " \n", "s", ["x"]), ("d", "p", None, ["x"]), ("e", "p", "s", []), ("f", "p", "s", None), ("g", "p", "s", ["x"] * 100), ("h", "p", "s", ["x"] * 101)]


def compare(rows):
    return rows.withColumn("conflict", F.col("target") == "conflict").withColumn("severity", F.when(F.col("target") == "fail", "Error").otherwise("Low"))


def test_events(spark):
    events = M.compared(spark.createDataFrame(REQUESTS, SCHEMA), compare)
    assert [f"{n} {t.replace('bigint', 'long')}" for n, t in events.dtypes] == M.EVENT.split(", ")
    got = sorted(((r.run_id, r.seq, r.type, r["index"], r.conflict, r.severity, r.total, r.conflicts_found, r.errors) for r in events.filter("run_id IN ('a', 'b')").collect()), key=lambda r: r[:2])
    assert got == [
        ("a", 0, "status", None, None, None, 3, None, None), ("a", 1, "result", 0, False, "Low", 3, None, None), ("a", 2, "result", 1, True, "Low", 3, None, None), ("a", 3, "result", 2, False, "Low", 3, None, None), ("a", 4, "complete", None, None, None, 3, 1, 0),
        ("b", 0, "status", None, None, None, 1, None, None), ("b", 1, "result", 0, False, "Error", 1, None, None), ("b", 2, "complete", None, None, None, 1, 0, 1),
    ]
    assert {r.run_id: r.message for r in events.filter("type = 'error'").collect()} == {"c": "blank prompt", "d": "blank source", "e": "no target", "f": "no target", "h": "too many targets"}
    assert {r.run_id: (r.type, r.n, r.whole) for r in M.complete_runs(events).collect()} == {"a": ("complete", 5, True), "b": ("complete", 3, True), "g": ("complete", 102, True)} | {k: ("error", 1, True) for k in "cdefh"}
    assert M.compared(spark.createDataFrame([], SCHEMA), compare).count() == 0


def test_runs_that_are_not_whole(spark):
    events = M.compared(spark.createDataFrame(REQUESTS[:2], SCHEMA), compare)
    for kept in ("seq <> 1", "type <> 'complete'", "type <> 'status'"):
        assert not any(r.whole for r in M.complete_runs(events.filter(kept)).collect())
    assert not any(r.whole for r in M.complete_runs(events.unionByName(events.filter("seq = 1"))).collect())


@pytest.mark.parametrize("when", ["before", "after"])
def test_a_stream_that_is_lost_gives_each_event_once(spark, tmp_path, when):
    for k in range(4):
        spark.createDataFrame(REQUESTS[2 * k : 2 * k + 2], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    calls = []

    def lost(rows):
        calls.append(1)
        if len(calls) == 3 and when == "before":
            raise RuntimeError("lost")
        return compare(rows)

    if when == "before":
        with pytest.raises(StreamingQueryException):
            M.write_events(stream, f"{tmp_path}/out", f"{tmp_path}/check", lost).awaitTermination()
    else:

        def fails(batch, batch_id):
            M.compared(batch, compare).write.mode("overwrite").parquet(f"{tmp_path}/out/batch={batch_id}")
            if batch_id == 2:
                raise RuntimeError("lost")

        with pytest.raises(StreamingQueryException):
            stream.writeStream.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).foreachBatch(fails).start().awaitTermination()
    M.write_events(stream, f"{tmp_path}/out", f"{tmp_path}/check", compare).awaitTermination()
    got = M.read_events(spark, f"{tmp_path}/out")
    want = M.compared(spark.createDataFrame(REQUESTS, SCHEMA), compare)
    assert sorted(map(str, got.drop("batch").collect())) == sorted(map(str, want.collect()))
    assert all(r.whole for r in M.complete_runs(got).collect()) and got.select("batch").distinct().count() == 4

"""Upload progress: the stream's last word on each run is the batch's, whatever the order of events."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from clausegrid.streaming import uploads as U

SCHEMA = "run_id string, stage string, progress int, at timestamp"
BEGIN = datetime(2024, 1, 1)


def told(run, steps, begin=0, every=2):
    return [(run, stage, percent, BEGIN + timedelta(seconds=begin + every * k)) for k, (stage, percent) in enumerate(steps)]


def runs():
    all_steps = list(U.STEPS)
    return [
        *told("done", all_steps), *told("short", all_steps[:9], 500), *told("silent", all_steps[:5]), *told("failed", [*all_steps[:6], (U.ERROR, 0)]), *told("late", [*all_steps[:3], (U.ERROR, 0), all_steps[3]]),
        *told("gap", [all_steps[0], all_steps[13], all_steps[14]], 500), *told("mixed", [all_steps[k] for k in (0, 2, 1, 3)], 500), *told("odd", [("OTHER", 1), all_steps[0]], 500), *told("lost", [("OTHER", 1)], 500),
        ("tick", "OTHER", 1, BEGIN + timedelta(seconds=560)),
    ]


WANT = {
    "done": ("PROCESSING_COMPLETED", 100, "completed", 16, 0, True), "short": ("TOC_REMOVAL_STARTED", 55, "running", 9, 0, True), "silent": ("PARSING_STARTED", 25, "aborted", 5, 0, True), "failed": ("ERROR", 0, "failed", 7, 0, True),
    "late": ("ERROR", 0, "failed", 5, 0, True), "gap": ("DB_SAVE_PROGRESS", 90, "running", 3, 12, True), "mixed": ("DB_CREATE_COMPLETED", 20, "running", 4, 0, False), "odd": ("UPLOAD_RECEIVED", 5, "running", 2, 0, True),
    "lost": (None, 0, "running", 1, 0, True), "tick": (None, 0, "running", 1, 0, True),
}


def status(rows):
    return {r.run_id: (r.stage, r.progress, r.status, r.events, r.missing, r.in_order) for r in rows}


def test_batch(spark):
    assert status(U.upload_status(spark.createDataFrame(runs(), SCHEMA), 300).collect()) == WANT
    assert U.upload_status(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_batch(spark, tmp_path, seed):
    """Events of early runs come in any order, in three batches, then those of later runs, then one that moves the watermark on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", U.PROVIDER)
    rnd, rows = random.Random(seed), runs()
    early, later = [r for r in rows if r[3] < BEGIN + timedelta(seconds=400)], [r for r in rows if r[3] >= BEGIN + timedelta(seconds=400) and r[0] != "tick"]
    rnd.shuffle(early)
    rnd.shuffle(later)
    batches = [early[0::3], early[1::3], early[2::3], later[0::2], later[1::2], [rows[-1]]]
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/start")
    out = []
    for k in range(len(batches)):
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/live/*")
        spark.read.parquet(f"{tmp_path}/in/{k}").coalesce(1).write.parquet(f"{tmp_path}/live/{k}")
        query = U.upload_status(stream, 300).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).foreachBatch(lambda df, i: out.extend((i, r) for r in df.collect())).start()
        query.awaitTermination(120)
    last = {}
    for i, r in out:
        assert r.status in ("running", "completed", "failed", "aborted")
        last[r.run_id] = (r.stage, r.progress, r.status, r.events, r.missing, r.in_order)
    want = status(U.upload_status(spark.createDataFrame(rows, SCHEMA), 300).collect())
    assert want == WANT
    assert last == want
    states = [r.status for _, r in out if r.run_id == "silent"]
    assert states[-1] == "aborted" and set(states[:-1]) == {"running"}


def test_steps(spark):
    df = spark.createDataFrame([(s, p) for s, p in U.STEPS] + [("DB_SAVE_PROGRESS", 80), (None, 5), ("PARSING_STARTED", None)], "s string, p int")
    assert [r.k for r in df.select(U.step_of(F.col("s"), F.col("p")).alias("k")).collect()] == [*range(16), None, None, None]

"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only where that is
    unset and all runs on one machine, as in tests, a folder of our own is made and set; on
    a cluster a machine-local folder would scatter the data, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="clausegrid-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for one use below the shared folder, with its scheme, so that it means the same to every reader."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/clausegrid/{name}-{uuid.uuid4().hex}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read back.

    Cuts the lineage in a way that outlives executors, fixes anything that would
    differ when computed again, and lets later steps read only the columns they need.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def smaller_batches(spark: SparkSession, rows: int = 2_000) -> Iterator[None]:
    """Arrow batches of at most so many rows for what is written in here: whole texts by the ten thousand would fill executors."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Returns what Arrow and the C library hold in reserve to the machine: a Python worker is used again by later stages, and would keep it until its end."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def whole(text: Column) -> Column:
    """The text itself; null counts as empty."""
    return F.coalesce(text, F.lit(""))


def bound_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Sets Arrow batches of this session to at most so many rows. For queries and pipelines, which hand whole texts on without writing them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(spark.conf.get(name))
    if held <= 0 or held > rows:
        spark.conf.set(name, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _word(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits + 6)


def _bit(key: Column, bits: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(key, 64 - bits).bitwiseAND(F.lit(63)).cast("int"))


def repeated_keys(keys: DataFrame, bits: int) -> DataFrame:
    """A bitmap of the 64-bit hashes in `key` that at least two rows have.

    It has at most 2**(bits-6) rows of two longs, whatever the input holds, so it may
    be broadcast. A set bit can be shared by other keys: those are looked at once more
    than needed, but no repeated key is missed.
    """
    return bitmap_of(keys.groupBy("key").count().filter("count > 1").select("key"), bits)


def bitmap_of(keys: DataFrame, bits: int) -> DataFrame:
    """The bitmap of all 64-bit hashes in `key`."""
    return (
        keys.groupBy(_word(F.col("key"), bits).alias("word")).agg(F.bit_or(_bit(F.col("key"), bits)).alias("set_bits"))
    )


def bits_of(bitmap: DataFrame, bits: int) -> np.ndarray:
    """A bitmap as an array of 2**(bits-6) words, whatever the input holds, for use inside tasks."""
    out = np.zeros(1 << (bits - 6), np.uint64)
    held = bitmap.toPandas()
    out[held["word"].to_numpy(np.int64)] = held["set_bits"].to_numpy(np.int64).view(np.uint64)
    return out


def bits_by_least(counted: DataFrame, least: tuple[int, ...], bits: int) -> list[np.ndarray]:
    """For each of `least` the bitmap, as an array, of the 64-bit hashes in `key` that are counted so often in `n`; all in one job."""
    key = F.col("key")
    marks = [F.bit_or(F.when(F.col("n") >= k, _bit(key, bits)).otherwise(F.lit(0).cast("long"))).alias(f"_{i}") for i, k in enumerate(least)]
    held = counted.groupBy(_word(key, bits).alias("word")).agg(*marks).toPandas()
    out = [np.zeros(1 << (bits - 6), np.uint64) for _ in least]
    for i, marked in enumerate(out):
        marked[held["word"].to_numpy(np.int64)] = held[f"_{i}"].to_numpy(np.int64).view(np.uint64)
    return out


def in_bits(held: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Whether the bits of 64-bit hashes are set, as 0 or 1."""
    at = keys.view(np.uint64) >> np.uint64(64 - bits)
    return ((held[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(np.int64)


def may_repeat(df: DataFrame, bitmap: DataFrame, key: str, flag: str, bits: int) -> DataFrame:
    """Adds `flag`: whether the hash in column `key` may be one of the repeated ones."""
    joined = df.join(F.broadcast(bitmap), _word(F.col(key), bits) == F.col("word"), "left")
    hit = F.col("set_bits").bitwiseAND(_bit(F.col(key), bits)) != 0
    return joined.withColumn(flag, F.coalesce(hit, F.lit(False))).drop("word", "set_bits")


def hot_join(many: DataFrame, one: DataFrame, on: list[str], rows: str, least: float) -> DataFrame:
    """many joined with the row of `one` that has the same keys, inner, where some keys may hold a large share of `many`.

    `one` has each key once, with the number of its rows in `many` in column `rows`. Keys with `least` rows and more are
    broadcast; with `least` a fixed share of all rows, say a thousandth, they are a thousand at most, whatever the
    input. The rest is shuffled, and there no key has more than `least` rows.
    """
    hot = F.broadcast(one.filter(F.col(rows) >= least))
    rest = one.filter(F.col(rows) < least)
    left = many.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return many.join(hot, on).unionByName(left.join(rest, on))

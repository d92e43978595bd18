"""Sharding by sampled splitters: near-equal bytes, equal texts next to each other."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausegrid.llm.common import table, whole, written

LOWEST = -(2**63)


class Splitters:
    """Sorted boundaries over the key (hash, id, uid); range k lies below boundary k."""

    def __init__(self, keys: list[tuple[int, int, int]]):
        self.keys = sorted(set(keys))
        self.hashes = np.array([k[0] for k in self.keys], dtype=np.int64)

    def ranges(self, h: np.ndarray, ident: np.ndarray, uid: np.ndarray) -> np.ndarray:
        """How many boundaries are at or below each key."""
        found = np.searchsorted(self.hashes, h, side="left")
        upper = np.searchsorted(self.hashes, h, side="right")
        for value in np.unique(h[upper > found]):
            rows = np.flatnonzero(h == value)
            first, last = found[rows[0]], upper[rows[0]]
            for _, low_id, low_uid in self.keys[first:last]:
                found[rows] += (ident[rows] > low_id) | ((ident[rows] == low_id) & (uid[rows] >= low_uid))
        return found


def _range_of(splitters: Splitters):
    @F.pandas_udf("int")
    def range_of(h: pd.Series, ident: pd.Series, uid: pd.Series) -> pd.Series:
        return pd.Series(splitters.ranges(h.to_numpy(), ident.to_numpy(), uid.to_numpy()).astype("int32"))

    return range_of


def _sample(rows: DataFrame, rate, seed: int) -> np.ndarray:
    """(hash, id, uid, weight) of rows drawn with a chance in proportion to size."""
    chance = F.shiftrightunsigned(F.xxhash64("_uid", F.lit(seed)), 11) / F.lit(float(2**53))
    expected = F.col("_size") * rate
    drawn = rows.filter(chance < expected).select("_h", "_order", "_uid", F.greatest(F.lit(1.0), expected).alias("_weight")).toPandas()
    return drawn.sort_values(["_h", "_order", "_uid"])


def _boundaries(drawn: pd.DataFrame, parts: int) -> list[tuple[int, int, int]]:
    """Weighted quantiles of a sample. A hash that would be a boundary twice is hot and is cut inside."""
    if drawn.empty or parts < 2:
        return []
    cum = drawn["_weight"].cumsum().to_numpy()
    at = np.unique(np.searchsorted(cum, cum[-1] * np.arange(1, parts) / parts))
    picked = drawn.iloc[at][["_h", "_order", "_uid"]].to_numpy(dtype=object).tolist()
    times = pd.Series([p[0] for p in picked]).value_counts()
    return [(h, LOWEST, LOWEST) if times[h] == 1 else (h, o, u) for h, o, u in picked]


def shard_by_bytes(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, carry: tuple[str, ...] = (),
    range_bytes: int = 4 << 20, max_ranges: int = 65_536, samples_per_range: int = 32, group_share: float = 0.01, rounds: int = 4,
) -> DataFrame:
    """One row per input row: id, size, shard, slot and the columns in `carry` (name the text there to move it along).

    The law is `bytes`: sizes (UTF-8 bytes of the text, null none, plus 1) near equal
    in all shards. Records lie in order of (hash of the text, id), so equal texts are
    neighbours; a group of equal texts of at most `group_share` of a shard stays whole unless
    the border of two ranges falls into it, a larger one is cut where the balance needs it. Slots count gapless from 0.

    Size-weighted key samples (at most max_ranges * samples_per_range rows, drawn over
    all rows) give quantile boundaries; the exact bytes of each range are then counted,
    and ranges over twice the target are sampled again and subdivided, if need be inside
    one text or one id: a hot key ends up in many ranges. So every window below holds a
    bounded part of the data, and only one row per range reaches the driver. A null id
    sorts first; repeated rows each get a slot; an empty table gives no rows.
    """
    rows = written(
        df.select(
            F.col(id_col).alias("_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("_order"),
            (F.octet_length(whole(F.col(text_col))) + 1).cast("long").alias("_size"), F.xxhash64(whole(F.col(text_col))).alias("_h"),
            F.monotonically_increasing_id().alias("_uid"), *[F.col(c).alias(f"_carry_{c}") for c in carry],
        ),
        "shard-rows",
    )
    spark = df.sparkSession
    total = rows.agg(F.sum("_size")).first()[0] or 0
    parts = max(4 * shards, min(max_ranges, -(-total // range_bytes)))
    target = max(1, total / parts)
    keys = rows.select("_h", "_order", "_uid", "_size")
    splitters = Splitters(_boundaries(_sample(keys, F.lit(samples_per_range / target), 0), parts))
    for again in range(1, rounds + 1):
        ranged = keys.withColumn("_range", _range_of(splitters)("_h", "_order", "_uid"))
        sizes = dict(ranged.groupBy("_range").agg(F.sum("_size").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("_range", "b").collect())
        over = {k: b for k, b in sizes.items() if b > 2 * target}
        if not over or again == rounds:
            break
        cut = spark.createDataFrame([(k,) for k in over], "_over int")
        drawn = _sample(ranged.join(F.broadcast(cut), F.col("_range") == F.col("_over"), "left_semi"), F.lit(samples_per_range / target), again)
        held = splitters.ranges(*(drawn[c].to_numpy(dtype="int64") for c in ("_h", "_order", "_uid")))
        more = [b for k, size in over.items() for b in _boundaries(drawn[held == k], int(-(-size // target)))]
        splitters = Splitters(splitters.keys + more)

    ranged = rows.withColumn("_range", _range_of(splitters)("_h", "_order", "_uid"))
    starts, before = [], 0
    for k, b in sorted(ranged.groupBy("_range").agg(F.sum("_size")).collect()):
        starts.append((k, before))
        before += b
    starts = spark.createDataFrame(starts, "_range int, _start long")
    in_range = Window.partitionBy("_range").orderBy("_h", "_order", "_uid")
    in_group = Window.partitionBy("_range", "_h")
    placed = (
        ranged.join(F.broadcast(starts), "_range")
        .withColumn("_at", F.sum("_size").over(in_range.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size"))
        .withColumn("_group_at", F.min("_at").over(in_group)).withColumn("_group_size", F.sum("_size").over(in_group))
    )
    small = F.col("_group_size") <= F.lit(group_share * total / shards)
    at = F.col("_start") + F.when(small, F.col("_group_at")).otherwise(F.col("_at"))
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(at * shards / F.lit(max(1, total)))).cast("int"))
    placed = placed.withColumn("_rn", F.row_number().over(Window.partitionBy("_range", "shard").orderBy("_h", "_order", "_uid")) - 1)
    placed = written(placed.select("_id", "_size", "_range", "shard", "_rn", *[f"_carry_{c}" for c in carry]), "shard-placed")
    counts = placed.groupBy("_range", "shard").agg(F.count(F.lit(1)).alias("_n"))
    # One row per range, and one more per shard boundary: as bounded as the ranges.
    offsets = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("shard").orderBy("_range")) - F.col("_n"))
    return placed.join(F.broadcast(offsets.drop("_n")), ["_range", "shard"]).select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), "shard", (F.col("_before") + F.col("_rn")).cast("long").alias("slot"),
        *[F.col(f"_carry_{c}").alias(c) for c in carry],
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law (bytes), shard, slot and grown_shard (null under this law)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.encode(whole(F.col("text")), "UTF-8")).alias("text_crc32"))
    return shard_by_bytes(docs, carry=("text_crc32",)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )

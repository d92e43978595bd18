"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid.llm.common import may_repeat, repeated_keys, table, whole, written


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), prefix_chars: int = 256, bits: int = 23) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept and the columns in `carry`.

    Texts are equal when identical after no change; a null text counts as empty, and
    all empty texts form one group. Of a group the row with the largest id is kept, a
    null id being the smallest; of rows that repeat the same id and text exactly one is
    kept. An empty table gives an empty result. Other columns of `df`, whatever their
    names, are left alone; `carry` names those to hand through.

    Only lengths that occur twice get a prefix hash, and only (length, prefix) pairs
    that occur twice get a hash of the whole text. Which keys occur twice is broadcast
    as a bitmap of 2**bits bits, so no text is ever shuffled: a bitmap that fills up
    costs hashing, never a group. `bits` should exceed the log of the distinct keys.
    """
    base = df.select(F.col(id_col).alias("_id"), whole(F.col(text_col)).alias("_text"), *[F.col(c).alias(f"_carry_{c}") for c in carry])
    base = base.withColumn("_len", F.octet_length("_text")).withColumn("_len_key", F.xxhash64("_len"))
    lengths = repeated_keys(base.select(F.col("_len_key").alias("key")), bits)
    base = may_repeat(base, lengths, "_len_key", "_len_hit", bits)
    base = base.withColumn("_prefix_key", F.when(F.col("_len_hit"), F.xxhash64("_len", F.substring("_text", 1, prefix_chars))))
    prefixes = repeated_keys(base.filter("_len_hit").select(F.col("_prefix_key").alias("key")), bits)
    base = may_repeat(base, prefixes, "_prefix_key", "_prefix_hit", bits)
    # A row that did not survive is alone with its length, or with its length and prefix.
    full = F.when(F.col("_prefix_hit"), F.sha2("_text", 256)).otherwise(F.concat_ws(":", "_len", "_prefix_key"))
    rows = written(base.select("_id", *[f"_carry_{c}" for c in carry], full.alias("_key"), F.monotonically_increasing_id().alias("_uid")), "exact-dedup")
    groups = rows.groupBy("_key").agg(F.max(F.struct("_id", "_uid")).alias("_keep"), F.count(F.lit(1)).alias("group_size"))
    out = rows.join(groups, "_key")
    return out.select(
        F.col("_id").alias(id_col), F.col("_keep._id").alias("keep_id"), "group_size", (F.col("_uid") == F.col("_keep._uid")).alias("kept"),
        *[F.col(f"_carry_{c}").alias(c) for c in carry],
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, keep_id (of the row of equal texts that stays), group_size, kept and text_sha256."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(whole(F.col("text")), 256).alias("text_sha256"))
    return exact_dedup(docs, carry=("text_sha256",))


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

"""A corpus pipeline out of five of the operators in clausegrid.llm.

Every stage works on all rows its predecessor kept, and its decisions take effect:
toxic documents go, lines of recurring templates go, one document of each class of
near-duplicates stays, personal data gives way to its kind, and what is left is packed
into sequences. All stages but the last return the columns of documents, with n_chars
following the text. A stage cannot be stated in SQL, so there is no oracle; the tests
hold each stage against its operator and the operators against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid.llm.common import bound_batches, table, written
from clausegrid.llm.line_dedup import drop_recurring_lines
from clausegrid.llm.near_dedup import keep_one_of_each
from clausegrid.llm.packing import packed_rows
from clausegrid.llm.pii import find_pii, redacted
from clausegrid.llm.toxicity import fit, with_score

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REJECT = 0.7
#: Rows of an Arrow batch: five stages leave their buffers behind in the same executors, so batches are small.
BATCH_ROWS = 500


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose score reaches REJECT."""
    bound_batches(spark, BATCH_ROWS)
    docs = docs.select(*COLUMNS)
    model = fit(docs, table(spark, sf_dir, "labels"))
    return with_score(docs, model, score_col="_score").filter(F.col("_score") < REJECT).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines of recurring templates; every document stays."""
    bound_batches(spark, BATCH_ROWS)
    return _documents(drop_recurring_lines(docs, carry=("doc_id", "lang", "source")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates."""
    bound_batches(spark, BATCH_ROWS)
    return keep_one_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in angle brackets in the place of personal data and secrets; every document stays."""
    bound_batches(spark, BATCH_ROWS)
    found = find_pii(docs, carry=("doc_id", "text", "lang", "source"))
    text = F.when(F.size("spans") > 0, redacted(F.col("text"), F.col("spans"))).otherwise(F.coalesce("text", F.lit("")))
    return _documents(found.withColumn("text", text))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; the columns are those of op10_packing."""
    bound_batches(spark, BATCH_ROWS)
    return packed_rows(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs

"""Server-sent events and newline-delimited JSON, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EVENT = "type string, stage string, message string, progress int, data map<string,string>"
TOKEN = "response string, done boolean"


def to_sse(record: Column) -> Column:
    return F.concat(F.lit("data: "), F.to_json(record), F.lit("\n\n"))


def from_sse(lines: DataFrame, schema: str = EVENT, value: str = "value") -> DataFrame:
    """The events of lines that begin with `data: `; lines of other kinds and broken JSON are left out. Works on streams."""
    kept = lines.filter(F.startswith(value, F.lit("data: ")))
    event = F.from_json(F.substring(value, 7, 1 << 30), schema)
    return kept.withColumn("event", event).filter(F.col("event").isNotNull() & F.exists(F.array(*[F.col(f"event.{c.split()[0]}").isNotNull() for c in schema.split(", ")]), lambda x: x))


def from_ndjson(lines: DataFrame, value: str = "value", schema: str = TOKEN) -> DataFrame:
    """One token a line; malformed lines have a null token."""
    return lines.withColumn("chunk", F.from_json(value, schema)).withColumn("token", F.col("chunk.response")).withColumn("done", F.coalesce("chunk.done", F.lit(False))).drop("chunk")


def until_done(tokens: DataFrame, key: str, seq: str) -> DataFrame:
    """The lines of each stream up to the first that says it is done, that one included."""
    end = F.min(F.when(F.col("done"), F.col(seq))).over(Window.partitionBy(key))
    return tokens.withColumn("_end", end).filter(F.col("_end").isNull() | (F.col(seq) <= F.col("_end"))).drop("_end")

"""Chat prompts from the last turns, and metrics of token streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausegrid.functions.text import capitalized


def prompts(turns: DataFrame, k: int = 10, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """For each turn the prompt that its text would get: the k turns before it, in order, then itself."""
    before = Window.partitionBy(conv).orderBy(turn).rowsBetween(-k, -1)
    line = F.concat(capitalized(F.col("role")), F.lit(": "), F.col("text"), F.lit("\n"))
    context = F.coalesce(F.array_join(F.collect_list(line).over(before), ""), F.lit(""))
    return turns.select(conv, turn, F.concat(context, F.lit("User: "), F.col("text"), F.lit("\nAssistant:")).alias("prompt"))


def token_metrics(chunks: DataFrame, key: str, seq: str, token: str, at: str, start: str) -> DataFrame:
    """Answer, number of tokens, time to the first token, total time and tokens per second of each stream.

    A null token is a line that was malformed or had no token: it counts for time alone.
    Without any token the time to the first is the total time; without time the rate is 0.
    """
    has = F.col(token).isNotNull()
    out = chunks.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(has, F.struct(seq, token)))), lambda x: x[token]), "").alias("response"),
        F.count_if(has).alias("total_tokens"), F.min(F.when(has, F.col(at))).alias("_first"), F.max(at).alias("_last"), F.min(start).alias("_start"),
    )
    total = F.col("_last") - F.col("_start")
    return out.select(
        key, "response", "total_tokens", F.round(F.coalesce(F.nullif(F.col("_first") - F.col("_start"), F.lit(0.0)), total), 6).alias("time_to_first_token"),
        F.round(total, 6).alias("total_time"), F.round(F.when(total > 0, F.col("total_tokens") / total).otherwise(0.0), 6).alias("tokens_per_second"),
    )


EVENT = "seq long, type string, content string, time_to_first_token double, total_tokens long, total_time double, tokens_per_second double"


def events(chunks: DataFrame, key: str, seq: str, token: str, at: str, start: str, error: str | None = None) -> DataFrame:
    """The events of streams of chunks, as a client gets them: a metric, the time to the first token, then the tokens in order, then complete with all that was measured and the answer as content.

    A chunk with an `error` ends its stream there: tokens before it stay, an event of type error with
    its message takes the place of complete, and what comes after it goes. A stream without a token has no metric and no tokens. Events are numbered
    from 0 without gaps. Null tokens are chunks that were malformed: they count for time alone.
    """
    broke = F.col(error) if error else F.lit(None).cast("string")
    stream = Window.partitionBy(key)
    rows = chunks.select(key, F.col(seq).alias("_seq"), F.col(token).alias("_token"), F.col(at).alias("_at"), F.col(start).alias("_start"), broke.alias("_error"))
    rows = rows.withColumn("_end", F.min(F.when(F.col("_error").isNotNull(), F.col("_seq"))).over(stream)).filter("_end IS NULL OR _seq <= _end")
    said = rows.filter("_token IS NOT NULL AND _error IS NULL")
    none = lambda *names: [F.lit(None).cast(dict(c.split() for c in EVENT.split(", "))[n]).alias(n) for n in names]
    tokens = said.select(key, F.row_number().over(stream.orderBy("_seq")).cast("long").alias("seq"), F.lit("token").alias("type"), F.col("_token").alias("content"), *none("time_to_first_token", "total_tokens", "total_time", "tokens_per_second"))
    whole = token_metrics(rows.withColumn("_token", F.when(F.col("_error").isNull(), F.col("_token"))), key, "_seq", "_token", "_at", "_start")
    ends = rows.groupBy(key).agg(F.max("_error").alias("_error"))
    whole = whole.join(ends, key)
    last = F.when(F.col("total_tokens") > 0, F.col("total_tokens") + 1).otherwise(0).cast("long")
    done = whole.filter("_error IS NULL").select(key, last.alias("seq"), F.lit("complete").alias("type"), F.col("response").alias("content"), "time_to_first_token", "total_tokens", "total_time", "tokens_per_second")
    lost = whole.filter("_error IS NOT NULL").select(key, last.alias("seq"), F.lit("error").alias("type"), F.col("_error").alias("content"), *none("time_to_first_token", "total_tokens", "total_time", "tokens_per_second"))
    first = whole.filter("total_tokens > 0").select(key, F.lit(0).cast("long").alias("seq"), F.lit("metric").alias("type"), *none("content"), "time_to_first_token", *none("total_tokens", "total_time", "tokens_per_second"))
    return first.unionByName(tokens).unionByName(done).unionByName(lost)

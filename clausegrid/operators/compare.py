"""Comparisons with results: a provider is asked, each answer is measured while it comes, and verdicts are read out of it."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.operators import verdicts as V
from clausegrid.operators.clauses import blank_or_large
from clausegrid.streaming.comparisons import request_fault, target_rows

#: Yields the tokens of an answer as they come.
Provider = Callable[[str], Iterable[str]]
Clock = Callable[[], float]
REPLY = "struct<answer:string,error:string,total_tokens:long,time_to_first_token:double,total_time:double,tokens_per_second:double>"
_FLAT = "answer string, error string, total_tokens long, time_to_first_token double, total_time double"


def one_token(answer: Callable[[str], str]) -> Provider:
    """A provider out of a function that gives its answer as a whole."""
    return lambda prompt: iter((answer(prompt),))


def asked_once(prompt: str, provider: Provider, clock: Clock) -> tuple[str | None, str | None, int, float, float]:
    """answer, error, number of tokens, time to the first, time in all. Without any token the first counts as the last; a failure has an error and no time."""
    begin, parts, first = clock(), [], None
    try:
        for token in provider(prompt):
            if first is None:
                first = clock() - begin
            parts.append(token)
    except Exception as problem:  # a failed call is a row, never a failed run
        return None, str(problem) or type(problem).__name__, 0, 0.0, 0.0
    total = clock() - begin
    return "".join(parts), None, len(parts), first or total, total


def ask(rows: DataFrame, prompt: Column, provider: Provider, concurrency: int = 5, clock: Callable[[], Clock] = lambda: time.monotonic) -> DataFrame:
    """`rows` with `reply`: (answer, error, total_tokens, time_to_first_token, total_time, tokens_per_second).

    Each distinct prompt is asked once; prompts are told apart by their SHA-256, and their texts cross the network
    once, to where they are asked. At most `concurrency` calls run at a time in a task, and a task takes prompts as it
    gets on, so a slow one does not hold up others. `clock` makes a clock for each call. A null prompt has a
    null reply. Other columns stay, but the names reply, _prompt and _key are taken.
    """
    keyed = rows.withColumns({"_prompt": prompt}).withColumn("_key", F.sha2("_prompt", 256))
    distinct = keyed.filter("_key IS NOT NULL").groupBy("_key").agg(F.first("_prompt").alias("_prompt"))
    return keyed.drop("_prompt").join(_replies(distinct, provider, concurrency, clock), "_key", "left").drop("_key")


def _replies(distinct: DataFrame, provider: Provider, concurrency: int = 5, clock: Callable[[], Clock] = lambda: time.monotonic) -> DataFrame:
    """(_key, reply) of prompts (_key, _prompt), each asked once."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                found = list(pool.map(lambda p: asked_once(p, provider, clock()), batch["_prompt"]))
                made = pd.DataFrame(found, columns=[c.split()[0] for c in _FLAT.split(", ")])
                yield made.astype({"answer": object, "error": object}).assign(_key=batch["_key"].to_numpy())

    replies = distinct.mapInPandas(call, f"{_FLAT}, _key {distinct.schema['_key'].dataType.simpleString()}")
    rate = F.when(F.col("total_time") > 0, F.col("total_tokens") / F.col("total_time")).otherwise(0.0)
    return replies.select("_key", F.struct("answer", "error", "total_tokens", "time_to_first_token", "total_time", rate.alias("tokens_per_second")).alias("reply"))


def _judged(rows: DataFrame, conflict: Callable[[Column], Column]) -> DataFrame:
    """conflict, explanation, severity and performance out of a reply; a failed call has no conflict, the severity Error and no performance."""
    answer, error = F.col("reply.answer"), F.col("reply.error")
    failed = error.isNotNull()
    return rows.withColumns({
        "conflict": F.when(failed, False).otherwise(conflict(answer)), "explanation": F.when(failed, F.concat(F.lit("Error: "), error)).otherwise(answer), "severity": F.when(failed, "Error").otherwise(V.severity(answer)),
        "performance": F.struct("reply.time_to_first_token", "reply.tokens_per_second", "reply.total_time", "reply.total_tokens"),
    }).drop("reply")


def compare_one(pairs: DataFrame, provider: Provider, **how) -> DataFrame:
    """`pairs` (prompt, clause_a, clause_b and any keys) with `response`, the answer as it came, and `error`, of which one is null.

    A blank prompt or clause is an error, and is not asked.
    """
    blank = F.trim(F.coalesce("clause_b", F.lit(""))) == ""
    rows = pairs.withColumn("_fault", F.coalesce(request_fault(F.col("prompt"), F.col("clause_a"), F.array("clause_b")), F.when(blank, "blank clause")))
    keys = [c for c in pairs.columns if c not in ("prompt", "clause_a", "clause_b")]
    told = ask(rows, F.when(F.col("_fault").isNull(), V.single_prompt(F.col("prompt"), F.col("clause_a"), F.col("clause_b"))), provider, **how)
    return told.select(*keys, F.col("reply.answer").alias("response"), F.coalesce("_fault", "reply.error").alias("error"))


def compare_one_to_many(requests: DataFrame, provider: Provider, **how) -> DataFrame:
    """Results of requests (run_id, prompt, source, targets): run_id, index, total, conflict, explanation, severity, performance.

    A request has 1 to 100 targets, a prompt and a source that are not blank; others have no results, see
    request_fault. The index counts a request's targets from 0.
    """
    good = requests.filter(request_fault(F.col("prompt"), F.col("source"), F.col("targets")).isNull())
    rows = target_rows(good)
    told = ask(rows, V.target_prompt(F.col("prompt"), F.col("source"), F.col("index"), F.col("target")), provider, **how)
    return _judged(told, V.conflict_one_to_many).select("run_id", "index", "total", "conflict", "explanation", "severity", "performance")


def compare_all(items: DataFrame, pair_prompt: Column, self_prompt: Column, provider: Provider, id_col: str = "doc_id", most: int = 50, **how) -> DataFrame:
    """Results of every clause (id, pos, content) against itself and all others of its document: id, i, j, is_self_check, pair_order, conflict, explanation, severity, performance.

    A document is compared if it has 2 to `most` clauses, none of them blank or over 50,000 characters; others are refused, see
    blank_or_large. So no document has more than most * (most + 1) / 2 pairs.
    """
    fit = blank_or_large(items, id_col, most=most).filter("ok").select(id_col)
    prompt = F.when(F.col("is_self_check"), self_prompt).otherwise(pair_prompt)
    pairs, asked = V.pair_prompts(items.join(fit, id_col, "left_semi"), prompt, id_col)
    told = pairs.join(_replies(asked, provider, **how), "_key", "left")
    return _judged(told, V.conflict_all_pairs).select(id_col, "i", "j", "is_self_check", "pair_order", "conflict", "explanation", "severity", "performance")


def performance(results: DataFrame, by: list[str]) -> DataFrame:
    """Sums of the performance of results that did not fail: n, tokens, seconds, tokens a second, and the longest wait for a first token."""
    good = results.filter("severity <> 'Error'")
    seconds = F.sum("performance.total_time")
    return good.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("performance.total_tokens").alias("tokens"), seconds.alias("seconds"), F.when(seconds > 0, F.sum("performance.total_tokens") / seconds).otherwise(0.0).alias("tokens_per_second"), F.max("performance.time_to_first_token").alias("longest_wait"))

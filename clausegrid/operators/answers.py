"""What services say, read into columns: the text of a reply, checks of clauses, the parts of bilingual texts, and what an upload came to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.functions.text import snippet, strip

CHECK = "is_valid boolean, confidence_score double, quality_score double, boundary_correct boolean, is_toc_entry boolean, issues array<string>, suggestions array<string>"
#: Letters of the Arabic script.
ARABIC = r"[؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿]"

PARTIES_ASKED = (
    "Name all parties to the contract below by their official names.\n- Look at who is defined as a party, after words like BETWEEN and AND; there may be more than two.\n"
    '- Leave out addresses, licence numbers, postal codes and what stands in brackets behind a name.\n- Answer with a JSON list of the names alone, as in ["First Party LLC", "Second Party Inc"].\n\nText:\n'
)


def party_prompt(text: Column, words: int = 4000) -> Column:
    """What a model is asked about the parties, with the first words of the text."""
    return F.concat(F.lit(PARTIES_ASKED), snippet(text, words), F.lit("\n"))


def content_of(reply: Column) -> Column:
    """The text in a chat reply, a JSON object: that of message, else of the first of choices; null if it is empty, missing or no JSON."""
    message, choice = F.get_json_object(reply, "$.message.content"), F.get_json_object(reply, "$.choices[0].message.content")
    whole = F.when(F.get_json_object(reply, "$.message").isNotNull(), message).otherwise(choice)
    return F.nullif(whole, F.lit(""))


def check_of(answer: Column) -> Column:
    """The struct of a clause's check in a model's answer, with or without a code fence around it; null if it is none."""
    bare = strip(F.regexp_replace(strip(answer), r"(?s)\A```(?:json)?\s*|\s*```\z", ""))
    found = F.from_json(bare, CHECK)
    return F.when(found["is_valid"].isNotNull() | found["quality_score"].isNotNull(), found)


def good_clauses(clauses: DataFrame, check: str = "check", quality: float = 0.5) -> DataFrame:
    """Clauses whose check says that they are valid, of enough quality and no line of a table of contents. One without a check stays: nothing speaks against it."""
    c = F.col(check)
    bad = (~F.coalesce(c["is_valid"], F.lit(True))) | (F.coalesce(c["quality_score"], F.lit(1.0)) < quality) | F.coalesce(c["is_toc_entry"], F.lit(False))
    return clauses.filter(c.isNull() | ~bad)


def bilingual(text: Column) -> Column:
    """(is_bilingual, english_text, arabic_text): the lines with Arabic letters, and those with other letters alone; null where there is none."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x.rlike(r"\p{L}"))
    joined = lambda rows: F.nullif(F.array_join(rows, "\n"), F.lit(""))
    english, arabic = joined(F.filter(lines, lambda x: ~x.rlike(ARABIC))), joined(F.filter(lines, lambda x: x.rlike(ARABIC)))
    return F.struct((english.isNotNull() & arabic.isNotNull()).alias("is_bilingual"), english.alias("english_text"), arabic.alias("arabic_text"))


def bilingual_lengths(clauses: DataFrame, keys: list[str], text: str = "content") -> DataFrame:
    """The keys, is_bilingual, english_length, arabic_length and original_length, 0 for what is not there."""
    rows = clauses.select(*keys, bilingual(F.col(text)).alias("b"), F.col(text).alias("_t"))
    size = lambda c: F.coalesce(F.length(c), F.lit(0)).cast("long")
    return rows.select(*keys, "b.is_bilingual", size(F.col("b.english_text")).alias("english_length"), size(F.col("b.arabic_text")).alias("arabic_length"), size(F.col("_t")).alias("original_length"))


def upload_summary(contracts: DataFrame, parties: DataFrame, kept: DataFrame, found: DataFrame) -> DataFrame:
    """What each upload came to: id, clause_count, removed_count (of those found, what did not stay) and party_count, 0 for what is not there.

    `kept` and `found` are main clauses, parties and clauses by contract_id.
    """
    out = contracts.select("id")
    for rows, name in ((kept, "clause_count"), (found, "_found"), (parties, "party_count")):
        n = rows.groupBy(F.col("contract_id").alias("id")).agg(F.count(F.lit(1)).alias(name))
        out = out.join(n, "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.select("id", "clause_count", (F.col("_found") - F.col("clause_count")).alias("removed_count"), "party_count")


def recent_status_counts(contracts: DataFrame, now: Column, days: int = 1) -> DataFrame:
    """How many contracts of the last days are in each status."""
    return contracts.filter(F.col("created_at") > now - F.expr(f"INTERVAL {days} DAY")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))

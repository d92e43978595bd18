"""What clauses claim, and which claims contradict each other by rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.operators.review import function_of
from clausegrid.operators.values import values_of

# Modalities that exclude each other, and the rules in the order in which they are tried.
OPPOSITES = (("MUST", "MUST_NOT"), ("SHALL", "SHALL_NOT"), ("MUST", "PROHIBITED"), ("REQUIRED", "FORBIDDEN"), ("PERMITTED", "PROHIBITED"))
RULES = ("modality", "value", "jurisdiction", "payment_timing", "lock_up")
#: How a modality reads; the first that is found.
MODALITIES = {
    "MUST_NOT": r"(?i)\bmust\s+not\b", "SHALL_NOT": r"(?i)\bshall\s+not\b", "PROHIBITED": r"(?i)\bprohibited\b", "FORBIDDEN": r"(?i)\bforbidden\b", "REQUIRED": r"(?i)\brequired\b", "PERMITTED": r"(?i)\bpermitted\b",
    "MUST": r"(?i)\bmust\b", "SHALL": r"(?i)\bshall\b",
}
SUBJECT = r"(?i)\bthe\s+([a-z]+)\s+(?:shall|must|may|will|is|are)\b"
OVERRIDES = r"(?i)notwithstanding|shall\s+prevail|takes?\s+precedence"
OVERRIDDEN = r"(?i)notwithstanding\s+(?:clause|section|article|paragraph)\s+([0-9]+(?:\.[0-9]+)*)"
LOCK_UP = r"(?i)\block[\s-]?up\b"
CLAIM = ("claim_id", "topic", "subject", "modality", "value_type", "value", "clause", "is_override", "overrides")


def bare_number(number: Column) -> Column:
    return F.regexp_replace(number, r"[.)]+$", "")


def topic_of(text: Column) -> Column:
    return F.when(text.rlike(LOCK_UP), "LOCK_UP").otherwise(function_of(text))


def modality_of(text: Column) -> Column:
    """The modality of a text; null if it has none."""
    return F.coalesce(*[F.when(text.rlike(pattern), F.lit(name)) for name, pattern in MODALITIES.items()])


def claims_of(clauses: DataFrame, scope: list[str], number: str = "clause_number", text: str = "content") -> DataFrame:
    """The claims of clauses: a row per value stated, one without a value where none is.

    Columns: the scope, then claim_id, which is made of the scope's and clause's place, topic, subject (who shall or must, in
    small letters), modality, value_type, value, clause, is_override, overrides (the clause that is named behind notwithstanding).
    `clauses` has the scope's columns, `pos`, a number and a text; a null text claims nothing.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    found = lambda pattern: F.nullif(F.regexp_extract(content, pattern, 1), F.lit(""))
    rows = clauses.select(*scope, "pos", content.alias("_text"), bare_number(F.col(number)).alias("clause"), F.lower(found(SUBJECT)).alias("subject"), found(OVERRIDDEN).alias("overrides"))
    text_ = F.col("_text")
    rows = rows.filter(text_ != "").withColumns({"topic": topic_of(text_), "modality": modality_of(text_), "is_override": text_.rlike(OVERRIDES)})
    rows = rows.select("*", F.posexplode_outer(values_of(text_)).alias("at", "v"))
    claim_id = F.concat_ws("/", *[F.col(c).cast("string") for c in scope], F.col("pos").cast("string"), F.coalesce("at", F.lit(0)).cast("string"))
    return rows.select(*scope, claim_id.alias("claim_id"), "topic", "subject", "modality", F.col("v.kind").alias("value_type"), F.col("v.value").alias("value"), "clause", "is_override", "overrides")


def _sides(a: DataFrame, b: DataFrame, keys: list[str], rule: str, scope: list[str]) -> DataFrame:
    """Pairs of the claims (c) of both sides that share the keys."""
    joined = a.withColumnRenamed("c", "_a").join(b.withColumnRenamed("c", "_b"), keys)
    return joined.select(*scope, F.col("topic"), F.col("_a"), F.col("_b"), F.lit(RULES.index(rule)).alias("rule"))


def _unequal(claims: DataFrame, keys: list[str], rule: str, scope: list[str]) -> DataFrame:
    """Pairs with different values under the same keys: values are paired first, each once, then give way to the claims that state them.

    So claims that agree never meet, however many they are.
    """
    values = claims.select(*keys, "_value").distinct()
    pairs = values.withColumnRenamed("_value", "_one").join(values.withColumnRenamed("_value", "_other"), keys).filter(F.col("_one") < F.col("_other"))
    one = claims.select(*keys, F.col("_value").alias("_one"), F.col("c").alias("_a")).join(pairs, [*keys, "_one"])
    both = one.join(claims.select(*keys, F.col("_value").alias("_other"), F.col("c").alias("_b")), [*keys, "_other"])
    return both.select(*scope, "topic", "_a", "_b", F.lit(RULES.index(rule)).alias("rule"))


def _all_of(claims: DataFrame, keys: list[str], rule: str, scope: list[str]) -> DataFrame:
    """All pairs under the same keys: what the two rules on durations ask for."""
    pairs = _sides(claims, claims, keys, rule, scope)
    return pairs.filter(F.col("_a.id") < F.col("_b.id"))


def find_conflicts(claims: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, i, j, topic, rule) for claims of one scope and topic that contradict; i < j, each pair once, with the first rule that it breaks.

    modality: one subject, modalities that exclude each other. value: one subject and kind of value, but other
    values. jurisdiction: other jurisdictions, whatever the subject. payment_timing: two durations of one subject in the
    topic PAYMENT. lock_up: two durations in a topic of lock-up. A pair of which one claim overrides the other's clause is none.
    Null subjects count as the same subject; claims without a value break no rule on values, but for jurisdictions,
    where none differs from any. Each rule joins on all that it asks for, and claims that cannot
    contradict never meet, so the work follows the number of conflicts. Each rule reads the claims anew: hand in a stored table.
    """
    c = F.struct(F.col("claim_id").alias("id"), "clause", "is_override", "overrides").alias("c")
    rows = claims.select(*scope, "topic", F.coalesce("subject", F.lit("\u0000")).alias("subject"), "modality", "value_type", F.nullif("value", F.lit("")).alias("value"), c)
    by_subject = [*scope, "topic", "subject"]
    sides = [rows.select(*by_subject, F.explode(F.array_compact(F.array(*[F.when(F.col("modality") == pair[s], F.lit(k)) for k, pair in enumerate(OPPOSITES)]))).alias("k"), "c") for s in (0, 1)]
    durations = rows.filter("value_type = 'DURATION'")
    valued = rows.filter("value IS NOT NULL AND value_type IS NOT NULL").withColumn("_value", F.col("value"))
    places = rows.filter("value_type = 'JURISDICTION'").withColumn("_value", F.coalesce("value", F.lit("\u0000")))
    found = [
        _sides(*sides, [*by_subject, "k"], "modality", scope), _unequal(valued, [*by_subject, "value_type"], "value", scope), _unequal(places, [*scope, "topic"], "jurisdiction", scope),
        _all_of(durations.filter("topic = 'PAYMENT'"), by_subject, "payment_timing", scope), _all_of(durations.filter(F.contains(F.lower("topic"), F.lit("lock"))), [*scope, "topic"], "lock_up", scope),
    ]
    pairs = reduce(DataFrame.unionByName, found)
    over = lambda x, y: F.col(f"{x}.is_override") & F.coalesce(F.col(f"{x}.overrides") == F.col(f"{y}.clause"), F.lit(False))
    pairs = pairs.filter(~(F.coalesce(over("_a", "_b"), F.lit(False)) | F.coalesce(over("_b", "_a"), F.lit(False))))
    pairs = pairs.select(*scope, F.least("_a.id", "_b.id").alias("i"), F.greatest("_a.id", "_b.id").alias("j"), "topic", "rule")
    first = pairs.groupBy(*scope, "i", "j", "topic").agg(F.min("rule").alias("rule"))
    return first.withColumn("rule", F.element_at(F.array(*map(F.lit, RULES)), F.col("rule") + 1))

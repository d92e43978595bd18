"""Documented review rules: clause filters, classes, candidate tiers, claims and conflict reports.

These follow written descriptions; where those leave a list or threshold open it is a
parameter here, with the default stated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausegrid.functions.text import strip, words

LEGAL = r"(?i)\b(shall|must|will|may|agrees?|undertakes?|warrants?|liable)\b"
OVERRIDE = r"(?i)notwithstanding|subject to|except as|in the event of (?:any )?conflict|shall prevail|supersedes?|takes? precedence"
REFERENCE = r"(?i)(?:clause|section|article|paragraph)\s+(\d+(?:\.\d+)*)"
PROCEDURE = ("notice", "procedure", "mediation", "escalation")
JURISDICTION = ("jurisdiction", "governing law", "courts of")
#: Function of a clause by what it mentions; the first that fits.
FUNCTIONS = {
    "PAYMENT": r"(?i)\b(payment|invoice|fees?|price)\b", "TERMINATION": r"(?i)\bterminat", "CONFIDENTIALITY": r"(?i)\bconfidential", "INDEMNITY_LIABILITY": r"(?i)\b(indemnif|indemnit|liabilit|liable)",
    "IP": r"(?i)\b(intellectual property|copyright|licen[cs]e)", "GOVERNING_LAW": r"(?i)\b(governing law|jurisdiction)\b", "DISPUTE": r"(?i)\b(arbitration|dispute|mediation)", "NOTICE": r"(?i)\bnotices?\b",
    "FORCE_MAJEURE": r"(?i)\bforce majeure\b", "ASSIGNMENT": r"(?i)\bassign", "TERM": r"(?i)\b(term|duration|commencement)\b",
}
ALLOWED_ACROSS = (("INDEMNITY_LIABILITY", "CONFIDENTIALITY"), ("CONFIDENTIALITY", "INDEMNITY_LIABILITY"))


def toc_line(line: Column) -> Column:
    """A line of a table of contents: number, heading and page; tabbed parts with a page; or a leader of dots."""
    numbered = line.rlike(r"^\d+(?:\.\d+)*\.?\s+\S.*\s\d{1,3}$") & (F.length(line) < 100)
    tabs = F.split(line, "\t")
    return numbered | ((F.size(tabs) >= 3) & F.element_at(tabs, -1).rlike(r"^\d+$")) | line.rlike(r"\.{5,}") | F.lower(line).rlike(r"^\s*(table of )?contents\s*$")


def is_stub(text: Column) -> Column:
    """A clause that only leads up to others."""
    bare = strip(text)
    agreed = bare.rlike(r"(?is)it is (?:hereby )?agreed that:?.{0,19}$")
    return bare.endswith(":") | agreed | ((F.length(bare) < 30) & ~bare.rlike(LEGAL))


def is_short_stub(text: Column, chars: int = 180, few_words: int = 15) -> Column:
    bare = strip(text)
    return (F.length(bare) < chars) & (bare.endswith(":") | (bare.rlike(r"(?i)agreed that|as follows") & (F.size(words(bare)) < few_words)))


def is_substantive(text: Column, min_words: int = 10, min_chars: int = 50) -> Column:
    return ((F.size(words(text)) >= min_words) & (F.length(strip(text)) >= min_chars)) | text.rlike(LEGAL) | text.rlike(r'(?i)"[^"]+"\s+(means|refers to)')


def removal_reason(text: Column) -> Column:
    """In the order of the pipeline: toc, stub, no_content, or null for a clause that stays."""
    return F.when(toc_line(text), "toc").when(is_stub(text), "stub").when(~is_substantive(text), "no_content")


def in_detection(number: Column, heading: Column, text: Column) -> Column:
    return ~(F.startswith(number, F.lit("0.")) | (F.upper(heading).isin("APPENDIX", "SCHEDULE", "ANNEX", "EXHIBIT") & (F.length(text) < 50)) | F.contains(F.upper(text), F.lit("TABLE OF CONTENTS")))


def function_of(text: Column) -> Column:
    out = F.lit("GENERAL")
    for name, pattern in reversed(FUNCTIONS.items()):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def gate(first: Column, second: Column, bypass: Column) -> Column:
    """Whether two functions may be compared."""
    across = reduce(lambda a, b: a | b, [(first == x) & (second == y) for x, y in ALLOWED_ACROSS])
    return (first == second) | across | bypass


def _mentions(text: Column, terms: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(t)) for t in terms])


def procedure_against_jurisdiction(a: Column, b: Column) -> Column:
    """A pair to drop: one side is about procedure and not about jurisdiction."""
    only = lambda t: _mentions(t, PROCEDURE) & ~_mentions(t, JURISDICTION)
    return only(a) | only(b)


def severity_by_confidence(c: Column) -> Column:
    return F.when(c >= 0.95, "CRITICAL").when(c >= 0.90, "HIGH").when(c >= 0.85, "MEDIUM").otherwise("LOW")


def severity_by_materiality(materiality: Column, kind: Column, function: Column, classification: Column) -> Column:
    """The last rule that applies wins."""
    out = F.when(function.isin("PAYMENT", "TERMINATION", "INDEMNITY_LIABILITY"), "HIGH").otherwise(materiality)
    out = F.when(kind == "JurisdictionMismatch", "CRITICAL").otherwise(out)
    return F.when(classification == "AMBIGUITY", "MEDIUM").otherwise(out)


def references(text: Column) -> Column:
    """Clause numbers that a text refers to, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1)))


def override_pairs(clauses: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Clauses with override words beside the clauses they name."""
    over = clauses.filter(F.col("content").rlike(OVERRIDE)).select(F.col(id_col).alias("id"), F.col("pos").alias("i"), F.explode(references(F.col("content"))).alias("number"))
    named = clauses.select(F.col(id_col).alias("id"), F.col("pos").alias("j"), F.regexp_replace("clause_number", r"[.)]$", "").alias("number"))
    return over.join(named, ["id", "number"]).filter("i <> j").withColumnRenamed("id", id_col)


def split_long(clauses: DataFrame, most: int = 2500) -> DataFrame:
    """Clauses over `most` characters become parts at (1) (2) marks, else at headings in capitals with a colon, else at sentence ends; parts are numbered n.k."""
    marks = F.split(F.regexp_replace("content", r"\s(?=\(\d+\)\s)", "\x01"), "\x01")
    headed = F.split(F.regexp_replace("content", r"\s([A-Z][A-Z ]{2,}:)", "\x01$1"), "\x01")
    sentences = F.split(F.regexp_replace("content", r"(?<=[.!?])\s+(?=\p{Lu})", "\x01"), "\x01")
    parts = F.when(F.length("content") <= most, F.array("content")).when(F.size(marks) > 1, marks).when(F.size(headed) > 1, headed).otherwise(sentences)
    rows = clauses.withColumn("_parts", parts).select("*", F.posexplode("_parts").alias("part", "part_text"))
    several = F.size("_parts") > 1
    number = F.regexp_replace("clause_number", r"[.)]$", "")
    return rows.withColumn("split_from", F.when(several, F.col("clause_number"))).withColumn("clause_number", F.when(several, F.concat(number, F.lit("."), F.col("part") + 1)).otherwise(F.col("clause_number"))).withColumn("content", F.col("part_text")).drop("_parts", "part_text")


def hierarchy(numbered: DataFrame, id_col: str, pos: str, number: str) -> DataFrame:
    """depth and parent number: 2.1 hangs below 2; (a) below the last dotted number before it."""
    dotted = F.when(F.col(number).rlike(r"^\d+(\.\d+)*$"), F.col(number))
    above = F.last(dotted, ignorenulls=True).over(Window.partitionBy(id_col).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1))
    parent = F.when(dotted.isNull(), above).when(F.contains(F.col(number), F.lit(".")), F.regexp_replace(number, r"\.\d+$", ""))
    dots = lambda c: F.size(F.split(c, r"\."))
    depth = F.when(dotted.isNotNull(), dots(dotted)).otherwise(F.coalesce(dots(above), F.lit(0)) + 1)
    return numbered.withColumn("parent_number", parent).withColumn("depth", depth)


def claim_conflicts(claims: DataFrame) -> DataFrame:
    """Pairs of claims on one topic that contradict: opposite modality, or other values of one kind and subject."""
    a, b = claims.alias("a"), claims.alias("b")
    opposite = (F.col("a.modality") != F.col("b.modality")) & (F.col("a.action") == F.col("b.action"))
    differs = (F.col("a.value_type") == F.col("b.value_type")) & (F.col("a.subject") == F.col("b.subject")) & (F.col("a.value") != F.col("b.value"))
    pairs = a.join(b, (F.col("a.topic") == F.col("b.topic")) & (F.col("a.claim_id") < F.col("b.claim_id")) & (opposite | differs))
    return pairs.select(F.col("a.claim_id").alias("i"), F.col("b.claim_id").alias("j"), F.col("a.topic").alias("topic"), F.when(opposite, "modality").otherwise("value").alias("rule"))


def stored(conflicts: DataFrame, least: float = 0.85) -> DataFrame:
    return conflicts.filter(F.col("classification").isin("TRUE_CONFLICT", "AMBIGUITY") & (F.col("confidence") >= least))


def longest_of_each_number(clauses: DataFrame, id_col: str = "doc_id") -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(id_col, "clause_number").orderBy(F.desc(F.length("content")), "pos"))
    return clauses.withColumn("_rn", rn).filter("_rn = 1").drop("_rn")


def route(n: Column) -> Column:
    return F.when(n <= 50, "fast").when(n <= 150, "medium").otherwise("smart")


def is_appendix(number: Column) -> Column:
    return F.upper(number).rlike("APPENDIX|SCHEDULE|EXHIBIT")


def first_list(answer: Column) -> Column:
    """The list in a JSON object under conflicts, results, data or conflict_list, the first that is there; a JSON list is itself."""
    found = [F.get_json_object(answer, f"$.{name}") for name in ("conflicts", "results", "data", "conflict_list")]
    return F.when(F.startswith(F.ltrim(answer), F.lit("[")), answer).otherwise(F.coalesce(*found))


def cut_text(text: Column, most: int = 1000) -> Column:
    return F.substring(text, 1, most)


def topic_counts(claims: DataFrame, topic: str = "topic") -> DataFrame:
    return claims.groupBy(topic).agg(F.count(F.lit(1)).alias("n"))

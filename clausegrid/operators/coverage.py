"""Where clauses stand in a text, and how much of it they cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausegrid.functions.text import OPEN, strip
from clausegrid.operators import clauses as C


def _stretches(piece: Column) -> Column:
    """What a clause keeps of its piece, as array of (start, end) within it: neither the white space around it nor lines of equal signs."""
    bare = strip(piece)
    lead = F.length(piece) - F.length(F.regexp_replace(piece, r"(?U)\A\s+", ""))
    kept = F.transform(F.split(bare, C.RULES, -1), lambda p: F.length(p))
    left_out = F.concat(F.transform(F.regexp_extract_all(bare, F.lit(C.RULES), F.lit(0)), lambda p: F.length(p)), F.array(F.lit(0)))
    begin = F.struct(lead.alias("at"), F.expr("CAST(array() AS array<struct<start:int,end:int>>)").alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + x["k"] + x["g"]).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + x["k"]).alias("end")))).alias("out"))
    return F.filter(F.aggregate(F.zip_with(kept, left_out, lambda k, g: F.struct(k.alias("k"), g.alias("g"))), begin, step, lambda acc: acc["out"]), lambda s: s["end"] > s["start"])


def clause_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, clause_number, start, end, is_toc): the stretches of normalized and capitalized text that make up each clause with its sub-clauses.

    Offsets count code points, ends are exclusive. A clause has a stretch for each part between lines of equal signs.
    Lengths alone are summed up over a document; its text is not carried along.
    """
    first = F.length(F.regexp_extract(F.regexp_replace(F.col(text_col), r"(^|\n)((?U:\d){1,2}[.)])((?U:\s))", f"$1{OPEN}$2$3"), f"(?s)\\A([^{OPEN}]*)", 1))
    rows = C._pieces(df.select(id_col, text_col), id_col, text_col)
    body = C._body(F.col("piece"))
    rows = rows.select(id_col, "pos", C._number(F.col("piece")).alias("clause_number"), F.length("piece").alias("_n"), C.is_toc(C._own(body, C._parts(body))).alias("is_toc"), _stretches(F.col("piece")).alias("_s"))
    rows = rows.join(df.select(F.col(id_col).alias("_id"), first.alias("_first")), F.col(id_col) == F.col("_id"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_first")
    rows = rows.withColumn("_at", before).select(id_col, "pos", "clause_number", "is_toc", "_at", F.explode("_s").alias("s"))
    return rows.select(id_col, "pos", "clause_number", (F.col("_at") + F.col("s.start")).alias("start"), (F.col("_at") + F.col("s.end")).alias("end"), "is_toc")


def united(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end): the union of spans, as stretches that neither overlap nor touch. Empty spans and those with a null end or start count for nothing."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.filter(F.col("end") > F.col("start")).select(*keys, "start", "end")
    rows = rows.withColumn("_new", F.when(F.col("start") <= reach, 0).otherwise(1))
    rows = rows.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def coverage(texts: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, covered, gaps, coverage): how many characters the spans cover together, in how many stretches there are holes, and the share in percent.

    Texts without spans cover nothing; an empty or null text has a coverage of 0.
    """
    parts = united(spans, [id_col]).groupBy(id_col).agg(F.sum(F.col("end") - F.col("start")).alias("covered"), F.count(F.lit(1)).alias("_n"), F.min("start").alias("_from"), F.max("end").alias("_to"))
    out = texts.select(id_col, F.length(F.coalesce(text_col, F.lit(""))).cast("long").alias("n_chars")).join(parts, id_col, "left")
    inner = F.coalesce(F.col("_n") - 1 + (F.col("_from") > 0).cast("int") + (F.col("_to") < F.col("n_chars")).cast("int"), (F.col("n_chars") > 0).cast("int"))
    covered = F.coalesce("covered", F.lit(0)).cast("long")
    return out.select(id_col, "n_chars", covered.alias("covered"), inner.cast("long").alias("gaps"), F.when(F.col("n_chars") > 0, F.round(F.lit(100.0) * covered / F.col("n_chars"), 4)).otherwise(0.0).alias("coverage"))

"""Splitting text into clauses and sub-clauses, filters over them, and the clause tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.functions.text import OPEN, capitalize_titles, normalize, strip

#: What a dotted leader holds.
TOC = "....."


def split_clauses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, pos, clause_number, content, subs) of normalized and capitalized text.

    A clause begins at the start or after a newline, with one or two digits, a dot or a
    bracket, and white space, which the match uses up: a number right behind it is not
    another clause. Text before the first clause is dropped. `=` lines are removed after
    stripping. subs is an array of (clause_number, content); the content of a clause with
    sub-clauses is what stands before the first.
    """
    rows = _pieces(df, id_col, text_col)
    rows = rows.select(id_col, "pos", _number(F.col("piece")).alias("clause_number"), _body(F.col("piece")).alias("body"))
    rows = rows.withColumn("parts", _parts(F.col("body")))
    rows = computed(rows, [id_col, "pos"], clause_number=F.col("clause_number"), content=_own(F.col("body"), F.col("parts")), parts=F.col("parts"))
    subs = F.transform(F.slice("parts", 2, MOST_PARTS), lambda p: F.struct(F.regexp_extract(p, r"^([a-z]\))", 1).alias("clause_number"), strip(p).alias("content")))
    return rows.select(id_col, "pos", "clause_number", "content", subs.alias("subs"))


#: More than any array has.
MOST_PARTS = 1 << 30


def computed(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """`keep` and the columns, each worked out once a row: filters and projections that follow take the results, and do not put the expressions in their place."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


#: What is taken out of a clause's text: lines of equal signs and the white space behind them.
RULES = r"=+(?U:\s)*"


def _pieces(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, piece): the stretches of text that begin with a clause number; what stands before the first goes."""
    marked = F.regexp_replace(F.col(text_col), r"(^|\n)((?U:\d){1,2}[.)])((?U:\s))", f"$1{OPEN}$2$3")
    pieces = F.split(marked, OPEN, -1)
    return df.select(id_col, F.posexplode(F.slice(pieces, 2, MOST_PARTS)).alias("pos", "piece"))


def _number(piece: Column) -> Column:
    return F.regexp_extract(piece, r"^((?U:\d){1,2}[.)])", 1)


def _body(piece: Column) -> Column:
    return F.regexp_replace(strip(piece), RULES, "")


def _parts(body: Column) -> Column:
    return F.split(F.regexp_replace(body, r"(?<=\n)([a-z]\))((?U:\s))", f"{OPEN}$1$2"), OPEN, -1)


def _own(body: Column, parts: Column) -> Column:
    return F.when(F.size(parts) > 1, strip(F.element_at(parts, 1))).otherwise(body)


def is_toc(content: Column) -> Column:
    return F.contains(content, F.lit(TOC))


def remove_toc(clauses: DataFrame) -> DataFrame:
    """Drops clauses whose own text has a dotted leader, and their sub-clauses with them."""
    return clauses.filter(~is_toc(F.col("content")))


def remove_unnumbered(clauses: DataFrame) -> DataFrame:
    return clauses.filter(~F.startswith("clause_number", F.lit("UNNUMBERED")))


def extract_clauses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """normalize, capitalize, split, then the two filters: narrow transformations only."""
    text = df.select(id_col, capitalize_titles(normalize(F.col(text_col))).alias(text_col))
    return remove_toc(remove_unnumbered(split_clauses(text, id_col, text_col)))


def sub_clauses(clauses: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows (id, pos, sub_pos, clause_number, content) of the sub-clauses."""
    return clauses.select(id_col, "pos", F.posexplode("subs").alias("sub_pos", "s")).select(id_col, "pos", "sub_pos", "s.*")


def extraction_stats(docs: DataFrame, clauses: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Main, sub and total clause counts of every document."""
    counts = clauses.groupBy(id_col).agg(F.count(F.lit(1)).alias("main_count"), F.sum(F.size("subs")).alias("sub_count"))
    out = docs.select(id_col).join(counts, id_col, "left")
    main, sub = F.coalesce("main_count", F.lit(0)), F.coalesce("sub_count", F.lit(0))
    return out.select(id_col, main.alias("main_count"), sub.alias("sub_count"), (main + sub).alias("total_count"))


def flat_clauses(clauses: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The stored form: one row per clause or sub-clause, with deterministic ids, parent ids and order among siblings.

    Both come out of one pass, as a clause's own row and those of its sub-clauses.
    """
    key = F.sha2(F.concat_ws("~", id_col, "pos"), 256)

    def row(number: Column, content: Column, parent: Column, at: Column, row_id: Column) -> Column:
        return F.struct(row_id.alias("id"), number.alias("clause_number"), content.alias("content"), parent.alias("parent_clause_id"), at.cast("int").alias("order_index"))

    own = row(F.col("clause_number"), F.col("content"), F.lit(None).cast("string"), F.col("pos"), key)
    subs = F.transform("subs", lambda s, k: row(s["clause_number"], s["content"], key, k, F.sha2(F.concat_ws("~", F.col(id_col), F.col("pos"), k), 256)))
    rows = clauses.select(F.col(id_col).alias("contract_id"), F.inline(F.concat(F.array(own), subs)))
    return rows.select("id", "contract_id", "clause_number", "content", "parent_clause_id", "order_index")


def clause_tree(flat: DataFrame) -> DataFrame:
    """Main clauses with their sub-clauses as an ordered array; one join instead of a query per clause."""
    subs = flat.filter("parent_clause_id IS NOT NULL").groupBy("parent_clause_id").agg(F.array_sort(F.collect_list(F.struct("order_index", "id", "clause_number", "content"))).alias("sub_clauses"))
    main = flat.filter("parent_clause_id IS NULL").drop("parent_clause_id")
    empty = F.expr("CAST(array() AS array<struct<order_index:int,id:string,clause_number:string,content:string>>)")
    return main.join(subs, main["id"] == subs["parent_clause_id"], "left").drop("parent_clause_id").withColumn("sub_clauses", F.coalesce("sub_clauses", empty))


def search(clauses: DataFrame, query: str) -> DataFrame:
    """Clauses whose number or own text holds the query, whatever the case; sub-clauses are not searched."""
    wanted = F.lit(query.lower())
    return clauses.filter(F.contains(F.lower("clause_number"), wanted) | F.contains(F.lower("content"), wanted))


def blank_or_large(clauses: DataFrame, id_col: str = "doc_id", most_chars: int = 50_000, most: int = 50) -> DataFrame:
    """What keeps a document's clauses from an all-against-all run: blank ones, too long ones, too few or too many."""
    blank = F.length(strip(F.col("content"))) == 0
    return clauses.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(blank, F.col("pos")))).alias("blank_at"),
        F.count_if(F.length("content") > most_chars).alias("too_long"),
    ).withColumn("ok", F.col("n").between(2, most) & (F.size("blank_at") == 0) & (F.col("too_long") == 0))

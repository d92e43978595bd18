"""The outline of numbered clauses: what hangs below what, how deep, and the category that comes down from the top."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausegrid.operators.review import function_of

#: An appendix and its label, as in SCHEDULE 2 or Appendix A – Fees.
APPENDIX = r"(?i)^\s*(appendix|annex|schedule|exhibit)\s+([A-Z0-9]+)\b"
DOTTED = r"^[0-9]+(?:\.[0-9]+)*$"
LETTERED = r"^[A-Z](?:\.[0-9]+)+$"


def label(number: Column) -> Column:
    """What a number is called by what hangs below it: 2.1 for itself and for 2.1., A for Appendix A, null for (a) and the like."""
    bare = F.regexp_replace(F.trim(number), r"[.)]+$", "")
    return F.when(number.rlike(APPENDIX), F.upper(F.regexp_extract(number, APPENDIX, 2))).when(bare.rlike(DOTTED) | bare.rlike(LETTERED), bare)


def outline(rows: DataFrame, id_col: str = "doc_id", pos: str = "pos", number: str = "number") -> DataFrame:
    """`rows` with `parent_pos`, where the clause stands that each one hangs below, or null at the top.

    2.1 hangs below the last 2 before it, A.1 below the last APPENDIX A (or ANNEX, SCHEDULE, EXHIBIT), A.1.2 below A.1;
    where that one is missing, below the next one up that is there; (a) hangs below the last numbered clause or appendix. An appendix is at the
    top, and so is what has nothing above it. Numbers may come again: the last one before counts. Positions must be unique
    within a document; columns of other names are kept.
    """
    own = label(F.col(number))
    is_appendix = F.col(number).rlike(APPENDIX)
    marked = rows.withColumns({"_own": own, "_top": F.coalesce(is_appendix, F.lit(False))})
    before = Window.partitionBy(id_col).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.withColumn("_above", F.last(F.when(F.col("_own").isNotNull(), F.col(pos)), ignorenulls=True).over(before))
    # Every numbered clause asks for all labels above its own, the nearest first: those of 2.1.3 are 2.1 and 2.
    parts = F.split("_own", r"\.")
    depth = F.size(parts)
    asked = F.transform(F.sequence(F.lit(1), depth - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), depth - k), "."))
    asks = marked.filter(F.col("_own").isNotNull() & ~F.col("_top") & (depth > 1)).select(F.col(id_col).alias("_id"), F.posexplode(asked).alias("_near", "_label"), F.col(pos).alias("_at"), F.lit(False).alias("_has"))
    has = marked.filter(F.col("_own").isNotNull()).select(F.col(id_col).alias("_id"), F.lit(0).alias("_near"), F.col("_own").alias("_label"), F.col(pos).alias("_at"), F.lit(True).alias("_has"))
    last = F.last(F.when(F.col("_has"), F.col("_at")), ignorenulls=True).over(Window.partitionBy("_id", "_label").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    found = asks.unionByName(has).withColumn("_found", last).filter("NOT _has AND _found IS NOT NULL")
    nearest = found.groupBy("_id", "_at").agg(F.min_by("_found", "_near").alias("_parent"))
    out = marked.join(nearest, (marked[id_col] == F.col("_id")) & (marked[pos] == F.col("_at")), "left").drop("_id", "_at")
    parent = F.when(F.col("_top"), None).when(F.col("_own").isNull(), F.col("_above")).otherwise(F.col("_parent"))
    return out.withColumn("parent_pos", parent).drop("_own", "_top", "_above", "_parent")


def with_roots(rows: DataFrame, id_col: str = "doc_id", pos: str = "pos", most_depth: int | None = None) -> DataFrame:
    """`rows` of outline with `root_pos`, the clause at the top of each, and `depth`, 0 at the top.

    Pointers are doubled: each round every clause looks up where its pointer points, so the top of a tree
    of depth d is reached after log2(d) joins. Without `most_depth`, the greatest depth there may be, rounds go on until no
    pointer moves.
    """
    point = rows.select(F.col(id_col).alias("_id"), F.col(pos).alias("_pos"), F.coalesce("parent_pos", F.col(pos)).alias("_to"), F.col("parent_pos").isNotNull().cast("int").alias("_steps"))
    reached = 1
    while most_depth is None or reached < most_depth:
        there = point.select("_id", F.col("_pos").alias("_to"), F.col("_to").alias("_next"), F.col("_steps").alias("_more"))
        moved = point.join(there, ["_id", "_to"]).select("_id", "_pos", F.col("_next").alias("_to"), (F.col("_steps") + F.col("_more")).alias("_steps"), (F.col("_next") != F.col("_to")).alias("_moved"))
        if most_depth is None:
            moved = moved.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else moved.persist()
            if not moved.filter("_moved").limit(1).count():
                break
        point, reached = moved.drop("_moved"), reached * 2
    point = point.withColumnsRenamed({"_to": "root_pos", "_steps": "depth"})
    return rows.join(point, (rows[id_col] == point["_id"]) & (rows[pos] == point["_pos"])).drop("_id", "_pos")


def with_category(rows: DataFrame, text: str, id_col: str = "doc_id", pos: str = "pos", category: Callable[[Column], Column] = function_of) -> DataFrame:
    """`rows` of with_roots with `category`: that of the clause at the top, by its own text, for all that hangs below it."""
    tops = rows.filter(F.col("depth") == 0).select(F.col(id_col).alias("_id"), F.col(pos).alias("_root"), category(F.col(text)).alias("category"))
    return rows.join(tops, (rows[id_col] == F.col("_id")) & (rows["root_pos"] == F.col("_root")), "left").drop("_id", "_root")

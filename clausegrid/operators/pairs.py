"""Pairs to compare, by equi-join on the document so that no product of documents arises."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upper_triangular(items: DataFrame, id_col: str = "doc_id", pos: str = "pos", text: str = "content", self_checks: bool = True) -> DataFrame:
    """(id, i, j, is_self_check, text_i, text_j) for i <= j in each document; pair_order puts self-checks first.

    The order comes from the items' ranks by a formula, so that only items are sorted, never
    pairs. Positions are taken to be unique within a document.
    """
    within = Window.partitionBy(id_col)
    ranked = items.select(F.col(id_col).alias("id"), F.col(pos).alias("_pos"), F.col(text).alias("_text"), (F.row_number().over(within.orderBy(pos)) - 1).cast("long").alias("_rank"), F.count(F.lit(1)).over(within).alias("_n"))
    a = ranked.withColumnsRenamed({"_pos": "i", "_text": "text_i", "_rank": "_a"})
    b = ranked.drop("_n").withColumnsRenamed({"_pos": "j", "_text": "text_j", "_rank": "_b"})
    pairs = a.join(b, "id").filter(F.col("i") <= F.col("j") if self_checks else F.col("i") < F.col("j"))
    before = (F.col("_a") * (2 * F.col("_n") - F.col("_a") - 1) / 2).cast("long") + F.col("_b") - F.col("_a") - 1
    order = F.when(F.col("i") == F.col("j"), F.col("_a")).otherwise(before + (F.col("_n") if self_checks else 0)).cast("int")
    return pairs.withColumn("is_self_check", F.col("i") == F.col("j")).withColumn("pair_order", order).drop("_a", "_b", "_n").withColumnRenamed("id", id_col)


def one_to_many(items: DataFrame, id_col: str = "doc_id", pos: str = "pos", text: str = "content") -> DataFrame:
    """Each document's first item against its others; target_index counts from 0."""
    first = items.filter(F.col(pos) == 0).select(F.col(id_col).alias("id"), F.col(text).alias("source"))
    rest = items.filter(F.col(pos) > 0).select(F.col(id_col).alias("id"), (F.col(pos) - 1).alias("target_index"), F.col(text).alias("target"))
    return first.join(rest, "id").withColumnRenamed("id", id_col)


def blocks(pairs: DataFrame, size: int = 10, order: str = "pair_order") -> DataFrame:
    return pairs.withColumn("block", F.floor(F.col(order) / size))


def sliding_blocks(items: DataFrame, id_col: str = "doc_id", pos: str = "pos", width: int = 75, step: int = 50) -> DataFrame:
    """Overlapping windows over each document's items: a row per item and window it is in."""
    n = F.count(F.lit(1)).over(Window.partitionBy(id_col))
    last = F.greatest(F.lit(0), F.ceil((n - width) / step))
    low = F.greatest(F.lit(0), F.floor((F.col(pos) - width) / step) + 1)
    high = F.least(last, F.floor(F.col(pos) / step))
    rows = items.withColumn("_low", low.cast("int")).withColumn("_high", high.cast("int")).filter("_low <= _high")
    return rows.withColumn("block", F.explode(F.sequence("_low", "_high"))).drop("_low", "_high")


def capped_pairs(items: DataFrame, group: list[str], most: int, pos: str = "pos") -> DataFrame:
    """All pairs i < j among the first `most` items of each group: a feature of the tiers it serves, whose groups are capped."""
    kept = items.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(pos))).filter(F.col("_rn") <= most)
    a, b = kept.select(*group, F.col(pos).alias("i")), kept.select(*group, F.col(pos).alias("j"))
    return a.join(b, group).filter("i < j")


def pairs_in_groups(items: DataFrame, groups: str = "groups", id_col: str = "doc_id", pos: str = "pos", size: int = 200) -> DataFrame:
    """(id, i, j, groups) for all i < j of a document's items that share a group, each pair once, with all groups that it shares in order.

    `groups` is the array of an item's groups; positions are taken to be unique within a document. The pairs of a group are as many
    as its square: its items form blocks of `size`, any two of which meet on a key of their own, so that its pairs are dealt out,
    and the hint keeps them so where a side is small enough to broadcast. A pair comes from its first common group alone.
    """
    within = Window.partitionBy("id", "_group")
    rank, n = F.row_number().over(within.orderBy("_pos")), F.count(F.lit(1)).over(within)
    each = items.select(F.col(id_col).alias("id"), F.col(pos).alias("_pos"), F.array_sort(groups).alias("_all")).select("*", F.posexplode("_all").alias("_k", "_group"))
    each = each.withColumns({"_block": F.floor((rank - 1) / size), "_last": F.floor((n - 1) / size), "_before": F.slice("_all", F.lit(1), F.col("_k"))})
    a = each.select("id", "_group", F.col("_pos").alias("i"), F.col("_all").alias("_a"), F.col("_before").alias("_before_a"), F.col("_block").alias("_low"), F.explode(F.sequence("_block", "_last")).alias("_high"))
    b = each.select("id", "_group", F.col("_pos").alias("j"), F.col("_all").alias("_b"), F.col("_before").alias("_before_b"), F.explode(F.sequence(F.lit(0).cast("long"), "_block")).alias("_low"), F.col("_block").alias("_high"))
    pairs = a.hint("merge").join(b, ["id", "_group", "_low", "_high"]).filter((F.col("i") < F.col("j")) & ~F.arrays_overlap("_before_a", "_before_b"))
    return pairs.select(F.col("id").alias(id_col), "i", "j", F.array_intersect("_a", "_b").alias(groups))


def canonical(pairs: DataFrame, id_col: str, by: str) -> DataFrame:
    """One row per unordered pair, the first by `by`."""
    rn = F.row_number().over(Window.partitionBy(id_col, "i", "j").orderBy(by))
    return pairs.withColumns({"_i": F.least("i", "j"), "_j": F.greatest("i", "j")}).drop("i", "j").withColumnsRenamed({"_i": "i", "_j": "j"}).withColumn("_rn", rn).filter("_rn = 1").drop("_rn")


def positions(requests: DataFrame, id_col: str, items: str) -> DataFrame:
    """An array of texts a request becomes rows (id, pos, content), positions counting from 0."""
    return requests.select(id_col, F.posexplode(items).alias("pos", "content"))


def without_blank(items: DataFrame, id_col: str = "doc_id", pos: str = "pos", text: str = "content") -> DataFrame:
    """Items that are not blank, numbered anew from 0."""
    from clausegrid.functions.text import strip

    kept = items.filter(strip(F.col(text)) != "")
    return kept.withColumn(pos, F.row_number().over(Window.partitionBy(id_col).orderBy(pos)) - 1)


def united(tiers: list[DataFrame], columns: list[str]) -> DataFrame:
    """The pairs of several tiers, each once; (a, b) and (b, a) are two pairs."""
    out = tiers[0].select(*columns)
    for tier in tiers[1:]:
        out = out.unionByName(tier.select(*columns))
    return out.distinct()

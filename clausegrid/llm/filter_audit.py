"""How document filters interact, by a Walsh-Hadamard audit of their failures."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid.llm.common import table, whole

#: Characters that separate words: blanks and the control characters from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def filters_of(text: Column) -> dict[str, Column]:
    """The four conditions that depend on a text alone, true where it fails."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    return {
        "A": F.size(words) < 100,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 80,
        "C": F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") * 100 > F.length(text).cast("long") * 10,
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, filters: Mapping[str, Column], duplicate: str | None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Rows (id, part, mask, n): how many rows share an id, a part and a set of failed filters.

    `filters` are expressions over `_text`, the text with null as empty; the k-th one fails as
    bit k of mask. `duplicate` names the last filter: a row fails it if a smaller id
    anywhere has an identical text. Texts are held against each other by SHA-256, and never shuffled: rows meet the
    smallest id of their text on (text, id), so a group of copies, however large, is spread over
    all tasks. A row without an id is no duplicate and none of its copies is one for its sake. Rows alike in all
    are counted before anything is joined. A null part counts as empty.
    """
    bits = [F.when(f, 1 << k).otherwise(0) for k, f in enumerate(filters.values())]
    rows = docs.select(F.col(id_col).alias("id"), whole(F.col(part_col)).alias("part"), whole(F.col(text_col)).alias("_text"))
    rows = rows.select("id", "part", sum(bits[1:], bits[0]).alias("mask"), F.unhex(F.sha2("_text", 256)).alias("key"))
    rows = rows.groupBy("key", "id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    if duplicate is None:
        return rows.drop("key")
    known = rows.filter("id IS NOT NULL")
    first = known.groupBy("key").agg(F.min("id").alias("id")).withColumn("_first", F.lit(True))
    found = known.join(first, ["key", "id"], "left")
    fails = F.when(F.col("_first").isNull(), 1 << len(filters)).otherwise(0)
    return found.select("id", "part", (F.col("mask") + fails).alias("mask"), "n").unionByName(rows.filter("id IS NULL").select("id", "part", "mask", "n"))


def labelled(rows: DataFrame, labels: DataFrame, flags: Mapping[str, Column], id_col: str = "doc_id") -> DataFrame:
    """`rows` (id, ...) with one boolean for each flag: whether any label row of the id has it. Rows without an id or a label have none."""
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*[F.bool_or(F.coalesce(f, F.lit(False))).alias(name) for name, f in flags.items()])
    no = {name: F.coalesce(F.col(name), F.lit(False)) for name in flags}
    found = rows.filter("id IS NOT NULL").join(marks, "id", "left").withColumns(no)
    return found.unionByName(rows.filter("id IS NULL").withColumns({name: F.lit(False) for name in flags}))


def _sign(mask: Column, subset: int) -> Column:
    """1 where mask and subset share an even number of filters, else -1."""
    return 1 - 2 * F.bit_count(mask.bitwiseAND(F.lit(subset))).bitwiseAND(F.lit(1))


def parity_sums(rows: DataFrame, n_filters: int, keys: list[str]) -> DataFrame:
    """Per group the 2**n signed sums: over all rows, n times -1 to the number of failed filters in each subset."""
    subsets = range(1 << n_filters)
    sums = [F.sum(F.col("n") * _sign(F.col("mask"), s)).alias(f"w{s}") for s in subsets]
    return rows.groupBy(*keys).agg(*sums).select(*keys, F.array(*[F.col(f"w{s}") for s in subsets]).alias("sums"))


def cells_of(sums: Column, n_filters: int) -> Column:
    """The number of rows with each exact set of failed filters: the transform is its own inverse but for a division, which leaves no rest."""
    size = 1 << n_filters
    sign = lambda m, s: 1 - 2 * F.bit_count(m.bitwiseAND(s)).bitwiseAND(F.lit(1))
    total = lambda m: F.aggregate(F.transform(sums, lambda w, s: w * sign(m, s)), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda m: F.call_function("div", total(m), F.lit(size).cast("long")))


def _over(cells: str, holds, times=lambda m: F.lit(1)) -> Column:
    """The sum of the cells whose mask fits, each taken so many times."""
    return F.aggregate(F.transform(cells, lambda n, m: F.when(holds(m), n * times(m)).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x)


def _has(bit: int):
    return lambda m: m.bitwiseAND(F.lit(bit)) != 0


def audit(rows: DataFrame, names: str, counted: Mapping[str, Column], part_col: str = "part") -> DataFrame:
    """Per part, order of the filters and step: what each filter removes, and what it is to blame for.

    `rows` has the part, mask (bit k is filter names[k]), n and whatever the columns in `counted`
    use: each of those is a condition on the label columns, and gives a column of the rows that a step loses of it.
    One pass sums up signed parities per part and label; all else follows from those few
    numbers, and no order is ever run over the rows. Columns: part, filter_order, step, kept, removed, redundant,
    unique_fails, those of `counted`, shapley. The last is exact: of all orders, a row with k
    failures is removed by each of the k in one k-th of them. An empty table gives no rows.
    """
    n = len(names)
    labels = [c for c in rows.columns if c not in ("id", "mask", "n", part_col)]
    sums = parity_sums(rows, n, [part_col, *labels]).select(part_col, *labels, cells_of(F.col("sums"), n).alias("cells"))
    each = sums.select(part_col, *labels, F.posexplode("cells").alias("mask", "cell"))
    masks = range(1 << n)
    pick = lambda m, cond: F.sum(F.when((F.col("mask") == m) & cond, F.col("cell")).otherwise(0))
    groups = {"_all": F.lit(True), **counted}
    parts = each.groupBy(part_col).agg(*[F.array(*[pick(m, cond) for m in masks]).alias(f"_cells_{name}") for name, cond in groups.items()])
    steps = [(order, k + 1, sum(1 << names.index(f) for f in order[:k]), 1 << names.index(f)) for order in map("".join, permutations(names)) for k, f in enumerate(order)]
    fails = [_has(1 << k) for k in range(n)]
    share = lambda m: F.call_function("div", F.lit(factorial(n)), F.bit_count(m))
    parts = parts.withColumns({"_fails": F.array(*[_over("_cells__all", f) for f in fails]), "_blame": F.array(*[_over("_cells__all", f, share) for f in fails])})
    listed = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(before).alias("before"), F.lit(own).alias("own")) for o, k, before, own in steps])
    out = parts.select("*", F.explode(listed).alias("s")).select("*", "s.*")
    own, before = F.col("own"), F.col("before")
    gone = lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(before) == 0)
    at = F.bit_count(own - 1) + 1  # place of the filter among the names
    out = out.withColumn("removed", _over("_cells__all", gone))
    return out.select(
        part_col, "filter_order", "step", _over("_cells__all", lambda m: m.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"), "removed",
        (F.element_at("_fails", at) - F.col("removed")).alias("redundant"), F.element_at("_cells__all", own + 1).alias("unique_fails"),
        *[_over(f"_cells_{name}", gone).alias(name) for name in counted], F.element_at("_blame", at).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part (lang), order of the filters A to E and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A label row with quality or toxic 1 marks all documents of its id. Repeated documents count each; columns beyond
    those read are left alone.
    """
    rows = failures(table(spark, sf_dir, "documents"), filters_of(F.col("_text")), "E")
    rows = labelled(rows, table(spark, sf_dir, "labels"), {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1})
    return audit(rows, "ABCDE", {"good_lost": F.col("good"), "toxic_lost": F.col("toxic")})


OP13_SQL = r"""
WITH words AS (SELECT *, coalesce(text, '') AS t, [w FOR w IN string_split_regex(coalesce(text, ''), '[ \t-\r]+') IF w <> ''] AS w FROM documents),
failed AS (SELECT doc_id, coalesce(lang, '') AS part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM words),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
cells AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END) AS f,
  count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed LEFT JOIN marks USING (doc_id) GROUP BY 1, 2),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (SELECT p.l || q.l || r.l || s.l || t.l AS o FROM letters p, letters q, letters r, letters s, letters t WHERE len(list_distinct([p.l, q.l, r.l, s.l, t.l])) = 5),
steps AS (SELECT o, k, o[k] AS l, left(o, k - 1) AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
met AS (SELECT part, o, k, l, n, good, toxic, f, contains(f, l) AS fails, len(list_intersect(string_split(f, ''), string_split(before, ''))) > 0 AND f <> '' AND before <> '' AS earlier FROM cells, steps),
sums AS (SELECT part, o AS filter_order, k AS step, l, sum(n) FILTER (NOT earlier AND NOT fails) AS kept, sum(n) FILTER (fails AND NOT earlier) AS removed, sum(n) FILTER (fails AND earlier) AS redundant,
  sum(n) FILTER (f = l) AS unique_fails, sum(good) FILTER (fails AND NOT earlier) AS good_lost, sum(toxic) FILTER (fails AND NOT earlier) AS toxic_lost FROM met GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, l))::BIGINT AS shapley FROM sums
"""

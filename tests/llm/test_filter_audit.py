"""The filter audit against its SQL and against orders that are really run."""

from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from clausegrid.llm import filter_audit as A

WORDS = " ".join(f"w{i}" for i in range(120))
TEXTS = [
    None, "", " \t\r\n", "a b", WORDS, WORDS, WORDS, WORDS + " #", "ABC " + WORDS.upper(), "same " * 150, "same " * 150 + "$", WORDS + "\x85x y", "A" * 50_000, "|", "|", "é" * 9 + "A", "é" * 8 + "AA", "WORDS é 😀" * 40,
]


def documents(spark, path):
    rows = [(i, t, ["en", None, "", "de"][i % 4], 7) for i, t in enumerate(TEXTS)] + [(None, WORDS, "en", 7), (None, "|", "fr", 7), (4, WORDS, "en", 7), (4, WORDS, "de", 7), (0, "|", "en", 7)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, part int").repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 30, 2)] + [(4, 1, 1), (4, None, None), (None, 1, 1), (6, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows, labels


def run(rows, labels):
    """All orders, one after the other over the rows."""
    seen = {}
    for i, t, _, _ in rows:
        if i is not None:
            seen[t or ""] = min(seen.get(t or "", i), i)
    docs = []
    for i, t, lang, _ in rows:
        t = t or ""
        words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in t).split(" ") if w]
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and seen[t] < i}
        docs.append((lang or "", fails, any(x == i and q == 1 for x, q, _ in labels if i is not None), any(x == i and tox == 1 for x, _, tox in labels if i is not None)))
    out, total = [], {}
    for part in {d[0] for d in docs}:
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            every = left
            for k, f in enumerate(order):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                total[part, f] = total.get((part, f), 0) + len(gone)
                out.append([part, order, k + 1, len(left), len(gone), sum(d[1][f] for d in every) - len(gone), sum(d[1][f] and sum(d[1].values()) == 1 for d in every), sum(d[2] for d in gone), sum(d[3] for d in gone)])
    return sorted((*r, total[r[0], r[1][r[2] - 1]]) for r in out)


def test_query_equals_orders_that_are_run_and_its_sql(spark, tmp_path):
    rows, labels = documents(spark, tmp_path)
    got = A.op13_filter_audit(spark, str(tmp_path))
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert got.columns == names and [t for _, t in got.dtypes] == ["string", "string", "int"] + ["bigint"] * 7
    assert sorted(map(tuple, got.collect())) == run(rows, labels)
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    found = con.sql(A.OP13_SQL)
    assert sorted(tuple(r[found.columns.index(n)] for n in names) for r in found.fetchall()) == run(rows, labels)


def test_transform_is_inverted_exactly(spark):
    rows = spark.createDataFrame([("x", m, (m * 7919) ** 3 % 10_007 + 10**12) for m in range(32)], "part string, mask int, n long")
    cells = A.parity_sums(rows, 5, ["part"]).select(A.cells_of(F.col("sums"), 5).alias("c")).first().c
    assert cells == [(m * 7919) ** 3 % 10_007 + 10**12 for m in range(32)]


def test_other_filters_and_no_duplicates(spark):
    docs = spark.createDataFrame([(1, "ab", "p"), (2, "b", "p"), (3, "ac", "p")], "i long, t string, l string")
    rows = A.failures(docs, {"X": F.contains("_text", F.lit("a")), "Y": F.contains("_text", F.lit("b"))}, None, "i", "t", "l")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in A.audit(rows, "XY", {}).collect()}
    assert got == {("XY", 1): (1, 2, 0, 1, 3), ("XY", 2): (0, 1, 1, 1, 3), ("YX", 1): (1, 2, 0, 1, 3), ("YX", 2): (0, 1, 1, 1, 3)}


@pytest.mark.parametrize("empty", ["documents", "labels"])
def test_empty_tables(spark, tmp_path, empty):
    documents(spark, tmp_path)
    spark.read.parquet(f"{tmp_path}/{empty}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{empty}.parquet")
    other = {"documents": "labels", "labels": "documents"}[empty]
    spark.read.parquet(f"{tmp_path}/{other}.parquet").write.parquet(f"{tmp_path}/none/{other}.parquet")
    got = A.op13_filter_audit(spark, f"{tmp_path}/none").collect()
    assert not got if empty == "documents" else len(got) == 600 * 4 and not any(r.good_lost or r.toxic_lost for r in got)

"""What keeps work in step with the input: texts are worked on once, and a query that takes clauses up again reads a stored table."""

import pytest
from pyspark.sql import functions as F

from clausegrid.functions.text import SPACES, strip
from clausegrid.operators import candidates as T, clauses as C, verdicts as V
from clausegrid.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_strip_takes_the_white_space_of_the_pattern(spark):
    every = spark.range(0x10000).filter("id < 55296 OR id > 57343").selectExpr("id", "decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE') AS c")
    spaces = {r.c for r in every.filter(r"c RLIKE '(?U)^\\s\\z'").collect()}
    assert spaces == set(SPACES)
    df = spark.createDataFrame([("  a b \n",), ("\t　",), ("",), (None,)], "s string")
    assert [r.s for r in df.select(strip(df.s).alias("s")).collect()] == ["a b", "", "", None]


def test_a_clause_is_worked_out_once(spark):
    docs = spark.createDataFrame([("a", "1. Pay ===\n2. Stay ..... 3")], "doc_id string, text string")
    clauses = C.extract_clauses(docs)
    assert plan(clauses).count(C.RULES) == 1
    assert [(r.pos, r.content) for r in clauses.collect()] == [(0, "1. Pay ")]  # what stands before the equal signs stays


def test_tiers_read_clauses_once_and_turn_them_to_small_letters_once(spark):
    items = spark.createDataFrame([("a", 0, "They SHALL pay"), ("a", 1, "They shall not pay"), ("a", 2, None), ("b", 0, "Subject to a fee")], "doc_id string, pos int, content string")
    assert plan(T.cluster_pairs(items)).count("lower(") <= 2  # a self-join shows its side twice
    assert plan(T.contrary_pairs(items)).count("lower(") == 1
    assert plan(T.override_against_all(items)).count("lower(") == 1
    assert [tuple(r) for r in T.contrary_pairs(items).collect()] == [("a", 0, 1)]
    assert T.override_against_all(items).collect() == []


@pytest.mark.parametrize("name", ["all_tiers_united", "contradicting_claims", "verified_conflicts", "conflict_evidence", "pairs_past_the_gate", "clause_tree", "clauses_of_kinds", "prompts_one_to_many", "clause_coverage"])
def test_documents_are_read_once(spark, name):
    """The stored table stands in the plan, the documents do not."""
    assert "documents.parquet" not in catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_stored_tables_works_files_out_once(spark, monkeypatch):
    """What is inserted comes from stored files, not from the documents, in each run."""
    seen = []
    monkeypatch.setattr(catalog.ContractStore, "insert", lambda self, tables, run_id: seen.extend(df._jdf.queryExecution().executedPlan().toString() for df in tables.values()))
    catalog.QUERIES["stored_tables"](spark, SF)
    assert len(seen) == 12 and not any("documents.parquet" in plan for plan in seen)


def test_texts_of_pairs_are_never_shuffled(spark):
    """Each distinct prompt is asked once, and what crosses the network for a pair is digests."""
    items = spark.createDataFrame([(d, p, t) for d in "ab" for p, t in enumerate(("must pay 5", "must not pay", None))], "doc_id string, pos int, content string")
    pairs, asked = V.pair_prompts(items, F.lit("Compare."))
    assert pairs.count() == 12 and asked.count() == 3  # three of each document without a null text, alike in both
    got = {(r.doc_id, r.i, r.j): r.answer for r in V.answered_pairs(items, F.lit("Compare.")).collect()}
    ranked = items.select("doc_id", F.col("pos").alias("i"), F.col("content").alias("a")).join(items.select("doc_id", F.col("pos").alias("j"), F.col("content").alias("b")), "doc_id").filter("i <= j")
    plain = V.answers(ranked.withColumn("prompt", V.pair_prompt(F.lit("Compare."), F.col("i"), F.col("j"), F.col("a"), F.col("b"))))
    assert got == {(r.doc_id, r.i, r.j): r.answer for r in plain.collect()} and len(got) == 6
    keys = [line for line in pairs._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
    assert keys and not any("content" in line for line in keys)

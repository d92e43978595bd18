"""Every registered query against its SQL on the smallest tables, and that inputs exercise both sides of the filters."""

import math

import duckdb
import pytest

import __spark_entry__
from clausegrid.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: round(float(v), 6) if isinstance(v, float) and not math.isnan(v) else str(v) if v is not None and not isinstance(v, (int, bool)) else v
    return sorted((tuple(plain(r[k]) for k in order) for r in values), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    found = duck.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(found.columns, found.fetchall())


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert catalog.QUERIES["toc_filtered_clauses"](spark, SF).count() < catalog.QUERIES["split_into_clauses"](spark, SF).count()


@pytest.mark.parametrize("name, column, values", [
    ("sliding_blocks_of_sources", "block > 0", {True, False}), ("routes_of_sources", "route", {"fast", "medium"}), ("evidence_inside_texts", "start > 3", {True, False}), ("run_counters_with_errors", "errors > 0", {True}),
    ("upload_steps", "status", {"failed", "completed", "aborted", "running"}), ("upload_steps", "in_order", {True, False}), ("comparison_events", "type", {"status", "result", "complete", "error"}),
    ("clause_outline", "depth >= 5", {True, False}), ("clause_outline", "category", {"PAYMENT", "TERMINATION", "CONFIDENTIALITY", "INDEMNITY_LIABILITY", "NOTICE"}), ("compared_one_to_many", "severity", {"High", "Low", "Unknown", "Error"}),
    ("clause_values", "kind", {"DURATION", "AMOUNT", "PERCENT", "DATE", "JURISDICTION"}), ("clause_coverage", "coverage > 0", {True, False}), ("mixed_folder", "kind", {"txt", "csv", "json", "error"}), ("stored_tables", "name", {"contracts", "versions", "parties", "clauses"}),
])
def test_inputs_meet_each_case(spark, name, column, values):
    found = {r[0] for r in catalog.QUERIES[name](spark, SF).selectExpr(f"{column} AS x").distinct().collect()}
    assert values <= found

"""Spans of clauses, unions of spans, and the functions for SQL."""

import random

from pyspark.sql import functions as F

from clausegrid.functions import text as X
from clausegrid.functions.sql import register_functions
from clausegrid.operators import clauses as C
from clausegrid.operators import coverage as D

TEXTS = ["1. A\n===  b\n2) C ==== D\na) e\n3. ", "no clause", "", None, "front\n1. x ..... 3\na) y\n12. z", "1. ==== \n2.\n\n 3. \u00a0é😀 == \u2003", "===\n1. a\n==\n==\n2. b"]


def test_spans_are_where_the_clauses_stand(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    spans = D.clause_spans(df).collect()
    found = {}
    for s in sorted(spans, key=lambda s: (s.doc_id, s.pos, s.start)):
        found.setdefault((s.doc_id, s.pos), []).append(TEXTS[s.doc_id][s.start : s.end])
    whole = {(r.doc_id, r.pos): (r.content, r.n) for r in C.split_clauses(df).select("doc_id", "pos", "content", F.size("subs").alias("n")).collect()}
    for key, (content, n) in whole.items():
        joined = "".join(found.get(key, []))
        assert joined == content if not n else joined.startswith(content)
    assert set(found) <= set(whole)
    assert {(s.doc_id, s.pos) for s in spans if s.is_toc} == {(4, 0)}


def test_unions_and_coverage(spark):
    rnd = random.Random(7)
    rows = [(d, s, s + rnd.randrange(-1, 12)) for d in range(30) for s in (rnd.randrange(60) for _ in range(rnd.randrange(9)))] + [(0, None, 5), (0, 3, None)]
    texts = [(d, "x" * 70) for d in range(32)] + [(40, ""), (41, None)]
    spans, docs = spark.createDataFrame(rows, "doc_id long, start int, end int"), spark.createDataFrame(texts, "doc_id long, text string")
    held = {d: {k for x, s, e in rows if x == d and s is not None and e is not None for k in range(s, e)} for d, _ in texts}
    got = {r.doc_id: (r.covered, r.gaps, r.coverage) for r in D.coverage(docs, spans).collect()}
    for d, text in texts:
        bits = "".join("x" if k in held[d] else " " for k in range(len(text or "")))
        assert got[d] == (len(held[d]), len(bits.replace("x", " x ").split("x")) and len([g for g in bits.split("x") if g]), round(100.0 * len(held[d]) / len(text), 4) if text else 0.0)
    ends = {}
    for r in D.united(spans, ["doc_id"]).collect():
        ends.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    assert ends == {d: h for d, h in held.items() if h}


def test_functions_for_sql_are_the_operators(spark):
    assert register_functions(spark) == ["normalize_text", "capitalize_titles", "contract_clauses", "has_leader"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, "1. scope of work\na) first thing\nb) second\n2) price\n\n\nis fixed", "٣. arabic\n1. ßtraße"])], "doc_id long, text string")
    df.createOrReplaceTempView("docs")
    ready = X.capitalize_titles(X.normalize(F.col("text")))
    want = df.select("doc_id", ready.alias("text"))
    assert spark.sql("SELECT doc_id, capitalize_titles(normalize_text(text)) AS text FROM docs").collect() == want.collect()
    by_sql = spark.sql("SELECT d.doc_id, c.* FROM (SELECT doc_id, capitalize_titles(normalize_text(text)) AS text FROM docs) d, LATERAL contract_clauses(d.text) c")
    assert sorted(by_sql.collect()) == sorted(C.split_clauses(want).collect()) and by_sql.count() > 8
    assert "Python" not in by_sql._jdf.queryExecution().executedPlan().toString()
    assert spark.sql("SELECT count(*) FROM contract_clauses('1. a\n2. b') WHERE NOT has_leader(content)").first()[0] == 2

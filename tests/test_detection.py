"""Rules of detection and of answers on planted cases; that the catalogue's inputs meet both sides of each filter."""

from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

from clausegrid.operators import answers as A
from clausegrid.operators import detection as E
from clausegrid.operators import pairs as P
from clausegrid.plans import catalog
from tests.test_text_and_clauses import column

SF = "/root/testdata/sf0.001"


def test_references_and_overrides(spark):
    texts = ["See also Section 3 and clause 2.1.4; Appendix 7", "pursuant to Article 5, as defined in Clause 4, see section 5", "no 12", ""]
    assert column(spark, texts, E.references) == [["3", "2.1", "7"], ["5", "4"], [], []]
    assert column(spark, ["This SHALL  prevail.", "It supersedes all.", "in the event of conflict", "shall apply"], E.is_override) == [True, True, True, False]
    assert column(spark, ["Payment of a fee", "nothing"], E.categories_of) == [["PAYMENT", "FEES_COMMISSION"], ["GENERAL"]]


CLAUSES = [
    (1, 0, "1.", "Terms", "The payment of invoices is due at once."), (1, 1, "2.", "Terms", "The payment of invoices is due at once."), (1, 2, "3.", "Terms", "Fees ............ 4 and more of them"), (1, 3, "4.", "Terms", "12. only"),
    (1, 4, "0.3", "Terms", "The payment of a page number is long."), (1, 5, "6.", "Appendix", "An appendix with a heading alone"), (1, 6, "7.", "Appendix", "An appendix with a heading and a text that says a good deal more"),
    (1, 7, "8.", "Terms", "Notwithstanding all, the payment is late."), (1, 8, "9.", "Terms", "The table of contents is missing here."), (1, 9, "10.", "Terms", "All payment follows the notice procedure."), (2, 0, "1.", "Terms", "The payment of invoices is due at once."),
]


def test_what_takes_part_and_the_pairs(spark):
    df = spark.createDataFrame(CLAUSES, "doc_id long, pos int, clause_number string, heading string, content string")
    clean = E.cleaned(df)
    assert sorted((r.doc_id, r.pos) for r in clean.collect()) == [(1, k) for k in (0, 4, 5, 6, 7, 8, 9)] + [(2, 0)]
    eligible = E.taking_part(clean)
    assert sorted((r.doc_id, r.pos) for r in eligible.collect()) == [(1, 0), (1, 6), (1, 9), (2, 0)]
    assert [(r.i, r.j, r.categories) for r in E.category_pairs(df.filter("doc_id = 1 AND pos IN (0, 4, 7)")).orderBy("i", "j").collect()] == [(0, 4, ["PAYMENT"]), (0, 7, ["PAYMENT"]), (4, 7, ["PAYMENT"])]
    assert E.category_pairs(df.filter("doc_id = 1 AND pos IN (0, 4, 7)"), most=2).count() == 1
    pairs = spark.createDataFrame([(1, 0, 4), (1, 0, 6), (1, 0, 7), (1, 0, 9), (1, 6, 7)], "doc_id long, i int, j int")
    assert sorted((r.i, r.j, r.function_i, r.function_j) for r in E.gated(pairs, df).collect()) == [(0, 4, "PAYMENT", "PAYMENT"), (0, 7, "PAYMENT", "PAYMENT"), (6, 7, "GENERAL", "PAYMENT")]


def test_all_pairs_of_a_category_are_there(spark):
    clauses = [(1, k, f"Item {k} of the payment" + ", a fee" * (k % 3 == 0)) for k in range(450)] + [(2, 0, "payment"), (2, 0, "nothing"), (2, 1, "a fee"), (2, 1, "the payment"), (None, 0, "payment"), (None, 1, "payment")]
    got = E.category_pairs(spark.createDataFrame(clauses, "doc_id long, pos int, content string")).collect()
    both = ["FEES_COMMISSION", "PAYMENT"]
    wanted = [(1, i, j, both if i % 3 == j % 3 == 0 else ["PAYMENT"]) for i, j in combinations(range(450), 2)] + [(2, 0, 1, ["PAYMENT"])]
    assert sorted((r.doc_id, r.i, r.j, r.categories) for r in got) == wanted


@pytest.mark.parametrize("size", [1, 3, 7, 200])
def test_pairs_in_groups_are_the_same_in_blocks_of_any_size(spark, size):
    items = [(d, 2 * k, [g for n, g in enumerate("dbca") if (k * (n + 2) + d) % (n + 2 + d) == 0]) for d in (1, 2) for k in range(22)]
    got = P.pairs_in_groups(spark.createDataFrame(items, "doc_id int, pos int, groups array<string>"), size=size).collect()
    wanted = [(d, i, j, shared) for (d, i, a), (e, j, b) in combinations(items, 2) if d == e and (shared := sorted(set(a) & set(b)))]
    assert len(wanted) > 100 and sorted((r.doc_id, r.i, r.j, r.groups) for r in got) == wanted


def test_pairs_of_long_documents_equal_the_sql(spark, tmp_path):
    kinds = ("invoice", "fee", "courts of law", "nothing else")
    texts = [(d, "\n".join(f"Line {k} of the long document {d} has {kinds[(k * k + d) % 4]}" for k in range(n))) for d, n in ((1, 600), (2, 40), (2, 30), (3, 1))]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duck, found = duckdb.connect(), {}
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("pairs_of_categories", "pairs_past_the_gate"):
        df = catalog.QUERIES[name](spark, str(tmp_path))
        found[name] = sorted(tuple(r) for r in df.collect())
        assert found[name] == sorted(duck.sql(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLES[name]})").fetchall())
    fees = [(i, j) for doc, i, j, categories in found["pairs_of_categories"] if doc == 1 and "FEES_COMMISSION" in categories.split(",")]
    n = len({k for pair in fees for k in pair})
    assert n > 40 and len(fees) == n * (n - 1) // 2


def test_kinds(spark):
    flat = spark.createDataFrame([("a", None), ("b", "a")], "id string, parent_clause_id string")
    assert [[r.id for r in E.of_kind(flat, k).collect()] for k in ("all", "main", "sub")] == [["a", "b"], ["a"], ["b"]]
    with pytest.raises(ValueError, match="no kind"):
        E.of_kind(flat, "other")


def test_answers(spark):
    replies = ['{"message":{"content":"x"}}', '{"choices":[{"message":{"content":"y"}}]}', '{"message":{"content":""}}', "no json", None, '{"choices":[]}']
    assert column(spark, replies, A.content_of) == ["x", "y", None, None, None, None]
    checks = ['{"is_valid":true,"quality_score":0.5,"issues":["a"]}', '```json\n{"quality_score":0.4}\n```', "no", "{}", None]
    got = column(spark, checks, A.check_of)
    assert [(c.is_valid, c.quality_score, c.issues) if c else None for c in got] == [(True, 0.5, ["a"]), (None, 0.4, None), None, None, None]
    rows = spark.createDataFrame([(k, c) for k, c in enumerate([*checks, '{"is_valid":false}', '{"is_valid":true,"is_toc_entry":true}'])], "id int, answer string").withColumn("check", A.check_of(F.col("answer")))
    assert sorted(r.id for r in A.good_clauses(rows).collect()) == [0, 2, 3, 4]
    prompt = column(spark, ["a  b\nc d"], lambda c: A.party_prompt(c, 3))[0]
    assert prompt.endswith("Text:\na b c\n") and "JSON list" in prompt


def test_bilingual(spark):
    texts = ["Hello\nعقد البيع\n12\nWorld", "only english", "عقد", "", None, "123"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    assert [tuple(r) for r in A.bilingual_lengths(df, ["id"]).orderBy("id").collect()] == [(0, True, 11, 9, 24, ), (1, False, 12, 0, 12), (2, False, 0, 3, 3), (3, False, 0, 0, 0), (4, False, 0, 0, 0), (5, False, 0, 0, 3)]
    assert column(spark, texts[:1], A.bilingual)[0].english_text == "Hello\nWorld"


def test_filters_of_the_catalogue_keep_some_and_drop_some(spark):
    q = lambda name: catalog.QUERIES[name](spark, SF)
    every = catalog._detected(spark, SF)
    assert 0 < q("clauses_in_detection").count() < E.cleaned(every).count() < every.count()
    assert 0 < q("pairs_past_the_gate").count() < q("pairs_of_categories").count()
    assert {r.override for r in q("all_references").select("override").distinct().collect()} == {True, False}
    assert 0 < q("clauses_that_hold").count() < 200
    kinds = {r.kind: r.n for r in q("clauses_of_kinds").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    assert 0 < kinds["sub"] < kinds["main"] < kinds["all"] == kinds["main"] + kinds["sub"]
    summaries = q("upload_summaries").collect()
    assert any(r.removed_count for r in summaries) and {r.party_count for r in summaries} == {0, 1, 2}

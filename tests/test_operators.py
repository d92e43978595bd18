"""Golden cases of parties, verdicts, pairs, chat, contracts and review rules."""

import datetime

from pyspark.sql import functions as F

from clausegrid.operators import candidates as T, chat, contracts as K, ingest as G, pairs as P, parties as N, review as R, verdicts as V
from tests.test_text_and_clauses import column


def test_parties(spark):
    texts = ["made BETWEEN Acme LLC and Beta FZE, hereinafter", "Agreement between Acme and Beta.", "Parties: Acme and Beta.", "nothing"]
    assert column(spark, texts, N.by_pattern) == [["Acme LLC", "Beta FZE"], ["Acme", "Beta"], ["Acme", "Beta"], ["UNKNOWN PARTY 1", "UNKNOWN PARTY 2"]]
    answers = ['```json\n["A", " B "]\n```', '["x"]', "[]", "no", '[" "]', None]
    assert column(spark, answers, N.parse_list) == [["A", "B"], ["x"], None, None, None, None]
    kept = column(spark, ["Acme|1 Main Street", "P.O. Box 1|Road 5"], lambda c: N.without_addresses(F.split(c, r"\|")))
    assert kept == [["Acme"], ["P.O. Box 1", "Road 5"]]


def test_verdicts(spark):
    cases = {
        "Conflict: Yes. Severity: High": (True, True, "High"), "**Conflict:** Yes / **Severity:** High": (True, False, "Unknown"), "Conflict: Yes but conflict: no": (False, True, "Unknown"),
        "Conflict: none": (False, False, "Unknown"), "There is a conflict.": (True, False, "Unknown"), "A conflict exists. There is no conflict elsewhere.": (False, True, "Unknown"),
        "This contradicts clause 2; low severity": (True, False, "Low"), "medium severity and high severity": (False, False, "High"), "": (False, False, "Unknown"),
    }
    got = zip(column(spark, list(cases), V.conflict_all_pairs), column(spark, list(cases), V.conflict_one_to_many), column(spark, list(cases), V.severity), strict=True)
    assert list(got) == list(cases.values())


def test_pairs_and_blocks(spark):
    items = spark.createDataFrame([(1, k, f"t{k}") for k in range(3)] + [(2, 0, "x")], "doc_id long, pos int, content string")
    got = [(r.i, r.j) for r in P.upper_triangular(items).filter("doc_id = 1").orderBy("pair_order").collect()]
    assert got == [(0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)]
    thirty = spark.createDataFrame([(1, k, "t") for k in range(30)], "doc_id long, pos int, content string")
    assert P.upper_triangular(thirty).count() == 465 and P.upper_triangular(thirty, self_checks=False).count() == 435
    assert P.one_to_many(thirty).count() == 29
    many = spark.createDataFrame([(1, k) for k in range(160)], "doc_id long, pos int")
    blocks = {}
    for r in P.sliding_blocks(many).collect():
        blocks.setdefault(r.block, []).append(r.pos)
    assert {b: (min(p), max(p)) for b, p in blocks.items()} == {0: (0, 74), 1: (50, 124), 2: (100, 159)}


def test_provider_failures_become_error_rows(spark):
    def provider(prompt):
        if "bad" in prompt:
            raise ValueError("down")
        return V.rule_provider(prompt)

    prompts = spark.createDataFrame([("bad",), ("x\n\n[Clause 1]\npay 30 days\n\n[Clause 2]\npay 60 days\n\nend",), ("x\n\n[Clause 1]\nsame\n\nend",)], "prompt string")
    got = {r.prompt[:3]: (r.conflict, r.severity) for r in V.judged(V.answers(prompts, provider)).collect() if r.prompt == "bad"}
    assert got == {"bad": (False, "Error")}
    assert sorted(r.severity for r in V.judged(V.answers(prompts, provider)).collect()) == ["Error", "Low", "Medium"]


def test_chat(spark):
    turns = spark.createDataFrame([(1, k, "USER" if k % 2 else "assistant", f"m{k}") for k in range(13)], "conv_id long, turn long, role string, text string")
    got = {r.turn: r.prompt for r in chat.prompts(turns).collect()}
    assert got[0] == "User: m0\nAssistant:" and got[2] == "Assistant: m0\nUser: m1\nUser: m2\nAssistant:"
    assert got[12].startswith("Assistant: m2\n") and got[12].count("\n") == 11


def test_contracts(spark):
    at = datetime.datetime(2024, 1, 1, 5)
    rows = [(str(k), "f", "f", "txt", 10, "parsing", None, at + datetime.timedelta(minutes=k % 2), at) for k in range(5)]
    contracts = spark.createDataFrame(rows, K.CONTRACTS)
    assert [r.id for r in K.list_contracts(contracts, 1, 3).collect()] == ["3", "0", "2"]
    patch = spark.createDataFrame([("1", "failed", "oops"), ("2", None, "warn")], "id string, status string, error_message string")
    got = {r.id: (r.status, r.error_message) for r in K.update(contracts, patch, F.lit(at).cast("timestamp_ntz")).collect()}
    assert got["1"] == ("failed", "oops") and got["2"] == ("parsing", "warn") and got["0"] == ("parsing", None)
    clauses = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, contract_id string")
    left = K.delete({"contracts": contracts, "clauses": clauses}, spark.createDataFrame([("1",), ("1",)], "id string"))
    assert left["contracts"].count() == 4 and [r.id for r in left["clauses"].collect()] == ["b"]
    assert column(spark, ["a.PDF", "b.md", "c"], lambda c: K.upload_error(c, F.lit(1))) == [None, "unsupported file type", "unsupported file type"]


def test_review_rules(spark):
    assert column(spark, ["1. Terms 12", "A\tB\t3", "Fees ..... 3", "Table of Contents", "The fee is due."], R.toc_line) == [True, True, True, True, False]
    assert column(spark, ["The parties agree as follows:", "Fees", "The Supplier shall deliver the goods."], R.is_stub) == [True, True, False]
    assert column(spark, ["see clause 2.1 and Section 2.1, article 7"], R.references) == [["2.1", "7"]]
    assert column(spark, ["Fees are payable; invoice monthly", "confidential data", "hello"], R.function_of) == ["PAYMENT", "CONFIDENTIALITY", "GENERAL"]
    numbered = spark.createDataFrame([(1, k, n) for k, n in enumerate(["1", "1.1", "(a)", "2", "2.1.3"])], "d long, pos int, n string")
    got = [(r.n, r.parent_number, r.depth) for r in R.hierarchy(numbered, "d", "pos", "n").orderBy("pos").collect()]
    assert got == [("1", None, 1), ("1.1", "1", 2), ("(a)", "1.1", 3), ("2", None, 1), ("2.1.3", "2.1", 3)]
    long = spark.createDataFrame([("10.", "A. " + "x " * 20 + "(1) one two (2) three"), ("11.", "short")], "clause_number string, content string")
    assert [r.clause_number for r in R.split_long(long, 30).collect()] == ["10.1", "10.2", "10.3", "11."]


def test_pair_order_counts_self_checks_then_pairs(spark):
    items = spark.createDataFrame([(d, p, "x") for d, ps in ((1, (0, 2, 5, 9)), (2, (3,)), (None, (0, 1))) for p in ps], "doc_id int, pos int, content string")
    for self_checks in (True, False):
        got = {(r.doc_id, r.i, r.j): r.pair_order for r in P.upper_triangular(items, self_checks=self_checks).collect()}
        want = {}
        for d, ps in ((1, (0, 2, 5, 9)), (2, (3,))):  # rows without an id meet nothing
            pairs = sorted(((i, j) for i in ps for j in ps if i < j or (self_checks and i == j)), key=lambda p: (p[0] != p[1], p))
            want |= {(d, *pair): k for k, pair in enumerate(pairs)}
        assert got == want


def test_candidate_tiers(spark):
    texts = ["Payment of the FEE", "an invoice; they shall", "they shall not", "recipient", None, "nothing", "subject to an invoice"]
    items = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)] + [(2, 0, "invoice")], "doc_id int, pos int, content string")
    ij = lambda df: sorted((r.i, r.j) for r in df.collect())
    assert ij(T.topic_pairs(items)) == [(0, 1), (0, 6), (1, 6)]
    assert ij(T.topic_pairs(items, 2)) == [(0, 1)]
    assert ij(T.cluster_pairs(items)) == [(0, 1), (0, 6), (1, 6)]  # each once, and "ip" is inside "recipient" alone
    assert ij(T.contrary_pairs(items)) == [(1, 2)]
    assert ij(T.override_against_all(items)) == [(6, k) for k in range(6)]


def test_conflicts_reported(spark):
    found = spark.createDataFrame([(1, 0, 1, 0.9, "d" * 50, "Acme pays", "Beta"), (1, 0, 2, 0.95, "d" * 50, "", "zz"), (1, 0, 7, 1.0, "d" * 60, "Acme", "Acme"), (1, 1, 2, 0.7, None, None, None)], "doc_id int, i int, j int, confidence double, description string, quote_i string, quote_j string")
    items = spark.createDataFrame([(1, 0, "Acme pays the whole price"), (1, 1, "Then Beta pays the whole price"), (1, 2, "short")], "doc_id int, pos int, content string")
    with_texts = T.with_texts(found, items)
    assert with_texts.count() == 3
    assert [(r.i, r.j) for r in T.believable(with_texts).collect()] == [(0, 1)]
    assert [(r.i, r.j) for r in T.verified(with_texts).collect()] == [(0, 1)]
    shown = sorted((r.side, r.start, r.end, r.snippet) for r in T.evidence(with_texts, ["doc_id", "i", "j"], 4).collect())
    assert shown == [("i", 0, 4, "Acme"), ("j", 5, 9, "Beta")]


def test_ingest_makes_the_four_tables(spark):
    long = "1. Scope\n" + "The supplier delivers the goods to the site of the buyer. " * 3 + "\na) first part\n2. Price\nIt is fixed."
    files = spark.createDataFrame([("k1", "/in/A.TXT", 10, long, '["Acme", "Beta"]'), ("k2", "/in/b.exe", 10, long, None), ("k3", "/in/c.txt", 10, None, None)], "id string, path string, size long, text string, answer string")
    made = G.ingest(files, F.lit("2024-01-01").cast("timestamp_ntz"))
    for name, schema in (("contracts", K.CONTRACTS), ("versions", K.VERSIONS), ("parties", K.PARTIES), ("clauses", K.CLAUSES)):
        assert [(f.name, f.dataType) for f in made[name].schema] == [(f.name, f.dataType) for f in schema]
    assert {r.id: (r.status, r.error_message, r.file_type, r.original_filename) for r in made["contracts"].collect()} == {
        "k1": ("completed", None, "txt", "A.TXT"), "k2": ("failed", "unsupported file type", "exe", "b.exe"), "k3": ("failed", "too little text", "txt", "c.txt"),
    }
    assert [(r.contract_id, r.version_number, r.raw_text) for r in made["versions"].collect()] == [("k1", 1, long)]
    assert sorted(r.name for r in made["parties"].collect()) == ["Acme", "Beta"]
    clauses = made["clauses"].collect()
    assert {c.version_id for c in clauses} == {r.id for r in made["versions"].collect()}
    assert {c.parent_clause_id for c in clauses} - {None} <= {c.id for c in clauses}
    assert sorted(c.clause_number for c in clauses if c.parent_clause_id is None) == ["1.", "2."]

"""Comparisons with results: what is asked, how often, how many at a time, and what is read out of it."""

import itertools
import threading
import time
from collections import Counter

from pyspark.sql import functions as F

from clausegrid.operators import compare as B
from clausegrid.operators import verdicts as V


def ticking():
    ticks = itertools.count()
    return lambda: next(ticks) / 2


def words(prompt):
    if "fail" in prompt:
        raise ValueError("no such model")
    if "silent" not in prompt:
        yield "Conflict: Yes."
        yield " Severity: "
        yield "High"


def test_replies_and_their_times(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "fail"), (4, "silent"), (5, None)], "id int, p string")
    got = {r.id: tuple(r.reply) if r.reply else None for r in B.ask(df, F.col("p"), words, clock=ticking).collect()}
    assert got == {1: ("Conflict: Yes. Severity: High", None, 3, 0.5, 1.0, 3.0), 2: ("Conflict: Yes. Severity: High", None, 3, 0.5, 1.0, 3.0), 3: (None, "no such model", 0, 0.0, 0.0, 0.0), 4: ("", None, 0, 0.5, 0.5, 0.0), 5: None}


def test_a_call_fails_in_the_middle(spark):
    def breaks(prompt):
        yield "begun"
        raise OSError

    assert tuple(B.asked_once("x", breaks, ticking())) == (None, "OSError", 0, 0.0, 0.0)


def test_each_prompt_is_asked_once_and_few_at_a_time(spark, tmp_path):
    folder = str(tmp_path)

    def noted(prompt):
        with open(f"{folder}/{threading.get_ident()}-{time.time_ns()}", "w") as f:
            f.write(prompt)
        time.sleep(0.05)
        return "Conflict: No"

    df = spark.createDataFrame([(i, f"p{i % 12}") for i in range(60)], "id int, p string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert B.ask(df, F.col("p"), B.one_token(noted), concurrency=3).filter("reply.answer = 'Conflict: No'").count() == 60
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    asked = list(tmp_path.iterdir())
    assert Counter(f.read_text() for f in asked) == {f"p{i}": 1 for i in range(12)}
    assert 1 < len({f.name.split("-")[0] for f in asked}) <= 3


def test_one_to_many(spark):
    requests = [("r", "p", "s", ["x", "fail", "y"]), ("none", "p", "s", []), ("blank", " ", "s", ["x"]), ("many", "p", "s", ["x"] * 101)]
    df = spark.createDataFrame(requests, "run_id string, prompt string, source string, targets array<string>")
    got = B.compare_one_to_many(df, words, clock=ticking)
    assert sorted((r.run_id, r["index"], r.total, r.conflict, r.severity, r.explanation, r.performance.total_tokens) for r in got.collect()) == [
        ("r", 0, 3, True, "High", "Conflict: Yes. Severity: High", 3), ("r", 1, 3, False, "Error", "Error: no such model", 0), ("r", 2, 3, True, "High", "Conflict: Yes. Severity: High", 3),
    ]
    assert [tuple(r) for r in B.performance(got, ["run_id"]).collect()] == [("r", 2, 6, 2.0, 3.0, 0.5)]


def test_one_to_one(spark):
    pairs = [(1, "p", "a", "b"), (2, "p", "fail", "b"), (3, "", "a", "b"), (4, "p", "a", " "), (5, "p", None, "b"), (6, "p", "a", None)]
    got = B.compare_one(spark.createDataFrame(pairs, "id int, prompt string, clause_a string, clause_b string"), words)
    assert {r.id: (r.response, r.error) for r in got.collect()} == {1: ("Conflict: Yes. Severity: High", None), 2: (None, "no such model"), 3: (None, "blank prompt"), 4: (None, "blank clause"), 5: (None, "blank source"), 6: (None, "blank clause")}


def test_all_against_all(spark):
    items = spark.createDataFrame([(1, 0, "It shall not."), (1, 1, "It shall."), (1, 2, "fail"), (2, 0, "alone"), (3, 0, "a"), (3, 1, " "), *[(4, k, "x") for k in range(51)]], "doc_id long, pos int, content string")
    def provider(prompt):
        if "fail" in prompt:
            raise ValueError("no")
        return V.rule_provider(prompt)

    got = B.compare_all(items, F.lit("pair"), F.lit("self"), B.one_token(provider)).collect()
    assert sorted((r.pair_order, r.i, r.j, r.is_self_check, r.conflict, r.severity) for r in got) == [
        (0, 0, 0, True, False, "Low"), (1, 1, 1, True, False, "Low"), (2, 2, 2, True, False, "Error"), (3, 0, 1, False, True, "High"), (4, 0, 2, False, False, "Error"), (5, 1, 2, False, False, "Error"),
    ]

"""Contradicting claims against the rules tried pair by pair, and that the query's inputs meet every rule."""

import random
from itertools import combinations

from clausegrid.operators import claims as Q
from clausegrid.plans import catalog

SCHEMA = "doc long, claim_id string, topic string, subject string, modality string, value_type string, value string, clause string, is_override boolean, overrides string"
SF = "/root/testdata/sf0.001"


def rule(a, b):
    """The first rule that a pair breaks, or None."""
    (_, _, topic, subject, mod, kind, value, clause, over, what), (_, _, topic2, subject2, mod2, kind2, value2, clause2, over2, what2) = a, b
    if topic != topic2 or (over and what is not None and what == clause2) or (over2 and what2 is not None and what2 == clause):
        return None
    if subject == subject2 and ((mod, mod2) in Q.OPPOSITES or (mod2, mod) in Q.OPPOSITES):
        return "modality"
    if kind and kind == kind2 and value and value2 and subject == subject2 and value != value2:
        return "value"
    if kind == kind2 == "JURISDICTION" and (value or None) != (value2 or None):
        return "jurisdiction"
    if kind == kind2 == "DURATION":
        if topic == "PAYMENT" and subject == subject2:
            return "payment_timing"
        if "lock" in topic.lower():
            return "lock_up"
    return None


def test_pairs_are_those_of_the_rules(spark):
    rnd = random.Random(3)
    rows = [
        (rnd.randrange(3), f"c{k:03d}", rnd.choice(["PAYMENT", "LOCK_UP", "TERM"]), rnd.choice(["buyer", "seller", None]), rnd.choice([*{m for p in Q.OPPOSITES for m in p}, None]), rnd.choice(["DURATION", "JURISDICTION", "AMOUNT", None]),
         rnd.choice(["1", "2", "", None]), str(rnd.randrange(4)), rnd.random() < 0.2, rnd.choice(["1", "2", None]))
        for k in range(150)
    ]
    want = {(a[0], a[1], b[1], a[2], r) for a, b in combinations(rows, 2) if a[0] == b[0] and (r := rule(a, b))}
    got = Q.find_conflicts(spark.createDataFrame(rows, SCHEMA), ["doc"]).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert {r for *_, r in want} == set(Q.RULES)
    assert Q.find_conflicts(spark.createDataFrame([], SCHEMA), ["doc"]).count() == 0


def test_claims_of_clauses(spark):
    clauses = [(1, 0, "1.", "The Supplier must not pay USD 5 or AED 6."), (1, 1, "2)", "Notwithstanding Clause 1.2, a lock-up of 30 days shall prevail."), (1, 2, "3.", None), (1, 3, "4.", "Nothing.")]
    got = Q.claims_of(spark.createDataFrame(clauses, "doc long, pos int, clause_number string, content string"), ["doc"]).collect()
    assert sorted((r.claim_id, r.topic, r.subject, r.modality, r.value_type, r.value, r.clause, r.is_override, r.overrides) for r in got) == [
        ("1/0/0", "GENERAL", "supplier", "MUST_NOT", "AMOUNT", "USD 5", "1", False, None), ("1/0/1", "GENERAL", "supplier", "MUST_NOT", "AMOUNT", "AED 6", "1", False, None),
        ("1/1/0", "LOCK_UP", None, "SHALL", "DURATION", "30 days", "2", True, "1.2"), ("1/3/0", "GENERAL", None, None, None, None, "4", False, None),
    ]


def test_the_query_meets_every_rule_and_overrides(spark):
    found = catalog.QUERIES["contradicting_claims"](spark, SF).groupBy("rule").count().collect()
    assert {r.rule for r in found} == set(Q.RULES)
    claims = Q.claims_of(catalog._stating(spark, SF), ["doc_id"]).cache()
    kept = Q.find_conflicts(claims, ["doc_id"]).count()
    assert 0 < kept < Q.find_conflicts(claims.drop("overrides").selectExpr("*", "CAST(NULL AS STRING) AS overrides"), ["doc_id"]).count()

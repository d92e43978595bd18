"""Outlines against a stack-free plain version, on made-up documents and planted cases."""

import random
import re

from clausegrid.operators import outline as O

NUMBERS = ["1", "1.1", "1.1.1", "1.1.1.1", "1.1.1.1.1", "1.1.1.1.1.1", "2", "2.1.", "2.1.4", "(a)", "(ii)", "APPENDIX A", "Schedule 2 - Fees", "A.1", "A.1.2", "B.1", None, "3)", "x"]


def plain(numbers):
    """(parent, root, depth) of each number of one document."""
    labels, out = [], []
    for n in numbers:
        bare = re.sub(r"[.)]+$", "", (n or "").strip())
        m = re.match(r"(?i)\s*(appendix|annex|schedule|exhibit)\s+([A-Z0-9]+)\b", n or "")
        labels.append((m[2].upper(), True) if m else (bare, False) if re.fullmatch(r"[0-9]+(\.[0-9]+)*|[A-Z](\.[0-9]+)+", bare) else (None, False))
    for i, (own, top) in enumerate(labels):
        parent = None
        if own is None:
            parent = max((k for k in range(i) if labels[k][0] is not None), default=None)
        elif not top:
            parts = own.split(".")
            for size in range(len(parts) - 1, 0, -1):
                parent = max((k for k in range(i) if labels[k][0] == ".".join(parts[:size])), default=None)
                if parent is not None:
                    break
        out.append((parent, i if parent is None else out[parent][1], 0 if parent is None else out[parent][2] + 1))
    return out


def test_outlines_of_made_up_documents(spark):
    rnd = random.Random(2)
    docs = {d: [rnd.choice(NUMBERS) for _ in range(rnd.randrange(1, 40))] for d in range(40)}
    docs[99] = ["1", "1.1", "1.1.1", "1.1.1.1", "1.1.1.1.1", "1.1.1.1.1.1", "(a)", "APPENDIX A", "A.1", "A.1.2", "(b)", "9.9"]
    df = spark.createDataFrame([(d, p, n, "x") for d, ns in docs.items() for p, n in enumerate(ns)], "doc_id long, pos int, number string, label string")
    for most in (None, 16, 40):
        got = {(r.doc_id, r.pos): (r.parent_pos, r.root_pos, r.depth) for r in O.with_roots(O.outline(df), most_depth=most).collect()}
        assert got == {(d, p): x for d, ns in docs.items() for p, x in enumerate(plain(ns))}
    assert got[99, 6] == (5, 0, 6) and got[99, 8] == (7, 7, 1) and got[99, 10] == (9, 7, 3) and got[99, 11] == (None, 11, 0)


def test_categories_come_down(spark):
    rows = [(1, 0, "1", "Payment"), (1, 1, "1.1", "The liability is limited."), (1, 2, "(a)", "any notice"), (1, 3, "SCHEDULE 1", "Confidential matters"), (1, 4, "(a)", "fees")]
    df = O.with_roots(O.outline(spark.createDataFrame(rows, "doc_id long, pos int, number string, text string")))
    assert [r.category for r in O.with_category(df, "text").orderBy("pos").collect()] == ["PAYMENT"] * 3 + ["CONFIDENTIALITY"] * 2


def test_empty(spark):
    assert O.with_category(O.with_roots(O.outline(spark.createDataFrame([], "doc_id long, pos int, number string, text string"))), "text").count() == 0

"""Golden cases and differential tests of text functions and the clause splitter, against plain scanners."""

import random
import string
from itertools import groupby

from pyspark.sql import functions as F

from clausegrid.functions import text as X
from clausegrid.operators import clauses as C

SMALL = tuple(string.ascii_lowercase)


def column(spark, values, f):
    df = spark.createDataFrame(list(enumerate(values)), "i long, t string")
    return [r.o for r in df.select("i", f(F.col("t")).alias("o")).orderBy("i").collect()]


# The rules once more, as scanners that go through a text character by character.


def squeezed(text):
    """Runs of newlines become one newline, then runs of white space one blank; nothing at the ends."""
    single = "".join(c for k, c in enumerate(text) if not (c == "\n" and text[k - 1 : k] == "\n"))
    runs = ("".join(run) for _, run in groupby(single, str.isspace))
    return "".join(" " if run.isspace() and len(run) > 1 else run for run in runs).strip()


def number_end(text, at):
    """Where a clause number (one or two digits, then a dot or bracket) that begins at `at` ends."""
    digits = len(text[at : at + 2]) if text[at : at + 2].isdecimal() else len(text[at : at + 1]) if text[at : at + 1].isdecimal() else 0
    sizes = (digits, digits - 1) if digits == 2 else (digits,)
    return next((at + n + 1 for n in sizes if n and text[at + n : at + n + 1] in (".", ")")), None)


def letter_end(text, at):
    return at + 2 if text[at : at + 1] in SMALL and text[at + 1 : at + 2] == ")" else None


def after_newline(text, at, free):
    return at > 0 and text[at - 1] == "\n"


def at_line_start(text, at, free):
    """As a boundary of a clause: the newline must not belong to the mark before."""
    return at == 0 or (text[at - 1] == "\n" and at - 1 >= free)


def shouted(text, end_of, starts):
    """Titles in capitals: what follows a mark up to the end of its line, if it begins with a small letter."""
    out, at, free = [], 0, 0
    while at < len(text):
        end = end_of(text, at) if starts(text, at, free) else None
        title = end
        while title is not None and text[title : title + 1].isspace():
            title += 1
        if title is not None and text[title : title + 1] in SMALL:
            stop = text.find("\n", title)
            stop = len(text) if stop < 0 else stop
            out.append(text[at:end] + " " + text[title:stop].upper())
            at = free = stop
        else:
            out.append(text[at])
            at += 1
    return "".join(out)


def capitals(text):
    return shouted(shouted(text, number_end, at_line_start), letter_end, after_newline)


def marks(text, end_of, starts):
    """(place, mark) of each mark with white space behind it, which it uses up."""
    out, free = [], 0
    for at in range(len(text)):
        end = end_of(text, at) if at >= free and starts(text, at, free) else None
        if end is not None and text[end : end + 1].isspace():
            out.append((at, text[at:end]))
            free = end + 1
    return out


def without_rules(text):
    """Without runs of equal signs and the white space behind each."""
    out, dropping = [], False
    for c in text:
        if c == "=" or (dropping and c.isspace()):
            dropping = True
        else:
            dropping = False
            out.append(c)
    return "".join(out)


def cut(text, found):
    return [(mark, text[at:stop].strip()) for (at, mark), stop in zip(found, [p for p, _ in found[1:]] + [len(text)], strict=True)] if found else []


def clauses_of(text):
    out = []
    for number, body in cut(text, marks(text, number_end, at_line_start)):
        body = without_rules(body)
        found = marks(body, letter_end, after_newline)
        out.append((number, body[: found[0][0]].strip() if found else body, cut(body, found)))
    return out


def test_normalize_golden(spark):
    cases = {"A\r\n1. foo\r\n2. bar": "A 1. foo 2. bar", "A\n   a) foo\n \n1. bar": "A a) foo 1. bar", "A\n\n\nB": "A\nB", "": "", "  x": "x"}
    assert column(spark, list(cases), X.normalize) == list(cases.values())


def test_capitalize_golden(spark):
    cases = {"1. intro x": "1. INTRO X", "1. Intro x": "1. Intro x", "2)fees": "2) FEES", "1.\nfoo": "1. FOO", "x\na) scope": "x\na) SCOPE"}
    assert column(spark, list(cases), X.capitalize_titles) == list(cases.values())


def test_split_golden_and_fuzzed(spark):
    golden = ["Intro\n1. X\nbody\na) S\nb) T\n2) Y", "1.\n2. x", "1.5 x", "123. x", "1. a == b", "1. T ..... 4\na) s", "1. T\na) s ..... 4", "", "no clause"]
    rnd = random.Random(4)
    parts = ["1.", "12)", "3. ", "a)", "b) ", "\n", "\n\n", " ", "  ", "x", "Text here", "==", ".....", "title", "ß", "\t", "9)y"]
    texts = golden + ["".join(rnd.choices(parts, k=rnd.randrange(1, 25))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = df.select("doc_id", X.capitalize_titles(X.normalize(F.col("text"))).alias("text"))
    assert [r.text for r in plain.orderBy("doc_id").collect()] == [capitals(squeezed(t)) for t in texts]
    got = {}
    for r in C.split_clauses(plain).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append((r.clause_number, r.content, [tuple(s) for s in r.subs]))
    want = {i: s for i, t in enumerate(texts) if (s := clauses_of(capitals(squeezed(t))))}
    assert got == want and len(want) > 300
    kept = {(r.doc_id, r.pos) for r in C.extract_clauses(df).collect()}
    assert kept == {(i, k) for i, s in want.items() for k, c in enumerate(s) if "....." not in c[1]}


def test_words_and_pages(spark):
    values = ["one", " ".join(["w"] * 999), " ".join(["w"] * 1000), "", "  \n "]
    assert column(spark, values, X.word_count) == [1, 999, 1000, 0, 0]
    assert column(spark, values, lambda c: X.page_count(X.word_count(c))) == [1, 1, 2, 1, 1]
    assert column(spark, ["[Page 3] a page12 b"], X.remove_page_numbers) == [" a  b"]


def test_tree_and_flat_table(spark):
    df = spark.createDataFrame([(1, "1. Alpha\na) one\nb) two\n2. Beta"), (2, "none"), (3, None)], "doc_id long, text string")
    clauses = C.extract_clauses(df)
    flat = C.flat_clauses(clauses)
    assert flat.count() == 4 and flat.filter("parent_clause_id IS NULL").count() == 2
    tree = {r.clause_number: [s.clause_number for s in r.sub_clauses] for r in C.clause_tree(flat).collect()}
    assert tree == {"1.": ["a)", "b)"], "2.": []}
    assert {tuple(r) for r in C.extraction_stats(df, clauses).collect()} == {(1, 2, 2, 4), (2, 0, 0, 0), (3, 0, 0, 0)}
    assert [r.clause_number for r in C.search(clauses, "BETA").collect()] == ["2."]

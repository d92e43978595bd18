"""Line dedup against a brute-force version of its definition."""

import random
import re
from collections import Counter, defaultdict

import pytest

from clausegrid.llm.line_dedup import drop_recurring_lines


def brute(texts, min_docs=10, leading=3, min_tokens=3, constant=0.7, variety=0.6):
    parsed = {}
    for t in texts:
        parsed[t or ""] = [tuple("<*>" if re.search("[0-9]", w) else w for w in re.split(r"[ \t\n\x0b\f\r]+", line) if w) for line in (t or "").split("\n")]
    leaf = lambda tokens: (len(tokens), tokens[:leading])
    support, holders = Counter(), defaultdict(set)
    for t, lines in parsed.items():
        for tokens in lines:
            if len(tokens) >= min_tokens:
                holders[tokens].add(t)
    for tokens, docs in holders.items():
        for at, w in enumerate(tokens):
            support[leaf(tokens), at, w] += len(docs)
    template, seen = {}, defaultdict(lambda: defaultdict(set))
    for tokens in holders:
        general = tuple(w if w != "<*>" and support[leaf(tokens), at, w] >= min_docs else "<*>" for at, w in enumerate(tokens))
        if sum(w != "<*>" for w in general) / len(general) >= constant:
            template[tokens] = (leaf(tokens), general)
    for t, lines in parsed.items():
        for i, tokens in enumerate(lines):
            if tokens in template:
                found = seen[template[tokens]]
                found["docs"].add(t)
                for k, v in (("before", leaf(lines[i - 1]) if i else None), ("after", leaf(lines[i + 1]) if i + 1 < len(lines) else None), ("first", leaf(lines[0])), ("last", leaf(lines[-1]))):
                    found[k].add(v)
    gone = {k for k, f in seen.items() if len(f["docs"]) >= min_docs and max(len(f[c]) for c in ("before", "after", "first", "last")) >= variety * len(f["docs"])}
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [line for line, tokens in zip(lines, parsed[t or ""], strict=True) if template.get(tokens) not in gone]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def corpus():
    rnd = random.Random(11)
    words = [f"{a}{b}" for a in "klmnprst" for b in ("an", "or", "ish", "ed", "um", "ou")]
    own = lambda n: " ".join(rnd.choices(words, k=n))
    texts = [None, "", "\n", "\n\n  \n", "a b c", " ".join(words) * 300]
    for i in range(60):
        lines = [own(rnd.randrange(4, 25)) for _ in range(rnd.randrange(1, 6))]
        if i % 2:
            lines.insert(rnd.randrange(len(lines) + 1), f"Page {i} of our site, all rights are kept by user{i % 5}")
        if i % 3 == 0:
            lines += ["This text may be shared", "under the terms of a licence"]
        if i % 4 == 0:
            lines.append(f"Sincerely yours in haste {rnd.choice(words)}{rnd.choice(words)}")
        texts.append("\n".join(lines))
    whole = [own(12) for _ in range(5)]
    for i in range(25):  # a copied document with a change in one line
        texts.append("\n".join([*whole[:3], whole[3] + f" {own(1)} {i}", whole[4]]))
    return texts + texts[7:20]


@pytest.mark.parametrize("most_handed", [500_000, 3])
def test_lines_dropped_are_those_of_the_definition(spark, most_handed):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, line string, leaf int")
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in drop_recurring_lines(df, most_handed=most_handed).collect()}
    want = brute(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(n for _, _, n in want) > 50 and all(n == 0 for _, _, n in want[66:91])


def test_empty_table(spark):
    assert drop_recurring_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def dropped(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = drop_recurring_lines(df).collect()
    return {r.doc_id: set(texts[r.doc_id].split("\n")) - set(r.text.split("\n")) for r in rows}


def own_words(rnd, n):
    return " ".join("".join(rnd.choices("abcdefghijklmnop", k=6)) for _ in range(n))


def test_near_copies_and_lines_that_recur_together_hide_nothing(spark):
    rnd = random.Random(5)
    site = ["Welcome to our site", "Choose what you read", "News for every day", "All rights are kept by us"]
    page = [own_words(rnd, 15) for _ in range(12)]
    texts = ["\n".join([*site[:3], *(own_words(rnd, 20) for _ in range(4)), site[3]]) for _ in range(30)]
    for _ in range(150):  # near copies of one page, each with words of its own anywhere
        words = [line.split() for line in page]
        for _ in range(4):
            line = rnd.choice(words)
            line.insert(rnd.randrange(len(line)), own_words(rnd, 1))
        texts.append("\n".join([site[0], *(" ".join(w) for w in words), site[3]]))
    got = dropped(spark, texts)
    assert all(got[i] == set(site) for i in range(30)) and all(got[i] == {site[0], site[3]} for i in range(30, 180))


def test_support_falls_with_length(spark):
    rnd = random.Random(6)
    passage, twice, copied = own_words(rnd, 60), own_words(rnd, 60), own_words(rnd, 60)
    texts = ["\n".join([own_words(rnd, 150), passage, own_words(rnd, 100), *([twice] if i < 2 else [])]) for i in range(3)]
    body = own_words(rnd, 200)
    texts += [f"{body} {own_words(rnd, 2)}\n{copied}" for _ in range(5)]
    texts += [own_words(rnd, 30) + "\nRead more\n" + own_words(rnd, 30) + f"\n{i}" for i in range(120)]
    texts += [own_words(rnd, 30) + "\nBy hand\n" + own_words(rnd, 30) for i in range(40)]
    got = dropped(spark, texts)
    assert all(got[i] == {passage} for i in range(3)) and all(not got[i] for i in range(3, 8)) and all(got[i] == {"Read more"} for i in range(8, 128)) and all(not got[i] for i in range(128, 168))


@pytest.mark.parametrize("shared, own", [(14, 5), (20, 5), (10, 5), (6, 6)])
def test_pages_that_are_mostly_alike_lose_what_they_share(spark, shared, own):
    rnd = random.Random(shared)
    site = [own_words(rnd, 10) for _ in range(shared)]
    texts = ["\n".join([*site[: shared // 2], *(own_words(rnd, 10) for _ in range(own)), *site[shared // 2 :]]) for _ in range(120)]
    got = dropped(spark, texts)
    assert all(got[i] == set(site) for i in range(120))

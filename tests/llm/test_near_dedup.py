"""Near-dedup: the signature's law, and classes against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np

from clausegrid.llm.common import bitmap_of, bits_by_least, bits_of
from clausegrid.llm.near_dedup import linked, merged, near_duplicates, signatures


def bag(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def similarity(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def brute(texts):
    bags, parent = [bag(t) for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or similarity(bags[i], bags[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(texts))]


def test_signature_agreement_is_the_weighted_jaccard_similarity():
    rnd = np.random.default_rng(7)
    names = rnd.integers(0, 2**63, 60).astype(np.uint64)
    a, b = rnd.integers(1, 9, 60), rnd.integers(1, 9, 60)
    left, right = signatures([(names[:50], a[:50]), (names[10:], b[10:])], 4096)
    full_a, full_b = np.where(np.arange(60) < 50, a, 0), np.where(np.arange(60) >= 10, b, 0)
    want = np.minimum(full_a, full_b).sum() / np.maximum(full_a, full_b).sum()
    assert abs((left == right).mean() - want) < 4 * np.sqrt(want * (1 - want) / 4096)


def corpus(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " ", "one two", "one two", "one  two", "a b c d e"]
    for _ in range(25):
        base = rnd.choices(words, k=rnd.choice([8, 60, 150, 300]))
        texts.append(" ".join(base))
        for _ in range(rnd.choice([0, 0, 1, 3, 12])):
            copy = list(base)
            for _ in range(rnd.randrange(0, 1 + len(base) // 25)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts.append(" ".join(copy))
    base = rnd.choices(words, k=200)
    for k in range(80):  # one large group, whose members mostly differ by more from each other than from its base
        copy = list(base)
        for _ in range(k % 7):
            copy[rnd.randrange(200)] = f"new{rnd.random()}"
        texts.append(" ".join(copy))
    rnd.shuffle(texts)
    return texts


def test_classes_are_the_components_of_all_links(spark):
    texts = corpus(5)
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, label int")
    out = near_duplicates(df).collect()
    want, got = brute(texts), {r.doc_id: r.class_id for r in out}
    assert [got[i] for i in range(len(texts))] == want
    sizes, kept = Counter(want), defaultdict(int)
    for r in out:
        assert r.class_size == sizes[r.class_id]
        kept[r.class_id] += r.kept
    assert set(kept.values()) == {1}


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "x y z"), (1, "x y z"), (None, "x y z"), (2, None)]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.class_id, r.class_size) for r in out) == [(1, 3), (1, 3), (1, 3), (2, 1)] and sum(r.kept for r in out) == 2
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_of_each_stays_where_ids_are_null_or_repeat(spark):
    from clausegrid.llm.near_dedup import keep_one_of_each

    base = [" ".join(f"w{k}x{i}" for i in range(300)) for k in range(3)]
    rows = [(None, base[0]), (None, base[0] + " a"), (None, base[0] + " b"), (None, base[0]), (7, base[1]), (7, base[1] + " c"), (None, base[2]), (8, None), (8, "")]
    kept = keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.text or "").split("x")[0] for r in kept) == ["", "w0", "w1", "w2"]


def test_no_links_leave_the_labels_as_they_are(spark):
    labels = spark.createDataFrame([(2, 1), (1, 1)], "id long, label long")
    assert merged(labels, spark.createDataFrame([], "a long, b long")) is labels
    after = merged(labels, spark.createDataFrame([(2, 7), (8, 7)], "a long, b long"))
    assert {tuple(r) for r in after.collect()} == {(1, 1), (2, 1), (7, 1), (8, 1)}


def test_labels_spread_along_a_chain(spark):
    chain = [(k + 1, k) for k in range(10, 40)] + [(90, 80)]
    assert {tuple(r) for r in linked(spark.createDataFrame(chain, "a long, b long")).collect()} == {*((k, 10) for k in range(10, 41)), (80, 80), (90, 80)}
    assert linked(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bitmaps_of_several_frequencies_are_those_of_each(spark):
    counted = spark.range(500).selectExpr("xxhash64(id) AS key", "id % 40 AS n")
    found = bits_by_least(counted, (2, 9, 33, 257), 12)
    for least, marked in zip((2, 9, 33, 257), found, strict=True):
        assert (marked == bits_of(bitmap_of(counted.filter(f"n >= {least}").select("key"), 12), 12)).all()

"""Packing: every id once, ids as the tokenizer gives them, gapless offsets, little padding."""

import random

from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from clausegrid.llm.packing import Plan, combinations, nnls, pack, cut_pieces, vocabulary_path

ODD = [None, "", " ", "\n\n", "Hello, World! it's <|endoftext|> 12.5%", "ΣΑΣ Σ İstanbul ǅ é  x\x1cy", "déjà Vu, GRÖSSE; ñ. a..b ,,", "word " * 3000, "x" * 5000, "same", "same", "日本語 テキスト😀"]


def check(rows, texts, window=2048):
    tokenizer = Tokenizer.from_file(vocabulary_path())
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(docs) == set(range(len(texts)))
    for i, text in enumerate(texts):
        want = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        got = b"".join(r.ids for r in sorted(docs[i], key=lambda r: r.start))
        assert got == want and all(r.doc_tokens == len(want) // 4 and r.length == len(r.ids) // 4 for r in docs[i])
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return sum(len(r.ids) // 4 for r in rows) / (window * len(sequences))


def test_ids_and_offsets(spark):
    rnd = random.Random(3)
    words = "alpha Beta gamma, délta epsilon. zeta (eta) theta's 42 iota-kappa".split()
    texts = ODD + [" ".join(rnd.choices(words, k=rnd.randrange(1, 1200))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert check(pack(cut_pieces(df, vocabulary_path())).collect(), texts) > 0.93


def test_empty_table_and_clashing_names(spark):
    assert pack(cut_pieces(spark.createDataFrame([], "doc_id long, text string"), vocabulary_path())).count() == 0
    rows = spark.createDataFrame([(None, "a b", 5, 7), (None, "a b", 5, 7)], "doc_id long, text string, length int, offset int")
    assert [(r.doc_id, r.length) for r in pack(cut_pieces(rows, vocabulary_path())).collect()] == [(None, 3), (None, 3)]


def test_combinations_are_all_that_fill_the_window():
    for levels, full in (([1, 2, 3, 5], 6), (list(range(1, 13)), 12), ([4], 12), ([7], 12)):
        want = {tuple(sorted(c)) for c in ([(a,) for a in levels] + [(a, b) for a in levels for b in levels] + [(a, b, c) for a in levels for b in levels for c in levels]) if sum(c) == full}
        assert set(combinations(levels, full)) == want


def test_nnls_meets_the_optimality_conditions():
    rnd = np.random.default_rng(1)
    a, b = rnd.random((20, 60)), rnd.random(20)
    x = nnls(a, b)
    slope = a.T @ (b - a @ x)
    assert (x >= 0).all() and slope.max() < 1e-7 and np.abs(slope[x > 0]).max() < 1e-7


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_each_piece_once(seed):
    rnd = random.Random(seed)
    histogram = {k: rnd.choice([0, 1, 7, 1000]) for k in range(1, 257) if rnd.random() < 0.7}
    plan = Plan(histogram, 256)
    used = Counter()
    for (level, first, sequence, _), after in zip(plan.entries, [*plan.entries[1:], None], strict=True):
        end = after[1] if after and after[0] == level else histogram[level]
        for k in range(end - first):
            used[sequence + k] += level
    assert max(used.values(), default=0) <= 256 and len(used) == plan.sequences
    total = sum(k * n for k, n in histogram.items())
    assert total / 256 <= plan.sequences <= fewest(histogram, 256) * 1.025 + 2


def fewest(histogram, full):
    """A lower bound on the sequences (Martello and Toth's L2): pieces over half a window never share one, and those of k or more only fit beside what leaves k."""
    best = 0
    for k in range(full // 2 + 1):
        alone = sum(n for size, n in histogram.items() if size > full - k)
        half = {size: n for size, n in histogram.items() if full // 2 < size <= full - k}
        rest = sum(size * n for size, n in histogram.items() if k <= size <= full // 2) - sum((full - size) * n for size, n in half.items())
        best = max(best, alone + sum(half.values()) + max(0, -(-rest // full)))
    return best

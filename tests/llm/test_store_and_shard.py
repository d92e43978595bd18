"""Exact dedup, sharding and media columns against brute force on small tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from clausegrid.llm.exact_dedup import exact_dedup
from clausegrid.llm.media import from_png, store_media, text_payloads, to_png, with_features, with_metadata
from clausegrid.llm.sharding import shard_by_bytes

ODD = [(1, "a b", "x"), (2, "a b", "y"), (2, "a b", "y"), (None, "a b", "z"), (3, None, None), (4, "", "x"), (5, "a b ", "x"), (6, "é" * 300_000, "x"), (7, "é" * 300_000, "w"), (8, "a" * 256 + "1", None), (9, "a" * 256 + "2", None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, size string")  # `size`: a clashing name


def test_exact_dedup_odd_rows(spark):
    out = exact_dedup(frame(spark, ODD)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in out) == Counter(
        [(1, 2, 4), (2, 2, 4), (2, 2, 4), (None, 2, 4), (3, 4, 2), (4, 4, 2), (5, 5, 1), (6, 7, 2), (7, 7, 2), (8, 8, 1), (9, 9, 1)]
    )
    assert Counter(r.keep_id for r in out if r.kept) == Counter([2, 4, 5, 7, 8, 9])


def test_exact_dedup_with_a_full_bitmap_and_empty(spark):
    rows = [(i, f"text {i % 150}", None) for i in range(400)]
    out = exact_dedup(frame(spark, rows), bits=7).collect()
    last = {f"text {i % 150}": i for i in range(400)}
    assert {(r.doc_id, r.keep_id) for r in out} == {(i, last[t]) for i, t, _ in rows}
    assert exact_dedup(frame(spark, [])).count() == 0


@pytest.mark.parametrize("rows", [ODD, [(i, f"word {i % 37} " * (i % 50), None) for i in range(600)] + [(7, "same text", None)] * 300, [(1, "one", None)], []])
def test_sharding_is_balanced_and_gapless(spark, rows):
    out = shard_by_bytes(frame(spark, rows), range_bytes=2_000).collect()
    assert Counter((r.doc_id, r["size"]) for r in out) == Counter((i, len((t or "").encode()) + 1) for i, t, _ in rows)
    slots, size = defaultdict(list), Counter()
    for r in out:
        slots[r.shard].append(r.slot)
        size[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if rows:
        largest = max(len((t or "").encode()) + 1 for _, t, _ in rows)
        share = sum(size.values()) / 8
        assert all(abs(size[k] - share) <= 2 * (largest + 0.01 * share) for k in range(8))


def test_sharding_keeps_small_groups_whole(spark):
    rows = [(i, f"text number {i // 3}", None) for i in range(3000)]
    out = shard_by_bytes(frame(spark, rows), range_bytes=4_000).collect()
    text = {i: t for i, t, _ in rows}
    where = defaultdict(set)
    for r in out:
        where[text[r.doc_id]].add(r.shard)
    assert sum(len(s) > 1 for s in where.values()) <= 30  # only where a range boundary fell inside


def test_png_round_trip():
    for n in (1, 2, 1000):
        payload = bytes((i * 7) % 256 for i in range(64 * n))
        assert from_png(to_png(payload)) == payload
    with pytest.raises(ValueError):
        to_png(b"")
    broken = bytearray(to_png(bytes(640)))
    broken[45] ^= 1
    with pytest.raises(ValueError):
        from_png(bytes(broken))


def test_media_columns_are_what_was_stored(spark):
    payloads = text_payloads(frame(spark, ODD))
    found = {r.digest: r for r in with_features(with_metadata(store_media(payloads))).collect()}
    rows = payloads.collect()
    assert {r.digest for r in rows} == set(found)
    for (_, text, _), row in zip(ODD, rows, strict=True):
        raw = (text or "").encode()
        want = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        got = found[row.digest]
        assert (row.n_bytes, got.payload_bytes, got.payload_sha256) == (len(raw), len(want), hashlib.sha256(want).hexdigest())
        assert got.tail_crc32 == zlib.crc32(want[-64:])
        assert (got.width, got.height, got.bit_depth, got.colour_type) == (64, len(want) // 64, 8, 0)
    assert store_media(text_payloads(frame(spark, []))).count() == 0

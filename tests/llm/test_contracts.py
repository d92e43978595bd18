"""The queries as they are registered, on the smallest tables: names, types, and what can be worked out again beside them."""

import hashlib
import math
import zlib
from collections import defaultdict

import duckdb
import pandas as pd
import pytest

from clausegrid import llm

SF = "/root/testdata/sf0.001"
#: The columns that each contract fixes, in order; more may follow.
COLUMNS = {
    "op1_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op2_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op3_media_columns": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op5_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op7_html_text": "page_id bigint, url string, text string, n_chars bigint", "op9_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op11_prefix_trie": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
    "op12_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op13_filter_audit": "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint",
}


@pytest.fixture(scope="module")
def results(spark):
    return {name: query(spark, SF) for name, query in llm.QUERIES.items()}


@pytest.fixture(scope="module")
def texts():
    return {r.doc_id: r.text or "" for r in pd.read_parquet(f"{SF}/documents.parquet").itertuples()}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_names_and_types(results, name):
    found = dict(results[name].dtypes)
    wanted = dict(c.split() for c in COLUMNS[name].split(", "))
    assert {c: found.get(c) for c in wanted} == wanted


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in llm.QUERIES) == list(range(1, 14)) and set(llm.ORACLES) <= set(llm.QUERIES)


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_query_equals_its_sql(results, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    sql = con.sql(llm.ORACLES[name])
    assert sorted(sql.columns) == sorted(results[name].columns)
    rows = [tuple(r[sql.columns.index(c)] for c in results[name].columns) for r in sql.fetchall()]
    assert sorted(map(str, rows)) == sorted(str(tuple(r)) for r in results[name].collect())


def test_sharding(results, texts):
    rows = results["op2_sharding"].collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {d: (len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in texts.items()}
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [sum(r.size for r in rows if r.shard == k) for k in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in rows)


def test_media(results, texts):
    seen = {}
    for r in results["op3_media_columns"].collect():
        raw = texts[r.doc_id].encode()
        padded = raw + bytes(64 * max(1, math.ceil(len(raw) / 64)) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert seen.setdefault(raw, tuple(r)[5:8]) == tuple(r)[5:8]


def test_toxicity(results, texts):
    rows = results["op9_toxicity"].collect()
    assert {r.doc_id for r in rows} == set(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_packing(results, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in results["op10_packing"].collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for d, text in texts.items():
        ids, at = [*tokenizer.encode(text, add_special_tokens=False).ids, 1], 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    assert sorted(sequences) == list(range(len(sequences)))
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_copies_and_spans(results, texts):
    groups = defaultdict(list)
    for d, t in texts.items():
        groups[t].append(d)
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in results["op1_exact_dedup"].collect()} == {d: (max(groups[t]), len(groups[t]), d == max(groups[t])) for d, t in texts.items()}
    for name, kinds in (("op5_pii", ("email", "ip", "card", "phone")), ("op12_secret_scan", ("assign", "access", "hex"))):
        for r in results[name].collect():
            spans = [s.split(":") for s in r.spans.split(",") if s]
            base = [s for s in spans if s[0] in kinds]
            assert hashlib.sha256(",".join(map(":".join, base)).encode()).hexdigest() == r.base_sha256
            assert all(0 <= int(a) < int(e) <= len(texts[r.doc_id]) for _, a, e in spans) and [int(a) for _, a, _ in spans] == sorted(int(a) for _, a, _ in spans)

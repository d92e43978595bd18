"""The trie of shared prefixes against a dictionary of all prefixes, and the query against its SQL."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from clausegrid.llm import prefix_trie as P

NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def plain(rows):
    """Rebuilt conversations of rows (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    turns = {c: [t[3:] for t in sorted(own)] for c, own in convs.items()}
    borrowed = {c: zlib.crc32(str(c).encode()) % 6 for c in turns}
    return {c: turns.get(c - int(math.fmod(c, 100)), [])[: borrowed[c]] + turns[c][borrowed[c] :] for c in turns}


def brute(convs):
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    kids, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
            leaves[p[:d]] += not kids[p]
    ends = lambda p, m: ",".join(str(c) for c in m if len(convs[c]) == len(p))
    return sorted(((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends(p, m).encode()).hexdigest()) for p, m in members.items()), key=lambda r: r[:2])


def rows_of(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=lambda r: r[:2])


def made_up(seed):
    """Rows with nulls, gaps, ties, repeats, bases that are short or absent, negative ids and copies."""
    rnd = random.Random(seed)
    rows = []
    for c in [*range(0, 12), *range(100, 108), 205, 206, 207, 301, -5, -105, -100, 2**40]:
        for turn in range(rnd.randrange(1, 9)):
            rows.append((c, rnd.choice([turn, None]) if turn == 0 else turn, rnd.choice(["user", "bot", None]), rnd.choice(["a", "bb", "", None, "é😀"])))
    return rows + [(None, 1, "user", "lost"), (3, 2, "user", "tie"), (3, 2, "user", "tie"), (3, 2, "bot", "x" * 100_000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_query_equals_brute_force_and_its_sql(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(P, "PARTS", 3)  # so that classes are met both ways
    rows = made_up(seed)
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, pos int")
    df.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = P.op11_prefix_trie(spark, str(tmp_path))
    assert got.columns == list(NAMES) and [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    assert rows_of(got) == brute(plain(rows))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    found = con.sql(P.OP11_SQL)
    assert sorted((tuple(r[found.columns.index(n)] for n in NAMES) for r in found.fetchall()), key=lambda r: r[:2]) == brute(plain(rows))


def given(spark, convs):
    rows = [(c, p, (hashlib.sha256(repr(t).encode()).digest() if p else None), len(t[1]) if p else 0) for c, turns in convs.items() for p, t in enumerate([("", ""), *turns])]
    return spark.createDataFrame(rows, "conv long, pos long, digest binary, chars long")


def listed(trie):
    """The nodes of a trie, with the hash of the ids that end there."""
    several = trie.nodes.join(P.id_list_digests(trie.members), "copies")
    one = trie.nodes.filter("coalesce(n_ends, 0) < 2").withColumn("sha256", F.sha2(F.coalesce(F.col("end_id").cast("string"), F.lit("")), 256))
    return rows_of(several.select(*NAMES[:7], F.col("sha256").alias("ends_sha256")).unionByName(one.select(*NAMES[:7], F.col("sha256").alias("ends_sha256"))))


def test_long_common_stretches_copies_and_forks_at_the_end(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 4)
    long = [("user", "t" * (k % 5)) for k in range(61)]
    convs = {1: long, 2: long[:60] + [("user", "other")], 3: long, 4: long[:30], 5: long[:30], 6: [], 7: [], 8: long[:10] + [("bot", "x")] * 5, 9: [("z", "z")] * 3, 10: [("z", "z")] * 3, 11: long + [("user", "more")]}
    assert listed(P.prefix_trie(given(spark, convs))) == brute(convs)


def test_one_conversation_alone_only_copies_and_none(spark):
    for convs in ({7: [("a", "bc")] * 3}, {7: [("a", "bc")] * 3, 8: [("a", "bc")] * 3, 12: [("a", "bc")] * 3}, {5: []}):
        assert listed(P.prefix_trie(given(spark, convs))) == brute(convs)
    empty = spark.createDataFrame([], "conv long, pos long, digest binary, chars long")
    assert P.prefix_trie(empty).nodes.count() == 0


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert P.op11_prefix_trie(spark, str(tmp_path)).count() == 0


def test_a_conversation_over_many_ranges_is_numbered_through(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keeps all ranges apart
    try:
        rows = [(1, k, "user", "a") for k in range(3)] + [(2, k, "user", str(k)) for k in range(500)] + [(3, 0, "user", "b")]
        got = P.turns_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert sorted((r.conv, r.pos) for r in got) == [(c, t + 1) for c, t, _, _ in rows]
    assert {(r.conv, r.pos): bytes(r.digest).hex() for r in got} == {(c, t + 1): digest(role, text) for c, t, role, text in rows}

"""Line dedup with a log-template tree: recurring line templates are dropped from all documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid.llm.common import bitmap_of, bits_of, give_back, hot_join, in_bits, may_repeat, table, whole, written
from clausegrid.llm.near_dedup import components

VARIABLE = b"<*>"
BITS = 23
#: Digits as zeros, so that one search tells whether there is any.
ZEROS = bytes.maketrans(b"0123456789", b"0" * 10)
LINE = "_key binary, pos int, line binary, masked string, leaf long"
#: A text's sketch: the least hash of its WINDOW-byte windows in each of BANDS * ROWS ranges of hashes.
WINDOW, BANDS, ROWS = 16, 16, 4
#: And 16 bits of the least hash in each of PRINTS ranges: the share of equal ones estimates the similarity of two texts with a
#: deviation of 0.025 at 0.8. What is estimated at ALIKE or more counts as a near copy: 0.8, less what the estimate may be off.
PRINTS, ALIKE = 256, 0.73
#: The two low bits of a leaf: an ordinary line, a long one, a short one.
LONG, SHORT = 1, 2


def _tokens(line: bytes, leading: int) -> tuple[int, list[bytes]]:
    """How many tokens a line has, and the leading ones; a token with a digit is a variable field from the start."""
    words = line.split()
    return len(words), [VARIABLE if b"0" in w.translate(ZEROS) else w for w in words[:leading]]


def _leaf(n: int, head: list[bytes], min_tokens: int, long_tokens: int) -> int:
    """The leaf of the tree reached by the number of tokens and the leading ones, as a signed 64-bit hash with the line's length class."""
    kind = LONG if n >= long_tokens else SHORT if n < min_tokens else 0
    return (xxhash.xxh64_intdigest(b"%d %s" % (n, b" ".join(head))) & ~3 | kind) - (1 << 63)


def _masked(line: bytes) -> bytes:
    """A line's tokens, variable ones masked, joined by one blank."""
    words = line.split()
    if b"0" in line.translate(ZEROS):
        words = [VARIABLE if b"0" in w.translate(ZEROS) else w for w in words]
    return b" ".join(words)


def _texts(batch: pa.RecordBatch, seen: set[bytes]) -> Iterator[tuple[bytes, list[bytes]]]:
    """Key and lines of each text that this task has not met before."""
    for text in batch.column(0).cast(pa.binary()):
        raw = text.as_py()
        key = hashlib.md5(raw).digest()
        if key not in seen:
            seen.add(key)
            yield key, raw.split(b"\n")


def _leaves(leading: int, min_tokens: int, long_tokens: int):
    """(_key, leaves): the distinct leaves of each text's lines that are not blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keys, leaves = [], []
            for key, lines in _texts(batch, seen):
                keys.append(key)
                leaves.append(list({_leaf(n, head, min_tokens, long_tokens) for n, head in (_tokens(line, leading) for line in lines) if n}))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(leaves, pa.list_(pa.int64()))], ["_key", "leaves"])
        give_back()

    return run


def _near_lines(busy: np.ndarray, leading: int, min_tokens: int, long_tokens: int):
    """The lines in busy leaves (a bitmap of BITS bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            rows = []
            for key, lines in _texts(batch, seen):
                parsed = [_tokens(line, leading) for line in lines]
                leaves = [_leaf(*p, min_tokens, long_tokens) for p in parsed]
                hit = in_bits(busy, np.array(leaves, np.int64), BITS)
                for i in np.flatnonzero(hit).tolist():
                    if parsed[i][0]:
                        masked = _masked(lines[i])
                        rows.append((key, i, hashlib.md5(masked).digest(), masked.decode(), leaves[i]))
            kinds = [pa.binary(), pa.int32(), pa.binary(), pa.string(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in LINE.split(", ")])
        give_back()

    return run


def sketch(raw: bytes) -> tuple[list[int], bytes]:
    """Hashes of which two texts share at least one if they are near copies, and the prints that tell how alike two texts are.

    A pair whose windows have a Jaccard similarity of 0.8 shares no hash with a chance of 2e-4, one at 0.3 shares one with 0.12.
    """
    raw = raw.ljust(WINDOW, b"\0")
    n = len(raw) - WINDOW + 1
    half = [np.ndarray((n,), np.uint64, raw, k, (1,)) for k in (0, 8)]
    h = half[0] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += half[1]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    h.sort()

    def least(ranges: int) -> np.ndarray:
        # An empty range takes the next hash above it, the last ones the first hash of all.
        return np.append(h, h[0])[np.searchsorted(h, np.arange(ranges, dtype=np.uint64) * np.uint64((1 << 64) // ranges))]

    bands = [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(least(BANDS * ROWS).reshape(BANDS, ROWS))]
    return bands, least(PRINTS).astype("<u2").tobytes()


def _sketches(held: np.ndarray):
    """(_key, bands, prints): the sketch of each text whose key may be in a bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keys, bands, prints = [], [], []
            for text in batch.column(0).cast(pa.binary()):
                raw = text.as_py()
                key = hashlib.md5(raw).digest()
                at = int.from_bytes(key[:8], "big") >> 64 - BITS
                if int(held[at >> 6]) >> (at & 63) & 1 and key not in seen:
                    seen.add(key)
                    keys.append(key)
                    found = sketch(raw)
                    bands.append(found[0])
                    prints.append(found[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(prints, pa.binary())], ["_key", "bands", "prints"])
        give_back()

    return run


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose prints are alike."""
    for batch in batches:
        x, y = (np.array([np.frombuffer(p, "<u2") for p in batch.column(c).to_pylist()]).reshape(-1, PRINTS) for c in ("x", "y"))
        near = pa.array((x == y).mean(axis=1) >= ALIKE) if batch.num_rows else pa.array([], pa.bool_())
        yield batch.select(["a", "b"]).filter(near)


def near_classes(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(_key, label): the class of near copies of each text in `keys` that has any.

    Texts that share a band of their sketches are held against one of them, by their prints: only those that are alike are
    linked. So pages of one site, of which most is the same lines around texts of their own, stay apart.
    """
    # The first 64 bits of a key are as good as a hash of it.
    first = F.conv(F.substring(F.hex("_key"), 1, 16), 16, -10).cast("long")
    held = bits_of(bitmap_of(keys.select(first.alias("key")), BITS), BITS)
    sketched = docs.select("_text").mapInArrow(_sketches(held), "_key binary, bands array<long>, prints binary").withColumn("id", F.xxhash64("_key"))
    sketched = written(sketched.dropDuplicates(["id"]), "lines-sketches")
    banded = sketched.select("id", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low <> high").select("band", "low")
    pairs = written(banded.join(shared, "band").select(F.col("id").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct(), "lines-pairs")
    # Many may be held against one: its prints meet them by broadcast.
    others = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).join(sketched.select(F.col("id").alias("b"), F.col("prints").alias("y")), "b")
    met = hot_join(pairs, written(others, "lines-others"), ["b"], "n", max(1, pairs.count() / 1024)).join(sketched.select(F.col("id").alias("a"), F.col("prints").alias("x")), "a")
    edges = written(met.select("a", "b", "x", "y").mapInArrow(_alike, "a long, b long"), "lines-edges")
    labels = components(sketched.select("id"), edges)
    return sketched.select("id", "_key").join(labels, "id").select("_key", "label")


def _likely(held: np.ndarray, constant: float):
    """The lines of whose tokens (null: variable) a share of `constant` may be in a bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values, offsets = lists.values, lists.offsets.to_numpy().astype(np.int64)
            at = values.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - BITS)
            hit = ((held[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(np.int64) * values.is_valid().to_numpy(zero_copy_only=False)
            total = np.concatenate([[0], np.cumsum(hit)])
            yield batch.filter(pa.array(total[offsets[1:]] - total[offsets[:-1]] >= constant * np.diff(offsets)))

    return run


def _cut(gone: set[bytes], busy: np.ndarray, leading: int, min_tokens: int, long_tokens: int):
    """Each text without the lines whose digest is in `gone`, its number of lines and of those dropped; `busy` has their leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text in batch.column(batch.num_columns - 1).cast(pa.binary()):
                lines = text.as_py().split(b"\n")
                stay = []
                for line in lines:
                    n, head = _tokens(line, leading)
                    at = (_leaf(n, head, min_tokens, long_tokens) & (1 << 64) - 1) >> 64 - BITS
                    if not n or not int(busy[at >> 6]) >> (at & 63) & 1 or hashlib.md5(_masked(line)).digest() not in gone:
                        stay.append(line)
                texts.append(b"\n".join(stay))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
            more = [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], [*batch.schema.names, "n_lines", "n_dropped"])
        give_back()

    return run


def drop_recurring_lines(
    df: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), min_docs: int = 10, leading: int = 3, min_tokens: int = 3, constant: float = 0.7,
    long_tokens: int = 50, long_docs: int = 3, short_docs: int = 100, most_handed: int = 500_000,
) -> DataFrame:
    """The columns in `carry`, the text without lines of recurring templates, n_lines and n_dropped; a row per input row.

    Lines end at newlines; a null text is empty, one empty line. Lines walk down a tree of
    fixed depth: their number of tokens, then their first `leading` tokens, tokens with
    digits counting as variable. In a leaf, a token that too few documents have at its
    place becomes a variable field too; what stays is the line's template. A template
    recurs, and all its lines are dropped, if at least `constant` of its tokens are
    constant and enough documents have it: `min_docs`, but `long_docs` for lines of
    `long_tokens` tokens or more and `short_docs` for those under `min_tokens`. Near copies
    count as one document, whatever else they hold (see near_classes), so documents that
    were copied as a whole keep their lines, and copies never hide what recurs elsewhere. Pages
    that share most of their lines, but under 0.8 of their text, are no copies, and lose those lines.
    Blank lines stay, and texts that lose no line stay as they are.

    Texts are read four times: which leaves matter is handed out as bitmaps of fixed size,
    false hits change nothing. The distinct wordings of lines to drop are counted; up to
    `most_handed` of them (16 bytes each) are handed out as well, and texts stay where they
    are; beyond, the texts that lose lines are shuffled to meet the places of those lines.
    Lines are taken apart where the texts are read, copies once a task, and stand as 16-byte
    digests afterwards; their wording is kept once a distinct line. Counts are over all
    documents and pre-aggregated, so a line that a third of them hold costs a row a task.
    Repeated rows, null ids and other columns are left as they are.
    """
    docs = df.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)], whole(F.col(text_col)).alias("_text"))
    shape = (leading, min_tokens, long_tokens)

    def needed(leaf: Column) -> Column:
        kind = leaf.bitwiseAND(F.lit(3))
        return F.when(kind == LONG, long_docs).when(kind == SHORT, short_docs).otherwise(min_docs)

    leaves = docs.select("_text").mapInArrow(_leaves(*shape), "_key binary, leaves array<long>")
    in_leaf = leaves.select("_key", F.explode("leaves").alias("leaf")).distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("docs"))
    busy = bits_of(bitmap_of(in_leaf.filter(F.col("docs") >= needed(F.col("leaf"))).select(F.col("leaf").alias("key")), BITS), BITS)
    near = written(docs.select("_text").mapInArrow(_near_lines(busy, *shape), LINE), "lines-near")

    worded = near.select("leaf", "line", "masked").dropDuplicates(["leaf", "line"])
    held = near.select("leaf", "line", "_key").distinct().groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("n"))
    at_place = F.transform(F.split("masked", " ", -1), lambda w, i: F.when(w != VARIABLE.decode(), F.xxhash64("leaf", i, w)))
    tokens = written(worded.join(held, ["leaf", "line"]).select("line", "n", needed(F.col("leaf")).alias("needed"), at_place.alias("tokens")), "lines-tokens")
    placed = tokens.select("n", "needed", F.explode("tokens").alias("token")).filter("token IS NOT NULL")
    support = placed.groupBy("token").agg(F.sum("n").alias("support"), F.first("needed").alias("needed")).filter("support >= needed")
    support = written(support.select("token", F.lit(True).alias("fixed")), "lines-support")
    # Only lines of which enough tokens may be constant, by a bitmap, meet the counts.
    likely = tokens.select("line", "tokens").mapInArrow(_likely(bits_of(bitmap_of(support.select(F.col("token").alias("key")), BITS), BITS), constant), "line binary, tokens array<long>")
    likely = written(likely.select("line", F.posexplode("tokens").alias("at", "token")), "lines-likely")
    marked = likely.join(support, "token", "left").withColumn("fixed", F.coalesce("fixed", F.lit(False)))
    general = marked.groupBy("line").agg(F.array_sort(F.collect_list(F.struct("at", F.when(F.col("fixed"), F.col("token")).alias("token")))).alias("t"), F.avg(F.col("fixed").cast("double")).alias("share"))
    general = general.filter(F.col("share") >= constant).select("line", F.md5(F.array_join("t.token", " ", "*")).alias("template"))
    general = written(general, "lines-templates")
    with_template = written(near.drop("masked").join(general, "line"), "lines-templated")
    # A template may be in a third of all rows: such ones meet their rows by broadcast.
    least = max(1, with_template.count() / 1024)
    counted = with_template.groupBy("leaf", "template").agg(F.count_distinct("_key").alias("n"), F.count(F.lit(1)).alias("rows")).filter(F.col("n") >= needed(F.col("leaf")))
    counted = written(counted.select("leaf", "template", "rows"), "lines-counted")
    often = written(hot_join(with_template, counted, ["leaf", "template"], "rows", least).drop("rows"), "lines-often")
    labels = near_classes(docs, often.select("_key").distinct())
    holders = often.select("leaf", "template", "_key").distinct().join(labels, "_key")
    recurring = holders.groupBy("leaf", "template").agg(F.count_distinct("label").alias("n")).filter(F.col("n") >= needed(F.col("leaf"))).select("leaf", "template")
    recurring = written(recurring.join(counted, ["leaf", "template"]), "lines-recurring")
    found = written(hot_join(often.select("leaf", "template", "line", "_key", "pos"), recurring, ["leaf", "template"], "rows", least).drop("rows"), "lines-found")
    wording = found.select("leaf", "line").distinct()
    if wording.limit(most_handed + 1).count() <= most_handed:
        busy = bits_of(bitmap_of(wording.select(F.col("leaf").alias("key")), BITS), BITS)
        cut = _cut({bytes(r["line"]) for r in wording.select("line").collect()}, busy, *shape)
        schema = ", ".join([*(f"{n} {t}" for n, t in docs.dtypes), "n_lines long, n_dropped long"])
        return docs.mapInArrow(cut, schema).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], F.col("_text").alias(text_col), "n_lines", "n_dropped")
    gone = written(found.groupBy("_key").agg(F.collect_set("pos").alias("_gone")), "lines-gone")

    docs = docs.withColumn("_key", F.unhex(F.md5("_text")))
    marks = bitmap_of(gone.select(F.xxhash64("_key").alias("key")), BITS)
    docs = may_repeat(docs.withColumn("_hash", F.xxhash64("_key")), marks, "_hash", "_hit", BITS).drop("_hash")
    none = F.expr("CAST(array() AS array<int>)")
    same = docs.filter("NOT _hit").withColumn("_gone", none)
    cut = docs.filter("_hit").join(gone, "_key", "left").withColumn("_gone", F.coalesce("_gone", none))
    both = same.unionByName(cut)
    pieces = F.split("_text", "\n", -1)
    kept = F.array_join(F.filter(F.zip_with(pieces, F.sequence(F.lit(0), F.size(pieces) - 1), lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: ~F.array_contains(F.col("_gone"), x["i"]))["p"], "\n")
    return both.select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], F.when(F.size("_gone") > 0, kept).otherwise(F.col("_text")).alias(text_col),
        (F.length("_text") - F.length(F.replace(F.col("_text"), F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"), F.size("_gone").cast("long").alias("n_dropped"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, and SHA-256 and length of the text that is left."""
    out = drop_recurring_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("long").alias("n_chars"))

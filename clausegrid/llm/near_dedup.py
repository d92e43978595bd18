"""MinHash near-dedup: BagMinHash signatures of word shingles, bands, exact multiset verification, components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid.llm.common import bitmap_of, bits_by_least, give_back, in_bits, may_repeat, table, whole, written

WORDS = 5
SIZE = 128
ROWS = 5
BANDS = SIZE // ROWS
#: Of the 128 components, 2 bits each are kept to estimate similarity. At 0.8 they differ in 19.2 components, with a
#: standard deviation of 4.04; this many lie four deviations above. Pairs that differ by more wait for the prefix filter.
MOST_DIFFERENT = 35
BITS = 23
CLASSES = (2, 3, 5, 9, 33, 257)  # the least frequencies of the classes of items


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the runs of five words, and how often each occurs. A shorter text is one run."""
    n = len(words)
    factors = [np.uint64(2 * k * k * 0x9E3779B97F4A7C15 + 0xD1342543DE82EF95 & (2**64 - 1)) | np.uint64(1) for k in range(1, WORDS + 1)]
    runs = max(1, n - WORDS + 1)
    total = np.full(runs, np.uint64(min(n, WORDS)), np.uint64)
    for k in range(min(n, WORDS)):
        total += words[k : k + runs] * factors[k]
    return np.unique(mix(total), return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], size: int = SIZE) -> np.ndarray:
    """BagMinHash signatures (len(bags) x size) of bags of (hashes, integer weights).

    Each unit of an element's weight has its own Poisson process of points on the positive
    line; a point falls into a random component, whose value is its first point. Two bags
    then agree in a component with their weighted Jaccard similarity as chance. The
    processes are laid out in a hierarchy: one for each of the weight levels [0,1), [1,2),
    [2,4), [4,8), ..., each point of which draws its level, and counts if the weight is
    above it. Points beyond the place where all components are surely filled are not made.
    """
    out = np.full((len(bags), size), np.inf)
    weight = np.array([c.sum() for _, c in bags], float)
    limit = size * (math.log(size) + 4) / np.maximum(weight, 1)
    todo = np.arange(len(bags))
    while len(todo):
        doc = np.repeat(todo, [len(bags[i][0]) for i in todo])
        h, c = np.concatenate([bags[i][0] for i in todo]), np.concatenate([bags[i][1] for i in todo])
        parts = [(doc, h, c, np.zeros(len(h), np.int64))]
        j = 1
        while (more := c > 2 ** (j - 1)).any():
            doc, h, c = doc[more], h[more], c[more]
            parts.append((doc, h, c, np.full(len(h), j, np.int64)))
            j += 1
        doc, h, c, j = (np.concatenate(p) for p in zip(*parts, strict=True))
        h = mix(h + (j.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        low = np.where(j > 0, 2.0 ** (j - 1), 0.0)
        rate = np.where(j > 0, low, 1.0)
        x, step = np.zeros(len(h)), 0
        flat = out.reshape(-1)
        while len(h):
            step += 1
            g = mix(h + np.uint64(step * 0xD1342543DE82EF95 & (2**64 - 1)))
            x = x - np.log(((g >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate
            keep = x <= limit[doc]
            doc, h, c, low, rate, x, g = (v[keep] for v in (doc, h, c, low, rate, x, g))
            g = mix(g ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            component = ((g >> np.uint64(40)) * np.uint64(size)) >> np.uint64(24)
            level = low + rate * ((g & np.uint64(0xFFFFFFFF)).astype(float) * 2.0**-32)
            counts = (low == 0) | (level < c)
            np.minimum.at(flat, doc[counts] * size + component[counts].astype(np.int64), x[counts])
        todo = todo[np.isinf(out[todo]).any(axis=1)]
        limit[todo] *= 2
    return out


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes in the last column give way to band hashes and four longs of two bits a component."""
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        values, offsets = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
        bands, bits = [], []
        for first in range(0, batch.num_rows, 256):
            span = range(first, min(batch.num_rows, first + 256))
            found = signatures([shingles(values[offsets[i] : offsets[i + 1]]) for i in span]).view(np.uint64)
            hashed = mix(found)
            code = np.zeros((len(span), BANDS), np.uint64)
            for r in range(ROWS):
                code = mix(code * np.uint64(0x9E3779B97F4A7C15) + hashed[:, r : BANDS * ROWS : ROWS] + np.uint64(r + 1))
            bands.append(mix(code + np.arange(BANDS, dtype=np.uint64)))
            two = (hashed & np.uint64(3)).reshape(len(span), 4, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2))
            bits.append(np.bitwise_or.reduce(two, axis=2))
        bands = np.concatenate(bands).view(np.int64) if bands else np.zeros((0, BANDS), np.int64)
        bits = np.concatenate(bits).view(np.int64) if bits else np.zeros((0, 4), np.int64)
        rows = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * BANDS, pa.int32()), pa.array(bands.reshape(-1), pa.int64()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], rows, *(pa.array(bits[:, k]) for k in range(4))], [*batch.schema.names[:-1], "_bands", "_s0", "_s1", "_s2", "_s3"])
        give_back()


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_key, items): a number for each shingle and each further time it occurs; each key once a task."""
    seen: set[str] = set()
    for batch in batches:
        keys, items = [], []
        lists = batch.column(1)
        values, offsets = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
        for i, key in enumerate(batch.column(0).to_pylist()):
            if key not in seen:
                seen.add(key)
                h, c = shingles(values[offsets[i] : offsets[i + 1]])
                nth = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                keys.append(key)
                items.append(mix(np.repeat(h, c) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(items, pa.list_(pa.int64()))], ["_key", "items"])


def _profiles(marks: list[np.ndarray], threshold: float):
    """(id, size, c0, c1, ..., index, probe): how many of a text's items lie in each class of frequency, and its prefixes.

    Items are put in one order for all texts: by class, the rarest first, then by hash. Two
    texts, the shorter of size n and the longer of size m, that reach `threshold` share an
    item of the shorter one's first n - ceil(2t/(1+t) n) + 1 and the longer one's first
    m - ceil(tm) + 1. Items that no other text has are left out of both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            first, last = int(offsets[0]), int(offsets[-1])
            values = lists.values.to_numpy(zero_copy_only=False)[first:last]
            level = sum(in_bits(held, values, BITS) for held in marks)
            columns = []
            for k in range(1, len(marks) + 1):
                total = np.concatenate([[0], np.cumsum(level == k)])
                columns.append(pa.array(total[offsets[1:] - first] - total[offsets[:-1] - first], pa.int64()))
            size = np.diff(offsets)
            owner = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((values, level, owner))
            rank, own = np.arange(len(values)) - np.repeat(offsets[:-1] - first, size), owner[order]
            prefixes = []
            for share in (2 * threshold / (1 + threshold), threshold):
                taken = (rank < (size - np.ceil(share * size - 1e-9) + 1)[own]) & (level[order] > 0)
                ends = np.concatenate([[0], np.cumsum(np.bincount(own[taken], minlength=len(size)))])
                prefixes.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[order][taken], pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), *columns, *prefixes], ["id", "size", *(f"c{k}" for k in range(len(marks))), "index", "probe"])

    return run


def word_hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def _similar(a: str, b: str) -> Column:
    """Whether the two-bit sketches differ little enough for a similarity of 0.8."""
    odd = F.lit(0x5555555555555555).cast("long")
    total = F.lit(0)
    for k in range(4):
        x = F.col(f"{a}._s{k}").bitwiseXOR(F.col(f"{b}._s{k}"))
        total = total + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(odd))
    return total <= MOST_DIFFERENT


def linked(edges: DataFrame) -> DataFrame:
    """(id, label) of every id in `edges` (a, b): the smallest id that it is connected to. Labels spread along the edges and jump to their label's label."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-edges")
    # The first spread is from labels that are the ids themselves.
    spread = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near")).select("id", F.col("id").alias("old"), F.least("id", "near").alias("label"))
    while True:
        spread = written(spread, "near-labels")
        jump = spread.select(F.col("id").alias("label"), F.col("label").alias("next"))
        moved = written(spread.join(jump, "label", "left").select("id", "old", F.coalesce("next", "label").alias("label")), "near-labels")
        labels = moved.select("id", "label")
        if moved.filter("label <> old").isEmpty():
            return labels
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "id", "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label) of every vertex; one without edges is its own label."""
    return vertices.select("id").join(linked(edges), "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """`labels` (id, label), which leaves out ids that are alone, after some more links: only the labels that these join are worked on."""
    if links.isEmpty():
        return labels
    ends = links.join(labels.select(F.col("id").alias("a"), F.col("label").alias("la")), "a", "left").join(labels.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b", "left")
    ends = ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).filter("a <> b")
    joined = written(linked(ends).select(F.col("id").alias("old"), F.col("label").alias("new")), "near-joined")
    moved = labels.join(joined, labels["label"] == joined["old"], "left").select("id", F.coalesce("new", "label").alias("label"))
    alone = joined.select(F.col("old").alias("id"), F.col("new").alias("label")).join(labels.select("id"), "id", "left_anti")
    return written(moved.unionByName(alone), "near-classes")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, with_key: bool = False) -> DataFrame:
    """One row per input row: id, class_id (smallest id of its class), class_size and kept (one row of each class).

    Classes are the connected components of the links: equal texts, and texts whose
    multisets of five-word shingles have a Jaccard similarity of `threshold` or more. Words
    are runs of non-space characters; a text of under five words is one shingle; null counts
    as empty, and all empty texts are one class. The row with the smallest id is kept; a
    null id comes last, and class_id is null only where all ids of a class are. Repeated
    rows are copies. Texts are read as a whole, however long; an empty table gives no rows.
    `with_key` adds _key, the MD5 of the text. Other columns are left alone.

    Equal texts are collapsed first. Texts that share one of 25 bands of BagMinHash are
    candidates (a pair at 0.8 shares none with a chance of 5e-5). A bucket never emits all
    its pairs: in each of three rounds a member meets one text, the most popular of those
    that lead its buckets and are not in its class yet, popular being who has the fullest
    buckets. What is then still apart in a bucket meets by an exact prefix filter: the
    shorter text's rarest ninth or so of items against the longer one's rarest fifth, rarest
    in the sense of classes of frequency, under an exact bound of the overlap by class. So
    variants of one text, each with words of its own, do not all meet. Every link is
    verified on the full multisets, which are only built for texts with candidates, and no
    pair is verified twice.
    """
    base = df.select(F.col(id_col).alias("_id"), whole(F.col(text_col)).alias("_text"))
    keyed = base.select("_id", F.monotonically_increasing_id().alias("_uid"), F.md5("_text").alias("_key"), word_hashes(F.col("_text")).alias("_words"))
    kind = df.schema[id_col].dataType.simpleString()
    rows = keyed.mapInArrow(_sketches, f"_id {kind}, _uid long, _key string, _bands array<long>, _s0 long, _s1 long, _s2 long, _s3 long")
    rows = written(rows, "near-sketches")
    groups = written(rows.groupBy("_key").agg(F.min("_uid").alias("_rep")), "near-groups")
    texts = rows.join(groups, (rows["_uid"] == groups["_rep"]), "left_semi").select(F.col("_uid").alias("id"), "_key", "_bands", "_s0", "_s1", "_s2", "_s3")

    members = texts.select("id", "_s0", "_s1", "_s2", "_s3", F.explode("_bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = written(members.join(sizes, "bucket"), "near-members")
    popular = members.groupBy("id").agg(F.round(F.sum(F.log("n")), 6).alias("fame"))
    members = written(members.join(popular, "id").drop("n"), "near-buckets")

    wanted = members.select("id").distinct().join(texts.select("id", "_key"), "id")
    marks = bitmap_of(wanted.select(F.xxhash64("_key").alias("key")), BITS)
    again = base.select(F.md5("_text").alias("_key"), "_text").withColumn("_hash", F.xxhash64("_key"))
    again = may_repeat(again, marks, "_hash", "_hit", BITS).filter("_hit").select("_key", word_hashes(F.col("_text")).alias("_words"))
    items = again.mapInArrow(_items, "_key string, items array<long>").join(wanted, "_key").select("id", "items")
    items = written(items.dropDuplicates(["id"]), "near-items")

    tested = written(items.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0), "near-tested")

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among pairs that were not tested before."""
        nonlocal tested
        fresh = written(pairs.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "near-pairs")
        if fresh.isEmpty():
            return fresh
        tested = tested.unionByName(fresh)
        full = fresh.join(items.select(F.col("id").alias("b"), F.col("items").alias("y")), "b").join(items.select(F.col("id").alias("a"), F.col("items").alias("x")), "a")
        common = F.size(F.array_intersect("x", "y"))
        return written(full.filter(common >= F.lit(threshold) * (F.size("x") + F.size("y") - common)).select("a", "b"), "near-links")

    def lead(held: DataFrame) -> DataFrame:
        """The most popular member of each bucket."""
        return held.groupBy("bucket").agg(F.max(F.struct("fame", (-F.col("id")).alias("order"), "id", "label", "_s0", "_s1", "_s2", "_s3")).alias("lead")).select("bucket", "lead.*")

    def stars(held: DataFrame, leads: DataFrame) -> DataFrame:
        """Each member beside the most popular of its buckets' leads that is in another class and looks like it."""
        other = (F.col("m.bucket") == F.col("l.bucket")) & (F.col("m.label") != F.col("l.label")) & _similar("m", "l")
        best = held.alias("m").join(leads.alias("l"), other).groupBy(F.col("m.id").alias("a")).agg(F.max(F.struct(F.col("l.fame").alias("fame"), (-F.col("l.id")).alias("order"), F.col("l.id").alias("b"))).alias("best"))
        return best.select(F.least("a", "best.b").alias("a"), F.greatest("a", "best.b").alias("b"))

    def labelled() -> DataFrame:
        return members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))

    labels = linked(verified(stars(members.withColumn("label", F.col("id")), lead(members.withColumn("label", F.col("id"))))))
    for _ in range(2):
        now = written(labelled(), "near-labelled")
        served = lead(now).select("bucket", F.col("label").alias("served"))
        # The leads of those whom a bucket's most popular member does not serve.
        rest = now.join(served, "bucket").filter(F.col("label") != F.col("served")).drop("served")
        labels = merged(labels, verified(stars(now, lead(rest))))
    now = written(labelled(), "near-labelled")
    mixed = now.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("bucket")
    apart = written(now.join(mixed, "bucket").select("id", "label").distinct(), "near-apart")
    # What two texts share is as frequent in one as in the other: by class of frequency, that bounds their overlap.
    loose = written(items.join(apart.select("id"), "id", "left_semi"), "near-loose")
    often = written(loose.select(F.explode("items").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "near-frequencies")
    marks = bits_by_least(often, CLASSES, BITS)
    classes = [f"c{k}" for k in range(len(CLASSES))]
    profile = loose.mapInArrow(_profiles(marks, threshold), ", ".join(["id long", "size long", *(f"{c} long" for c in classes), "index array<long>, probe array<long>"]))
    profile = written(apart.join(profile, "id"), "near-profiles")
    bound = reduce(lambda x, y: x + y, [F.least(f"p.{c}", f"q.{c}") for c in classes])
    enough = bound * (1 + threshold) + 1e-6 >= threshold * (F.col("p.size") + F.col("q.size"))
    shorter = F.struct("p.size", "p.id") < F.struct("q.size", "q.id")
    facts = ["id", "label", "size", *classes]
    short, long = (profile.select(*facts, F.explode(side).alias("item")) for side in ("index", "probe"))
    pairs = short.alias("p").join(long.alias("q"), (F.col("p.item") == F.col("q.item")) & shorter & (F.col("p.label") != F.col("q.label")) & (F.col("p.size") >= threshold * F.col("q.size") - 1e-6) & enough)
    labels = merged(labels, verified(pairs.select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b"))))

    named = written(rows.select("_id", "_uid", "_key").join(groups, "_key").join(labels, F.col("_rep") == F.col("id"), "left").select("_id", "_uid", "_key", F.coalesce("label", "_rep").alias("label")), "near-rows")
    classes = named.groupBy("label").agg(F.min("_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"), F.min(F.struct(F.isnull("_id").alias("last"), "_id", "_uid")).alias("first"))
    return named.join(classes, "label").select(F.col("_id").alias(id_col), "class_id", "class_size", (F.col("_uid") == F.col("first._uid")).alias("kept"), *(["_key"] if with_key else []))


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """The rows of `df` of which near_duplicates keeps one a class, with all their columns.

    Rows are told apart by id and text, as ids may be null or repeat. Those in no class of
    several pass by a bitmap of fixed size; only the others are shuffled, to meet what is kept.
    """
    found = near_duplicates(df, id_col, text_col, threshold, with_key=True).filter("class_size > 1")
    found = written(found.select(F.col(id_col).alias("_kept_id"), F.col("_key").alias("_kept_key"), "kept"), "near-several")
    marks = bitmap_of(found.select(F.xxhash64("_kept_id", "_kept_key").alias("key")), BITS)
    rows = df.withColumn("_near_text", F.md5(whole(F.col(text_col))))
    rows = may_repeat(rows.withColumn("_near_key", F.xxhash64(id_col, "_near_text")), marks, "_near_key", "_near_hit", BITS).drop("_near_key")
    several = rows.filter("_near_hit").drop("_near_hit")
    each = found.groupBy("_kept_id", "_kept_key").agg(F.bool_or("kept").alias("_any"))
    same = F.col(id_col).eqNullSafe(F.col("_kept_id")) & (F.col("_near_text") == F.col("_kept_key"))
    stay = several.join(each, same, "left").filter("_any OR _any IS NULL").drop("_kept_id", "_kept_key", "_any").dropDuplicates([id_col, "_near_text"])
    return rows.filter("NOT _near_hit").drop("_near_hit").unionByName(stay).drop("_near_text")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, class_id, class_size and kept (see near_duplicates)."""
    return near_duplicates(table(spark, sf_dir, "documents"))

"""PII by bootstrapped contextual extraction; DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid.llm.common import bitmap_of, may_repeat, table, whole, written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")  # secrets have no base pattern: seeds and learned patterns alone find them
#: The base patterns. They match what the plain forms match; a lookbehind or the end of the last match (\G) keeps a
#: search from starting inside a run, and possessive groups from recursing, so that long runs take linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Whole tokens with a digit or an @ and six characters or more.
TOKEN = r"(?:\G|(?<!\S))(?=[^\s0-9@]*[0-9@])\S{6,}"
#: Numbers next to each other, as in (017) 555 7713; possessive, so that long runs take linear time.
RUN = r"(?:\G|(?<![\p{L}\p{N}_.@(+-]))[(+]?+[0-9]++(?:[().+/\x20-]{1,3}+[0-9]++)++"
NEAR = 100
#: Seeds of the kind secret: what stands behind a credential's name and a sign, and a published form of access keys.
CREDENTIAL = r"""(?i)(?:^|[^\p{L}])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)["']?\s*[=:]\s*["']?$"""
ACCESS_KEY = r"^(?:AKIA|ASIA)[0-9A-Z]{16}$"
FOLDED = 64
BITS = 23
SPAN = "array<struct<start:int,end:int,rank:int,kind:string>>"


def matches(text: Column, pattern: str) -> Column:
    """The matches of a pattern, leftmost and not overlapping: array of (start, end, value), in code points.

    Places are summed up in blocks of FOLDED matches, then over the blocks, as a fold that
    appends copies what it has: so the work stays near the number of matches.
    """
    none = F.expr("CAST(array() AS array<struct<s:int,e:int>>)")

    def block(steps: Column, k: Column) -> Column:
        return F.aggregate(
            F.slice(steps, k * FOLDED + 1, F.lit(FOLDED)), F.struct(F.lit(0).alias("at"), none.alias("out")),
            lambda acc, m: F.struct((acc["at"] + m["g"] + m["n"]).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + m["g"]).alias("s"), (acc["at"] + m["g"] + m["n"]).alias("e")))).alias("out")),
        )

    def places(blocks: Column) -> Column:
        before = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["at"])))
        return F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), lambda x, o: F.transform(x["out"], lambda p: F.struct((p["s"] + o).alias("s"), (p["e"] + o).alias("e")))))

    def found(x: Column) -> Column:
        steps = F.arrays_zip(F.transform(x["values"], lambda v: F.length(v)).alias("n"), F.transform(F.slice(x["gaps"], F.lit(1), F.size(x["values"])), lambda g: F.length(g)).alias("g"))
        blocks = _bound(steps, lambda st: F.transform(F.sequence(F.lit(0), ((F.size(st) - 1) / FOLDED).cast("int")), lambda k: block(st, k)))
        return F.zip_with(_bound(blocks, places), x["values"], lambda p, v: F.struct(p["s"].alias("start"), p["e"].alias("end"), v.alias("value")))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"), F.split(text, pattern, -1).alias("gaps"))
    empty = F.expr("CAST(array() AS array<struct<start:int,end:int,value:string>>)")
    return _bound(both, lambda x: F.when(F.size(x["values"]) > 0, found(x)).otherwise(empty))


def _bound(value: Column, body) -> Column:
    """body(value), with the value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int").isNull() | (F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int") <= 255)))
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15)


def base_spans(text: Column) -> Column:
    """All spans of the four base kinds: array of (start, end, rank, kind), by start, then kind as listed."""
    found = []
    for rank, kind in enumerate(BASE):
        spans = F.transform(_kept(text, kind), _as_span(rank, kind))
        likely = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else text.rlike("[0-9]")
        found.append(F.when(likely, spans).otherwise(F.expr(f"CAST(array() AS {SPAN})")))
    return F.array_sort(F.concat(*found))


def _kept(text: Column, kind: str) -> Column:
    return F.filter(matches(text, PATTERNS[kind]), lambda m: _holds(kind, m["value"]))


def _as_span(rank: int, kind: str):
    return lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"))


def _shape(value: Column) -> Column:
    """What an identifier looks like: runs of capitals, small letters and digits as A, a and 9."""
    return reduce(lambda c, r: F.regexp_replace(c, *r), [(r"\p{Lu}+", "A"), (r"[\p{L}&&[^\p{Lu}]]+", "a"), (r"[0-9]+", "9")], value)


def contexts(rows: DataFrame) -> DataFrame:
    """Identifier-like tokens of each text with the two tokens around each.

    `rows` has _row, _text and _base (the base spans). A token is a run of non-space
    characters, trimmed of the punctuation around it; it is identifier-like if it has a
    digit or an @ and at least 6 characters. Base spans with blanks stand whole, instead of
    the tokens in them, and so do runs of numbers with blanks and the 6 to 19 digits of the
    base kinds, beside their tokens. The neighbours of each are the tokens nearest to it,
    as far as they lie within NEAR characters. Result: _row, start, end, seed (the kind of
    the base span that holds the token, else null), value, left, right, before (what the
    token has up to its last = or : or quote, as in password=...). `seed` may also be the kind
    secret, which has no base pattern (see CREDENTIAL and ACCESS_KEY).
    """
    text = F.col("_text")

    def part(m: Column, value: Column, is_whole: bool) -> Column:
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), value.alias("value"), F.lit(is_whole).alias("is_whole"))

    def value_of(b: Column) -> Column:
        return F.substring(text, b["start"] + 1, b["end"] - b["start"])

    def crosses(spans: str):
        return lambda m: F.exists(spans, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))

    def is_run(m: Column) -> Column:
        return F.contains(m["value"], F.lit(" ")) & F.length(F.regexp_replace(m["value"], "[^0-9]", "")).between(6, 19) & ~crosses("_base")(m)

    wide = rows.filter(text.rlike("[0-9@]")).withColumn("_wide", F.filter("_base", lambda b: F.contains(value_of(b), F.lit(" "))))
    tokens = F.transform(F.filter(matches(text, TOKEN), lambda m: ~crosses("_wide")(m)), lambda m: part(m, m["value"], False))
    runs = F.transform(F.filter(matches(text, RUN), is_run), lambda m: part(m, m["value"], True))
    found = wide.select("_row", "_base", "_text", F.explode(F.concat(tokens, F.transform("_wide", lambda b: part(b, value_of(b), True)), runs)).alias("t"))
    begin = F.greatest(F.lit(0), F.col("t.start") - NEAR)
    behind = F.substring(F.col("_text"), F.col("t.end") + 1, F.lit(NEAR))
    # A neighbour that reaches beyond the window is no word to learn from: it counts as a long one.
    ahead = F.substring(F.col("_text"), begin + 1, F.col("t.start") - begin)
    word = r"(\S+(?:\s+[=:])?)\s*$"  # a sign alone takes the word in front of it along
    left = F.when(begin == 0, F.regexp_extract(ahead, word, 1)).otherwise(F.coalesce(F.nullif(F.regexp_extract(ahead, r"(?<=\s)" + word, 1), F.lit("")), F.lit("~")))
    right = F.when(F.length(behind) < NEAR, F.regexp_extract(behind, r"^\s*(\S+)", 1)).otherwise(F.coalesce(F.nullif(F.regexp_extract(behind, r"^\s*(\S+)\s", 1), F.lit("")), F.lit("~")))
    # lower() of a constant is worked out by the driver, which first builds ICU tables for it: three GB of garbage.
    each = found.select("_row", "_base", F.col("t.start").alias("start"), F.col("t.value").alias("raw"), F.col("t.is_whole").alias("is_whole"), F.when(left == "", "^").otherwise(F.lower(left)).alias("left"), F.when(right == "", "$").otherwise(F.lower(right)).alias("right"))
    before = F.when(F.col("is_whole"), "").otherwise(F.regexp_extract("core", r"""^(?:[^=:"'(\[{<]*[=:"'(\[{<]+)*""", 0))
    # What closes a token is taken off first, else a closing quote would count as the last one in front of a value.
    each = each.withColumn("core", F.regexp_replace("raw", r"""[.,;:!?"')\]}>]+$""", ""))
    value = F.expr("substring(core, length(before) + 1)")
    each = each.withColumn("before", before).withColumn("value", value).filter("length(value) >= 6")
    each = each.withColumn("start", F.col("start") + F.length("before")).withColumn("end", F.col("start") + F.length("value"))
    seed = F.try_element_at(F.filter("_base", lambda b: (b["start"] <= F.col("start")) & (b["end"] >= F.col("end"))), F.lit(1))["kind"]
    named = F.concat_ws(" ", "left", "before").rlike(CREDENTIAL) | F.col("before").rlike(CREDENTIAL)
    secret = ~F.col("is_whole") & ((named & (F.length("value") >= 8)) | F.col("value").rlike(ACCESS_KEY))
    return each.select("_row", "start", "end", F.coalesce(seed, F.when(secret, "secret")).alias("seed"), "value", "left", "right", F.lower("before").alias("before"))


def bootstrap(found: DataFrame, rounds: int = 3, confidence: float = 0.8, support: int = 5) -> DataFrame:
    """(kind, value) of the identifiers that high-confidence patterns discover.

    A pattern is both neighbours of a token, or its shape with one of: the token on its
    left, on its right, what stands before it in the same token; or, for values of 16
    characters and more, its first four and its length. An instance is a distinct
    value. Seeds are the values of base spans. In each round a pattern's confidence for a
    kind is the summed belief of its instances in that kind over the number of its
    instances plus one; a value's belief is 1 for seeds, else noisy-or over its patterns
    with at least `support` instances. Only sums over (pattern) and (value) cross the
    network, pre-aggregated by Spark, so a pattern or value that a third of the rows hold
    costs one row a task. Beliefs are rounded, so that the order of sums does not matter.
    """
    shape = _shape(F.col("value"))
    keyed = found.select(
        "value", "seed",
        F.explode(F.array(F.concat_ws("\u0001", F.lit("N"), "left", "right"), F.concat_ws("\u0001", F.lit("L"), "left", shape), F.concat_ws("\u0001", F.lit("R"), "right", shape), F.when(F.col("before") != "", F.concat_ws("\u0001", F.lit("B"), "before", shape)), F.when(F.length("value") >= 16, F.concat_ws("\u0001", F.lit("P"), F.substring("value", 1, 4), F.length("value"))))).alias("pattern"),
    ).filter("pattern IS NOT NULL")
    edges = keyed.groupBy("pattern", "value").agg(F.min("seed").alias("seed"))
    edges = written(edges, "pii-edges")
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.count("seed").alias("seeds")).filter(F.col("n") >= support)
    useful = written(edges.join(sizes.select("pattern", "n"), "pattern"), "pii-graph")
    belief = edges.filter("seed IS NOT NULL").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("belief")).distinct()
    known = belief
    for _ in range(rounds):
        scored = useful.join(known, "value").groupBy("pattern", "kind").agg((F.sum("belief") / (F.first("n") + 1)).alias("c"))
        scored = scored.filter(F.col("c") >= confidence)
        fresh = useful.filter("seed IS NULL").join(scored, "pattern").groupBy("value", "kind").agg(F.round(1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("c"))))), 6).alias("belief"))
        known = written(belief.unionByName(fresh.filter(F.col("belief") >= confidence)), "pii-beliefs")
    return known.join(belief.select("value").distinct(), "value", "left_anti").groupBy("value").agg(F.max(F.struct("belief", "kind")).alias("b")).select("value", F.col("b.kind").alias("kind"))


def find_pii(df: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), rounds: int = 3, confidence: float = 0.8, support: int = 5) -> DataFrame:
    """The columns in `carry`, `base` and `spans` of every row; both are arrays of (start, end, rank, kind).

    `base` holds the base spans; `spans` those, the seeds of the kind secret, and the tokens whose
    value the bootstrapped patterns identify, leaving out what overlaps a base span or lies within another one. Offsets are code points, the
    end exclusive; order is by start, then kind as listed. Null and empty texts have empty
    arrays; each repeated row gets its own; other columns of `df` are left alone.
    """
    rows = df.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)], whole(F.col(text_col)).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.withColumn("_base", base_spans(F.col("_text")))
    # One pass over the texts: base spans of every row, and the tokens that look like identifiers.
    kept = written(rows.select("_row", *[f"_c{i}" for i in range(len(carry))], "_base", F.when(F.col("_text").rlike("[0-9@]"), F.col("_text")).alias("_text")), "pii-base")
    found = written(contexts(kept), "pii-contexts")
    more = bootstrap(found, rounds, confidence, support)
    rank = reduce(lambda c, k: c.when(F.col("kind") == k[1], k[0]), enumerate(KINDS), F.when(F.lit(False), 0))
    secrets = found.filter("seed = 'secret'").select("_row", "start", "end", F.col("seed").alias("kind"))
    extra = found.filter("seed IS NULL").join(more, "value").select("_row", "start", "end", "kind").unionByName(secrets)
    extra = extra.select("_row", F.struct("start", "end", rank.cast("int").alias("rank"), "kind").alias("s"))
    extra = extra.groupBy("_row").agg(F.collect_list("s").alias("_more"))  # a row's own tokens
    # Only rows that gain spans are shuffled; the others pass by a bitmap of fixed size.
    extra = written(extra, "pii-extra")
    marks = bitmap_of(extra.select(F.xxhash64("_row").alias("key")), BITS)
    out = may_repeat(kept.drop("_text").withColumn("_key", F.xxhash64("_row")), marks, "_key", "_hit", BITS).drop("_key")
    out = out.filter("NOT _hit").withColumn("_more", F.expr(f"CAST(NULL AS {SPAN})")).unionByName(out.filter("_hit").join(extra, "_row", "left"))
    free = F.filter(F.coalesce("_more", F.expr(f"CAST(array() AS {SPAN})")), lambda m: ~F.exists("_base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    free = F.filter(free, lambda m: ~F.exists(free, lambda o: (o["start"] <= m["start"]) & (m["end"] <= o["end"]) & (o["end"] - o["start"] > m["end"] - m["start"])))
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], F.col("_base").alias("base"), F.array_sort(F.concat("_base", free)).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; overlapping spans give the first one's."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        put = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), put.alias("out"))).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    return F.aggregate(spans, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans), spans (all of them) and n_secret."""
    found = find_pii(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    secrets = F.size(F.filter("spans", _is("secret"))).cast("long").alias("n_secret")
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), secrets)


def _is(kind: str):
    return lambda s: s["kind"] == kind

"""Secrets by corpus-wide ownership: who else has a value tells a live credential from a copied example; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid.llm.common import bitmap_of, hot_join, may_repeat, table, whole, written
from clausegrid.llm.pii import BITS, joined, matches

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "owned")  # the last has no pattern: ownership finds it
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The base patterns. They match what the plain forms match and are long enough for: a lookbehind or the end of the last
#: match (\G) keeps a search from starting inside a run.
PATTERNS = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}+", "hex": r"(?:\G|(?<![0-9a-f]))[0-9a-f]{24,}+"}
LIKELY = {"assign": "[:=]", "access": "AKIA", "hex": "[0-9a-f]{24}"}
LEAST_ASSIGNED = 6
#: Candidates beside the base patterns: runs of what credentials are made of, with a letter and a digit.
TOKEN = r"(?:\G|(?<![A-Za-z0-9_-]))(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{8,}+={0,2}+"
#: What placeholders hold, in small letters.
PLACEHOLDER = r"(.)\1{3}|example|sample|dummy|test|changeme|placeholder|your|xxx|1234|abcd|qwerty"
SPAN = "array<struct<start:int,end:int,rank:int,kind:string>>"
FOUND = "array<struct<start:int,end:int,rank:int,hash:bigint,live:boolean>>"


def looks_live(value: Column) -> Column:
    """Whether a value could be a working credential by its looks.

    20 characters and more, ten different ones, digits in two places at least, large and small
    letters (or 32 characters without a hyphen), and nothing that placeholders hold.
    """
    varied = F.size(F.array_distinct(F.split(value, ""))) >= 10
    mixed = (value.rlike("[A-Z]") & value.rlike("[a-z]")) | ((F.length(value) >= 32) & ~F.contains(value, F.lit("-")))
    return (F.length(value) >= 20) & value.rlike("[0-9][^0-9]+[0-9]") & mixed & varied & ~F.lower(value).rlike(PLACEHOLDER)


def _credential(kind: str) -> Callable[[Column], Column]:
    """The credential in a match: for assign what stands behind the sign, else all of it."""
    return lambda m: F.regexp_extract(m["value"], ASSIGN, 1) if kind == "assign" else m["value"]


def _as_found(rank: int, value: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(rank).alias("rank"), F.xxhash64(value(m)).alias("hash"), looks_live(value(m)).alias("live"))


def base_matches(text: Column) -> Column:
    """All base matches: array of (start, end, rank of the kind, hash of the credential, live), by start, then kind as listed; ends exclusive, in code points."""
    each = []
    for rank, kind in enumerate(BASE):
        found = matches(text, PATTERNS[kind])
        if kind == "assign":
            found = F.filter(found, lambda m: F.length(_credential("assign")(m)) >= LEAST_ASSIGNED)
        each.append(F.when(text.rlike(LIKELY[kind]), F.transform(found, _as_found(rank, _credential(kind)))).otherwise(F.expr(f"CAST(array() AS {FOUND})")))
    return F.array_sort(F.concat(*each))


def candidates(text: Column) -> Column:
    """Tokens that could be credentials, in the form of base_matches, with the rank of the kind owned."""
    found = F.transform(matches(text, TOKEN), _as_found(len(BASE), lambda m: m["value"]))
    return F.when(text.rlike("[0-9]"), found).otherwise(F.expr(f"CAST(array() AS {FOUND})"))


def ownership(seen: DataFrame, copied_owners: int = 3, copied_repos: int = 8) -> DataFrame:
    """Per hash: n rows, n_repos, n_owners, named (whether a base pattern has it anywhere), live, and what follows: class.

    `seen` has a row per occurrence: hash, owner, repo, rank, live. A value is `copied` if so many
    owners have it, or so many repositories of two owners; `owned` if one owner has it alone; else
    `shared`. Counts are exact: occurrences are summed up by (hash, owner, repo), those by (hash, owner), then by hash,
    each pre-aggregated, so that a value that a third of all rows hold costs a row a task.
    """
    pairs = seen.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("rank") < len(BASE)).alias("named"), F.bool_or("live").alias("live"))
    owners = pairs.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repos"), F.bool_or("named").alias("named"), F.bool_or("live").alias("live"))
    values = owners.groupBy("hash").agg(F.sum("n").alias("n"), F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"), F.bool_or("named").alias("named"), F.bool_or("live").alias("live"))
    copied = (F.col("n_owners") >= copied_owners) | ((F.col("n_owners") > 1) & (F.col("n_repos") >= copied_repos))
    return values.withColumn("class", F.when(copied, "copied").when(F.col("n_owners") == 1, "owned").otherwise("shared"))


def scan_secrets(df: DataFrame, owner: Column, repo: Column, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), copied_owners: int = 3, copied_repos: int = 8) -> DataFrame:
    """The columns in `carry`, then `base` and `spans`, arrays of (start, end, rank, kind), n_live and n_copied, for every row.

    `owner` and `repo` are expressions over `df`: to whom a row belongs, and to which of their
    repositories; null counts as one owner, one repository. All values of base matches, and all tokens that could
    be credentials, are counted over the whole corpus by the owners that have them. A token becomes a span of the
    kind `owned` if one owner alone has it and it looks live, or if it is not widely copied and a
    base pattern names it as a credential somewhere: so a password that is named in one file is found where it stands
    bare in another. Tokens that overlap a base span are none. Base spans always stay: n_live counts those that
    look live and have one owner, n_copied those whose value is widely copied, as examples are.
    Order is by start, then kind as listed; ends are exclusive, in code points.

    Null and empty texts have empty arrays; repeated rows each get their own; an empty table gives an
    empty one; other columns of `df`, whatever their names, are left alone.
    """
    text, names = F.col("_text"), [f"_c{i}" for i in range(len(carry))]
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(carry, names, strict=True)], whole(owner.cast("string")).alias("_owner"), whole(repo.cast("string")).alias("_repo"), whole(F.col(text_col)).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    rows = written(rows.select("_row", *names, "_owner", "_repo", base_matches(text).alias("_base"), candidates(text).alias("_tokens")), "secrets-found")
    free = F.filter("_tokens", lambda t: ~F.exists("_base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    seen = rows.select("_row", F.col("_owner").alias("owner"), F.col("_repo").alias("repo"), F.inline(F.concat("_base", free)))
    # A token matters if it looks live or a base pattern names it; which are named is a bitmap of fixed size.
    named = bitmap_of(seen.filter(F.col("rank") < len(BASE)).select(F.col("hash").alias("key")), BITS)
    seen = written(may_repeat(seen, named, "hash", "_named", BITS).filter("live OR _named").drop("_named"), "secrets-seen")
    least = max(1, seen.count() / 1024)
    values = written(ownership(seen, copied_owners, copied_repos), "secrets-values")
    add = (F.col("rank") == len(BASE)) & (((F.col("class") == "owned") & F.col("live")) | ((F.col("class") != "copied") & F.col("named")))
    based = F.col("rank") < len(BASE)
    judged = hot_join(seen.drop("live"), values.filter("named OR class = 'owned'").drop("n_repos", "n_owners"), ["hash"], "n", least)
    judged = judged.withColumns({"_add": add, "_live": based & F.col("live") & (F.col("class") == "owned"), "_copied": based & (F.col("class") == "copied")}).filter("_add OR _live OR _copied")
    span = F.struct("start", "end", "rank", F.lit("owned").alias("kind"))
    more = judged.groupBy("_row").agg(F.collect_list(F.when(F.col("_add"), span)).alias("_more"), F.count_if("_live").alias("n_live"), F.count_if("_copied").alias("n_copied"))
    more = written(more, "secrets-more")
    # Rows that gain nothing pass by without a shuffle.
    marks = bitmap_of(more.select(F.xxhash64("_row").alias("key")), BITS)
    base = F.transform("_base", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), b["rank"].alias("rank"), F.element_at(F.array(*map(F.lit, BASE)), b["rank"] + 1).alias("kind")))
    out = may_repeat(rows.select("_row", *names, base.alias("_base")).withColumn("_key", F.xxhash64("_row")), marks, "_key", "_hit", BITS).drop("_key")
    plain = out.filter("NOT _hit").withColumns({"_more": F.expr(f"CAST(NULL AS {SPAN})"), "n_live": F.lit(0).cast("long"), "n_copied": F.lit(0).cast("long")})
    out = plain.unionByName(out.filter("_hit").join(more, "_row", "left"))
    spans = F.array_sort(F.concat("_base", F.coalesce("_more", F.expr(f"CAST(array() AS {SPAN})"))))
    counts = [F.coalesce(n, F.lit(0)).alias(n) for n in ("n_live", "n_copied")]
    return out.select(*[F.col(n).alias(c) for c, n in zip(carry, names, strict=True)], F.col("_base").alias("base"), spans.alias("spans"), *counts)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256 (of the base spans), spans (all of them), n_owned, n_live and n_copied.

    The source is the owner; its documents in one language are a repository.
    """
    docs = table(spark, sf_dir, "documents")
    found = scan_secrets(docs, F.col("source"), F.concat_ws("/", "source", "lang"))
    n = lambda column, kind: F.size(F.filter(column, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[n("base", k) for k in BASE], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), n("spans", "owned"), "n_live", "n_copied")

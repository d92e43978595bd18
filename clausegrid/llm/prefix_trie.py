"""A trie of the prefixes that conversations share, by partition refinement."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausegrid.llm.common import hot_join, new_folder, table, whole, written

#: Keys with this share of all rows are broadcast in joins, so there are as many of them at most.
PARTS = 1024
#: Places of a chain, and ids of a list, that are worked on together.
BLOCK = 1024
NODE = "cls long, pos long, start long, parent long, n long, digest binary, chars long, last long, copies string, end_id long, n_ends long"
CHAIN = "cls long, start long, level int, up long, up_start long, up_level int, n long, last long"
END = "cls long, pos long, copies string, end_id long, n_ends long"


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of a turn; null counts as empty. The length in front keeps role and text apart."""
    role, text = whole(role), whole(text)
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def turns_of(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv, pos, digest, chars): each conversation's turns, numbered from 1.

    Turns are ordered by `turn_col`, null first; those with one number by their digest, and
    repeated rows each count. Rows without a conversation id belong to none and are left out. Rows are
    numbered where a sort by range puts them, so a conversation may hold any share of them.
    """
    rows = df.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), turn_digest(F.col(role_col), F.col(text_col)).alias("digest"), F.length(whole(F.col(text_col))).cast("long").alias("chars"), F.monotonically_increasing_id().alias("uid")
    )
    return numbered(written(rows, "trie-turns"), ["turn", "digest", "uid"]).select("conv", "pos", "digest", "chars")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` with `pos`, their place in their conversation, from 1.

    They are dealt out by ranges of (conv, *order) and counted as they pass. Only a range's first conversation can
    have begun in an earlier range: where it stands by then is a number per range.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange("conv", *order).sortWithinPartitions("conv", *order)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv").to_numpy()
            begins = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            sizes = np.diff(np.r_[begins, len(conv)])
            pos = np.arange(len(conv)) - np.repeat(begins, sizes) + 1
            if conv[0] == held:
                pos[: sizes[0]] += seen
            held, seen = conv[-1], int(pos[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pos, pa.int64()), pa.array(np.full(len(conv), part), pa.int32())], [*batch.schema.names, "pos", "part"])

    out = written(dealt.mapInArrow(count, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", pos long, part int"), "trie-numbered")
    ends = out.groupBy("part").agg(F.min("conv").alias("first"), F.max("conv").alias("last"), F.max(F.struct("conv", "pos")).alias("end")).select("part", "first", "last", F.col("end.pos").alias("seen"))
    before, held, seen = [], None, 0
    for r in sorted(ends.collect()):  # one row per range
        if r["first"] == held:
            before.append((r["part"], held, seen))
        held, seen = r["last"], r["seen"] + (seen if r["first"] == held and r["last"] == r["first"] else 0)
    offsets = spark.createDataFrame(before, "part int, conv long, more long")
    return out.join(F.broadcast(offsets), ["part", "conv"], "left").withColumn("pos", F.col("pos") + F.coalesce("more", F.lit(0))).drop("part", "more")


def rebuilt(turns: DataFrame, borrowed: Column, base: Column) -> DataFrame:
    """Rows (conv, pos, digest, chars) of rebuilt conversations, with a row at pos 0, of no turn, for each.

    A conversation takes over the first `borrowed` turns of the conversation `base`, both expressions over conv: all
    of them if there are fewer, none if there is no such conversation; its own turns after the first
    `borrowed` follow.
    """
    sizes = written(turns.groupBy("conv").agg(F.max("pos").alias("n")), "trie-sizes")
    convs = sizes.withColumns({"h": borrowed.cast("long"), "base": base.cast("long")})
    had = sizes.select(F.col("conv").alias("base"), F.col("n").alias("_had"))
    # A base serves as many conversations as name it, so it is the side that each conversation looks up.
    convs = written(convs.join(had, "base", "left").withColumn("taken", F.least("h", F.coalesce("_had", F.lit(0)))).drop("_had"), "trie-convs")
    most = convs.agg(F.max("h")).first()[0] or 0
    first = turns.filter(F.col("pos") <= most).withColumnRenamed("conv", "base")
    taken = convs.filter("taken > 0").select("conv", "base", F.explode(F.sequence(F.lit(1).cast("long"), "taken")).alias("pos")).join(first, ["base", "pos"]) if most else None
    least = max(1, turns.count() / PARTS)
    own = hot_join(turns, convs.select("conv", "h", "taken", "n"), ["conv"], "n", least).filter("pos > h")
    out = own.select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "chars")
    out = out.unionByName(convs.select("conv", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars")))
    return out.unionByName(taken.select("conv", "pos", "digest", "chars")) if taken is not None else out


class _Emitted:
    """Rows that rounds add to one table in the shared folder."""

    def __init__(self, spark: SparkSession, name: str, schema: str) -> None:
        self.spark, self.path, self.schema, self.any = spark, new_folder(spark, name), schema, False

    def add(self, rows: DataFrame) -> None:
        names = [c.split()[0] for c in self.schema.split(", ")]
        rows.select(*names).write.mode("append").parquet(self.path)
        self.any = True

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path) if self.any else self.spark.createDataFrame([], self.schema)


@dataclass
class Trie:
    """A trie, as tables.

    `nodes` has a row per node: conv_id, its smallest member; depth; parent_conv_id; n_convs, its members; n_children;
    n_leaves; saved_tokens; digest, of its last turn; and of the members that end there n_ends, end_id, the smallest, and
    copies, the class that `members` (copies, conv) has all of them under.
    """

    nodes: DataFrame
    members: DataFrame


def prefix_trie(turns: DataFrame) -> Trie:
    """The trie of conversations given as rows (conv, pos, digest, chars), with a row at pos 0 for each.

    Identical conversations are one to begin with, found by a fingerprint that is summed up like a count. All
    others start as one class. In each round every class is split by its next turn; a class of one is retired
    and the rest of its turns emitted as a unary chain. Where a class agrees on all the turns looked at, they are emitted as
    part of its own chain, and twice as many are looked at next. So rounds follow the forks on a path and the logarithm
    of what lies between, not the number of turns. Subtrees are then folded back, chain by chain, from the deepest.

    saved_tokens sums up, over a subtree, chars of each node's last turn for each member but one. Classes and
    conversations that hold a large share of the rows are met by broadcast, all others by a shuffle.
    No turns give no nodes.
    """
    spark = turns.sparkSession
    turns = written(turns, "trie-rebuilt")
    mark = lambda salt: F.bit_xor(F.when(F.col("pos") > 0, F.xxhash64(F.lit(salt), "digest", "pos")).otherwise(0))
    prints = turns.groupBy("conv").agg(F.max("pos").alias("length"), mark(1).alias("_a"), mark(2).alias("_b"))
    prints = written(prints.select("conv", "length", F.concat_ws("/", "length", "_a", "_b").alias("copies")), "trie-prints")
    groups = written(prints.groupBy("copies").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("w"), F.max("length").alias("length")), "trie-groups")
    least_turns, least_convs = max(1, turns.count() / PARTS), max(1, groups.count() / PARTS)
    nodes, chains, ends = (_Emitted(spark, f"trie-{name}", schema) for name, schema in (("nodes", NODE), ("chains", CHAIN), ("ends", END)))

    none = F.lit(None).cast("long")
    # Those that take the same turn out of the same class; to begin with all, out of none, at the place of no turn.
    forked = groups.select("conv", "w", "length", "copies", F.lit(0).cast("long").alias("cls"), none.alias("up"), none.alias("start"), F.lit(-1).alias("level"), F.lit(0).cast("long").alias("fork"), F.lit(b"").alias("digest"))
    rest, going, level = turns, None, 0
    while True:
        made = written(forked.groupBy("cls", "up", "start", "level", "fork", "digest").agg(F.min("conv").alias("new"), F.count(F.lit(1)).alias("k"), F.sum("w").alias("n"), F.max("length").alias("longest")), "trie-made")
        alone = F.col("k") == 1
        chains.add(made.select(F.col("new").alias("cls"), F.col("fork").alias("start"), F.lit(level).alias("level"), "up", F.col("start").alias("up_start"), F.col("level").alias("up_level"), "n", F.when(alone, F.col("longest")).alias("last")))
        single = made.filter(alone).select(F.col("new").alias("conv"), F.col("fork").alias("start"), F.col("up").alias("parent"), "n", F.col("longest").alias("last"), (F.col("longest") + 1).alias("size"))
        single = written(single.join(groups.select("conv", "copies"), "conv"), "trie-single")
        tails, over = hot_join(rest, single, ["conv"], "size", least_turns).filter("pos >= start"), F.col("pos") == F.col("last")
        nodes.add(tails.select(F.col("conv").alias("cls"), "pos", "start", "parent", "n", "digest", "chars", "last", *[F.when(over, F.col(c)).alias(name) for c, name in (("copies", "copies"), ("conv", "end_id"), ("n", "n_ends"))]))
        several = made.filter(~alone).select("cls", "digest", "new", "up", "fork", "k", "n")
        members = hot_join(forked.select("conv", "w", "length", "copies", "cls", "digest"), several, ["cls", "digest"], "k", least_convs)
        members = members.select("conv", "w", "length", "copies", F.col("new").alias("cls"), F.col("fork").alias("start"), F.col("up").alias("parent"), F.lit(level).alias("level"), (F.col("fork") - 1).alias("at"), F.lit(2).cast("long").alias("look"), "k", "n")
        members = written(members if going is None else members.unionByName(going), "trie-members")
        if members.isEmpty():
            break
        ahead = hot_join(rest, members.drop("w", "copies").withColumn("size", F.col("length") + 1), ["conv"], "size", least_turns).filter("pos > at")
        ahead = written(ahead.drop("size", "length"), "trie-ahead")
        of = ("cls", "start", "parent", "k", "n")
        places = ahead.filter("pos <= at + look").groupBy(*of, "pos").agg(F.count(F.lit(1)).alias("held"), F.min("digest").alias("digest"), F.max("digest").alias("_most"), F.min("chars").alias("chars"))
        places = written(places.withColumn("agreed", (F.col("held") == F.col("k")) & F.col("digest").eqNullSafe(F.col("_most"))).drop("_most", "held"), "trie-places")
        forks = written(places.groupBy("cls", "k").agg(F.min(F.when(~F.col("agreed"), F.col("pos"))).alias("fork")), "trie-forks")
        chain = places.join(forks.drop("k"), "cls").filter("fork IS NULL OR pos < fork")
        nodes.add(chain.select("cls", "pos", "start", "parent", "n", "digest", "chars", *[none.cast(kind).alias(c) for c, kind in (("last", "long"), ("copies", "string"), ("end_id", "long"), ("n_ends", "long"))]))
        told = written(hot_join(members.drop("k"), forks, ["cls"], "k", least_convs), "trie-told")
        going = told.filter("fork IS NULL").drop("fork").withColumns({"at": F.col("at") + F.col("look"), "look": F.col("look") * 2})
        apart = told.filter("fork IS NOT NULL").join(ahead.select("conv", F.col("pos").alias("fork"), "digest"), ["conv", "fork"], "left")
        apart = written(apart, "trie-apart")
        ends.add(apart.filter("digest IS NULL").select("cls", (F.col("fork") - 1).alias("pos"), "copies", F.col("conv").alias("end_id"), F.col("w").alias("n_ends")))
        forked = apart.filter("digest IS NOT NULL").select("conv", "w", "length", "copies", "cls", F.col("cls").alias("up"), "start", "level", "fork", "digest")
        rest, level = ahead.select("conv", "pos", "digest", "chars"), level + 1
    return Trie(_folded(spark, nodes.table(), chains.table(), ends.table()), prints.select("copies", "conv"))


def _folded(spark: SparkSession, nodes: DataFrame, chains: DataFrame, ends: DataFrame) -> DataFrame:
    """The nodes with what their subtrees sum up to."""
    own = F.sum((F.col("n") - 1) * F.col("chars")).alias("own")
    gifts = _Emitted(spark, "trie-gifts", "up long, up_start long, up_level int, leaves long, saved long, kids long")
    summed = _Emitted(spark, "trie-summed", "cls long, start long, leaves long, below long, kids long, last long")
    # Chains without forks are most of them; of those only copies save anything.
    tails = chains.filter("last IS NOT NULL")
    copied = tails.filter("n > 1").join(nodes.filter("last IS NOT NULL AND n > 1").groupBy("cls", "start").agg(own), ["cls", "start"])
    tails = tails.filter("n = 1").withColumn("own", F.lit(0).cast("long")).unionByName(copied)
    gifts.add(tails.filter("up IS NOT NULL").groupBy("up", "up_start", "up_level").agg(F.count(F.lit(1)).alias("leaves"), F.sum("own").alias("saved"), F.count(F.lit(1)).alias("kids")))
    none = F.lit(0).cast("long")
    summed.add(copied.select("cls", "start", (none + 1).alias("leaves"), none.alias("below"), none.alias("kids"), "last"))
    inner = chains.filter("last IS NULL").drop("last").join(nodes.filter("last IS NULL").groupBy("cls", "start").agg(F.max("pos").alias("last"), own), ["cls", "start"])
    inner = written(inner, "trie-inner")
    for level in sorted((r["level"] for r in inner.select("level").distinct().collect()), reverse=True):  # at most a number per round
        got = gifts.table().filter(F.col("up_level") == level).groupBy(F.col("up").alias("cls"), F.col("up_start").alias("start")).agg(*[F.sum(c).alias(c) for c in ("leaves", "saved", "kids")])
        here = written(inner.filter(F.col("level") == level).join(got.withColumnRenamed("saved", "below"), ["cls", "start"]), "trie-level")
        summed.add(here)
        gifts.add(here.filter("up IS NOT NULL").select("up", "up_start", "up_level", "leaves", (F.col("own") + F.col("below")).alias("saved"), (none + 1).alias("kids")))
    above = F.when(F.col("pos") == F.col("start"), F.col("parent")).otherwise(F.col("cls")).alias("parent_conv_id")
    shown = ["digest", "n_ends", "end_id", "copies"]
    out = [F.col("cls").alias("conv_id"), F.col("pos").alias("depth"), above, F.col("n").alias("n_convs")]
    alone = nodes.filter("n = 1").select(*out, (F.col("pos") < F.col("last")).cast("long").alias("n_children"), (none + 1).alias("n_leaves"), none.alias("saved_tokens"), *shown)
    # What a node's chain holds below it: later blocks of places as a whole, then the places of its own block.
    many = nodes.filter("n > 1").drop("last").withColumn("block", F.floor(F.col("pos") / BLOCK))
    blocks = many.groupBy("cls", "start", "block").agg(F.sum("chars").alias("held"))
    later = F.sum("held").over(Window.partitionBy("cls", "start").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("later", F.coalesce(later, F.lit(0))).drop("held").join(summed.table(), ["cls", "start"])
    many = many.join(blocks, ["cls", "start", "block"])
    held = F.sum("chars").over(Window.partitionBy("cls", "start", "block").orderBy(F.desc("pos"))) + F.col("later")
    many = many.withColumn("saved_tokens", F.col("below") + (F.col("n") - 1) * held)
    ended = ends.select("cls", "pos", *[F.col(c).alias(f"_{c}") for c in ("n_ends", "end_id", "copies")])
    many = many.join(ended, ["cls", "pos"], "left").withColumns({c: F.coalesce(c, f"_{c}") for c in ("n_ends", "end_id", "copies")})
    return alone.unionByName(many.select(*out, F.when(F.col("pos") < F.col("last"), F.lit(1)).otherwise(F.col("kids")).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), "saved_tokens", *shown))


def id_list_digests(members: DataFrame) -> DataFrame:
    """(copies, n, sha256) of each class of `members` (copies, conv) that has two and more: the hash of its ids, ascending, with commas between.

    Ids are sorted by range and joined into blocks wherever they are, so that a class of any size is spread; then a class's blocks
    pass one task in order, a stream of which nothing but the hash is held.
    """
    sizes = written(members.groupBy("copies").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "trie-classes")
    ids = written(hot_join(members, sizes, ["copies"], "n", max(1, members.count() / PARTS)).select("copies", "conv"), "trie-ids")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            copies, conv = batch.column("copies"), batch.column("conv")
            codes = np.asarray(copies.dictionary_encode().indices)
            begins = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            text = pc.cast(conv, pa.string())
            lists = pa.ListArray.from_arrays(pa.array(np.r_[begins, len(codes)], pa.int32()), text)
            yield pa.RecordBatch.from_arrays([copies.take(pa.array(begins)), conv.take(pa.array(begins)), pc.binary_join(lists, ",")], ["copies", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            done: list[tuple[str, str]] = []
            for copies, ids in zip(batch.column("copies").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if copies == held:
                    state.update(b"," + ids.encode())
                else:
                    if held is not None:
                        done.append((held, state.hexdigest()))
                    held, state = copies, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string())], ["copies", "sha256"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held]), pa.array([state.hexdigest()])], ["copies", "sha256"])

    blocks = ids.repartitionByRange("copies", "conv").sortWithinPartitions("copies", "conv").mapInArrow(join, "copies string, first long, ids string")
    return blocks.repartition("copies").sortWithinPartitions("copies", "first").mapInArrow(digest, "copies string, sha256 string")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation c takes over the first crc32(c) % 6 turns of conversation c - c % 100.
    """
    c = F.col("conv")
    turns = turns_of(table(spark, sf_dir, "conversations"))
    trie = prefix_trie(rebuilt(turns, F.crc32(c.cast("string")) % 6, c - c % 100))
    shown = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    several = trie.nodes.filter("n_ends > 1").join(id_list_digests(trie.members), "copies")
    others = trie.nodes.filter("coalesce(n_ends, 0) < 2")
    return others.select(*shown, F.sha2(F.coalesce(F.col("end_id").cast("string"), F.lit("")), 256).alias("ends_sha256")).unionByName(several.select(*shown, F.col("sha256").alias("ends_sha256")))


_CRC = "xor(list_reduce(flatten([[ascii(x), -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(c::VARCHAR, '')]), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, 4294967295::BIGINT), 4294967295)"
OP11_SQL = f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k,
    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, {_CRC} % 6 AS h, c - c % 100 AS base FROM (SELECT DISTINCT c FROM t)),
taken AS (SELECT v.c, 0 AS own, b.k, b.d, b.chars FROM convs v JOIN t b ON b.c = v.base AND b.k <= v.h UNION ALL SELECT c, 1, k, d, chars FROM t JOIN convs USING (c) WHERE k > h),
turns AS (SELECT c, row_number() OVER w AS pos, d, chars, sha256(string_agg(d, '' ) OVER w) AS p FROM taken WINDOW w AS (PARTITION BY c ORDER BY own, k)),
prefixes AS (SELECT c, pos, chars, p FROM turns UNION ALL SELECT c, 0, 0, '' FROM convs),
lengths AS (SELECT c, max(pos) AS n FROM prefixes GROUP BY 1),
nodes AS (SELECT pos, p, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (pos = n), '') AS ids FROM prefixes JOIN lengths USING (c) GROUP BY 1, 2),
path AS (SELECT x.conv_id, x.pos, x.n_convs, x.chars, y.p AS above, y.pos AS above_pos FROM nodes x JOIN prefixes y ON y.c = x.conv_id AND y.pos <= x.pos),
kids AS (SELECT above AS p, above_pos AS pos, count(*) AS n_children FROM path WHERE above_pos = pos - 1 GROUP BY 1, 2),
leaves AS (SELECT conv_id, pos, n_convs, chars, above, above_pos, NOT EXISTS (SELECT 1 FROM kids k JOIN nodes z ON z.p = k.p AND z.pos = k.pos WHERE z.conv_id = path.conv_id AND z.pos = path.pos) AS leaf FROM path),
below AS (SELECT above AS p, above_pos AS pos, count(*) FILTER (leaf) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens FROM leaves GROUP BY 1, 2),
up AS (SELECT x.conv_id, x.pos, z.conv_id AS parent_conv_id FROM path x JOIN nodes z ON z.p = x.above AND z.pos = x.above_pos WHERE x.above_pos = x.pos - 1)
SELECT n.conv_id, n.pos::BIGINT AS depth, up.parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, sha256(n.ids) AS ends_sha256
FROM nodes n JOIN below b USING (p, pos) LEFT JOIN kids k USING (p, pos) LEFT JOIN up ON up.conv_id = n.conv_id AND up.pos = n.pos
"""

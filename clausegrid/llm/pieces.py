"""SentencePiece encoding and decoding over a relational lattice."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid.llm.common import smaller_batches, table, whole, written

SPACE = "▁"
PENALTY = 10.0  # what an unknown character costs below the lowest score
BLOCK = 64  # longer words are taken apart in blocks of so many characters
PRIME = 4_294_967_291
LAST = ((1 << 22) - 1) << 34  # the rank of what is no merge
SLICE_BYTES = 2 << 20  # texts are taken apart in slices of about so many bytes


@dataclass(frozen=True)
class Vocabulary:
    """The pieces of a model: a table of at most a few hundred thousand rows, so it may be broadcast."""

    rows: tuple[tuple[str, int, float], ...]
    special: tuple[tuple[int, bytes], ...]  # ids that are not pieces of text, and the bytes they stand for
    byte_base: int | None
    unknown: int
    longest: int
    lowest: float
    by_merges: bool = False  # BPE merges by rank instead of the best sum of scores

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        byte = {i: bytes([int(model.id_to_piece(i)[3:5], 16)]) for i in every if model.is_byte(i)}
        rows = tuple((model.id_to_piece(i), i, float(np.float32(model.get_score(i)))) for i in every if not (i in byte or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)))
        base = min(byte) if len(byte) == 256 and all(byte[min(byte) + k] == bytes([k]) for k in range(256)) else None
        special = {i: b"" for i in every if model.is_control(i)} | {model.unk_id(): " ⁇ ".encode()} | byte
        return cls(rows, tuple(special.items()), base, model.unk_id(), max(len(p) for p, _, _ in rows), min(s for _, _, s in rows))

    def with_merges(self) -> Vocabulary:
        """The vocabulary for a BPE model, whose ids come from merges."""
        return replace(self, by_merges=True)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), "piece string, id int, score float")

    def ranks(self) -> dict[int, int]:
        """The rank of each piece's merge, by id; equal scores share one, and then the leftmost merges first."""
        of_score = {score: k for k, score in enumerate(sorted({s for _, _, s in self.rows}, reverse=True))}
        return {i: of_score[s] for _, i, s in self.rows}

    def merge_table(self, spark: SparkSession) -> DataFrame:
        """piece, id and `code`: what of an edge in merges() does not depend on its place."""
        rank, of = self.ranks(), {p: i for p, i, _ in self.rows}
        if max(rank) >= 1 << 21:
            raise ValueError("ids of more than 21 bits are not foreseen")
        ends = {(i, of[part]) for p, i, _ in self.rows for k in range(1, len(p)) for part in (p[:k], p[k:]) if len(part) > 1 and part in of}
        returns = {part for i, part in ends if rank[part] >= rank[i]}  # its merge may make one of an earlier rank possible
        rows = [(p, i, (rank[i] << 34) + ((i in returns) << 22) + i) for p, i, _ in self.rows]
        return spark.createDataFrame(rows, "piece string, id int, code long")

    def contents(self) -> list[tuple[int, bytes]]:
        """(id, content): the bytes that each id stands for."""
        return [(i, p.replace(SPACE, " ").encode()) for p, i, _ in self.rows] + list(self.special)


class Splitter:
    """Cuts texts into the words that the lattice sees.

    Blanks become marks and one mark is put in front of a text that isn't empty. A word
    ends between two characters that no piece has next to each other: no piece reaches
    over such a place, so the best path and the merges of a text are those of its words.
    """

    def __init__(self, vocabulary: Vocabulary):
        inside = {(ord(a), ord(b)) for piece, _, _ in vocabulary.rows for a, b in zip(piece, piece[1:])}
        self.inside = np.array(sorted((a << 32) + b for a, b in inside), np.int64)

    def of(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct words, the number of each word of the texts in order, and how many words each text has."""
        # Blank-separated chunks with a mark each; where blanks follow each other, the marks go to the next chunk.
        plain = pc.invert(pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.starts_with(texts, " "), pc.equal(texts, ""))))
        lists = pc.split_pattern(texts.filter(plain), " ")
        chunks = pc.binary_join_element_wise(SPACE, lists.flatten(), "").dictionary_encode()
        regular, sizes = plain.to_numpy(zero_copy_only=False), np.zeros(len(texts), np.int64)
        sizes[regular] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        values, codes = chunks.dictionary, chunks.indices.to_numpy().astype(np.int64)
        odd = np.flatnonzero(~regular)
        if len(odd):
            more = [_marked_chunks(t) for t in texts.take(pa.array(odd)).to_pylist()]
            extra = pa.array([c for one in more for c in one], pa.string()).dictionary_encode()
            new = np.split(extra.indices.to_numpy().astype(np.int64) + len(values), np.cumsum([len(one) for one in more])[:-1])
            parts = np.split(codes, np.cumsum(sizes)[:-1])
            for i, one in zip(odd.tolist(), new, strict=True):
                parts[i], sizes[i] = one, len(one)
            values, codes = pa.concat_arrays([values, extra.dictionary]), np.concatenate(parts)
        words, per_chunk = self._cut(values)
        coded = words.dictionary_encode()
        number = coded.indices.to_numpy().astype(np.int64)
        count = per_chunk[codes]
        first = np.cumsum(per_chunk) - per_chunk
        after = np.cumsum(count)
        at = np.arange(after[-1] if len(after) else 0) - np.repeat(after - count - first[codes], count)
        ends = np.cumsum(sizes)
        return coded.dictionary, number[at], np.diff(np.concatenate([[0], after])[ends], prepend=0)

    def _cut(self, chunks: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of chunks one after the other, and how many each chunk has."""
        if not len(chunks):
            return pa.array([], pa.string()), np.zeros(0, np.int64)
        starts = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset : chunks.offset + len(chunks) + 1].astype(np.int64)
        data = np.frombuffer(chunks.buffers()[2], np.uint8)[starts[0] : starts[-1]]
        starts = starts - starts[0]
        begins = np.flatnonzero((data & 0xC0) != 0x80)  # of characters
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
        pairs = (points[:-1] << 32) + points[1:]
        at = np.minimum(np.searchsorted(self.inside, pairs), len(self.inside) - 1)
        begin = np.ones(len(points), bool)
        begin[1:] = self.inside[at] != pairs
        begin[np.searchsorted(begins, starts[:-1])] = True
        cuts = begins[begin]
        words = pa.StringArray.from_buffers(len(cuts), pa.py_buffer(np.append(cuts, len(data)).astype(np.int32)), pa.py_buffer(data))
        return words, np.diff(np.searchsorted(cuts, starts))


def _marked_chunks(text: str) -> list[str]:
    """A text's chunks, each with the marks in front of it."""
    out, marks = [], ""
    for chunk in text.split(" ") if text else ():
        marks += SPACE
        if chunk:
            out.append(marks + chunk)
            marks = ""
    return [*out, marks] if marks else out


def _sliced(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts have about SLICE_BYTES together; a longer text is alone."""
    for batch in batches:
        after = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(after, (after[first - 1] if first else 0) + SLICE_BYTES, side="right")))
            yield batch.slice(first, last - first)
            first = last
        pa.default_memory_pool().release_unused()


def _counted(vocabulary: Vocabulary, most: int = 300_000):
    """(unit, n): the words of a task's texts and how often each occurs; once a task, or more often where there are over `most`."""

    def combined(held: list[pa.Table]) -> list[pa.RecordBatch]:
        return pa.concat_tables(held).group_by("unit").aggregate([("n", "sum")]).rename_columns(["unit", "n"]).combine_chunks().to_batches(100_000) if held else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(vocabulary)
        held: list[pa.Table] = []
        for batch in _sliced(batches, 0):
            words, codes, _ = splitter.of(batch.column(0))
            held.append(pa.table({"unit": words, "n": pa.array(np.bincount(codes, minlength=len(words)), pa.int64())}))
            if sum(map(len, held)) > most:
                yield from combined(held)
                held = []
        yield from combined(held)

    return run


def _listed(vocabulary: Vocabulary):
    """(_row, units): the words of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(vocabulary)
        for batch in _sliced(batches, 1):
            words, codes, sizes = splitter.of(batch.column(1))
            units = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), words.take(pa.array(codes)))
            yield pa.RecordBatch.from_arrays([batch.column(0), units], ["_row", "units"])

    return run


def _path(edges: Column) -> Column:
    """Viterbi as a fold over edges by end, then start: the best path as array of (s, id, lost).

    The state has the best (score, start, id) for each place reached so far. Scores are
    32-bit sums from left to right; of equal ones the edge that starts first wins.
    """
    begin = F.expr("array(named_struct('score', CAST(0 AS FLOAT), 's', -1, 'id', -1, 'lost', CAST(NULL AS STRING)))")

    def step(best: Column, x: Column) -> Column:
        mine = F.array(F.struct((F.element_at(best, x["s"] + 1)["score"] + x["score"]).alias("score"), x["s"].alias("s"), x["id"].alias("id"), x["lost"].alias("lost")))
        better = F.element_at(mine, 1)["score"] > F.element_at(best, -1)["score"]
        return F.when(F.size(best) == x["e"], F.concat(best, mine)).when(better, F.concat(F.slice(best, F.lit(1), x["e"]), mine)).otherwise(best)

    def back(best: Column) -> Column:
        first = F.struct((F.size(best) - 1).alias("at"), F.expr("CAST(array() AS array<struct<id:int,lost:string>>)").alias("out"))

        def follow(state: Column, _: Column) -> Column:
            here = F.element_at(best, state["at"] + 1)
            return F.when(state["at"] <= 0, state).otherwise(F.struct(here["s"].alias("at"), F.concat(F.array(F.struct(here["id"].alias("id"), here["lost"].alias("lost"))), state["out"]).alias("out")))

        return F.aggregate(best, first, follow, lambda state: state["out"])

    return F.aggregate(edges, begin, step, back)


def _ids(vocabulary: Vocabulary, path: Column) -> Column:
    def of(p: Column) -> Column:
        if vocabulary.byte_base is None:
            return F.array(F.when(p["id"] >= 0, p["id"]).otherwise(vocabulary.unknown))
        code = F.hex(F.encode(p["lost"], "UTF-8"))
        spelled = F.transform(F.sequence(F.lit(1), F.length(code), F.lit(2)), lambda i: F.conv(F.substring(code, i, F.lit(2)), 16, 10).cast("int") + vocabulary.byte_base)
        return F.when(p["id"] >= 0, F.array(p["id"])).otherwise(spelled)

    return F.flatten(F.transform(path, of))


def viterbi(vocabulary: Vocabulary):
    """The same best path, for one word in Python: what tests hold the fold against."""
    known = {p: (i, np.float32(s)) for p, i, s in vocabulary.rows}
    lost = np.float32(np.float32(vocabulary.lowest) - np.float32(PENALTY))

    def encode(unit: str) -> list[int]:
        best: list[tuple[np.float32, int, int]] = [(np.float32(0), -1, -1)]
        for e in range(1, len(unit) + 1):
            top = None
            for s in range(max(0, e - vocabulary.longest), e):
                found = known.get(unit[s:e]) or ((-1, lost) if s == e - 1 else None)
                if found and (top is None or best[s][0] + found[1] > top[0]):
                    top = (best[s][0] + found[1], s, found[0])
            best.append(top)
        out, at = [], len(unit)
        while at:
            _, s, i = best[at]
            out.append([i] if i >= 0 else [vocabulary.unknown] if vocabulary.byte_base is None else [vocabulary.byte_base + b for b in unit[s:at].encode()])
            at = s
        return [i for part in reversed(out) for i in part]

    return encode


class Edges:
    """A lattice edge as one long: start (27 bits), length (5), and the piece's id, or -1 - code point of a character that no piece has (32)."""

    @staticmethod
    def packed(s: Column, k: Column, id_: Column) -> Column:
        low = id_.cast("long").bitwiseAND(F.lit((1 << 32) - 1))
        return F.shiftleft(s.cast("long"), 37).bitwiseOR(F.shiftleft(k.cast("long"), 32)).bitwiseOR(low)

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.rank = vocabulary.ranks()

    def spelled(self, point: int) -> list[int]:
        if self.vocabulary.byte_base is None:
            return [self.vocabulary.unknown]
        return [self.vocabulary.byte_base + b for b in chr(point).encode("utf-8", "replace")]

    def spelled_out(self, lists: pa.ListArray) -> pa.ListArray:
        """The ids of each word, where a character that no piece has is spelled by its ids."""
        flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        lost = np.flatnonzero(flat < 0)
        spelled = [self.spelled(-1 - int(c)) for c in flat[lost]]
        count = np.ones(len(flat), np.int64)
        count[lost] = [len(one) for one in spelled]
        after = np.concatenate([[0], np.cumsum(count)])
        out = np.repeat(flat, count).astype(np.int32)
        for at, one in zip(after[lost].tolist(), spelled, strict=True):
            out[at : at + len(one)] = one
        return pa.ListArray.from_arrays(pa.array(after[np.concatenate([[0], np.cumsum(sizes)])], pa.int32()), pa.array(out))

    def merged(self, edges: list[int]) -> list[int]:
        """The ids of one long word from its edges."""
        packed = np.array(edges, np.int64)
        s, k, i = packed >> 37, (packed >> 32) & 31, (packed & 0xFFFFFFFF).astype(np.uint32).view(np.int32).astype(np.int64)
        return self._long(int((k == 1).sum()), s, k, i)

    def _long(self, n: int, s: np.ndarray, k: np.ndarray, i: np.ndarray) -> list[int]:
        """The same merges for one long word, from a heap."""
        known = {(a, a + b): c for a, b, c in zip(s.tolist(), k.tolist(), i.tolist(), strict=True)}
        rank = {pair: self.rank[c] for pair, c in known.items() if c >= 0}
        after, before = {a: a + 1 for a in range(n)}, {a + 1: a for a in range(n)}
        agenda = [(rank[a, a + 2], a, a + 2) for a in range(n - 1) if (a, a + 2) in rank]
        heapq.heapify(agenda)
        while agenda:
            _, a, e = heapq.heappop(agenda)
            middle = after.get(a)
            if middle is None or after.get(middle) != e:
                continue
            del after[middle], before[middle]
            after[a], before[e] = e, a
            for pair in ((before.get(a), e), (a, after.get(e))):
                if pair in rank:
                    heapq.heappush(agenda, (rank[pair], *pair))
        out, a = [], 0
        while a < n:
            c = known[a, after[a]]
            out += [c] if c >= 0 else self.spelled(-1 - c)
            a = after[a]
        return out


def _merged_units(vocabulary: Vocabulary):
    """The ids of words as they are in the end: lost characters spelled, and the merges of words too long for the fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = Edges(vocabulary)
        for batch in batches:
            ids, lists = edges.spelled_out(batch.column(batch.num_columns - 2)), batch.column(batch.num_columns - 1)
            long = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
            if len(long):
                at = np.arange(len(ids))
                at[long] = len(ids) + np.arange(len(long))
                ids = pa.concat_arrays([ids, pa.array([edges.merged(lists[w].as_py()) for w in long.tolist()], ids.type)]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], ids], [*batch.schema.names[:-2], "ids"])

    return run


def merges(edges: Column, length: Column) -> Column:
    """BPE as a fold over the edges of a word of at most BLOCK characters: the ids of its path, or -1 - code point of a lost character.

    An edge is a long: its merge's rank, start (6 bits), length (5), whether its merge may
    make one of an earlier rank possible (1), id (22). Single characters, one a place, come last and are no merges. The state has a bit for each place
    where a piece ends or starts; the place BLOCK shares the bit of 0, both always set. In
    the order of ranks, then starts, an edge is merged when its ends are set and one place
    between them is, which is cleared. The fold starts over after a merge that may make an
    earlier one possible. The path is of the edges with set ends and nothing set between.
    """
    one = F.lit(1).cast("long")
    start = lambda x: F.shiftright(x, 28).bitwiseAND(63).cast("int")
    size = lambda x: F.shiftright(x, 23).bitwiseAND(31).cast("int")
    shift = lambda a, b: F.call_function("shiftleft", a, b)
    ends = lambda x: shift(one, start(x)).bitwiseOR(shift(one, start(x) + size(x)))
    inside = lambda x: shift(shift(one, size(x) - 1) - one, start(x) + 1)
    fits = lambda places, x: F.bitwise_not(places).bitwiseAND(ends(x)) == 0

    def step(state: Column, x: Column) -> Column:
        places = state["places"]
        merged = F.struct(places.bitwiseAND(F.bitwise_not(inside(x))).alias("places"), (x.bitwiseAND(1 << 22) != 0).alias("again"))
        return F.when(~state["again"] & (F.bit_count(places.bitwiseAND(inside(x))) == 1) & fits(places, x), merged).otherwise(state)

    def path(ordered: Column) -> Column:
        places = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), F.lit(63) - F.least(length, F.lit(63)))
        begin = F.struct(places.alias("places"), F.lit(True).alias("again"))
        over = lambda state, _: F.when(state["again"], F.aggregate(F.slice(ordered, F.lit(1), F.size(ordered) - length), F.struct(state["places"].alias("places"), F.lit(False).alias("again")), step)).otherwise(state)
        end = F.aggregate(F.sequence(F.lit(1), length), begin, over, lambda state: state["places"])  # a merge takes a place away
        stay = F.transform(F.array(end), lambda p: F.filter(ordered, lambda x: (p.bitwiseAND(inside(x)) == 0) & fits(p, x)))
        by_start = F.sort_array(F.transform(F.element_at(stay, 1), lambda x: x.bitwiseAND((1 << 34) - 1)))
        return F.transform(by_start, lambda x: F.shiftright(F.shiftleft(x, 42), 42).cast("int"))

    return F.element_at(F.transform(F.array(F.sort_array(edges)), path), 1)


def key_of(unit: Column) -> Column:
    """What stands for a word in joins: the word itself, or the hash of a long one, so that no row carries a long word many times."""
    return F.when(F.length(unit) <= BLOCK, unit).otherwise(F.concat(F.lit("\n"), F.sha2(unit, 256)))


def lattice(units: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """units (`key`, as key_of gives it, distinct; `unit` and `n`) with their edges, or their path.

    Result: key, n and `ids`, the path with the best sum of scores, folded here. Where the
    vocabulary goes by BPE merges, their fold gives `ids`, with lost characters still to be
    spelled; a word of more than BLOCK characters has none, but `edges` as Edges packs them.

    Substrings up to the longest piece are exploded and equi-joined to the piece table;
    characters that no piece has get an edge of their own. Long words are exploded block
    by block, each block reaching over its end by the longest piece less one, so that no
    substring is missed. The edges of a word come from one row and stay in its task, so
    when `units` is partitioned by key, grouping them takes no shuffle.
    """
    spark = units.sparkSession
    longest = min(31, vocabulary.longest)
    if vocabulary.longest > 31:
        raise ValueError("pieces of more than 31 characters are not foreseen")
    parts = F.regexp_extract_all("unit", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    reaching = F.transform(parts, lambda p, i: F.concat(p, F.substring(F.coalesce(F.get(parts, i + 1), F.lit("")), 1, longest - 1)))
    blocks = units.select("key", "n", F.posexplode(F.when(F.length("unit") <= BLOCK, F.array("unit")).otherwise(reaching)).alias("b", "part"))
    # Two generators instead of one array of substrings: they stay in generated code.
    last = F.least(F.lit(BLOCK), F.length("part")) - 1
    starts = blocks.select("key", "n", "b", "part", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    cuts = starts.select("key", "n", "b", "part", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("part") - F.col("at")))).alias("k"))
    cuts = cuts.select("key", "n", (F.col("b") * BLOCK + F.col("at")).alias("s"), "k", F.expr("substring(part, at + 1, k)").alias("piece"))
    pieces = vocabulary.merge_table(spark) if vocabulary.by_merges else vocabulary.table(spark)
    edges = cuts.join(F.broadcast(pieces), "piece", "left").filter("id IS NOT NULL OR k = 1")
    if vocabulary.by_merges:
        short, lost = F.length("key") <= BLOCK, F.lit(-1) - F.ascii("piece")
        place = F.shiftleft(F.col("s").cast("long"), 28).bitwiseOR(F.shiftleft(F.col("k").cast("long"), 23))
        edge = F.when(short, F.coalesce("code", lost.cast("long").bitwiseAND((1 << 22) - 1)).bitwiseOR(place).bitwiseOR(F.when(F.col("k") == 1, LAST).otherwise(0))).otherwise(Edges.packed(F.col("s"), F.col("k"), F.coalesce("id", lost)))
        grouped = edges.groupBy("key").agg(F.first("n").alias("n"), F.collect_list(edge).alias("edges"))
        return grouped.select("key", "n", F.when(short, merges(F.col("edges"), F.length("key"))).otherwise(F.array().cast("array<int>")).alias("ids"), F.when(~short, F.col("edges")).alias("edges"))
    lost = float(np.float32(np.float32(vocabulary.lowest) - np.float32(PENALTY)))
    edge = F.struct((F.col("s") + F.col("k")).alias("e"), "s", F.coalesce("score", F.lit(lost).cast("float")).alias("score"), F.coalesce("id", F.lit(-1)).alias("id"), F.when(F.col("id").isNull(), F.col("piece")).alias("lost"))
    grouped = edges.groupBy("key").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(edge)).alias("edges"))
    return grouped.select("key", "n", _path(F.col("edges")).alias("path")).select("key", "n", _ids(vocabulary, F.col("path")).alias("ids"))


def _contents(vocabulary: Vocabulary) -> list[bytes]:
    """The bytes of each id, by id."""
    contents = [b""] * (1 + max(i for i, _ in vocabulary.contents()))
    for i, content in vocabulary.contents():
        contents[i] = content
    return contents


def _decoded(contents: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.array(contents, pa.large_binary())
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            flat = held.take(ids.flatten())
            at = np.frombuffer(flat.buffers()[1], np.int64)[: len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
            ends = at[ids.offsets.to_numpy() - ids.offsets[0].as_py()]
            joined = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends.copy()), flat.buffers()[2]])
            try:
                text = joined.cast(pa.binary()).cast(pa.string())
            except pa.ArrowInvalid:  # some bytes are no UTF-8
                text = pa.array([b.decode("utf-8", "replace") for b in joined.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], [*batch.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, vocabulary: Vocabulary, keys: tuple[str, ...], ids_col: str = "ids") -> DataFrame:
    """keys, ids and `decoded`: the text that the ids of each row spell; bytes that are no UTF-8 become replacement characters.

    The contents of the pieces, as bounded as the piece table, are handed to the tasks. The
    mark in front of a text stays a blank here; assemble() takes it off. Rows may repeat;
    without ids the text is empty. An id that the vocabulary does not have is an error.
    """
    rows = encoded.select(*keys, F.coalesce(ids_col, F.array().cast("array<int>")).alias("ids"))
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(_decoded(_contents(vocabulary)), f"{schema}, decoded string")


def _with_crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds `crc`: crc32 of the ids in the first-but-one column as little-endian unsigned 32-bit numbers."""
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("ids"))
        data, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_pylist()
        crc = [zlib.crc32(data[a:b]) for a, b in zip(offsets, offsets[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(crc, pa.int64())], [*batch.schema.names, "crc"])


def encoded_words(df: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> DataFrame:
    """A row (key, n, ids, decoded, crc) for each distinct word of all texts: every word is encoded and decoded once.

    Words are counted where the texts are read and summed by word. A null or empty text has none.
    """
    seen = df.select(whole(F.col(text_col)).alias("_text")).mapInArrow(_counted(vocabulary), "unit string, n long")
    # Dealt out by key alone, so that grouping the edges takes no second shuffle; a task sends a word about once.
    counts = seen.withColumn("key", key_of(F.col("unit"))).repartition("key").groupBy("key", "unit").agg(F.sum("n").alias("n"))
    steps = [*([_merged_units(vocabulary)] if vocabulary.by_merges else []), _decoded(_contents(vocabulary)), _with_crc]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps:  # in one worker: a worker a step would hold three times the memory
            batches = step(batches)
        return batches

    known = lattice(counts, vocabulary).mapInArrow(run, "key string, n long, ids array<int>, decoded string, crc long")
    with smaller_batches(df.sparkSession):
        return written(known, "piece-words")


def most_frequent(known: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The words above a count that at most `most` words reach, and that count."""
    sizes = known.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).limit(most).collect()
    least, held = 1 << 62, 0
    for n, here in sizes:
        if held + here > most:
            break
        least, held = n, held + here
    return known.filter(F.col("n") >= least), least


def encode(df: DataFrame, vocabulary: Vocabulary, row_col: str, text_col: str = "text", handed: int = 200_000) -> DataFrame:
    """The encoding as a relation: a row (row_col, pos, unit, ids, decoded) for each word of each text.

    At most `handed` words, the most frequent, are broadcast to the occurrences; the
    occurrences of all others are joined by shuffle. `row_col` must tell rows apart. A null
    or empty text has no words. Other columns are left alone.
    """
    known = encoded_words(df, vocabulary, text_col)
    kind = df.schema[row_col].dataType.simpleString()
    words = df.select(F.col(row_col).alias("_row"), whole(F.col(text_col)).alias("_text")).mapInArrow(_listed(vocabulary), f"_row {kind}, units array<string>")
    words = words.select("_row", F.posexplode("units").alias("pos", "unit")).withColumn("key", key_of(F.col("unit")))
    frequent, least = most_frequent(known, handed)
    near = words.join(F.broadcast(frequent.select("key", "ids", "decoded")), "key", "left")  # at most `handed` rows
    rare = near.filter("ids IS NULL").drop("ids", "decoded").join(known.filter(F.col("n") < least).select("key", "ids", "decoded"), "key")
    return near.filter("ids IS NOT NULL").unionByName(rare).select(F.col("_row").alias(row_col), "pos", "unit", "ids", "decoded")


def assemble(encoded: DataFrame, row_col: str) -> DataFrame:
    """row_col, ids and text of every row that has words: the words put together again."""
    rows = encoded.groupBy(row_col).agg(F.array_sort(F.collect_list(F.struct("pos", "ids", "decoded"))).alias("w"))
    return rows.select(row_col, F.flatten("w.ids").alias("ids"), F.expr("substring(array_join(w.decoded, ''), 2)").alias("text"))


def _summed(vocabulary: Vocabulary, keys: pa.Array, facts: np.ndarray):
    """Sums over the words of each text whose facts (ids, characters, crc, whether they come back) are handed out, and the other words with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(vocabulary)
        for batch in _sliced(batches, 1):
            words, codes, sizes = splitter.of(batch.column(1))
            found = pc.index_in(words, keys)  # long words are not among them
            known = found.is_valid().to_numpy(zero_copy_only=False)[codes]
            place = pc.fill_null(found, 0).to_numpy()[codes]
            row, after = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes)
            pos = np.arange(len(codes)) - np.repeat(after - sizes, sizes)
            total = lambda values: pa.array(np.diff(np.concatenate([[0], np.cumsum(np.where(known, values, 0))])[np.concatenate([[0], after])]))
            digest = ((pos + 1) % PRIME * facts[2][place]) % PRIME
            out = np.flatnonzero(~known)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[out], minlength=len(sizes)))]), pa.int32())
            others = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(pos[out].astype(np.int32)), words.take(pa.array(codes[out]))], ["pos", "unit"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), total(facts[0][place]), total(facts[1][place]), total(digest), total(1 - facts[3][place]), others], ["_row", "n_words", "n_pieces", "n_chars", "digest", "changed", "others"])

    return run


def encoding_digests(df: DataFrame, vocabulary: Vocabulary, row_col: str, text_col: str = "text", handed: int = 200_000) -> DataFrame:
    """row_col, n_words, n_pieces, n_chars, digest and round_trip of each row: sums over the relation that encode() gives, without listing it.

    `digest` is the sum over a text's words of (place + 1) * crc32(ids as little-endian
    unsigned 32-bit numbers), modulo 4294967291, places counting from 0. Facts of the most
    frequent words (at most `handed`, some tens of bytes each) are handed to the tasks that
    read the texts; only the occurrences of other words are shuffled. A null or empty text
    has no words, and comes back.
    """
    known = encoded_words(df, vocabulary, text_col)
    same = F.when(F.startswith("key", F.lit("\n")) & (F.length("key") > 1), F.concat(F.lit("\n"), F.sha2(F.translate("decoded", " ", SPACE), 256)) == F.col("key")).otherwise(F.translate("decoded", " ", SPACE) == F.col("key"))
    known = known.select("key", "n", F.size("ids").cast("long").alias("pieces"), F.length("decoded").cast("long").alias("chars"), "crc", same.cast("long").alias("same"))
    frequent, least = most_frequent(known, handed)
    rows = frequent.filter(F.length("key") <= BLOCK).toPandas()
    keys, facts = pa.array(rows["key"].tolist() or [None], pa.string()), rows[["pieces", "chars", "crc", "same"]].to_numpy(np.int64).T.copy()
    kind = df.schema[row_col].dataType.simpleString()
    schema = f"_row {kind}, n_words long, n_pieces long, n_chars long, digest long, changed long, others array<struct<pos:int,unit:string>>"
    texts = df.select(F.col(row_col).alias("_row"), whole(F.col(text_col)).alias("_text"))
    with smaller_batches(df.sparkSession):
        part = written(texts.mapInArrow(_summed(vocabulary, keys, facts if facts.size else np.zeros((4, 1), np.int64)), schema), "piece-texts")
    rare = part.select("_row", F.explode("others").alias("o")).select("_row", "o.pos", key_of(F.col("o.unit")).alias("key"))
    rare = rare.join(known.filter((F.col("n") < least) | (F.length("key") > BLOCK)), "key").groupBy("_row").agg(
        F.sum("pieces").alias("_pieces"), F.sum("chars").alias("_chars"), F.sum(((F.col("pos").cast("long") + 1) * F.col("crc")) % PRIME).alias("_digest"), F.sum(1 - F.col("same")).alias("_changed"),
    )
    both = part.drop("others").join(rare, "_row", "left")
    total = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return both.select(
        F.col("_row").alias(row_col), "n_words", total("n_pieces", "_pieces").alias("n_pieces"), F.greatest(F.lit(0), total("n_chars", "_chars") - 1).alias("n_chars"),
        (total("digest", "_digest") % PRIME).alias("digest"), (total("changed", "_changed") == 0).alias("round_trip"),
    )


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, n_pieces, n_chars of the decoded text, ids_digest (see encoding_digests), round_trip."""
    import public_tokenizers

    vocabulary = Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model")).with_merges()
    docs = table(spark, sf_dir, "documents").select(F.struct("doc_id", F.monotonically_increasing_id().alias("uid")).alias("_id"), "text")
    return encoding_digests(docs, vocabulary, "_id").select(F.col("_id.doc_id").alias("doc_id"), "n_words", "n_pieces", "n_chars", F.col("digest").alias("ids_digest"), "round_trip")

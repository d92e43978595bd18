"""Packing by non-negative least squares over shallow length combinations."""

from __future__ import annotations

import bisect
import os
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausegrid.llm.common import give_back, table, whole, written

END = 1  # the id that ends a document
SLICE_BYTES = 4 << 20  # texts are taken apart in slices of about so many bytes


def _gather(flat: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs of `flat` that begin at `first`, one after the other."""
    after = np.cumsum(count)
    return flat[np.arange(after[-1] if len(after) else 0) - np.repeat(after - count - first, count)]


class ChunkIds:
    """Ids of blank-separated chunks, each found once while it is remembered.

    This vocabulary's rules never look across a blank, so a text's ids are those of its
    chunks. A chunk of letters and one mark is the letters, then the mark. Place 0 is the
    end of a document. At most `most` chunks and those of one slice of texts are
    remembered; then all are forgotten and found again, which changes no id.
    """

    MARKS = ".,;:!?"

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([None], pa.string())
        self.flat, self.first, self.count = np.array([END], "<u4"), np.array([0]), np.array([1])

    def _each(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, one after the other, and how many each has."""
        found = [self.tokenizer.encode(c, add_special_tokens=False).ids for c in chunks]
        count = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), "<u4", int(count.sum())), count

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters, many in one call: a word's last id, and no other, ends a word."""
        flat, counts = [], []
        for at in range(0, len(words), 1000):
            some = words[at : at + 1000]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            count = np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1)
            if len(count) != len(some):
                ids, count = self._each(some)
            flat.append(ids)
            counts.append(count)
        return np.concatenate(flat or [np.zeros(0, "<u4")]), np.concatenate(counts or [np.zeros(0, np.int64)])

    def learn(self, fresh: pa.Array) -> None:
        """Remembers chunks: each is a word of letters and a mark or nothing, or is asked for as it is."""
        known_marks = pa.array(list(self.MARKS))
        tail, head = pc.utf8_slice_codeunits(fresh, -1), pc.utf8_slice_codeunits(fresh, 0, -1)
        cut = pc.and_(pc.is_in(tail, known_marks), pc.utf8_is_alpha(head))
        coded = pc.if_else(cut, head, fresh).dictionary_encode()
        heads, head = coded.dictionary, coded.indices.to_numpy()
        alpha = pc.utf8_is_alpha(heads)
        letters = alpha.to_numpy(zero_copy_only=False)
        words, odd = self._words(heads.filter(alpha).to_pylist()), self._each(heads.filter(pc.invert(alpha)).to_pylist())
        marks = self._each(list(self.MARKS))
        flat = np.concatenate([words[0], odd[0], marks[0]])
        count = np.concatenate([words[1], odd[1], marks[1], [0]])
        first = np.cumsum(count) - count
        place = np.empty(len(heads), np.int64)
        place[letters] = np.arange(letters.sum())
        place[~letters] = letters.sum() + np.arange((~letters).sum())
        mark = len(heads) + pc.if_else(cut, pc.index_in(tail, known_marks), len(self.MARKS)).to_numpy(zero_copy_only=False).astype(np.int64)
        both = np.column_stack([place[head], mark]).reshape(-1)
        total = count[both].reshape(-1, 2).sum(axis=1)
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(total) - total])
        self.count = np.concatenate([self.count, total])
        self.flat = np.concatenate([self.flat, _gather(flat, first[both], count[both])])
        self.known = pa.concat_arrays([self.known, fresh])

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts one after the other, each with the end behind it, and how many each text has."""
        # A string of a special token must stay as it is; else small letters of ASCII commute with the other rules.
        special, plain = pc.match_substring(texts, "<|"), pc.ascii_lower(texts)
        if pc.any(special).as_py():
            plain = pa.array([t if keep else low for t, keep, low in zip(texts.to_pylist(), special.to_pylist(), plain.to_pylist(), strict=True)], pa.string())
        lists = pc.split_pattern(pc.replace_substring(plain, "\n", " "), " ")
        chunks = lists.flatten()
        places = pc.index_in(chunks, self.known)
        if places.null_count:
            fresh = chunks.filter(places.is_null()).unique()
            if len(self.known) + len(fresh) > self.most:
                self.forget()
                fresh = chunks.unique()
            self.learn(fresh)
            places = pc.index_in(chunks, self.known)
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        at = np.insert(places.to_numpy(), ends, 0)
        count = self.count[at]
        after = np.cumsum(count)
        return _gather(self.flat, self.first[at], count), np.diff(after[ends + np.arange(len(ends))], prepend=0)


_CHUNK_IDS: dict[str, ChunkIds] = {}  # one a worker and vocabulary


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE_BYTES together; a longer text is alone."""
    first = total = 0
    for i, size in enumerate(sizes.tolist()):
        if i > first and total + size > SLICE_BYTES:
            yield first, i
            first, total = i, 0
        total += size
    if len(sizes):
        yield first, len(sizes)


def _cut(path: str, window: int, quantum: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        if path not in _CHUNK_IDS:
            _CHUNK_IDS[path] = ChunkIds(path)
        chunks, part, ranks = _CHUNK_IDS[path], TaskContext.get().partitionId(), np.zeros(-(-window // quantum) + 1, np.int64)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for low, high in _slices(pc.binary_length(texts).to_numpy(zero_copy_only=False)):
                ids, total = chunks.of(texts.slice(low, high - low))
                pieces = -(-total // window)
                of = np.repeat(np.arange(len(total)), pieces)
                start = (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
                length = np.minimum(window, total[of] - start)
                level = -(-length // quantum)
                rank = np.empty(len(of), np.int64)  # among the pieces of its level in this task
                order = np.argsort(level, kind="stable")
                counts = np.bincount(level, minlength=len(ranks))
                rank[order] = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(ranks, counts)
                ranks += counts
                ends = np.concatenate([[0], np.cumsum(length)]) * 4  # pieces lie one after the other, as the ids do
                binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(of), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())
                kept = [c.slice(low, high - low).take(pa.array(of)) for c in batch.columns[:-1]]
                columns = [pa.array(start), pa.array(length), pa.array(total[of]), binary, pa.array(level.astype(np.int32)), pa.array(np.full(len(of), part, np.int32)), pa.array(rank)]
                yield pa.RecordBatch.from_arrays([*kept, *columns], [*batch.schema.names[:-1], "start", "length", "doc_tokens", "ids", "_level", "_part", "_rank"])
            give_back()

    return run


def cut_pieces(df: DataFrame, vocabulary: str, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), window: int = 2048, quantum: int = 8) -> DataFrame:
    """Documents as pieces of at most `window` tokens: the columns in `carry`, start, length, doc_tokens, ids and where the piece counts.

    A document is its ids (`ids`: little-endian unsigned 32-bit, as binary) and the end id;
    a null or empty text is the end id alone. Every id is in exactly one piece. `vocabulary`
    is the path of a tokenizers file that every executor has.
    """
    rows = df.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)], whole(F.col(text_col)).alias("_text"))
    schema = ", ".join([*(f"{n} {t}" for n, t in rows.dtypes[:-1]), "start long, length long, doc_tokens long, ids binary, _level int, _part int, _rank long"])
    return rows.mapInArrow(_cut(vocabulary, window, quantum), schema).withColumnsRenamed({f"_c{i}": c for i, c in enumerate(carry)})


def combinations(levels: list[int], full: int, depth: int = 3) -> list[tuple[int, ...]]:
    """Non-decreasing combinations of at most `depth` of the levels that fill a window exactly."""
    known, out = sorted(levels), []

    def grow(head: tuple[int, ...], left: int, first: int) -> None:
        for k in range(first, len(known)):
            size = known[k]
            if size == left:
                out.append((*head, size))
            if size * 2 > left or len(head) + 1 >= depth:
                if len(head) + 1 >= depth:
                    at = bisect.bisect_left(known, left, k)
                    if at < len(known) and known[at] == left and size != left:
                        out.append((*head, left))
                    return
                if size > left:
                    return
                continue
            grow((*head, size), left - size, k)

    grow((), full, 0)
    return sorted(set(out))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2_000) -> np.ndarray:
    """Lawson and Hanson's active-set method: argmin |ax - b| over x >= 0, with at most len(b) positive entries."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    right = a.T @ b
    for _ in range(rounds):
        slope = right - a.T @ (a @ x)
        slope[free] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= 1e-9 * max(1.0, np.abs(right).max()):
            break
        free[best] = True
        while True:
            at = np.flatnonzero(free)
            held = a[:, at]  # products of the free columns only: all of them would take hundreds of megabytes
            s = np.linalg.lstsq(held.T @ held, right[at], rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            down = s <= 0
            step = np.min(x[at][down] / np.maximum(x[at][down] - s[down], 1e-300))
            x[at] += step * (s - x[at])
            free[at[x[at] <= 1e-12]] = False
            x[~free] = 0
    return x


class Plan:
    """Which (level, rank) goes to which sequence and slot, as ranges of ranks."""

    def __init__(self, histogram: dict[int, int], full: int, depth: int = 3):
        self.left, self.next_rank, self.sequences = dict(histogram), defaultdict(int), 0
        self.entries: list[tuple[int, int, int, int]] = []  # level, first rank, first sequence, slot
        self.full = full
        self._solve(depth)
        self._rest()
        self.entries.sort()

    def _place(self, level: int, count: int, sequence: int, slot: int) -> None:
        """One piece of this level into each of `count` sequences from `sequence` on."""
        self.entries.append((level, self.next_rank[level], sequence, slot))
        self.next_rank[level] += count
        self.left[level] -= count

    def _solve(self, depth: int) -> None:
        levels = sorted(k for k, n in self.left.items() if n)
        ways = combinations(levels, self.full, depth)
        if not ways:
            return
        row = {k: i for i, k in enumerate(levels)}
        a = np.zeros((len(levels), len(ways)))
        for j, way in enumerate(ways):
            for level in way:
                a[row[level], j] += 1
        # Rows weigh as much as their length: what counts is how many tokens are left over, not how many pieces.
        weight = np.array(levels, float)
        times = np.rint(nnls(a * weight[:, None], weight * [self.left[k] for k in levels])).astype(int)
        for j in sorted(np.flatnonzero(times), key=lambda j: (-ways[j][-1], -times[j])):  # long pieces have the fewest partners
            need = defaultdict(int)
            for level in ways[j]:
                need[level] += 1
            count = min([int(times[j]), *(self.left[k] // n for k, n in need.items())])
            if count > 0:
                for slot, level in enumerate(ways[j]):
                    self._place(level, count, self.sequences, slot)
                self.sequences += count

    def _rest(self) -> None:
        """Best fit, longest first, on whole groups of sequences with the same room."""
        room: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # room left -> (first sequence, count, slots used)
        for level in sorted((k for k, n in self.left.items() if n), reverse=True):
            while self.left[level]:
                size = min((r for r, groups in room.items() if r >= level and groups), default=None)
                if size is None:
                    size, first, count, used = self.full, self.sequences, -(-self.left[level] // (self.full // level)), 0
                    self.sequences += count
                else:
                    first, count, used = room[size].pop()
                each = size // level
                whole_ = min(count, self.left[level] // each)
                rest = min(self.left[level] - whole_ * each, each - 1) if whole_ < count else 0
                for slot in range(each if whole_ else 0):
                    self._place(level, whole_, first, used + slot)
                if whole_:
                    room[size - each * level].append((first, whole_, used + each))
                for slot in range(rest):
                    self._place(level, 1, first + whole_, used + slot)
                if rest:
                    room[size - rest * level].append((first + whole_, 1, used + rest))
                untouched = count - whole_ - (1 if rest else 0)
                if untouched:
                    room[size].append((first + whole_ + (1 if rest else 0), untouched, used))


def _slots(plan: Plan):
    keys = np.array([(level << 40) + rank for level, rank, _, _ in plan.entries] or [0], dtype=np.int64)
    ranks, firsts, slots = (np.array([e[k] for e in plan.entries] or [0], dtype=np.int64) for k in (1, 2, 3))

    @F.pandas_udf("sequence_id long, _slot long")
    def slots_of(level: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, (level.to_numpy(np.int64) << 40) + rank.to_numpy(np.int64), side="right") - 1
        return pd.DataFrame({"sequence_id": firsts[at] + rank.to_numpy(np.int64) - ranks[at], "_slot": slots[at]})

    return slots_of


def pack(pieces: DataFrame, window: int = 2048, quantum: int = 8, depth: int = 3) -> DataFrame:
    """Adds sequence_id and offset to the pieces that cut_pieces gave; other columns come along.

    Lengths count in steps of `quantum` tokens. The histogram over all pieces (at most
    window / quantum rows) goes to the driver, which enumerates the combinations of at most
    `depth` lengths that fill a window, solves for their repeat counts by non-negative least
    squares, rounds, and packs what is left greedily: a plan of ranges of ranks, whose size
    depends on the number of lengths alone. Pieces find their place in it by their rank
    among those of their length, from counts per task, so no length gathers in one task.
    A sequence's pieces lie gapless from offset 0, padding behind them.
    """
    pieces = written(pieces, "packing-pieces")
    counts = written(pieces.groupBy("_part", "_level").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    histogram = {r["_level"]: r["n"] for r in counts.groupBy("_level").agg(F.sum("n").alias("n")).collect()}
    plan = Plan(histogram, window // quantum, depth)
    starts = counts.withColumn("_before", F.sum("n").over(Window.partitionBy("_level").orderBy("_part")) - F.col("n")).drop("n")
    placed = pieces.join(starts, ["_part", "_level"]).withColumn("_s", _slots(plan)("_level", F.col("_before") + F.col("_rank")))
    placed = placed.withColumn("sequence_id", F.col("_s.sequence_id")).withColumn("_slot", F.col("_s._slot"))
    before = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)  # at most `window` pieces
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("_part", "_level", "_rank", "_before", "_s", "_slot")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed_rows(docs: DataFrame) -> DataFrame:
    """The query's columns for a table of documents."""
    pieces = cut_pieces(docs, vocabulary_path()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset."""
    return packed_rows(table(spark, sf_dir, "documents"))

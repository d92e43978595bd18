"""Toxicity by compression distance: zstandard dictionaries of ordinary and of toxic text."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid.llm.common import give_back, table, whole, written

LOW, HIGH = -16, 48  # saved bytes beyond these count as these
SAMPLE_WORDS = 4  # words of a run in the ordinary dictionary


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 3: 1 is held out, 2 is held out while the thresholds are set."""
    return (F.crc32(doc_id.cast("string")) % 3).cast("int")


@dataclass
class Model:
    """Two raw dictionaries, what a window's saving is worth, and the weights of (sum, log(1+windows), 1)."""

    ordinary: bytes
    toxic: bytes
    worth: list[float] = field(default_factory=lambda: [0.0] * (HIGH - LOW + 1))
    weights: tuple[float, float, float] = (1.0, 0.0, 0.0)
    window: int = 8
    level: int = 12


def windows(text: str, size: int) -> list[bytes]:
    """Lower-cased runs of `size` words, over the whole text; a run that comes again is no new evidence.

    Runs much shorter than eight words are often stored uncompressed by both dictionaries,
    which hides what the toxic one would save.
    """
    words = text.lower().split()
    return list(dict.fromkeys(f" {' '.join(words[i : i + size])} ".encode("utf-8", "replace") for i in range(0, len(words), size)))


class Distance:
    """How many bytes the toxic dictionary saves on each different window of a text, against the ordinary one."""

    def __init__(self, model: Model):
        self.size = model.window
        self.plain, self.toxic = (self._compressor(content, model.level) for content in (model.ordinary, model.toxic))

    @staticmethod
    def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
        known = zstandard.ZstdCompressionDict(content or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False)

    def saved(self, text: str) -> np.ndarray:
        saved = [len(self.plain.compress(w)) - len(self.toxic.compress(w)) for w in windows(text, self.size)]
        return np.clip(np.array(saved, dtype=np.int64), LOW, HIGH)


def _mapped(model: Model, of_text):
    """Replaces the text in the second column by of_text(distance, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(model)
        for batch in batches:
            values, kind = [of_text(distance, t.as_py() or "") for t in batch.column(1)], of_text.kind
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, kind), *batch.columns[2:]], [batch.schema.names[0], "value", *batch.schema.names[2:]])

    return run


def _savings(distance: Distance, text: str) -> list[int]:
    return distance.saved(text).tolist()


_savings.kind = pa.list_(pa.int32())


def _scorer(model: Model):
    worth, (a, b, c) = np.array(model.worth), model.weights

    def score(distance: Distance, text: str) -> float:
        saved = distance.saved(text)
        return float(1 / (1 + math.exp(-max(-700.0, min(700.0, a * worth[saved - LOW].sum() + b * math.log1p(len(saved)) + c)))))

    score.kind = pa.float64()
    return score


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1, higher: likelier toxic) of every row; null or empty text gets the score of no evidence.

    Each row is scored alone and as a whole, so ties, repeated rows, null ids and other columns play no part.
    """
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("_id"), F.col(text_col)).mapInArrow(_mapped(model, _scorer(model)), f"_id {kind}, value double").select(F.col("_id").alias(id_col), F.col("value").alias("score"))


def with_score(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All rows and columns of `df`, and their score; a column called `score_col` is replaced."""
    df = df.drop(score_col)
    scorer = _scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(model)
        for batch in batches:
            scores = [scorer(distance, t.as_py() or "") for t in batch.column(batch.schema.get_field_index(text_col))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, score_col])
        give_back()

    schema = df.select("*", F.lit(0.0).alias(score_col)).schema
    return df.mapInArrow(run, schema)


def _ordinary_content(samples: list[str], size: int) -> bytes:
    data = [f" {s} ".encode() for s in samples]
    if sum(map(len, data)) > 20 * size:
        try:
            return zstandard.train_dictionary(size, data, level=3).as_bytes()[-size:]
        except zstandard.ZstdError:  # too uniform to train on
            pass
    return b"".join(data)[-size:]


def _rising(counts: np.ndarray) -> list[float]:
    """Log ratio of toxic to ordinary windows by saving (columns of counts), pooled until it never falls."""
    rate = (counts.sum(axis=1) + 1.0)[:, None]
    pools = [[(t + 0.5) / rate[1, 0], (o + 0.5) / rate[0, 0], 1] for o, t in counts.T]
    out: list[list[float]] = []
    for pool in pools:
        out.append(pool)
        while len(out) > 1 and out[-2][0] * out[-1][1] >= out[-1][0] * out[-2][1]:
            t, o, n = out.pop()
            out[-1] = [out[-1][0] + t, out[-1][1] + o, out[-1][2] + n]
    return [math.log(t / o) for t, o, n in out for _ in range(int(n))]


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps."""
    beta, ridge = np.zeros(x.shape[1]), np.diag([1e-3] * x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (y - p)) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _cuts(text: Column, k: int) -> Column:
    """All strings of k characters in a text."""
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - (k - 1)))
    return F.filter(F.transform(at, lambda i: F.substring(text, i, F.lit(k))), lambda s: F.length(s) == k)


def _telling(rows: DataFrame, false_grams: float, max_bytes: int) -> bytes:
    """Strings of 5 to 8 characters from words of toxic texts that ordinary texts hardly have, the most telling last.

    Words are counted once a text and copies of a text once; strings are counted over the
    distinct words. In toxic texts a word counts no more often than it has different words
    before it: near copies repeat a word behind the same one, so that what they share is no
    evidence many times over. A string is telling when four in five of its words are in toxic texts and
    its log-likelihood ratio is so large that chance would give `false_grams` such strings.
    """
    texts = rows.dropDuplicates(["_text"])
    size = {r["_y"]: r["n"] for r in texts.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not size.get(1) or not size.get(0):
        return b""
    every = texts.select("_y", F.regexp_extract_all(F.lower("_text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("words"))
    words = every.select("_y", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.sum("_y").alias("n1"), F.sum(1 - F.col("_y")).alias("n0"))
    pairs = every.filter("_y = 1").select(F.concat(F.array(F.lit("")), "words").alias("before"), "words").select(F.inline(F.array_distinct(F.arrays_zip("words", "before"))).alias("word", "before"))
    places = pairs.filter("word IS NOT NULL").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("places"))
    words = words.join(places, "word", "left").select("word", F.least("n1", F.coalesce("places", F.lit(0))).alias("n1"), "n0")
    framed = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    cuts = [_cuts(framed, k) for k in (5, 6, 7, 8)]
    grams = words.select("n1", "n0", F.explode(F.array_distinct(F.concat(*cuts))).alias("gram")).groupBy("gram").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    grams = written(grams.filter("n1 >= 2"), "toxicity-grams")
    share = size[1] / (size[1] + size[0])
    part = F.col("n1") / (F.col("n1") + F.col("n0"))
    ratio = F.col("n1") * F.log(part / share) + F.when(F.col("n0") > 0, F.col("n0") * F.log((1 - part) / (1 - share))).otherwise(0.0)
    least = math.log(max(1.0, grams.count() / false_grams))
    found = grams.filter((part >= 0.8) & (ratio > least)).orderBy(F.desc(F.round(ratio, 6)), F.desc(F.length("gram")), "gram").limit(20 * max_bytes).select("gram").collect()
    content: list[str] = []
    joined, used = "", 0
    for (gram,) in found:
        if gram not in joined and used + len(gram.encode()) <= max_bytes:
            content.append(gram)
            joined, used = f"{joined}{gram}\n", used + len(gram.encode())
    return "".join(reversed(content)).encode()


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = 10_000, max_ordinary: int = 20_000, content_bytes: int = 32_000, toxic_bytes: int = 4_000, samples: int = 12_000, false_grams: float = 10.0) -> Model:
    """A model learned from labelled rows whose fold is not 1.

    At most `max_toxic` and `max_ordinary` of them, chosen by a hash of the id, are read
    (whole texts): a documented bound on labelled rows, the only sample that the model
    knows. Of the ordinary ones' runs of SAMPLE_WORDS words `samples`, chosen by hash, make the ordinary dictionary
    of `content_bytes`; of strings that are telling of toxic texts the `toxic_bytes` most
    telling make the toxic one. Savings beyond LOW and HIGH count as these. Toxic
    text is mostly ordinary words too, so the toxic dictionary shares that content but for
    its first part, which gives way to what is telling of toxic texts: the two differ on
    nothing else. Dictionaries of fold 0, tried on fold 2, set what a saving of each size
    is worth and the weights, at the share of toxic rows among all labels; the final
    dictionaries then come from both folds. Null labels and ids are left out; an id
    labelled twice counts as toxic if one of its labels does. With no labels of one class
    every text scores 0.5 or less.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_y")).filter("_id IS NOT NULL AND _y IN (0, 1)").withColumn("_fold", fold(F.col("_id"))).filter("_fold <> 1")
    share = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not share.get(1) or not share.get(0):
        return Model(b" ", b" ", weights=(0.0, 0.0, 0.0 if share.get(1) else -3.0))
    picked = known.filter("_y = 1").orderBy(F.xxhash64("_id"), "_id").limit(max_toxic).unionByName(known.filter("_y = 0").orderBy(F.xxhash64("_id"), "_id").limit(max_ordinary))
    picked = picked.groupBy("_id", "_fold").agg(F.max("_y").alias("_y"))  # at most max_toxic + max_ordinary rows
    texts = docs.select(F.col("doc_id").alias("_id"), whole(F.col("text")).alias("_text"))
    rows = written(texts.join(F.broadcast(picked), "_id").repartition(24), "toxicity-labelled")

    split = F.split(F.lower("_text"), r"\s+")
    # The words are bound by the outer lambda, so that a text is split once and not once a window.
    runs = F.transform(F.array(split), lambda w: F.transform(F.sequence(F.lit(1), F.size(w), F.lit(SAMPLE_WORDS)), lambda i: F.array_join(F.slice(w, i, SAMPLE_WORDS), " ")))
    each = rows.filter("_y = 0").select(F.explode(F.flatten(runs)).alias("window"))
    ordinary = _ordinary_content([r["window"] for r in each.orderBy(F.xxhash64("window"), "window").limit(samples).collect()], content_bytes)

    def model_of(telling: bytes) -> Model:
        return Model(ordinary, telling + ordinary[len(telling) :])

    tried = model_of(_telling(rows.filter("_fold = 0"), false_grams, toxic_bytes))
    held = rows.filter("_fold = 2").select("_y", "_text").mapInArrow(_mapped(tried, _savings), "_y int, value array<int>")
    held = written(held, "toxicity-savings")
    counts = np.zeros((2, HIGH - LOW + 1))
    for y, saved, n in held.select("_y", F.explode("value").alias("v")).groupBy("_y", "v").count().collect():
        counts[y, saved - LOW] = n
    model = model_of(_telling(rows, false_grams, toxic_bytes))
    model.worth = _rising(counts)
    worth = F.array(*[F.lit(float(w)) for w in model.worth])
    total = F.aggregate("value", F.lit(0.0), lambda a, v: a + F.element_at(worth, v + 1 - LOW))
    pairs = held.select("_y", total.alias("s"), F.size("value").alias("n")).toPandas()  # at most the picked rows
    if pairs["_y"].nunique() < 2:
        return model
    y = pairs["_y"].to_numpy(dtype=float)
    x = np.column_stack([pairs["s"], np.log1p(pairs["n"]), np.ones(len(pairs))])
    weight = np.where(y == 1, share[1] / y.sum(), share[0] / (1 - y).sum()) * len(y) / (share[0] + share[1])
    model.weights = tuple(float(v) for v in _logistic(x, y, weight))
    return model


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted (score of at least 0.7); learned from labels of the other folds alone."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))

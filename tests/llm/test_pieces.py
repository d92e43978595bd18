"""The relational lattice against sentencepiece itself in unigram mode, and exact round trips."""

import random
import re

import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from clausegrid.llm.pieces import Vocabulary, assemble, encode, viterbi

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  two  blanks ", "\n", "a\n\nb \n c", "Hello, World! It's 12.5%", "déjà vu größe ñandú", "日本語 テキスト😀 ​", "x" * 450, "word " * 200, "same text", "same text", "\ttab nbsp", "^$ {}|\\ <s> <0x41>"]


@pytest.fixture(scope="module")
def unigram():
    """The best path by the library's lattice over the same pieces and scores, as a unigram model; words come with their own mark.

    It is asked word by word: over a whole text its 32-bit sums lose the small scores
    once a character with a score of -1e9 has been met. Its n-best search is asked, as
    encode() takes a shortcut that gives a worse path for a few words, such as "the".
    """
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(PATH, "rb").read())
    model.trainer_spec.model_type = 1
    model.normalizer_spec.add_dummy_prefix = False
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())

    ours = viterbi(Vocabulary.load(PATH))

    def ids(text):
        words = re.findall("▁*[^▁\n]+|▁+|\n", "▁" + text.replace(" ", "▁"))
        return [i for w in words for i in (ours(w) if len(w) > 200 else library.nbest_encode_as_ids(w.replace("▁", " "), 2)[0])]  # long words have ties

    return ids


def test_ids_are_those_of_the_library_and_texts_come_back(spark, unigram):
    rnd = random.Random(2)
    syllables = "the tion er ing an ré eux über ció ñ lo st and of qu ß".split()
    texts = TEXTS + [" ".join("".join(rnd.choices(syllables, k=rnd.randrange(1, 5))) for _ in range(40)) for _ in range(30)]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "row long, text string, unit string, pos int")
    got = {r.row: (r.ids, r.text) for r in assemble(encode(df, Vocabulary.load(PATH), "row", handed=50), "row").collect()}
    for i, text in enumerate(texts):
        if not text:
            assert i not in got
        else:
            assert got[i] == (unigram(text), text)


def test_the_fold_in_python_is_the_same(unigram):
    path = viterbi(Vocabulary.load(PATH))
    for word in ("thetion", "é" * 40, "😀x", "ab" * 30, "größe"):
        assert path("▁" + word) == unigram(word)


def test_empty_table(spark):
    assert encode(spark.createDataFrame([], "row long, text string"), Vocabulary.load(PATH), "row").count() == 0


def test_merges_give_the_ids_of_the_unmodified_model(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rnd = random.Random(3)
    syllables = "the tion er ing an ré eux über ció ñ lo st and of qu ß".split()
    texts = [t for t in TEXTS if t] + ["Enpaeux", *(" ".join("".join(rnd.choices(syllables, k=rnd.randrange(1, 5))) for _ in range(40)) for _ in range(20))]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").filter("text <> ''").limit(40).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    got = {r.row: (r.ids, r.text) for r in assemble(encode(df, Vocabulary.load(PATH).with_merges(), "row"), "row").collect()}
    assert [got[i] for i in range(len(texts))] == [(library.encode(t), t) for t in texts]


def test_decoding_and_digests_are_those_of_the_unmodified_model(spark):
    import zlib

    import numpy as np
    from clausegrid.llm.pieces import PRIME, decode, encoding_digests

    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [*TEXTS, "lost bytes é", "trailing  ", "y" * 1000 + " " + "ab" * 700]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "row long, text string, n_words int").repartition(3)
    got = {r.row: r for r in encoding_digests(df, Vocabulary.load(PATH).with_merges(), "row", handed=5).collect()}
    words = {r.row: r.w for r in encode(df, Vocabulary.load(PATH).with_merges(), "row").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("w")).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "")
        assert [k for w in words.get(i, ()) for k in w.ids] == ids
        digest = sum((w.pos + 1) * zlib.crc32(np.array(w.ids, "<u4").tobytes()) for w in words.get(i, ())) % PRIME
        assert (got[i].n_pieces, got[i].n_words, got[i].n_chars, got[i].digest, got[i].round_trip) == (len(ids), len(words.get(i, ())), len(text or ""), digest, True)
    broken = spark.createDataFrame([(1, [3 + 0xC3, 3 + 0x28]), (2, None), (2, [])], "row long, ids array<int>")
    assert sorted((r.row, r.decoded) for r in decode(broken, Vocabulary.load(PATH), ("row",)).collect()) == [(1, "\ufffd("), (2, ""), (2, "")]


def test_the_fold_over_the_lattice_gives_the_ids_of_the_unmodified_model(spark):
    from clausegrid.llm.pieces import BLOCK, lattice

    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rnd = random.Random(5)
    syllables = "the tion er ing an ré eux über ció ñ lo st and of qu ß aa aaa".split()
    words = {"".join(rnd.choices(syllables, k=rnd.randrange(1, 20)))[: BLOCK - 1] for _ in range(400)} | {"a" * 61, "a" * 62, "b" * 63, "ing" * 21, "Enpaeux"}
    units = spark.createDataFrame([("▁" + w, 1, "▁" + w) for w in words], "key string, n long, unit string")
    got = {r.key[1:]: r.ids for r in lattice(units, Vocabulary.load(PATH).with_merges()).collect()}
    assert got == {w: library.encode(w) for w in words}
    assert {len(w) + 1 for w in words} >= {BLOCK - 2, BLOCK - 1, BLOCK}

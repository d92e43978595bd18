"""Toxicity: held-out accuracy on made-up texts, and odd input."""

import random
import zlib

from clausegrid.llm.toxicity import _telling, fit, score, with_score


def corpus(n=600):
    rnd = random.Random(8)
    words = ["".join(rnd.choices(["ka", "lo", "mi", "ter", "sun", "ble", "or", "est", "ion", "pra"], k=rnd.randrange(1, 5))) for _ in range(500)]
    bad = ["zwugglig", "hexkropf", "vyrmdreck", "qualmnase", "snotjuck"]
    docs, labels = [], []
    for i in range(n):
        text, toxic = rnd.choices(words, k=rnd.randrange(30, 120)), i % 5 == 0
        for _ in range(rnd.randrange(4, 9) if toxic else 0):
            text.insert(rnd.randrange(len(text)), rnd.choice(bad) + rnd.choice(["", ".", ","]))
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus()
    odd = [(1000, None), (1001, ""), (1002, "x" * 200_000), (None, "zwugglig hexkropf " * 20), (5, docs[5][1])]
    labelled = spark.createDataFrame([*labels, (None, 1), (7, None), (1003, 1), labels[0]], "doc_id long, toxic int")
    table = spark.createDataFrame([*docs, *odd], "doc_id long, text string")
    model = fit(table, labelled)
    rows = score(table, model).collect()
    assert len(rows) == len(docs) + len(odd) and all(0 <= r.score <= 1 for r in rows)
    toxic = dict(labels)
    held = [r for r in rows if r.doc_id in toxic and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    right = sum((r.score >= 0.7) == bool(toxic[r.doc_id]) for r in held)
    assert len(held) > 150 and right / len(held) >= 0.95
    assert [r.score >= 0.7 for r in rows if r.doc_id is None] == [True]
    assert all(r.score < 0.7 for r in rows if r.doc_id in (1000, 1001, 1002))
    assert with_score(table, model).columns == ["doc_id", "text", "score"]


def test_without_labels_or_rows(spark):
    docs, labels = corpus(20)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    none = fit(table, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.score <= 0.5 for r in score(table, none).collect())
    one = fit(table, spark.createDataFrame([(i, 0) for i, _ in labels], "doc_id long, toxic int"))
    assert all(r.score <= 0.5 for r in score(table, one).collect())
    assert score(table.limit(0), none).count() == 0


def test_near_copies_are_no_evidence_many_times_over(spark):
    rnd = random.Random(4)
    docs, _ = corpus(240)
    rows = [(" ".join(w for w in text.split() if not w.startswith(("zwugg", "hexk", "vyrm", "qualm", "snotj"))), 0) for _, text in docs]
    copied = " ".join("".join(rnd.choices("bdfghjklmnpqrstvwxyz", k=9)) for _ in range(60))
    rows += [(f"{copied} {i}", 1) for i in range(40)]
    rows += [(f"{text} zwugglig {text}", 1) for text, _ in rows[:40]]
    found = _telling(spark.createDataFrame(rows, "_text string, _y int"), 10.0, 4000).decode()
    assert "zwuggli" in found
    assert not any(word[:8] in found for word in copied.split())


def test_a_run_repeated_in_a_text_is_evidence_once(spark):
    docs, labels = corpus()
    model = fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    run = "sun ble or est ion pra ka zwugglig "
    rows = spark.createDataFrame([(0, run), (1, run * 200)], "doc_id long, text string")
    once, often = (r.score for r in score(rows, model).orderBy("doc_id").collect())
    assert once == often

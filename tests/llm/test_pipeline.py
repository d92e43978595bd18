"""The pipeline's stages on a small table with planted cases."""

import random

import corpus_pipeline
from clausegrid.llm.near_dedup import near_duplicates

SF = "/root/testdata/sf0.001"


def test_stages_keep_clean_documents_and_act_on_planted_ones(spark):
    rnd = random.Random(1)
    words = [a + b for a in ("kal", "mor", "tis", "ven", "dru", "sol") for b in ("an", "eb", "ir", "ok", "um", "est", "ing")]
    own = lambda n: " ".join(rnd.choices(words, k=n))
    rows = [(i, own(80) + ("\nThis notice stands on every page of this site\n" if i % 2 else "\n") + own(40), "en", "s", None) for i in range(40)]
    rows += [(100 + i, rows[0][1], "en", "s", None) for i in range(3)]
    rows += [(200, own(60) + " write to jo.doe@mail.example.com or +1 (543) 555-9258 soon", "en", "s", 1), (300, None, None, None, None), (301, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lined = corpus_pipeline.line_dedup(spark, docs, SF)
    texts = {r.doc_id: r.text for r in lined.collect()}
    assert set(texts) == {r[0] for r in rows} and not any("This notice" in t for t in texts.values())
    one = corpus_pipeline.near_dedup(spark, lined, SF)
    ids = [r.doc_id for r in one.collect()]
    assert len(ids) == len(set(ids)) and len(set(ids) & {0, 100, 101, 102}) == 1 and set(range(1, 40)) | {200} <= set(ids) and len(set(ids) & {300, 301}) == 1
    assert near_duplicates(one).filter("class_size > 1").isEmpty()
    clean = {r.doc_id: r for r in corpus_pipeline.pii(spark, one, SF).collect()}
    assert clean[200].text.endswith(" write to <EMAIL> or <PHONE> soon") and clean[200].n_chars == len(clean[200].text)
    packed = corpus_pipeline.packing(spark, corpus_pipeline.pii(spark, one, SF), SF).collect()
    assert {r.doc_id for r in packed} == set(ids)
    for stage in (lined, one):
        assert stage.columns == list(corpus_pipeline.COLUMNS)


def test_toxicity_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.toxicity(spark, docs, SF)
    assert 0.8 * docs.count() <= kept.count() <= docs.count() and kept.columns == list(corpus_pipeline.COLUMNS)


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "pii", "packing"]

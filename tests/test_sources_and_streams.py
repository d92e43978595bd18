"""Files, event lines, and that streamed folds equal the batch ones."""

import io
import zipfile

from pyspark.sql import functions as F

from clausegrid.plans import inputs as I
from clausegrid.plans.catalog import run_events
from clausegrid.sources import event_lines as L
from clausegrid.sources.files import parse_files, read_files
from clausegrid.streaming import folds as S

SF = "/root/testdata/sf0.001"


def docx(path):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("One") + p(" ") + f"<w:tbl><w:tr>{cell('a ')}{cell('b')}</w:tr></w:tbl>" + p("Two")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    path.write_bytes(out.getvalue())


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("café\r\nx".encode())
    (tmp_path / "b.MD").write_bytes("café".encode("latin-1"))
    (tmp_path / "c.txt").write_bytes("hi".encode("utf-16"))
    (tmp_path / "d.txt").write_bytes(b"  ")
    (tmp_path / "e.xyz").write_bytes(b"x")
    (tmp_path / "g.docx").write_bytes(b"broken")
    docx(tmp_path / "f.docx")
    got = {r.path.rsplit("/", 1)[1]: r for r in parse_files(read_files(spark, str(tmp_path))).collect()}
    assert (got["a.txt"].text, got["b.MD"].text, got["c.txt"].text) == ("café\nx", "café", "hi")
    assert got["f.docx"].text == "One\nTwo\na | b" and got["f.docx"].word_count == 5 and got["f.docx"].page_count == 1
    assert all(got[n].text is None and got[n].error for n in ("d.txt", "e.xyz", "g.docx"))


def test_event_lines_round_trip(spark):
    record = F.struct(F.lit("result").alias("type"), F.lit("S").alias("stage"), F.col("v").alias("message"), F.lit(5).alias("progress"))
    lines = spark.createDataFrame([("a",), ('q"uote',)], "v string").select(F.explode(F.split(L.to_sse(record), "\n")).alias("value"))
    assert sorted(r.event.message for r in L.from_sse(lines).collect()) == ["a", 'q"uote']


def run(stream, name, mode):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()


def test_streamed_run_fold_is_the_batch_fold(spark, tmp_path):
    events = I.table(spark, SF, "events")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(S.run_totals(run_events(stream)), "runs", "complete")
    assert {tuple(r) for r in spark.table("runs").collect()} == {tuple(r) for r in S.run_totals(run_events(events)).collect()}


def test_an_abort_outranks_what_comes_later(spark, tmp_path):
    schema = "run_id string, type string, conflict boolean, severity string"
    batches = [[("a", "result", True, "High"), ("b", "error", None, None)], [("a", "abort", None, None), ("b", "complete", None, None)], [("a", "complete", None, None), ("a", "result", None, "Error")]]
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    run(S.run_totals(stream), "aborted", "complete")
    assert {tuple(r) for r in spark.table("aborted").collect()} == {("a", 2, 1, 1, "aborted"), ("b", 0, 0, 0, "failed")}


def test_streamed_windows_are_the_batch_windows(spark, tmp_path):
    events = I.table(spark, SF, "events")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run(S.windowed_counts(stream, late="2 days"), "windows", "complete")
    assert {tuple(r) for r in spark.table("windows").collect()} == {tuple(r) for r in S.windowed_counts(events).collect()}


def test_streamed_chat_metrics_are_the_batch_metrics(spark, tmp_path):
    rows = [("a", 1, "Hi", 1.0), ("a", 2, None, 2.0), ("a", 3, " you", 3.5), ("b", 1, None, 1.0), ("b", 2, "x", 1.0)]
    schema = "k string, n int, token string, at double"
    for k in (1, 0):  # later chunks come first
        spark.createDataFrame(rows[k::2], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    from clausegrid.operators import chat

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*").withColumn("start", F.lit(0.5))
    run(chat.token_metrics(stream, "k", "n", "token", "at", "start"), "chats", "complete")
    want = chat.token_metrics(spark.createDataFrame(rows, schema).withColumn("start", F.lit(0.5)), "k", "n", "token", "at", "start")
    assert sorted(map(tuple, spark.table("chats").collect())) == sorted(map(tuple, want.collect())) and want.count() == 2


def test_chat_events(spark):
    from clausegrid.operators import chat

    rows = [("a", 1, "Hi", 1.0, None), ("a", 2, None, 2.0, None), ("a", 3, " you", 3.0, None), ("b", 1, "x", 1.0, None), ("b", 2, None, 2.0, "timed out"), ("b", 3, "late", 3.0, None), ("c", 1, None, 1.0, "no model"), ("d", 1, None, 2.0, None)]
    df = spark.createDataFrame(rows, "k string, n int, token string, at double, error string").withColumn("start", F.lit(0.0))
    got = chat.events(df, "k", "n", "token", "at", "start", "error").collect()
    assert sorted((r.k, r.seq, r.type, r.content, r.time_to_first_token, r.total_tokens, r.total_time) for r in got) == [
        ("a", 0, "metric", None, 1.0, None, None), ("a", 1, "token", "Hi", None, None, None), ("a", 2, "token", " you", None, None, None), ("a", 3, "complete", "Hi you", 1.0, 2, 3.0),
        ("b", 0, "metric", None, 1.0, None, None), ("b", 1, "token", "x", None, None, None), ("b", 2, "error", "timed out", None, None, None), ("c", 0, "error", "no model", None, None, None), ("d", 0, "complete", "", 2.0, 0, 2.0),
    ]


def test_encodings_in_order():
    from clausegrid.sources.files import decode_in_order

    assert [decode_in_order("é".encode(e)) for e in ("utf-8", "utf-16")] == ["é", "é"]
    assert decode_in_order(b"caf\xe9") == "\u6163\ue966" and decode_in_order(b"\xe9") == "é"

"""A mixed folder through the data source and Spark's own readers."""

import json

from clausegrid.sources import folder as D


def shout(data):
    return data.decode().upper()


def test_mixed_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    files = {"a.txt": b"Plain text\r\n", "sub/b.HTML": b"<title>T</title><script>x</script><p>One &amp; <b>two</b></p><p>three", "c.docx": b"broken", "d.xyz": b"hello", "e.txt": b"  \n", "f.bin": b"\x00", "_skip.txt": b"no", "g": b"none"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    D.register(spark, "docs", {".xyz": shout})
    df = spark.read.format("docs").option("partitionbytes", 10).load(str(tmp_path))
    got = {r.path.rpartition("/")[2]: (r.parser, r.text, r.error is not None) for r in df.collect()}
    assert got == {
        "a.txt": ("txt", "Plain text\r\n", False), "b.HTML": ("html", "T\nOne & two\nthree", False), "c.docx": ("docx", None, True), "d.xyz": ("shout", "HELLO", False),
        "e.txt": ("txt", None, True), "f.bin": (None, None, True), "g": (None, None, True),
    }
    assert df.rdd.getNumPartitions() > 3
    assert spark.read.format("docs").option("largestfile", 5).load(f"file://{tmp_path}").filter("text IS NOT NULL").count() == 1


def test_empty_folder(spark, tmp_path):
    D.register(spark, "docs_none")
    assert spark.read.format("docs_none").load(str(tmp_path)).count() == 0


def test_records(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n1,"two, three"\n4,\n')
    (tmp_path / "y.csv").write_text("c\nz\n")
    (tmp_path / "z.json").write_text('{"k": [1, 2]}\n{"m": {"n": "é"}}\n')
    got = sorted((r.path.rpartition("/")[2], r.kind, json.dumps(json.loads(r.record), sort_keys=True)) for r in D.read_records(spark, str(tmp_path)).collect())
    assert got == [("x.csv", "csv", '{"a": 1, "b": "two, three"}'), ("x.csv", "csv", '{"a": 4, "b": null}'), ("y.csv", "csv", '{"c": "z"}'), ("z.json", "json", '{"k": [1, 2]}'), ("z.json", "json", '{"m": {"n": "\\u00e9"}}')]

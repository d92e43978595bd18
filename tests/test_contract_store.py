"""The stored tables: whole commits or none, repeated runs, faults, and files in to tables out."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from clausegrid.operators import contracts as K, ingest as G
from clausegrid.sources.contract_store import ORDER, ContractStore, Conflict
from clausegrid.sources.files import read_files



def at(day):
    return F.lit(day).cast("timestamp_ntz")


NOW, LATER = "2024-01-01", "2025-01-01"
LONG = "1. Scope\n" + ("The supplier delivers the goods to the site of the buyer. " * 3).strip() + "\na) first part\n2. Price\nIt is fixed."


def made(spark, *ids):
    rows = [(i, f"/in/{i}.txt", 10, LONG, '["Acme", "Beta"]') for i in ids] + [("bad", "/in/b.exe", 10, LONG, None)]
    return G.ingest(spark.createDataFrame(rows, "id string, path string, size long, text string, answer string"), at(NOW))


def held(store):
    return {name: sorted(map(tuple, df.collect()), key=str) for name, df in store.tables().items()}


@pytest.fixture
def store(spark, tmp_path):
    store = ContractStore(spark, f"file://{tmp_path}/store")
    store.create()
    return store


def test_create_and_drop(spark, store):
    assert store.exists() and [store.read(n).count() for n in ORDER] == [0] * 4
    assert [[(f.name, f.dataType) for f in store.read(n).schema] for n in ORDER] == [[(f.name, f.dataType) for f in s] for s in (K.CONTRACTS, K.VERSIONS, K.PARTIES, K.CLAUSES)]
    store.insert(made(spark, "a"), "r1")
    store.create()  # changes nothing
    assert store.read("contracts").count() == 2
    store.drop()
    assert not store.exists()
    with pytest.raises(ValueError, match="no store"):
        store.read("contracts")


def test_insert_once_and_contracts_that_are_there_stay(spark, store):
    assert store.insert(made(spark, "a", "b"), "r1")
    first = held(store)
    assert [len(first[n]) for n in ORDER] == [3, 2, 4, 6]
    assert not store.insert(made(spark, "a", "b", "c"), "r1") and held(store) == first
    assert store.insert(made(spark, "b", "c"), "r2")
    after = held(store)
    assert [len(after[n]) for n in ORDER] == [4, 3, 6, 9] and all(set(first[n]) <= set(after[n]) for n in ORDER)


def test_what_fails_in_between_is_not_seen(spark, store, monkeypatch):
    store.insert(made(spark, "a"), "r1")
    before = held(store)
    staged = ContractStore._stage

    def fails(self, name, folder, rows):
        staged(self, name, folder, rows)
        if name == "parties":
            raise OSError("disk full")

    with monkeypatch.context() as m:
        m.setattr(ContractStore, "_stage", fails)
        with pytest.raises(OSError):
            store.insert(made(spark, "b"), "r2")
    assert held(store) == before
    assert store.vacuum() == 3  # contracts, versions and parties were staged
    assert store.insert(made(spark, "b"), "r2") and held(store)["contracts"] != before["contracts"]


def test_faults_are_found_where_rows_are_staged(spark, store):
    good = made(spark, "a")
    cases = {
        "contracts.id: 2 values repeat": {"contracts": good["contracts"].union(good["contracts"])},
        "versions.contract_id: 1 rows refer to nothing": {"versions": good["versions"].withColumn("contract_id", F.lit("gone"))},
        "parties.name is null in 2 rows": {"parties": good["parties"].withColumn("name", F.lit(None).cast("string"))},
        "clauses.parent_clause_id: 1 rows refer to nothing": {"clauses": good["clauses"].filter("clause_number <> '1.'")},
    }
    for message, change in cases.items():
        with pytest.raises(ValueError, match=message.replace(".", r"\.")):
            store.insert(good | change, message)
    assert all(not rows for rows in held(store).values())


def test_two_writers(spark, store, monkeypatch):
    other = ContractStore(spark, store.path)
    staged = ContractStore._check

    def slow(self, folder):
        staged(self, folder)
        monkeypatch.setattr(ContractStore, "_check", staged)
        other.insert(made(spark, "b"), "r2")

    monkeypatch.setattr(ContractStore, "_check", slow)
    with pytest.raises(Conflict):
        store.insert(made(spark, "a"), "r1")
    assert sorted(r.id for r in store.read("contracts").collect()) == ["b", "bad"]
    assert store.insert(made(spark, "a"), "r1") and store.read("contracts").count() == 3


def test_update_delete_truncate_compact(spark, store):
    store.insert(made(spark, "a", "b"), "r1")
    store.insert(made(spark, "c"), "r2")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    old = store.read("contracts")
    assert store.update(spark.createDataFrame([("a", "failed", None), ("zz", "failed", "x")], "id string, status string, file_type string"), at(LATER), "u1")
    now = {r.id: (r.status, r.file_type, r.updated_at.year) for r in store.read("contracts").collect()}
    assert now["a"] == ("failed", "txt", 2025) and now["b"] == ("completed", "txt", 2024) and len(now) == 4
    assert {r.status for r in old.filter("id = 'a'").collect()} == {"completed"}  # a frame reads what it was made of
    assert store.delete(ids("a", "nobody"), "d1") and not store.delete(ids("b"), "d1")
    for name in ORDER:
        assert "a" not in {r[0] for r in store.read(name).select("id" if name == "contracts" else "contract_id").collect()}
    before = held(store)
    assert store.compact("k1") and held(store) == before
    assert store.vacuum() > 0 and held(store) == before
    assert store.delete(ids("nobody"), "d2") and held(store) == before
    assert store.truncate("t1") and all(not rows for rows in held(store).values())
    assert store.insert(made(spark, "a"), "r3") and len(held(store)["contracts"]) == 2


def test_files_in_tables_out(spark, store, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "a.txt").write_text("Parties: Acme and Beta.\n" + LONG)
    (inbox / "again.md").write_text(LONG)
    (inbox / "short.txt").write_text("too short")
    (inbox / "broken.docx").write_bytes(b"no archive")
    word = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{line}</w:t></w:r></w:p>" for line in LONG.split("\n"))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {word}><w:body>{body}</w:body></w:document>")
    (inbox / "b.docx").write_bytes(data.getvalue())
    files = read_files(spark, f"file://{inbox}")
    assert G.load(store, files, at(NOW), "load")
    status = {r.original_filename: (r.status, r.error_message) for r in store.read("contracts").collect()}
    assert status.pop("broken.docx")[0] == "failed"
    assert status == {"a.txt": ("completed", None), "again.md": ("failed", "unsupported file type"), "short.txt": ("failed", "too little text"), "b.docx": ("completed", None)}
    names = {r.id: r.original_filename for r in store.read("contracts").collect()}
    assert sorted((names[r.contract_id], r.name) for r in store.read("parties").collect()) == [("a.txt", "Acme"), ("a.txt", "Beta"), ("b.docx", "UNKNOWN PARTY 1"), ("b.docx", "UNKNOWN PARTY 2")]
    assert sorted((names[r.contract_id], r.clause_number) for r in store.read("clauses").collect()) == [(n, c) for n in ("a.txt", "b.docx") for c in ("1.", "2.", "a)")]
    before = held(store)
    assert G.load(store, files, at(LATER), "load again") and held(store) == before

"""The four contract tables as Parquet in a shared folder, changed by whole commits.

Spark writes what a change adds into folders of its own, which nobody reads yet. A commit is one small file that lists,
for every table, the folders that make it up: renaming it into place changes all four tables at once, or, if
another writer was first, none. A run that fails before leaves nothing that is seen, and a run whose id is
committed already changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clausegrid.operators import contracts as K

SCHEMAS: dict[str, StructType] = {"contracts": K.CONTRACTS, "versions": K.VERSIONS, "parties": K.PARTIES, "clauses": K.CLAUSES}
#: Parents first; what removes rows goes the other way.
ORDER = ("contracts", "versions", "parties", "clauses")
#: Column, table and column that it refers to.
REFERENCES = {"versions": (("contract_id", "contracts"),), "parties": (("contract_id", "contracts"),), "clauses": (("contract_id", "contracts"), ("version_id", "versions"), ("parent_clause_id", "clauses"))}


class Conflict(RuntimeError):
    """Another writer has committed in between: nothing was changed, and the change may be tried again."""


class ContractStore:
    """Contracts, versions, parties and clauses below `path`, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._hadoop = self._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # Definition of the tables

    def create(self) -> None:
        """Creates the four empty tables; does nothing where they are."""
        if self._last() < 0:
            self._commit(0, {"runs": [], "folders": {name: [] for name in ORDER}})

    def drop(self) -> None:
        """Removes the tables, children before parents, and with them the store."""
        self._must_be()
        for name in (*reversed(ORDER), "_commits"):
            self._fs.delete(self._at(name), True)

    def exists(self) -> bool:
        return self._last() >= 0

    # Reading

    def read(self, name: str) -> DataFrame:
        """A table as of the last commit; a later one does not change what this frame reads."""
        folders = self._state()["folders"][name]
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.path}/{name}/{f}" for f in folders])

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.read(name) for name in ORDER}

    # Changes

    def insert(self, tables: dict[str, DataFrame], run_id: str) -> bool:
        """Adds contracts and what belongs to them; False if this run is committed already.

        Contracts that are stored are left as they are, and so is what comes with them. All rows are checked where they
        are staged: ids that are null or repeat, nulls in columns that take none, and references to
        nothing are errors, and then nothing is added.
        """

        def change(folder: str) -> dict[str, tuple[list[str], list[str]]]:
            known = self.read("contracts").select(F.col("id").alias("_known"))
            for name in ORDER:
                key = "id" if name == "contracts" else "contract_id"
                self._stage(name, folder, tables[name].join(known, F.col(key) == F.col("_known"), "left_anti"))
            self._check(folder)
            return {name: ([], [folder]) for name in ORDER}

        return self._run(run_id, change)

    def update(self, patch: DataFrame, now: Column, run_id: str) -> bool:
        """Puts the non-null columns of `patch` (by id) into contracts; changed rows get `now` as updated_at. Other ids are left out."""

        def change(folder: str) -> dict[str, tuple[list[str], list[str]]]:
            hit = self._holding("contracts", patch.select("id"), "id")
            if not hit:
                return {}
            self._stage("contracts", folder, K.update(self._of("contracts", hit), patch, now))
            return {"contracts": (hit, [folder])}

        return self._run(run_id, change)

    def delete(self, ids: DataFrame, run_id: str) -> bool:
        """Removes the contracts in `ids` and whatever belongs to them. Only folders that hold such rows are written anew."""

        def change(folder: str) -> dict[str, tuple[list[str], list[str]]]:
            out = {}
            for name in reversed(ORDER):
                hit = self._holding(name, ids.select("id"), "id" if name == "contracts" else "contract_id")
                if hit:
                    self._stage(name, folder, K.delete({name: self._of(name, hit)}, ids)[name])
                    out[name] = (hit, [folder])
            return out

        return self._run(run_id, change)

    def truncate(self, run_id: str) -> bool:
        """Empties the four tables, children before parents."""
        return self._run(run_id, lambda folder: {name: (self._state()["folders"][name], []) for name in reversed(ORDER)})

    def compact(self, run_id: str) -> bool:
        """Writes each table into one folder, its rows sorted by contract, so that a contract's rows lie in few row groups."""

        def change(folder: str) -> dict[str, tuple[list[str], list[str]]]:
            out = {}
            for name in ORDER:
                key = "id" if name == "contracts" else "contract_id"
                self._stage(name, folder, self.read(name).repartitionByRange(key))
                out[name] = (self._state()["folders"][name], [folder])
            return out

        return self._run(run_id, change)

    def vacuum(self) -> int:
        """Deletes folders that the last commit does not use: older states, and what failed runs left. No other run may be under way."""
        live, gone = self._state()["folders"], 0
        for name in reversed(ORDER):
            at = self._at(name)
            for found in self._fs.listStatus(at) if self._fs.exists(at) else ():
                if found.getPath().getName() not in live[name]:
                    self._fs.delete(found.getPath(), True)
                    gone += 1
        return gone

    # Commits

    def _run(self, run_id: str, change: Callable[[str], dict[str, tuple[list[str], list[str]]]]) -> bool:
        version, state = self._must_be(), self._state()
        if run_id in state["runs"]:
            return False
        done = change(f"run-{uuid.uuid4().hex}")
        folders = {name: [f for f in held if f not in done.get(name, ((), ()))[0]] + list(done.get(name, ((), ()))[1]) for name, held in state["folders"].items()}
        self._commit(version + 1, {"runs": [*state["runs"], run_id], "folders": folders})
        return True

    def _commit(self, version: int, state: dict) -> None:
        draft, final = self._at(f"_commits/.{uuid.uuid4().hex}"), self._at(f"_commits/{version:012d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            context.rename(context.makeQualified(draft), context.makeQualified(final), none)  # fails where the name is taken
        except Exception as error:
            self._fs.delete(draft, False)
            if self._fs.exists(final):
                raise Conflict(f"version {version} is there already") from error
            raise

    def _last(self) -> int:
        at = self._at("_commits")
        names = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith(".")), default=-1)

    def _must_be(self) -> int:
        if (version := self._last()) < 0:
            raise ValueError(f"there is no store at {self.path}")
        return version

    def _state(self) -> dict:
        stream = self._fs.open(self._at(f"_commits/{self._must_be():012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    # Staged rows

    def _stage(self, name: str, folder: str, rows: DataFrame) -> None:
        schema = SCHEMAS[name]
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
        rows.sortWithinPartitions("id" if name == "contracts" else "contract_id").write.parquet(f"{self.path}/{name}/{folder}")

    def _of(self, name: str, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.path}/{name}/{f}" for f in folders])

    def _holding(self, name: str, ids: DataFrame, key: str) -> list[str]:
        """The folders of a table that hold rows of these contracts."""
        folders = self._state()["folders"][name]
        if not folders:
            return []
        rows = self._of(name, folders).select(F.col(key).alias("_key"), F.element_at(F.split(F.input_file_name(), "/"), -2).alias("_folder"))
        return sorted(r["_folder"] for r in rows.join(ids, rows["_key"] == ids["id"], "left_semi").select("_folder").distinct().collect())  # folders only

    def _check(self, folder: str) -> None:
        staged = {name: self._of(name, [folder]) for name in ORDER}
        faults = []
        for name, rows in staged.items():
            must = [f.name for f in SCHEMAS[name] if not f.nullable]
            nulls = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in must]).first().asDict()
            faults += [f"{name}.{c} is null in {n} rows" for c, n in nulls.items() if n]
            if again := rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").count():
                faults.append(f"{name}.id: {again} values repeat")
            for column, other in REFERENCES.get(name, ()):
                there = staged[other].select(F.col("id").alias("_id"))
                if lost := rows.filter(F.col(column).isNotNull()).join(there, F.col(column) == F.col("_id"), "left_anti").count():
                    faults.append(f"{name}.{column}: {lost} rows refer to nothing")
        if faults:
            raise ValueError("; ".join(faults))

"""Stores that are written: rows by key under versions, and deletions across several stores that can be taken up again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.operators.versions import Versions


class KeyedStore:
    """Rows by key in a folder. An upsert adds a part, a deletion the keys that are gone; what was written is never touched.

    Of the rows of a key that of the last part counts, and within an upsert that with the greatest ``order`` (of equal ones any). A reader sees one version, so
    a change is there as a whole or not at all; of two writers at once one is first and the other's change goes on top of it.
    Keys may be null; rows need the store's columns, others are left out.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], schema: str) -> None:
        self.spark, self.keys, self.versions = spark, keys, Versions(spark, root)
        self.empty = spark.createDataFrame([], schema)

    def _added(self, rows: DataFrame, gone: bool) -> int:
        path = self.versions.written(rows.withColumn("_gone", F.lit(gone)), "rows")

        def add(state: dict) -> dict:
            parts = state.get("parts", [])
            return {"parts": [*parts, {"path": path, "number": 1 + max((part["number"] for part in parts), default=0)}]}

        return self.versions.commit(add)

    def upsert(self, rows: DataFrame, order: str | None = None) -> int:
        """Rows that take the place of those with their keys; the new version."""
        columns = [F.col(f"`{c}`") for c in self.empty.columns]
        whole = F.max_by(F.struct(*columns), F.col(f"`{order}`")) if order else F.first(F.struct(*columns))
        return self._added(rows.groupBy(*self.keys).agg(whole.alias("_row")).select("_row.*"), False)

    def delete(self, rows: DataFrame, on: list[str]) -> int:
        """Deletes what agrees with any of these rows in the columns ``on``; how many rows went."""
        wanted = rows.select(*on).distinct()
        same = reduce(lambda a, b: a & b, (F.col(f"mine.{c}").eqNullSafe(F.col(f"theirs.{c}")) for c in on))
        gone = self.read().alias("mine").join(wanted.alias("theirs"), same, "left_semi")
        number = self._added(gone, True)
        return self.spark.read.parquet(self.versions.state(number)["parts"][-1]["path"]).count()

    def swap(self, rows: DataFrame) -> int:
        """These rows instead of all that is there."""
        path = self.versions.written(rows.select(*self.empty.columns).withColumn("_gone", F.lit(False)), "rows")
        return self.versions.commit(lambda _: {"parts": [{"path": path, "number": 1}]})

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, by default the last."""
        return self._read(self.versions.state(number))

    def _read(self, state: dict) -> DataFrame:
        parts = state.get("parts", [])
        if not parts:
            return self.empty
        every = reduce(DataFrame.unionByName, (self.spark.read.parquet(part["path"]).withColumn("_part", F.lit(part["number"])) for part in parts))
        if len(parts) > 1:
            last = F.max_by(F.struct(*(F.col(f"`{c}`") for c in (*self.empty.columns, "_gone"))), "_part")
            every = every.groupBy(*self.keys).agg(last.alias("_row")).select("_row.*")
        return every.where("NOT _gone").select(*self.empty.columns)

    def compacted(self) -> int:
        """One part instead of many; what another writer adds meanwhile stays on top of it."""

        def one(state: dict) -> dict:
            if not state.get("parts"):
                return state
            path = self.versions.written(self._read(state).withColumn("_gone", F.lit(False)), "rows")
            return {"parts": [{"path": path, "number": max(part["number"] for part in state["parts"])}]}

        return self.versions.commit(one)


class Deletions:
    """Deletes documents from several stores, and from the one with their metadata last.

    A journal tells for each deletion which stores are done. A store that fails is reported and keeps no other from it, but the metadata stay, so the documents
    are still known; resumed() goes on with what isn't done. Deleting what is gone already does nothing, so no step harms if it is done twice.
    """

    def __init__(self, spark: SparkSession, root: str, stores: dict[str, KeyedStore], metadata: KeyedStore, key: str = "doc_id") -> None:
        self.spark, self.stores, self.metadata, self.key = spark, stores, metadata, key
        self.journal = Versions(spark, root)

    def _noted(self, name: str, **what) -> None:
        self.journal.commit(lambda state: {**state, name: {**state.get(name, {}), **what}})

    def delete(self, documents: DataFrame) -> DataFrame:
        """Deletes documents (key); (deletion, store, rows, error): what went, or why not."""
        path = self.journal.written(documents.select(self.key).distinct(), "deleted")
        name = path.rpartition("-")[2]
        self._noted(name, path=path, done={})
        return self._gone_on(name)

    def open(self) -> list[str]:
        """Deletions that aren't done."""
        return sorted(name for name, entry in self.journal.state().items() if "metadata" not in entry["done"])

    def resumed(self) -> DataFrame:
        """Goes on with all that aren't done."""
        reports = [self._gone_on(name) for name in self.open()]
        return reduce(DataFrame.unionByName, reports) if reports else self._report([])

    def _gone_on(self, name: str) -> DataFrame:
        entry = self.journal.state()[name]
        ids, done, rows = self.spark.read.parquet(entry["path"]), dict(entry["done"]), []
        for store, where in {**self.stores, "metadata": self.metadata}.items():
            if store in done:
                continue
            if store == "metadata" and set(self.stores) - set(done):
                rows.append((name, store, None, "kept until the others are done"))
                continue
            try:
                done[store] = where.delete(ids, [self.key])
            except Exception as error:  # noqa: BLE001  what fails in one store is part of the report
                rows.append((name, store, None, f"{type(error).__name__}: {error}"[:500]))
                continue
            self._noted(name, done=dict(done))
            rows.append((name, store, done[store], None))
        return self._report(rows)

    def _report(self, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, "deletion string, store string, rows long, error string")


def replaced(documents: DataFrame, deletions: Deletions, new: dict[str, DataFrame]) -> DataFrame:
    """Documents (key) are deleted everywhere and come in anew; the deletion's report. New rows wait until nothing of the old is left."""
    report = deletions.delete(documents)
    if not deletions.open():
        for name, rows in new.items():
            (deletions.metadata if name == "metadata" else deletions.stores[name]).upsert(rows)
    return report


def without_orphans(nodes: KeyedStore, edges: KeyedStore, node: str, ends: tuple[str, str] = ("src", "dst")) -> int:
    """Deletes nodes at no edge; how many."""
    linked = edges.read().select(F.explode(F.array(*ends)).alias(node)).distinct()
    return nodes.delete(nodes.read().join(linked, node, "left_anti"), [node])

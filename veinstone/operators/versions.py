"""Versions of stored data: a folder of immutable parts, and numbered manifests that say which of them count.

A manifest is a small JSON file, <root>/manifests/<number>.json, that is created only if its number is free. So of two writers one is
first, and the other computes its change again on what the first left. Readers see the parts of one manifest, whatever is
written meanwhile. Files go through Hadoop's file systems, so a root may be wherever Spark reads.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer was first, and again after the retry."""


class Versions:
    """state of a version: a dictionary of whatever its owner keeps there, with paths of parts in it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _name(self, number: int):
        return self._path(f"{self.root}/manifests/{number:010d}.json")

    def numbers(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        if not self._files.exists(folder):
            return []
        names = [str(status.getPath().getName()) for status in self._files.listStatus(folder)]
        return sorted(int(name[:10]) for name in names if len(name) == 15 and name.endswith(".json"))

    def latest(self) -> int:
        """The number of the last version; 0 before the first."""
        return max(self.numbers(), default=0)

    def state(self, number: int | None = None) -> dict:
        number = self.latest() if number is None else number
        if number == 0:
            return {}
        for pause in (0.05, 0.2, 1.0, 3.0, 0.0):  # another writer may hold its number and not have closed the file yet
            stream = self._files.open(self._name(number))
            try:
                return json.loads(bytes(stream.readAllBytes()).decode())
            except ValueError:
                time.sleep(pause)
            finally:
                stream.close()
        return self.state(number - 1)  # its writer died: what it had wanted to commit is no version

    def _claimed(self, number: int, state: dict) -> bool:
        """Writes a manifest, unless its number is taken."""
        try:
            stream = self._files.create(self._name(number), False)  # fails if it exists
        except Py4JJavaError:
            if self._files.exists(self._name(number)):
                return False
            raise
        stream.write(json.dumps(state).encode())
        stream.close()
        return True

    def commit(self, change: Callable[[dict], dict], retries: int = 1) -> int:
        """Makes change(state of the last version) the next version; after a conflict once more, on the state that the other writer left."""
        for _ in range(retries + 1):
            number = self.latest()
            if self._claimed(number + 1, change(self.state(number))):
                return number + 1
        raise Conflict(f"{self.root}: version {self.latest()} was written meanwhile")

    def written(self, rows: DataFrame, tag: str, by: list[str] | None = None) -> str:
        """Rows as a part; its path, which counts once a version names it. by: columns that folders are made of."""
        path = f"{self.root}/parts/{tag}-{uuid.uuid4().hex}"
        (rows.write.partitionBy(*by) if by else rows.write).parquet(path, compression="zstd")
        return path

    def swept(self, keep: int = 2) -> list[str]:
        """Deletes manifests before the last ``keep``, and parts that none of those names; no reader or writer may be at older ones."""
        kept = self.numbers()[-keep:]
        named = json.dumps([self.state(number) for number in kept])
        for number in self.numbers()[:-keep]:
            self._files.delete(self._name(number), False)
        folder, gone = self._path(f"{self.root}/parts"), []
        for status in self._files.listStatus(folder) if self._files.exists(folder) else []:
            if (name := str(status.getPath().getName())) not in named:
                self._files.delete(status.getPath(), True)
                gone.append(name)
        return sorted(gone)

    def remove(self) -> None:
        """Deletes the whole folder."""
        self._files.delete(self._path(self.root), True)

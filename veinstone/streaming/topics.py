"""Topics to publish to and subscribe to, as a Python data source.

    topics.register(spark)
    rows.writeStream.format("topic").option("path", folder).option("topic", "chat").option("checkpointLocation", c).start()
    spark.readStream.format("topic").option("path", folder).option("topic", "chat").load()

A topic is a folder that driver and executors share, with a folder for each writer and in it one for each of its micro-batches; a row is (type, payload), the payload being
JSON. Tasks write drafts, and once all tasks of a micro-batch are done the driver gives their folder its number by one move: a failed batch publishes nothing, and a repeated
one publishes once. A subscriber's offset is the next number of each writer. It begins behind the last ones when it starts: there is no replay. After that its offsets
are its own, so it goes on where it was after a restart from its checkpoint. Rows keep their order within a task. swept() deletes old batches.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

SCHEMA = "type string, payload string"


class _Folder:
    def __init__(self, options: dict) -> None:
        if not options.get("path") or not options.get("topic"):
            raise ValueError("a topic needs the options path and topic")
        self.uri, self.topic = options["path"].rstrip("/"), options["topic"]

    def at(self, name: str = "") -> tuple[fs.FileSystem, str]:
        files, root = fs.FileSystem.from_uri(self.uri if "://" in self.uri or self.uri.startswith("file:") else f"file://{self.uri}")
        return files, f"{root}/{self.topic}/{name}".rstrip("/")

    def _listed(self, name: str) -> list[str]:
        files, folder = self.at(name)
        return sorted(info.base_name for info in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if not info.base_name.startswith("."))

    def batches(self) -> dict[str, list[int]]:
        """Numbers of the batches of each writer."""
        return {writer: [int(name) for name in self._listed(f"messages/{writer}")] for writer in self._listed("messages")}

    def ends(self) -> dict[str, int]:
        return {writer: max(numbers) + 1 for writer, numbers in self.batches().items() if numbers}

    def files(self, writer: str, number: int) -> list[str]:
        return [f"messages/{writer}/{number:012d}/{name}" for name in self._listed(f"messages/{writer}/{number:012d}")]


@dataclass
class _Numbers(InputPartition):
    name: str


class _Reader(DataSourceStreamReader):
    def __init__(self, folder: _Folder) -> None:
        self.folder = folder

    def initialOffset(self) -> dict:
        return self.folder.ends()

    def latestOffset(self) -> dict:
        return self.folder.ends()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Numbers(name) for writer, numbers in self.folder.batches().items() for k in numbers if start.get(writer, 0) <= k < end.get(writer, 0) for name in self.folder.files(writer, k)]

    def read(self, partition: _Numbers) -> Iterator[tuple]:
        files, path = self.folder.at(partition.name)
        with files.open_input_stream(path) as stream:
            for line in stream.read().decode().splitlines():
                yield tuple(json.loads(line))

    def commit(self, end: dict) -> None:
        pass


@dataclass
class _Draft(WriterCommitMessage):
    name: str | None


class _Writer(DataSourceStreamWriter):
    def __init__(self, folder: _Folder, writer: str) -> None:
        self.folder, self.writer = folder, writer

    def write(self, iterator: Iterator[Row]) -> _Draft:
        lines = [json.dumps([row["type"], row["payload"]], ensure_ascii=False) for row in iterator]
        if not lines:
            return _Draft(None)
        name = f"drafts/{uuid.uuid4().hex}"
        files, path = self.folder.at(name)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        with files.open_output_stream(path, compression=None) as stream:
            stream.write("\n".join(lines).encode())
        return _Draft(name)

    def commit(self, messages: list[_Draft | None], batchId: int) -> None:
        files, target = self.folder.at(f"messages/{self.writer}/{batchId:012d}")
        drafts = [draft.name for draft in messages if draft is not None and draft.name]
        if not drafts or files.get_file_info(target).type != fs.FileType.NotFound:
            return
        _, whole = self.folder.at(f"drafts/batch-{uuid.uuid4().hex}")
        files.create_dir(whole, recursive=True)
        for nth, name in enumerate(drafts):
            files.move(self.folder.at(name)[1], f"{whole}/{nth:06d}.jsonl")
        files.create_dir(target.rpartition("/")[0], recursive=True)
        files.move(whole, target)

    def abort(self, messages: list[_Draft | None], batchId: int) -> None:
        for draft in messages:
            if draft is not None and draft.name:
                files, path = self.folder.at(draft.name)
                files.delete_file(path)


class Topic(DataSource):
    """options: path, topic, and for writers ``writer``, a name that is its own among a topic's (default: ``one``)."""

    @classmethod
    def name(cls) -> str:
        return "topic"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(_Folder(self.options))

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return _Writer(_Folder(self.options), self.options.get("writer", "one"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Topic)


def swept(path: str, topic: str, keep: int = 1) -> int:
    """Deletes all but the last ``keep`` batches of each writer, one at least; how many went. No subscriber may be behind these."""
    folder, gone = _Folder({"path": path, "topic": topic}), 0
    for writer, numbers in folder.batches().items():
        for number in sorted(numbers)[: -max(1, keep)]:
            files, batch = folder.at(f"messages/{writer}/{number:012d}")
            files.delete_dir(batch)
            gone += 1
    return gone

"""Stored edges that one node's relations can be read from without reading the others.

Edges (src, type, dst, ...) are written twice, by source and by target, each dealt into folders by a hash of that end and sorted by it. A question for some nodes
lists the folders of their hashes only, and the equality on the end skips what is left of these files. Added edges are a part of their own; equal edges of several parts count once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.operators.versions import Versions

#: Edges for each folder, folders at most, and tasks that write one, so that a hub isn't one task's.
FOLDER_EDGES, MOST_FOLDERS, WRITERS = 500_000, 4096, 8


def _folder(end: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(end), F.lit(folders)).cast("int")


class EdgeIndex:
    """See the module. root: a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.versions = spark, Versions(spark, root)

    def add(self, edges: DataFrame) -> int:
        """Adds edges; the new version. An edge without a source or target is at no node, and isn't found."""
        n = edges.count()
        folders = min(MOST_FOLDERS, 1 + n // FOLDER_EDGES)
        part = {"folders": folders}
        for end, other in (("src", "dst"), ("dst", "src")):
            dealt = edges.withColumn("folder", _folder(F.col(end), folders)).repartition("folder", F.pmod(F.hash(other), F.lit(min(WRITERS, folders))))
            part[end] = self.versions.written(dealt.sortWithinPartitions("folder", end), f"by-{end}", ["folder"])
        return self.versions.commit(lambda state: {"parts": [*state.get("parts", []), part]})

    def at(self, names: list, end: str = "src") -> DataFrame:
        """The edges whose source, or target, is one of the names."""
        parts = self.versions.state().get("parts", [])
        if not parts:
            raise ValueError("no edges were added")
        found = []
        for part in parts:
            rows = self.spark.read.parquet(part[end]).where(F.col(end).isin(names))
            if part["folders"] > 1:
                rows = rows.where(F.col("folder").isin(*(_folder(F.lit(name), part["folders"]) for name in names)))  # literals once they are folded
            found.append(rows.drop("folder"))
        return found[0] if len(found) == 1 else reduce(DataFrame.unionByName, found).distinct()

    def relations(self, names: list, direction: str = "both") -> DataFrame:
        """As graph.relations, for named nodes: edges with node, other and direction; of both ways a loop once."""
        ways = {}
        if direction != "in":
            ways["out"] = self.at(names, "src").withColumns({"node": F.col("src"), "other": F.col("dst"), "direction": F.lit("out")})
        if direction != "out":
            ways["in"] = self.at(names, "dst").withColumns({"node": F.col("dst"), "other": F.col("src"), "direction": F.lit("in")})
        if direction != "both":
            return ways[direction]
        return ways["out"].unionByName(ways["in"].where("src <> dst"))

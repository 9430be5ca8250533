"""Approximate neighbours from stored cells.

Coarse centroids are learned by k-means on unit vectors, of at most SAMPLE vectors (those with the smallest hashes of their id, all where there are fewer); about the square root of
their number of cells. Every vector is stored in the folder of its nearest centroid's cell, under versions: an upsert adds a part and the ids that it
replaces. A search looks at the cells whose centroids are nearest to the query, reads these folders only, and ranks what is in them by exact cosine.
search.knn is the exact search; the index returns what it would, but for neighbours in cells that weren't looked at.

How many cells are looked at is measured when they are learned: for ASKED stored vectors the exact NEIGHBOURS are found among the sample, and as many cells are taken as hold the share
FOUND of them. Where vectors have clusters that is a few; where they are mostly noise, in many dimensions, it is a good part of all.

Vectors that are null or empty, or rows without an id, aren't taken; of rows that repeat an id within an upsert one stays.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veinstone.functions import nested
from veinstone.operators import blocks, search
from veinstone.operators.tables import settled
from veinstone.operators.versions import Versions

SAMPLE, MOST_CELLS, ROUNDS, SEED = 200_000, 4096, 10, 1
ASKED, NEIGHBOURS, FOUND = 100, 10, 0.94
#: Cells that a search names one by one, so that only their folders are listed and read.
NAMED = 1000


class VectorIndex:
    """See the module. root: a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.versions = spark, Versions(spark, root)

    def upsert(self, vectors: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", cells: int | None = None) -> int:
        """Stores vectors (id, vector), in place of those with the same id; the first upsert learns the cells. The new version."""
        rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("v")).where("id IS NOT NULL AND size(v) > 0")
        rows = settled(rows.groupBy("id").agg(F.max("v").alias("v")).select("id", nested.normalised(F.col("v")).alias("v")), "unit-vectors")
        state = self.versions.state()
        known = state.get("model") or self._learned(rows, cells)
        model = KMeansModel.load(known)
        found = model.setFeaturesCol("unit").setPredictionCol("cell").transform(rows.withColumn("unit", array_to_vector("v"))).select("id", "v", "cell")
        path = self.versions.written(found.repartition("cell", F.pmod(F.hash("id"), F.lit(4))).sortWithinPartitions("cell"), "vectors", ["cell"])

        probes = state.get("probes") or self._measured(self.spark.read.parquet(path), model)

        def added(state: dict) -> dict:
            parts, dead = state.get("parts", []), state.get("dead", [])
            number = 1 + max((part["number"] for part in parts), default=0)
            if parts:
                gone = self.versions.written(self._vectors(state).join(self.spark.read.parquet(path).select("id"), "id", "left_semi").select("part", "id"), "dead")
                dead = [*dead, gone]
            return {"model": known, "probes": probes, "parts": [*parts, {"path": path, "number": number}], "dead": dead}

        return self.versions.commit(added)

    def _learned(self, rows: DataFrame, cells: int | None) -> str:
        """Where the model is."""
        n = rows.count()
        some = rows if n <= SAMPLE else rows.orderBy(F.xxhash64("id")).limit(SAMPLE)
        k = cells or min(MOST_CELLS, max(1, round(math.sqrt(min(n, SAMPLE)))))
        path = f"{self.versions.root}/parts/model-{SEED}-{n}-{k}"
        model = KMeans(k=max(2, k), maxIter=ROUNDS, seed=SEED, featuresCol="unit").fit(some.select(array_to_vector("v").alias("unit")))
        model.write().overwrite().save(path)
        return path

    def _cells(self, model: KMeansModel) -> DataFrame:
        """(cell, centre); MOST_CELLS at most."""
        return self.spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell int, centre array<double>")

    def _nearest(self, asked: DataFrame, model: KMeansModel) -> DataFrame:
        """(query_id, q, cell, nth): all cells of each query (query_id, q), a stated set, from the nearest on."""
        away = F.aggregate(F.zip_with("centre", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        met = asked.crossJoin(F.broadcast(self._cells(model))).select("query_id", "q", "cell", away.alias("away"))
        return met.select("query_id", "q", "cell", F.row_number().over(Window.partitionBy("query_id").orderBy("away", "cell")).alias("nth"))

    def _measured(self, vectors: DataFrame, model: KMeansModel) -> int:
        """How many cells hold the share FOUND of the neighbours of some stored vectors (id, v, cell)."""
        order = F.xxhash64("id")
        pool = settled(vectors.orderBy(order).limit(SAMPLE), "pool")
        asked = settled(pool.orderBy(order).limit(ASKED).select(F.col("id").alias("query_id"), F.col("v").alias("q")), "measured-queries")
        near = search.knn(pool, asked.withColumnRenamed("q", "vector"), NEIGHBOURS + 1, id_column="id", vector_column="v").where("query_id <> id")
        seen = near.join(pool.select("id", "cell"), "id").join(self._nearest(asked, model), ["query_id", "cell"]).select("nth")
        ranks = sorted(row["nth"] for row in seen.collect())  # ASKED * NEIGHBOURS rows
        return ranks[min(len(ranks) - 1, int(FOUND * len(ranks)))] if ranks else 1

    def _vectors(self, state: dict) -> DataFrame:
        """(part, id, v, cell) of vectors that count."""
        every = reduce(DataFrame.unionByName, (self.spark.read.parquet(part["path"]).withColumn("part", F.lit(part["number"])) for part in state["parts"]))
        if not state["dead"]:
            return every
        return every.join(reduce(DataFrame.unionByName, (self.spark.read.parquet(path) for path in state["dead"])), ["part", "id"], "left_anti")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, places: int = 6) -> DataFrame:
        """(query_id, id, score, rank, candidates): the best k of each query (query_id, vector) among the vectors of its nearest cells, as many as were measured unless told, and how many vectors these hold."""
        state = self.versions.state()
        asked = settled(queries.select("query_id", nested.normalised(F.col("vector").cast("array<double>")).alias("q")).where("size(q) > 0"), "asked-vectors")
        if not state.get("parts"):
            return asked.where("false").select("query_id", F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("candidates"))
        looked = settled(self._nearest(asked, KMeansModel.load(state["model"])).where(F.col("nth") <= (probes or state["probes"])).select("query_id", "q", "cell"), "cells")
        vectors, named = self._vectors(state), [row["cell"] for row in looked.select("cell").distinct().limit(NAMED + 1).collect()]
        if len(named) <= NAMED:
            vectors = vectors.where(F.col("cell").isin(named))
        # A cell's vectors meet its queries in blocks: large cells are cut in pieces, to each of which the queries go.
        sizes = settled(vectors.groupBy("cell").agg(F.count("*").alias("n")).withColumn("pieces", F.ceil(F.col("n") / blocks.PIECE).cast("int")), "cell-sizes")  # MOST_CELLS rows
        rows = vectors.join(F.broadcast(sizes), "cell").select(F.col("cell").alias("a"), F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int").alias("b"), "id", "v")
        met = looked.join(F.broadcast(sizes), "cell")
        asks = met.select(F.col("cell").alias("a"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("b"), "query_id", "q")
        pairs = blocks.nearest(rows, asks, k, 2 * 10.0**-places).select("query_id", "id", F.round("score", places).alias("score"))
        counted = met.groupBy("query_id").agg(F.sum("n").alias("candidates"))
        return search.best(pairs, k).join(search.held(settled(counted, "candidates")), "query_id")

"""Centroid clustering over ball trees.

Each task plants metric trees over its own vectors, at most TREE in one: a node has a ball (centre and radius), the number
of its vectors and their sum; a node over LEAF vectors is cut between two that are far from each other. The trees are written
once to the shared folder. A round hands all centroids to each tree. By the triangle inequality, of centroids a and b and a ball
of centre c and radius r, b owns none of the ball's vectors if d(c, a) + r < d(c, b) - r. A ball with one centroid left gives its count
and sum to it as a whole; others are opened, and in leaves the vectors' own distances to the centroids left decide. A task hands
over one row for each centroid, and Spark adds these up: the driver sees sums for each centroid and nothing else.

All sums and distances are exact whole numbers; only the choice of what to open uses square roots, with a margin that
leaves a ball open in doubt. So the result is that of comparing every vector with every centroid.

Vectors that are null, of another length, or with null or non-finite components are left out. Rows that repeat an id are vectors of their
own; among these a smaller vector goes first where the ids' digests are equal. Rows without an id are assigned, but start no centroid. With
fewer vectors than centroids there are as many centroids as vectors with ids; no such vector, no result. Columns besides id and vector are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.llm.common import superseded, table, written
from veinstone.llm.vectors import exact, kept_vectors, largest, squared

COMPONENTS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
LEAF, TREE = 16, 4096
#: Relative margin of comparisons of rounded square roots; their own error is under 1e-15.
MARGIN = 1e-9


@dataclass
class BallTree:
    """Nodes in breadth-first order, children of a node side by side; a node's vectors are those from start to end."""

    ids: np.ndarray
    known: np.ndarray
    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    child: np.ndarray  # the first of two, or -1
    centre: np.ndarray
    radius: np.ndarray  # squared
    total: np.ndarray

    @classmethod
    def plant(cls, ids: np.ndarray, known: np.ndarray, points: np.ndarray) -> BallTree:
        kind = exact(points.shape[1], largest(points))
        values, order = points.astype(kind), np.arange(len(points))
        ranges, child, centre, radius, total = [(0, len(points))], [], [], [], []
        for start, end in ranges:  # grows as nodes are cut
            own = order[start:end]
            members = values[own]
            total.append(points[own].sum(axis=0, dtype="i8"))
            centre.append(total[-1] // (end - start))
            away = squared(members, centre[-1][None].astype(kind))[:, 0]
            radius.append(int(away.max()))
            if end - start <= LEAF or radius[-1] == 0:
                child.append(-1)
                continue
            from_one = squared(members, members[[away.argmax()]])[:, 0]
            near = from_one <= squared(members, members[[from_one.argmax()]])[:, 0]
            order[start:end] = np.concatenate([own[near], own[~near]])
            child.append(len(ranges))
            cut = start + int(near.sum())
            ranges += [(start, cut), (cut, end)]
        starts, ends = np.array(ranges, "i8").T
        return cls(ids[order], known[order], points[order], starts, ends, np.array(child, "i8"), np.array(centre, "i8"), np.array(radius, "i8"), np.array(total, "i8"))

    def owners(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """Nodes that one centroid owns, and it; vectors of opened leaves, and the owner of each; how many distances that took."""
        kind = exact(centroids.shape[1], largest(centroids, self.points, self.centre))
        rivals, count = centroids.astype(kind), 0
        nodes, alive = np.zeros(1, "i8"), np.ones((1, len(centroids)), bool)
        whole, opened = [], []
        while len(nodes):
            away = np.sqrt(squared(self.centre[nodes].astype(kind), rivals).astype("f8"))
            count += int(alive.sum())
            away[~alive] = np.inf
            reach = away.min(axis=1) + 2 * np.sqrt(self.radius[nodes].astype("f8"))
            alive &= ~(away * (1 - MARGIN) > (reach * (1 + MARGIN))[:, None])
            one, leaf = alive.sum(axis=1) == 1, self.child[nodes] < 0
            whole.append((nodes[one], alive[one].argmax(axis=1)))
            # Leaves that are left with the same centroids are compared with these in one product.
            leaves, kinds = nodes[leaf & ~one], alive[leaf & ~one]
            sets, which = np.unique(kinds, axis=0, return_inverse=True)
            for k, left in enumerate(sets):
                candidates, at = np.flatnonzero(left), _ranges(self.start[leaves[which == k]], self.end[leaves[which == k]])
                own = squared(self.points[at].astype(kind), rivals[candidates])
                count += own.size
                opened.append((at, candidates[own.argmin(axis=1)]))
            on = ~one & ~leaf
            nodes, alive = (self.child[nodes[on]][:, None] + np.arange(2)).ravel(), np.repeat(alive[on], 2, axis=0)
        joined = [np.concatenate([np.zeros(0, "i8"), *parts]) for parts in (*zip(*whole), *(zip(*opened) if opened else ((), ())))]
        return *joined, count

    def assigned(self, centroids: np.ndarray) -> np.ndarray:
        """The centroid of each vector, in the tree's order."""
        found = np.zeros(len(self.points), "i8")
        nodes, owners, at, own, _ = self.owners(centroids)
        found[_ranges(self.start[nodes], self.end[nodes])] = np.repeat(owners, self.end[nodes] - self.start[nodes])
        found[at] = own
        return found

    def add_to(self, counts: np.ndarray, sums: np.ndarray, centroids: np.ndarray) -> int:
        """Adds this tree's vectors to the counts and sums of their centroids; the number of distances that it took."""
        nodes, owners, at, own, compared = self.owners(centroids)
        np.add.at(counts, owners, self.end[nodes] - self.start[nodes])
        np.add.at(sums, owners, self.total[nodes])
        np.add.at(counts, own, 1)
        np.add.at(sums, own, self.points[at])
        return compared


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    sizes = ends - starts
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


_FIELDS = {"ids": "<i8", "known": "?", "points": "<i4", "start": "<i8", "end": "<i8", "child": "<i8", "centre": "<i8", "radius": "<i8", "total": "<i8"}
_TREE = ", ".join(f"{name} binary" for name in _FIELDS)


def _packed(trees: list[BallTree]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([getattr(t, name).astype(kind).tobytes() for t in trees], pa.binary()) for name, kind in _FIELDS.items()], names=list(_FIELDS))


def _unpacked(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[BallTree]:
    for batch in batches:
        for row in batch.to_pylist():
            parts = {name: np.frombuffer(row[name], kind) for name, kind in _FIELDS.items()}
            yield BallTree(**{name: part.reshape(-1, width) if name in ("points", "centre", "total") else part for name, part in parts.items()})


def _planted(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        waiting = 0
        for batch in batches:
            ids, known = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            held.append((ids, known, batch.column(1).flatten().to_numpy().reshape(-1, width)))
            waiting += len(ids)
            while waiting >= TREE:
                ids, known, points = (np.concatenate(x) for x in zip(*held))
                yield _packed([BallTree.plant(ids[:TREE], known[:TREE], points[:TREE])])
                held, waiting = [(ids[TREE:], known[TREE:], points[TREE:])], waiting - TREE
        if waiting:
            yield _packed([BallTree.plant(*(np.concatenate(x) for x in zip(*held)))])

    return plant


def _summed(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, n, compared, s0, s1, ...): what all trees give to each centroid."""
    width = centroids.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, compared = np.zeros(len(centroids), "i8"), np.zeros(centroids.shape, "i8"), 0
        for tree in _unpacked(batches, width):
            compared += tree.add_to(counts, sums, centroids)
        own = np.flatnonzero(counts)
        work = np.where(np.arange(len(own)) == 0, compared, 0)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype("i4")), pa.array(counts[own]), pa.array(work.astype("i8")), pa.array(sums[own].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "compared", "sums"])

    rows = trees.mapInArrow(add, "cluster int, n long, compared long, sums array<long>")
    return rows.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("compared").alias("compared"), *(F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)))


@dataclass
class Clusters:
    """rows: (vec_id, cluster, distance) of every vector; compared: distances computed in each round, of centroids with balls and vectors."""

    rows: DataFrame
    centroids: np.ndarray
    compared: list[int]


def clusters(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, components: int = COMPONENTS, seed: int = SEED, *, id_column: str = "vec_id", vector_column: str = "embedding") -> Clusters | None:
    """k-means of whole-number vectors, or None where there is nothing to start from; see the module for odd rows.

    Centroids start as the vectors whose ids have the smallest digests. Their number times that of components is what the driver holds.
    """
    kept = kept_vectors(vectors, scale, id_column=id_column, vector_column=vector_column).where(F.size("vector") == components)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    firsts = kept.where(F.col("vec_id").isNotNull()).select(digest.alias("digest"), "vector").orderBy("digest", "vector").limit(centroids).collect()
    if not firsts:
        return None
    trees = written(kept.mapInArrow(_planted(components), _TREE), "ball-trees")
    places, work = np.array([row["vector"] for row in firsts], "i8"), []
    for _ in range(rounds):
        found = _summed(trees, places).collect()  # a row for each centroid
        work.append(sum(row["compared"] for row in found))
        for row in found:
            places[row["cluster"]] = [row[f"s{k}"] // row["n"] for k in range(components)]
    rows = written(_assigned(trees, places), "ball-clusters")
    superseded(trees)
    return Clusters(rows, places, work)


def _assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree in _unpacked(batches, centroids.shape[1]):
            own = tree.assigned(centroids)
            apart = tree.points.astype("i8") - centroids[own]
            yield pa.RecordBatch.from_arrays([pa.array(tree.ids, pa.int64(), mask=~tree.known), pa.array(own.astype("i4")), pa.array((apart * apart).sum(axis=1))], names=["vec_id", "cluster", "distance"])

    return trees.mapInArrow(assign, "vec_id long, cluster int, distance long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and the sums of distances of every vector."""
    found = clusters(table(spark, sf_dir, "embeddings"))
    columns = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if found is None:
        return spark.createDataFrame([], f"vec_id long, cluster int, distance long, {columns.partition(', ')[2]}")
    sums = {row["cluster"]: row["s"] for row in found.rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in found.centroids.tolist()]
    names = spark.createDataFrame([(k, s, sum(sums.values()), digests[k]) for k, s in sorted(sums.items())], columns)
    return found.rows.join(F.broadcast(names), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds_sql() -> str:
    """Assignment and update as SQL, for as many rounds."""
    apart = "CAST(list_dot_product(k.w, k.w) - 2 * list_dot_product(k.w, c.w) + list_dot_product(c.w, c.w) AS BIGINT)"
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, vec_id, v, best.n AS n, best.d AS d FROM (
                SELECT k.r, any_value(k.vec_id) AS vec_id, any_value(k.v) AS v, min(struct_pack(d := {apart}, n := c.n)) AS best FROM kept AS k, c{i} AS c GROUP BY k.r))""")
        if i < ROUNDS:
            steps.append(f"""m{i} AS (SELECT n, list(CAST((s - ((s % m) + m) % m) // m AS BIGINT) ORDER BY j) AS v
                FROM (SELECT n, j, CAST(sum(v[j]) AS BIGINT) AS s, count(*) AS m FROM a{i}, (SELECT unnest(range(1, {COMPONENTS + 1})) AS j) GROUP BY n, j) GROUP BY n)""")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.n, coalesce(m.v, c.v) AS v, CAST(coalesce(m.v, c.v) AS DOUBLE[]) AS w FROM c{i} AS c LEFT JOIN m{i} AS m USING (n))")
    return ",\n".join(steps)


SQL = f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, v, CAST(v AS DOUBLE[]) AS w
    FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
          WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {COMPONENTS})
), c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS n, v, w FROM kept WHERE vec_id IS NOT NULL
    ORDER BY n LIMIT {CENTROIDS}
), {_rounds_sql()}
SELECT a.vec_id, CAST(a.n AS INTEGER) AS "cluster", a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.n) AS BIGINT) AS cluster_inertia,
    CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} AS a JOIN c{ROUNDS} AS c USING (n)
"""

"""Vector code compression: product codes whose codebooks are found by exponion search.

A vector is cut into equal parts, and each part gets the index of the nearest entry in the codebook of its position. Entries
begin as parts of the vectors with the smallest ids; a round assigns all parts and moves each entry to the floor of the mean of its parts.

A search starts at the entry that the part had before, at distance u. An entry that is as near lies, by the triangle inequality,
within 2u of that one; so of that entry's list of neighbours, sorted by distance, only the beginning up to 2u is scanned. It holds every entry
that could win or tie: the result is that of a comparison with all. In the first round the search starts at the nearest of every STRIDE-th entry.
Distances are squared whole numbers, the radius is compared as 4 u^2, and ties go to the smaller index.

Each round reads the vectors with their codes and writes both anew to the shared folder, with a row for each task and entry that
holds a count and sums; the driver sees these added up, parts * entries rows, whatever the input.

Rows whose vector is null, or has null or non-finite components, are left out. All others come out; those whose vector hasn't the commonest length (of
equally common ones the greatest), or a length that isn't a positive multiple of the number of parts, have no code and no error. Rows that
repeat an id are vectors of their own, the smaller vector first where they start entries; rows without an id start none. With fewer vectors than entries
there are as many entries as vectors with ids. Where there is nothing to start from, no row has a code. Columns that aren't named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.llm.common import skew_safe_lookup, superseded, table, written
from veinstone.llm.vectors import exact, kept_vectors, largest, squared

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
STRIDE = 16
#: Points of one entry that are compared in one product, in order of how far they search.
TOGETHER = 128


def exponion(points: np.ndarray, entries: np.ndarray, previous: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of the nearest entry of each point, its squared distance, and how many distances were computed."""
    kind = exact(entries.shape[1], largest(points, entries))
    points, entries = points.astype(kind), entries.astype(kind)
    compared = 0
    if previous is None:
        some = np.arange(0, len(entries), STRIDE)
        previous = some[squared(points, entries[some]).argmin(axis=1)]
        compared += len(points) * len(some)
    between = squared(entries, entries)
    neighbours = np.argsort(between, axis=1, kind="stable")
    between = np.take_along_axis(between, neighbours, axis=1)
    apart = points - entries[previous]
    own = (apart * apart).sum(axis=1)
    code, error = np.empty(len(points), "i8"), np.empty(len(points), "i8")
    by_entry = np.argsort(previous, kind="stable")
    bounds = np.searchsorted(previous[by_entry], np.arange(len(entries) + 1))
    for entry in np.flatnonzero(np.diff(bounds)):
        members = by_entry[bounds[entry] : bounds[entry + 1]]
        reach = np.searchsorted(between[entry], 4 * own[members], side="right")
        farther = np.argsort(reach, kind="stable")
        members, reach = members[farther], reach[farther]
        for k in range(0, len(members), TOGETHER):
            some = members[k : k + TOGETHER]
            scanned = neighbours[entry, : reach[k : k + TOGETHER][-1]]
            away = squared(points[some], entries[scanned])
            compared += away.size
            nearest = away.min(axis=1)
            code[some], error[some] = np.where(away == nearest[:, None], scanned, len(entries)).min(axis=1), nearest
    return code, error, compared


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Rows of equally long binary values."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


_STATE = "vec_id long, label string, vector binary, codes binary, part int, entry int, n long, compared long, sums array<long>"


def _round(codebooks: np.ndarray, first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Vectors with their codes, then the sums of each entry over the task."""
    parts, entries, width = codebooks.shape
    names = [c.split()[0] for c in _STATE.split(", ")]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, compared = np.zeros((parts, entries), "i8"), np.zeros((parts, entries, width), "i8"), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, labels, vector = (batch.column(k) for k in range(3))
            points = vector.flatten().to_numpy().reshape(len(vector), -1) if first else _matrix(vector, "<i4")
            before = None if first else _matrix(batch.column(3), "<u2")
            codes = np.empty((len(points), parts), "<u2")
            for part in range(parts):
                own = points[:, part * width : (part + 1) * width]
                codes[:, part], _, work = exponion(own, codebooks[part], None if first else before[:, part].astype("i8"))
                compared += work
                counts[part] += np.bincount(codes[:, part], minlength=entries)
                np.add.at(sums[part], codes[:, part], own)
            packed = [pa.array([row.tobytes() for row in x], pa.binary()) for x in (points.astype("<i4"), codes)]
            yield pa.RecordBatch.from_arrays([ids, labels, *packed, *(pa.nulls(len(points), kind) for kind in (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], names=names)
        part, entry = np.nonzero(counts)
        work = np.where(np.arange(len(part)) == 0, compared, 0)
        yield pa.RecordBatch.from_arrays([
            *(pa.nulls(len(part), kind) for kind in (pa.int64(), pa.string(), pa.binary(), pa.binary())), pa.array(part.astype("i4")), pa.array(entry.astype("i4")), pa.array(counts[part, entry]),
            pa.array(work.astype("i8")), pa.array(sums[part, entry].tolist(), pa.list_(pa.int64())),
        ], names=names)

    return assign


def _last(codebooks: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    parts, _, width = codebooks.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points, before = _matrix(batch.column(2), "<i4"), _matrix(batch.column(3), "<u2").astype("i8")
                found = [exponion(points[:, k * width : (k + 1) * width], codebooks[k], before[:, k])[:2] for k in range(parts)]
                codes, errors = np.stack([x for x, _ in found], axis=1), sum(x for _, x in found)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([bytes(row) for row in codes.tolist()], pa.binary()), pa.array(errors)], names=["vec_id", "label", "code", "error"])

    return assign


@dataclass
class Codes:
    """rows: (vec_id, label, code, error), code as one byte for each part; codebooks: parts x entries x width, or None; compared: distances computed in each round."""

    rows: DataFrame
    codebooks: np.ndarray | None
    compared: list[int]

    def decoded(self) -> DataFrame:
        """(vec_id, vector): the whole numbers that each code stands for."""
        entries = F.array(*(F.array(*(F.array(*map(F.lit, entry)) for entry in part)) for part in self.codebooks.tolist()))
        index = lambda k: F.conv(F.hex(F.substring("code", k + 1, 1)), 16, 10).cast("int")
        return self.rows.select("vec_id", F.flatten(F.array(*(entries[k][index(k)] for k in range(len(self.codebooks))))).alias("vector"))


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, *, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str | None = "label") -> Codes:
    """Codes of whole-number vectors, floor(scale * x); at most 256 entries, a byte for each part. See the module for odd rows."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte for each part: 1 to 256 entries")
    label = (vectors[label_column].cast("string") if label_column else F.lit(None).cast("string")).alias("label")
    kept = kept_vectors(vectors, scale, label, id_column=id_column, vector_column=vector_column).select("vec_id", "label", "vector")
    commonest = kept.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = commonest["size"] if commonest and commonest["size"] and commonest["size"] % parts == 0 else None
    plain = kept.where(F.size("vector") == size) if size else kept.where("false")
    firsts = plain.where(F.col("vec_id").isNotNull()).select("vec_id", "vector").orderBy("vec_id", "vector").limit(entries).collect()
    if not firsts:
        return Codes(kept.select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")), None, [])
    codebooks = np.array([row["vector"] for row in firsts], "i8").reshape(len(firsts), parts, size // parts).transpose(1, 0, 2).copy()
    state, work = plain, []
    for k in range(rounds):
        before, state = state, written(state.mapInArrow(_round(codebooks, k == 0), _STATE), "exponion")
        if k:
            superseded(before)
        summed = state.where(F.col("part").isNotNull()).groupBy("part", "entry").agg(F.sum("n").alias("n"), F.sum("compared").alias("compared"), *(F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(size // parts)))
        found = summed.collect()  # parts * entries rows
        work.append(sum(row["compared"] for row in found))
        for row in found:
            codebooks[row["part"], row["entry"]] = [row[f"s{j}"] // row["n"] for j in range(size // parts)]
        state = state.where(F.col("part").isNull()).select("vec_id", "label", "vector", "codes")
    if not rounds:
        state = written(plain.mapInArrow(_round(codebooks, True), _STATE), "exponion").where(F.col("part").isNull()).select("vec_id", "label", "vector", "codes")
    rows = state.mapInArrow(_last(codebooks), "vec_id long, label string, code binary, error long")
    others = kept.where(F.size("vector") != size).select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = written(rows.unionByName(others), "exponion-codes")
    superseded(state)
    return Codes(coded, codebooks, work)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector; errors summed by label, those without one together."""
    found = compressed(table(spark, sf_dir, "embeddings"))
    digest = None if found.codebooks is None else hashlib.sha256(",".join(map(str, found.codebooks.ravel().tolist())).encode()).hexdigest()
    rows = found.rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", F.coalesce(F.concat(F.lit("="), "label"), F.lit("null")).alias("group"))
    sums = rows.groupBy("group").agg(F.sum("error").alias("label_error"), F.count("*").alias("members"))
    return skew_safe_lookup(rows, sums, "group", "members", F.col("vec_id")).select("vec_id", "code", "error", "label_error", F.lit(digest).cast("string").alias("codebooks_sha256"))


def _rounds_sql() -> str:
    apart = "CAST(list_dot_product(k.w, k.w) - 2 * list_dot_product(k.w, c.w) + list_dot_product(c.w, c.w) AS BIGINT)"
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, p, best.n AS n, best.d AS d FROM (
            SELECT k.r, k.p, min(struct_pack(d := {apart}, n := c.n)) AS best FROM pieces AS k JOIN c{i} AS c USING (p) GROUP BY k.r, k.p))""")
        if i < ROUNDS:
            steps.append(f"""m{i} AS (SELECT p, n, list(CAST((s - ((s % m) + m) % m) // m AS BIGINT) ORDER BY j) AS v
                FROM (SELECT p, n, j, CAST(sum(v[j]) AS BIGINT) AS s, count(*) AS m FROM (SELECT a.p, a.n, k.v, unnest(range(1, len(k.v) + 1)) AS j FROM a{i} AS a JOIN pieces AS k USING (r, p)) GROUP BY p, n, j) GROUP BY p, n)""")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.p, c.n, coalesce(m.v, c.v) AS v, CAST(coalesce(m.v, c.v) AS DOUBLE[]) AS w FROM c{i} AS c LEFT JOIN m{i} AS m USING (p, n))")
    return ",\n".join(steps)


#: For vectors of one length that the parts divide.
SQL = f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, row_number() OVER (ORDER BY vec_id, embedding) - 1 AS place, vec_id, label,
        list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), pieces AS MATERIALIZED (
    SELECT r, place, p, v, CAST(v AS DOUBLE[]) AS w
    FROM (SELECT r, place, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS v FROM kept, (SELECT unnest(range({PARTS})) AS p))
), c0 AS MATERIALIZED (SELECT p, place AS n, v, w FROM pieces WHERE place < {ENTRIES}), {_rounds_sql()},
coded AS (SELECT r, string_agg(printf('%02x', n), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, n)) FROM c{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (r)
"""

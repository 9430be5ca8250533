"""Vectors compared in blocks: Spark deals them out by keys, and a task compares the vectors of one key at a time with numpy.

Products of whole blocks tell which pairs may count; these are then summed in the order of the components, as nested.dot does, so results are the same to the
last bit. Vectors that are null, hold a null or differ in length have no product (null); a product that is no number is above every other, as in Spark's order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y

#: Products computed at a time, and pairs that are summed exactly at a time: bounds of a task's memory.
CELLS, SUMS = 1 << 21, 1 << 16
#: Vectors, and queries, that meet in one block.
PIECE, GROUP = 8192, 2048
MARGIN = 1e-9


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of one key at a time; the first ``keys`` columns are the key, not null, by which rows are sorted."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        changed = np.zeros(n, bool)
        for k in range(keys):
            column = batch.column(k)
            changed[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        changed[0] = last is not None and last != tuple(batch.column(k)[0].as_py() for k in range(keys))
        begin = 0
        for at in [*np.flatnonzero(changed).tolist(), n]:
            if at > begin:
                held.append(batch.slice(begin, at - begin))
            if at < n and held:
                yield pa.Table.from_batches(held)
                held = []
            begin = at
        last = tuple(batch.column(k)[n - 1].as_py() for k in range(keys))
    if held:
        yield pa.Table.from_batches(held)


def matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, filled up with zeros, and their lengths; -1 for one that is null or holds a null."""
    vectors = column.combine_chunks()
    vectors = pa.concat_arrays(vectors.chunks) if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).astype("i8")
    flat = vectors.flatten()
    width = int(max(0, sizes.max(initial=0)))
    if not flat.null_count and (sizes == width).all():
        return flat.to_numpy().reshape(len(sizes), width), sizes
    found = np.zeros((len(sizes), width))
    lengths = np.maximum(sizes, 0)
    row = np.repeat(np.arange(len(sizes)), lengths)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    found[row, place] = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    sizes[row[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    return found, sizes


def summed(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of rows i of one matrix and rows j of the other, both turned (a column for each row), summed in order."""
    found = np.zeros(len(i))
    with np.errstate(all="ignore"):
        for one, two in zip(a, b):
            found += one[i] * two[j]
    return found


def width(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def pairs(dealt: DataFrame, threshold: float) -> DataFrame:
    """(row, row_2, id, id_2, cosine): pairs of one key at or above the threshold.

    dealt: (label, a, b, own, row, id, unit), where rows of the pieces a and b of a label meet; within one piece each pair once.
    """
    types = {f.name: f.dataType for f in dealt.schema}
    schema = Y.StructType([Y.StructField(n, types[n.removesuffix("_2")]) for n in ("row", "row_2", "id", "id_2")] + [Y.StructField("cosine", Y.DoubleType())])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, 3):
            units, sizes = matrix(table.column("unit"))
            own, one = table.column("own").to_numpy(), table.column("a")[0].as_py() == table.column("b")[0].as_py()
            left = np.flatnonzero((own == table.column("a")[0].as_py()) & (sizes >= 0))
            right = left if one else np.flatnonzero((own == table.column("b")[0].as_py()) & (sizes >= 0))
            if not len(left) or not len(right):
                continue
            rows, ids, turned, across = table.column("row").combine_chunks(), table.column("id").combine_chunks(), np.ascontiguousarray(units.T), np.ascontiguousarray(units[right].T)
            step = max(1, CELLS // len(right))
            for at in range(0, len(left), step):
                some = left[at : at + step]
                with np.errstate(all="ignore"):
                    near = ~(units[some] @ across < threshold - MARGIN)
                near &= sizes[some][:, None] == sizes[right]
                i, j = np.nonzero(near)
                if one:
                    later = j > i + at
                    i, j = i[later], j[later]
                i, j = some[i], right[j]
                for k in range(0, len(i), SUMS):
                    x, y = i[k : k + SUMS], j[k : k + SUMS]
                    cosine = summed(turned, turned, x, y)
                    kept = ~(cosine < threshold)
                    x, y = pa.array(x[kept]), pa.array(y[kept])
                    yield pa.RecordBatch.from_arrays([rows.take(x), rows.take(y), ids.take(x), ids.take(y), pa.array(cosine[kept])], names=schema.names)

    keyed = dealt.select("label", "a", "b", "own", "row", "id", "unit").repartition(width(dealt), "label", "a", "b").sortWithinPartitions("label", "a", "b")
    return keyed.mapInArrow(compared, schema)


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Takes links of i and j into a forest: each row has its root at once, before and after."""
    while True:
        one, two = root[i], root[j]
        apart = np.flatnonzero(one != two)
        if not len(apart):
            return
        i, j, one, two = i[apart], j[apart], one[apart], two[apart]
        np.minimum.at(root, np.maximum(one, two), np.minimum(one, two))
        while not np.array_equal(further := root[root], root):
            root[:] = further


def linked(dealt: DataFrame, threshold: float) -> DataFrame:
    """(row, root, links): of each row that has others at or above the threshold under its key, to how many rows these stand for (copies), and a row that its links lead to, the same for all that are joined.

    dealt: (label, a, b, own, row, copies, unit) as for pairs. At most a row comes out for each that goes in, whatever the number of pairs.
    """
    kind = dealt.schema["row"].dataType
    schema = Y.StructType([Y.StructField("row", kind), Y.StructField("root", kind), Y.StructField("links", Y.LongType())])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, 3):
            units, sizes = matrix(table.column("unit"))
            own, one = table.column("own").to_numpy(), table.column("a")[0].as_py() == table.column("b")[0].as_py()
            left = np.flatnonzero((own == table.column("a")[0].as_py()) & (sizes >= 0))
            right = left if one else np.flatnonzero((own == table.column("b")[0].as_py()) & (sizes >= 0))
            if not len(left) or not len(right):
                continue
            copies, turned, across = table.column("copies").to_numpy().astype("f8"), np.ascontiguousarray(units.T), np.ascontiguousarray(units[right].T)
            links, root = np.zeros(len(units)), np.arange(len(units))
            alike = (sizes[left] == sizes[left[0]]).all() and (sizes[right] == sizes[left[0]]).all()
            step = max(1, CELLS // len(right))
            for at in range(0, len(left), step):
                some = left[at : at + step]
                with np.errstate(all="ignore"):
                    scores = units[some] @ across
                    near = ~(scores < threshold - MARGIN)
                if not alike:
                    near &= sizes[some][:, None] == sizes[right]
                i, j = np.nonzero(near)
                if one:
                    i, j = i[i + at != j], j[i + at != j]
                doubtful = np.flatnonzero(~(scores[i, j] > threshold + MARGIN))
                i, j, kept = some[i], right[j], np.ones(len(i), bool)
                for k in range(0, len(doubtful), SUMS):
                    these = doubtful[k : k + SUMS]
                    kept[these] = ~(summed(turned, turned, i[these], j[these]) < threshold)
                i, j = i[kept], j[kept]
                links += np.bincount(i, copies[j], len(units))
                if not one:
                    links += np.bincount(j, copies[i], len(units))
                _joined(root, i, j)
            found, rows = np.flatnonzero(links), table.column("row").combine_chunks()
            yield pa.RecordBatch.from_arrays([rows.take(pa.array(found)), rows.take(pa.array(root[found])), pa.array(links[found].astype("i8"))], names=schema.names)

    keyed = dealt.select("label", "a", "b", "own", "row", "copies", "unit").repartition(width(dealt), "label", "a", "b").sortWithinPartitions("label", "a", "b")
    return keyed.mapInArrow(compared, schema)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, margin: float) -> DataFrame:
    """(query_id, id, score): of each key the vectors (a, b, id, v) that may be among a query's best k, also when scores are rounded by less than half the margin.

    queries: (a, b, query_id, q), which meet the vectors of their key. Of equal scores the k smallest ids are enough.
    """
    kinds = {f.name: f.dataType for f in [*vectors.schema, *queries.schema]}
    schema = Y.StructType([Y.StructField("query_id", kinds["query_id"]), Y.StructField("id", kinds["id"]), Y.StructField("score", Y.DoubleType())])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, 2):
            asks = table.column("asks").to_numpy(zero_copy_only=False)
            units, sizes = matrix(table.column("v"))
            left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
            if not len(left) or not len(right):
                continue
            turned, across = np.ascontiguousarray(units.T), np.ascontiguousarray(units[right].T)
            names, ids = table.column("query_id").combine_chunks(), table.column("id").combine_chunks()
            step = max(1, CELLS // len(right))
            for at in range(0, len(left), step):
                some = left[at : at + step]
                with np.errstate(all="ignore"):
                    scores = units[some] @ across
                scores[np.isnan(scores)] = np.inf
                scores[(sizes[some][:, None] != sizes[right]) | (sizes[some] < 0)[:, None]] = -np.inf
                if len(right) > k:
                    least = np.partition(scores, len(right) - k, axis=1)[:, len(right) - k]
                    i, j = np.nonzero(scores >= (least - margin)[:, None])
                else:
                    i, j = (x.ravel() for x in np.indices(scores.shape))
                order, known = scores[i, j], scores[i, j] > -np.inf
                exact = np.concatenate([summed(turned, turned, some[i[n : n + SUMS]], right[j[n : n + SUMS]]) for n in range(0, len(i), SUMS)])
                order = np.where(known, np.where(np.isnan(exact), np.inf, exact), -np.inf)
                by = np.lexsort((j, -order, i))  # rows are sorted by id
                i, j, order, exact, known = i[by], j[by], order[by], exact[by], known[by]
                begins = np.ones(len(i), bool)
                begins[1:] = (i[1:] != i[:-1]) | (order[1:] != order[:-1])
                first = np.flatnonzero(begins)
                kept = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i)))) < k
                x, y = pa.array(some[i[kept]]), pa.array(right[j[kept]])
                yield pa.RecordBatch.from_arrays([names.take(x), ids.take(y), pa.array(exact[kept], mask=~known[kept])], names=schema.names)

    none = lambda name: F.lit(None).cast(kinds[name])
    both = vectors.select("a", "b", F.lit(False).alias("asks"), "id", none("query_id").alias("query_id"), F.col("v").cast("array<double>").alias("v"))
    both = both.unionByName(queries.select("a", "b", F.lit(True).alias("asks"), none("id").alias("id"), "query_id", F.col("q").cast("array<double>").alias("v")))
    return both.repartition(width(vectors), "a", "b").sortWithinPartitions("a", "b", "asks", "id").mapInArrow(compared, schema)


def dealt(vectors: DataFrame, queries: DataFrame, *more: DataFrame, piece: int | None = None, group: int | None = None) -> list[DataFrame]:
    """vectors (id, ...) and queries (query_id, ...) with keys a, b by which each query meets each vector once: pieces of vectors by groups of queries. more: rows (query_id, id, ...), each with the key of its two."""
    pieces, groups = max(1, -(-vectors.count() // (piece or PIECE))), max(1, -(-queries.count() // (group or GROUP)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda name, of, n: F.pmod(F.xxhash64(F.col(name).cast(dict(of.dtypes)[name])), F.lit(n)).cast("int")
    a, b = own("id", vectors, pieces), own("query_id", queries, groups)
    found = [vectors.withColumn("a", a).withColumn("b", every(groups)), queries.withColumn("b", b).withColumn("a", every(pieces))]
    return found + [rows.withColumns({"a": a, "b": b}) for rows in more]


def _cosines(turned: np.ndarray, sizes: np.ndarray, norms: np.ndarray, some: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """nested.cosine of rows ``some`` by rows ``right``, and where it is null."""
    found = np.zeros((len(some), len(right)))
    with np.errstate(all="ignore"):
        for one in turned:
            found += one[some][:, None] * one[right]
        both = norms[some][:, None] * norms[right]
        found = np.where(both == 0, 0.0, found / both)
    return found, ((sizes[some][:, None] != sizes[right]) & (both != 0)) | (sizes[some] < 0)[:, None] | (sizes[right] < 0)


def known(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, known): whether a query has a cosine other than 0 with any vector of its key; see nearest."""
    schema = Y.StructType([f for f in queries.schema if f.name == "query_id"] + [Y.StructField("known", Y.BooleanType())])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, 2):
            asks = table.column("asks").to_numpy(zero_copy_only=False)
            units, sizes = matrix(table.column("v"))
            left, right, turned = np.flatnonzero(asks), np.flatnonzero(~asks), np.ascontiguousarray(units.T)
            norms, found = np.sqrt(summed(turned, turned, *[np.arange(len(units))] * 2)), np.zeros(len(units), bool)
            for at in range(0, len(right), 64):  # one vector is mostly enough
                rest = left[~found[left]]
                if not len(rest):
                    break
                cosines, none = _cosines(turned, sizes, norms, rest, right[at : at + 64])
                found[rest] = ((cosines != 0) & ~none).any(axis=1)
            yield pa.RecordBatch.from_arrays([table.column("query_id").combine_chunks().take(pa.array(left)), pa.array(found[left])], names=schema.names)

    both = vectors.select("a", "b", F.lit(False).alias("asks"), F.lit(None).cast(schema[0].dataType).alias("query_id"), F.col("v").cast("array<double>").alias("v"))
    both = both.unionByName(queries.select("a", "b", F.lit(True).alias("asks"), "query_id", F.col("q").cast("array<double>").alias("v")))
    each = both.repartition(width(vectors), "a", "b").sortWithinPartitions("a", "b").mapInArrow(compared, schema)
    return each.groupBy("query_id").agg(F.max("known").alias("known"))


def cosines(vectors: DataFrame, queries: DataFrame, similarities: DataFrame) -> DataFrame:
    """(query_id, id, cosine, known, similarity): each query of a key with each vector of it, and what similarities (a, b, query_id, id, similarity) say of the two, or 0.

    vectors: (a, b, id, v); queries: (a, b, query_id, q, known). No pair is moved.
    """
    kinds = {f.name: f.dataType for f in [*vectors.schema, *queries.schema]}
    fields = [("query_id", kinds["query_id"]), ("id", kinds["id"]), ("cosine", Y.DoubleType()), ("known", Y.BooleanType()), ("similarity", Y.DoubleType())]
    schema = Y.StructType([Y.StructField(*f) for f in fields])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, 2):
            kind = table.column("kind").to_numpy()
            left, right, said = (np.flatnonzero(kind == k) for k in (0, 1, 2))
            if not len(left) or not len(right):
                continue
            units, sizes = matrix(table.column("v"))
            turned = np.ascontiguousarray(units.T)
            norms = np.sqrt(summed(turned, turned, *[np.arange(len(units))] * 2))
            names, ids, flags = (table.column(c).combine_chunks() for c in ("query_id", "id", "known"))
            # Distinct names and ids by number; what is said of them by these numbers.
            of, to = names.take(pa.array(left)).dictionary_encode(), ids.take(pa.array(right)).dictionary_encode()
            asked, place = (pc.fill_null(x.indices, -1).to_numpy(zero_copy_only=False) for x in (of, to))
            told = [pc.fill_null(pc.index_in(x.take(pa.array(said)), value_set=y.dictionary), -1).to_numpy(zero_copy_only=False) for x, y in ((names, of), (ids, to))]
            there = (told[0] >= 0) & (told[1] >= 0)
            who, whom, value = told[0][there], told[1][there], table.column("similarity").to_numpy()[said][there]
            step = max(1, (CELLS >> 3) // len(right))
            for at in range(0, len(left), step):
                some, number = left[at : at + step], asked[at : at + step]
                found, none = _cosines(turned, sizes, norms, some, right)
                alike = np.zeros((len(some), len(to.dictionary) + 1))
                for row, query in enumerate(number):
                    if query >= 0 and len(who):
                        mine = who == query
                        alike[row, whom[mine]] = value[mine]
                x = np.repeat(some, len(right))
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(x)), ids.take(pa.array(np.tile(right, len(some)))), pa.array(found.ravel(), mask=none.ravel()), flags.take(pa.array(x)), pa.array(alike[:, place].ravel())], names=schema.names,
                )

    void = {"query_id": kinds["query_id"].simpleString(), "id": kinds["id"].simpleString(), "v": "array<double>", "known": "boolean", "similarity": "double"}

    def side(rows: DataFrame, kind: int, **there: str) -> DataFrame:
        return rows.select("a", "b", F.lit(kind).alias("kind"), *((F.col(there[n]) if n in there else F.lit(None)).cast(t).alias(n) for n, t in void.items()))

    both = side(queries, 0, query_id="query_id", v="q", known="known").unionByName(side(vectors, 1, id="id", v="v")).unionByName(side(similarities, 2, query_id="query_id", id="id", similarity="similarity"))
    return both.repartition(width(vectors), "a", "b").sortWithinPartitions("a", "b").mapInArrow(compared, schema)

"""Vectors compared in blocks, against one pair at a time."""

import math
import random

from pyspark.sql import functions as F

from veinstone.functions import nested
from veinstone.operators import blocks, resolve, search

SCHEMA = "row long, id string, label string, vector array<float>"


def odd_rows(seed, n, labels=3):
    rng = random.Random(seed)
    rows = [(k, f"i{k - k % 7 if k % 14 == 1 else k}", f"l{rng.randrange(labels)}", [rng.gauss(0, 1) for _ in range(5)]) for k in range(n)]
    odd = [None, [], [0.0] * 5, [1.0, None, 1.0, 1.0, 1.0], [math.nan] * 5, [1.0, 2.0], [2.0, 4.0], rows[3][3], rows[3][3]]
    rows += [(1000 + k, f"o{k}", "l0", v) for k, v in enumerate(odd)]
    return rows + [(None, "a", "l0", rows[0][3]), (2000, None, "l0", rows[0][3]), (2001, "b", None, rows[0][3])]


def one_by_one(nodes, threshold):
    """Pairs by a plain join."""
    unit = nodes.select("row", "id", "label", nested.normalised(F.col("vector")).alias("u"))
    met = unit.join(unit.select(F.col("row").alias("row_2"), F.col("id").alias("id_2"), "label", F.col("u").alias("u_2")), "label")
    met = met.where("row < row_2 AND id <> id_2").withColumn("c", nested.dot(F.col("u"), F.col("u_2"))).where(F.col("c") >= threshold)
    return sorted((r.row, r.row_2, repr(r.s)) for r in met.select("row", "row_2", F.round("c", 4).alias("s")).collect())


def test_pairs_in_pieces_equal_pairs_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(blocks, "CELLS", 50)
    monkeypatch.setattr(blocks, "SUMS", 7)
    nodes = spark.createDataFrame(odd_rows(1, 120), SCHEMA)
    for threshold, piece in ((0.5, 8), (0.5, 1000), (1.0, 16), (-1.0, 30)):
        found = sorted((r.i, r.j, repr(r.similarity)) for r in resolve.similar_pairs(nodes, threshold, piece=piece).collect())
        assert found == one_by_one(nodes, threshold) and found


def test_pairs_are_not_joined_row_by_row(spark):
    """A plan that evaluates each pair as a row took 1000 times as long."""
    nodes = spark.createDataFrame(odd_rows(2, 30), SCHEMA)
    plan = resolve.similar_pairs(nodes, 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan.replace("zip_with(vector", "") and "unit_2" not in plan


def test_scan_report_of_large_ids(spark, tmp_path):
    """Numbers of pairs are told apart whatever the ids: 0 and 1000002 are another pair than 1 and 2."""
    from veinstone.plans import graph

    rows = [(0, [1.0, 0.0], 1), (1_000_002, [1.0, 0.1], 1), (1, [0.0, 1.0], 2), (2, [0.1, 1.0], 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    row = graph.scan_report(spark, str(tmp_path)).first()
    assert (row.nodes, row.candidates, row.confirmed, row.rejected, row.estimated_after) == (4, 2, 2, 0, 2)


def test_classes_in_pieces(spark):
    """Links and classes as pairs one by one make them, with copies and in small pieces."""
    rng = random.Random(4)
    rows = [(k, rng.randrange(2), [rng.gauss(0, 1) for _ in range(6)]) for k in range(80)]
    rows += [(100 + k, label, v) for k, label, v in rows if k % 5 == 0]
    nodes = spark.createDataFrame([(k, str(k), str(label), v) for k, label, v in rows], SCHEMA)
    pairs = [(i, j) for i, j, _ in one_by_one(nodes, 0.7)]
    least = {k: k for k, *_ in rows}
    while any(least[i] != least[j] for i, j in pairs):
        for i, j in pairs:
            least[i] = least[j] = min(least[i], least[j])
    want = sorted((k, least[k], sum(k in p for p in pairs)) for k, *_ in rows)
    found = resolve.similar_classes(nodes.select(F.col("row").alias("id"), "label", "vector"), 0.7, piece=9)
    assert sorted((r.id, r.class_id, r.links) for r in found.collect()) == want


def test_classes_of_odd_vectors_and_of_chains(spark, monkeypatch):
    """Nulls, lengths and no-numbers among them, blocks of a few products; classes that only a long chain of links through several pieces holds together."""
    monkeypatch.setattr(blocks, "CELLS", 50)
    monkeypatch.setattr(blocks, "SUMS", 3)
    turns = [(3000 + (k * 37) % 60, f"t{k}", "turns", [math.cos(k / 20), math.sin(k / 20)]) for k in range(60)]
    nodes = spark.createDataFrame([r for r in odd_rows(7, 90) if None not in r[:3]] + turns, SCHEMA).withColumn("id", F.col("row").cast("string"))
    for threshold, piece in ((0.6, 8), (math.cos(0.051), 7), (0.9, 1000)):
        pairs = [(i, j) for i, j, _ in one_by_one(nodes, threshold)]
        least = {r.row: r.row for r in nodes.collect()}
        while any(least[i] != least[j] for i, j in pairs):
            for i, j in pairs:
                least[i] = least[j] = min(least[i], least[j])
        found = {r.id: (r.class_id, r.links) for r in resolve.similar_classes(nodes.select(F.col("row").alias("id"), "label", "vector"), threshold, piece=piece).collect()}
        assert found == {k: (least[k], sum(k in p for p in pairs)) for k in least}


def test_classes_write_rows_and_not_pairs(spark, monkeypatch):
    """300 vectors, all alike, make 44850 pairs; what is written on the way are rows."""
    written, settled = [], resolve.settled

    def counted(df, tag):
        table = settled(df, tag)
        written.append(table.count())
        return table

    monkeypatch.setattr(resolve, "settled", counted)
    nodes = spark.createDataFrame([(k, "l", [1.0, k / 1000]) for k in range(300)], "id long, label string, vector array<double>")
    assert {(r.class_id, r.links) for r in resolve.similar_classes(nodes, 0.5, piece=150).collect()} == {(0, 299)}
    assert written and max(written) <= 4 * 300


def test_length_of_a_vector_is_taken_once(spark):
    """Not for each component: within the lambda that divides, nothing sums."""
    vectors = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([1.0, None],), (None,), ([],)], "v array<double>")
    units = vectors.select(nested.normalised(F.col("v")).alias("u"))
    assert units._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
    assert [r.u for r in units.collect()] == [[0.6, 0.8], [0.0, 0.0], [None, None], None, []]


def test_nearest_in_blocks_equal_all_pairs(spark, monkeypatch):
    """Odd vectors, copies and ties at the k-th place among them; blocks of a few vectors and queries."""
    for name, value in (("CELLS", 50), ("SUMS", 7), ("PIECE", 16), ("GROUP", 4)):
        monkeypatch.setattr(blocks, name, value)
    rows = [(k, v) for k, _, _, v in odd_rows(5, 90) if k is not None] + [(3000 + k, odd_rows(5, 90)[8][3]) for k in range(40)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = vectors.where("vec_id % 10 = 8 OR vec_id >= 1000 AND vec_id < 1010").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    unit = vectors.select(F.col("vec_id").alias("id"), nested.normalised(F.col("embedding")).alias("v"))
    every = unit.crossJoin(asked.select("query_id", nested.normalised(F.col("vector")).alias("q"))).select("query_id", "id", F.round(nested.dot(F.col("v"), F.col("q")), 6).alias("score"))
    told = lambda df: sorted((r.query_id, r["rank"], r.id, repr(r.score)) for r in df.collect())
    for k in (3, 200):
        assert told(search.knn(vectors, asked, k)) == told(search.best(every, k))


def test_linear_hybrid_in_blocks_equals_all_pairs(spark, monkeypatch):
    for name, value in (("CELLS", 400), ("PIECE", 16), ("GROUP", 4)):
        monkeypatch.setattr(blocks, name, value)
    vectors = spark.createDataFrame([(k, v) for k, _, _, v in odd_rows(6, 60) if k is not None], "id long, vector array<float>")
    asked = vectors.where("id % 9 = 0 OR id > 999").withColumnRenamed("id", "query_id")
    said = asked.select("query_id").crossJoin(vectors.select("id")).where("(query_id + id) % 3 = 0").withColumn("similarity", F.col("id") / 2000.0)
    every = vectors.crossJoin(asked.withColumnRenamed("vector", "q")).select("query_id", "id", nested.cosine(F.col("vector"), F.col("q")).alias("cosine"))
    flags = every.groupBy("query_id").agg(F.max(F.when(F.col("cosine") != 0, 1).otherwise(0)).alias("known"))
    plain = every.join(flags, "query_id").join(said, ["query_id", "id"], "left").fillna(0.0, ["similarity"])
    plain = plain.select("query_id", "id", F.round(F.when(F.col("known") == 0, F.col("similarity")).otherwise(0.85 * F.col("cosine") + 0.15 * F.col("similarity")), 6).alias("score"))
    told = lambda df: sorted((r.query_id, r.id, repr(r.score)) for r in df.collect())
    assert told(search.linear_hybrid(vectors, asked, said)) == told(plain)

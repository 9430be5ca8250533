"""Approximate neighbours against exact ones, and first trails against all trails in order."""

import random

from pyspark.sql import functions as F

from veinstone.operators import edge_index, graph, resolve, search
from veinstone.operators.tables import looked_up
from veinstone.operators.vector_index import VectorIndex

FOLDER = "/root/testdata/sf0.1"


def test_recall_of_stored_cells(spark, tmp_path):
    """Queries are all vectors whose id is divisible by 100: at least nine of ten neighbours are found, though fewer than all vectors are compared."""
    vectors = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    index = VectorIndex(spark, f"file://{tmp_path}/index")
    index.upsert(vectors)
    exact = {(r.query_id, r.id): r.score for r in search.knn(vectors, asked, 10).collect()}
    found = index.search(asked, 10).collect()
    assert {(r.query_id, r.id): r.score for r in found if (r.query_id, r.id) in exact}.items() <= exact.items()
    recall = sum((r.query_id, r.id) in exact for r in found) / len(exact)
    compared = {r.query_id: r.candidates for r in found}
    print("recall", recall, "compared", sum(compared.values()) / len(compared), "of", vectors.count())
    assert recall >= 0.9 and max(compared.values()) < vectors.count()


def test_cells_take_upserts(spark, tmp_path):
    rng = random.Random(1)
    point = lambda a: [a + rng.gauss(0, 0.01), 1.0, rng.gauss(0, 0.01)]
    first = [(k, point(k % 5)) for k in range(200)] + [(500, None), (501, []), (None, [1.0, 1.0, 1.0])]
    index = VectorIndex(spark, f"file://{tmp_path}/index")
    asked = spark.createDataFrame([(1, [9.0, -9.0, 0.0]), (2, None)], "query_id long, vector array<double>")
    assert index.search(asked, 3).collect() == []
    index.upsert(spark.createDataFrame(first, "vec_id long, embedding array<double>"))
    assert [r.id for r in index.search(asked, 1, probes=2).collect()] != [7]
    index.upsert(spark.createDataFrame([(7, [9.0, -9.0, 0.0]), (600, [9.0, -8.9, 0.0])], "vec_id long, embedding array<double>"))
    found = index.search(asked, 3, probes=100).orderBy("rank").collect()
    assert [r.id for r in found][:2] == [7, 600] and {r.candidates for r in found} == {201}
    exact = search.knn(spark.createDataFrame([r for r in first if r[1] and r[0] is not None and r[0] != 7] + [(7, [9.0, -9.0, 0.0]), (600, [9.0, -8.9, 0.0])], "vec_id long, embedding array<double>"), asked.where("query_id = 1"), 3)
    assert sorted((r.id, r.score) for r in found) == sorted((r.id, r.score) for r in exact.collect())


def links(seed, nodes, edges):
    rng = random.Random(seed)
    rows = [(k, f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}") for k in range(edges)]
    return rows + [(1000 + k, "hub", f"n{k % nodes}") for k in range(60)] + [(2000, "n0", "hub"), (2001, "hub", "hub")]


def test_first_trails_are_the_first_of_all(spark):
    for seed, nodes, count in ((1, 12, 30), (2, 40, 45), (3, 6, 25)):
        edges = spark.createDataFrame(links(seed, nodes, count), "edge_id long, src string, dst string")
        starts = spark.createDataFrame([(f"n{k}",) for k in range(nodes)] + [("hub",), ("nowhere",)], "node string")
        every = {}
        for r in graph.paths(edges, starts).collect():
            along = list(zip(r.nodes[1:], r.edge_ids))
            every.setdefault(r.start, []).append((r.hops, along))
        want = {(start, nth, hops, tuple(along)) for start, trails in every.items() for nth, (hops, along) in enumerate(sorted(trails)[:7], 1)}
        found = {(r.start, r.nth, r.hops, tuple(zip(r.nodes[1:], r.edge_ids))) for r in graph.first_paths(edges, starts, 7).collect()}
        assert found == want


def test_a_hub_hands_over_few_edges(spark):
    edges = spark.range(20_000).selectExpr("id AS edge_id", "'hub' AS src", "concat('n', id) AS dst").unionByName(spark.createDataFrame([(50_000, "a", "hub")], "edge_id long, src string, dst string"))
    found = graph.first_paths(edges, spark.createDataFrame([("a",), ("hub",)], "node string"), 10)
    assert found.groupBy("start").count().where("count = 10").count() == 2
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "n19999" not in plan and found.count() == 20


def test_giant_component_and_common_text(spark):
    """A hub with most links, and a text with most documents, are right when they are dealt out."""
    pairs = spark.range(3000).selectExpr("'hub' AS a", "concat('n', id) AS b").unionByName(spark.createDataFrame([("x", "y"), ("y", "z"), (None, "q")], "a string, b string"))
    found = resolve.representatives(pairs)
    assert found.where("representative = 'hub'").count() == 3001 and {(r.node, r.representative) for r in found.where("node IN ('x', 'y', 'z')").collect()} == {("x", "x"), ("y", "x"), ("z", "x")}
    docs = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 4 < 3 THEN 'common' WHEN id % 40 = 3 THEN NULL ELSE concat('t', id % 300) END AS text")
    rows = {r.id: (r.first_id, r.status) for r in resolve.exact_duplicates(docs).collect()}
    first = {}
    for k in range(4000):
        first.setdefault("common" if k % 4 < 3 else None if k % 40 == 3 else f"t{k % 300}", k)
    assert rows == {k: (f, "new" if f == k else "fast_resume") for k in range(4000) for f in [first["common" if k % 4 < 3 else None if k % 40 == 3 else f"t{k % 300}"]]}


def test_lookup_deals_out_hot_keys(spark):
    left = spark.range(5000).selectExpr("id", "CASE WHEN id % 10 < 8 THEN 'hot' WHEN id % 10 = 8 THEN NULL ELSE concat('k', id % 50) END AS key")
    right = left.where("key IS NOT NULL").groupBy("key").count().withColumn("value", F.concat(F.lit("v-"), "key"))
    found = looked_up(left, right, "key", "count", F.col("id"))
    assert found.count() == 5000 and found.where("key IS NULL AND value IS NULL").count() == 500 and found.where("value = concat('v-', key)").count() == 4500


def test_stored_edges_read_one_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(edge_index, "FOLDER_EDGES", 50)
    edges = spark.createDataFrame(links(4, 30, 400), "edge_id long, src string, dst string").withColumn("type", F.lit("t"))
    index = edge_index.EdgeIndex(spark, f"file://{tmp_path}/edges")
    index.add(edges)
    for names in (["n3"], ["hub", "n7", "nowhere"]):
        for direction in ("out", "in", "both"):
            want = graph.relations(edges, F.col("node").isin(names), direction)
            assert sorted(map(str, index.relations(names, direction).select(*want.columns).collect())) == sorted(map(str, want.collect()))
    read = index.at(["n3"])
    assert len({f.split("folder=")[1].split("/")[0] for f in read.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}) == 1
    filters = read._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("ReadSchema")[0]
    assert "folder" in filters.split("PushedFilters")[0] and "EqualTo(src,n3)" in filters
    index.add(edges.limit(20).unionByName(spark.createDataFrame([(9000, "n3", "new")], "edge_id long, src string, dst string").withColumn("type", F.lit("t"))))
    assert index.at(["n3"]).count() == edges.where("src = 'n3'").count() + 1

from pyspark.sql import functions as F

from veinstone.functions import nested, text as T
from veinstone.operators import chunking, graph, profile, resolve, search, sessions
from veinstone.sources import files
from veinstone.streaming import events as streams


def test_memory(spark):
    memory = spark.createDataFrame([("global", "abc"), ("project", "x" * 10), ("session", " ")], "scope string, content string")
    assert sessions.memory_context(memory, {"global": 10, "project": 4, "session": 5}).first().context == "abc\n\n...xxxx"
    old = spark.createDataFrame([("p", "1", "a")], "scope string, scope_id string, content string")
    new = spark.createDataFrame([("p", "1", "b"), ("p", "2", "c")], "scope string, scope_id string, content string")
    now = F.lit("2024-01-02 03:04:05").cast("timestamp")
    assert {(r.scope_id, r.content) for r in files.memory_log(old, new, now).collect()} == {("1", "a\n\n---\n_记录于 2024-01-02 03:04_\n\nb"), ("2", "c")}
    assert {(r.scope_id, r.content) for r in files.memory_log(old, new, now, append=False).collect()} == {("1", "b"), ("2", "c")}
    turns = spark.createDataFrame([("t", 0, "a"), ("t", 1, "b")], "session string, turn int, text string")
    more = spark.createDataFrame([("sub_t", "r")], "task string, text string")
    assert {(r.turn, r.text) for r in sessions.append_sub_tasks(turns, more).collect()} == {(0, "a"), (1, "b\nr")}


def test_rows_for_stores(spark):
    assets = spark.createDataFrame([("a.png", "", "cap", None, "ZGF0YQ==", "a.png"), ("b.png", None, None, "chart", "ZA==", "b.png"), ("c.png", "d", None, None, None, "c.png")], "image_path string, description string, caption string, category string, data string, filename string")
    assert {(r.filename, r.text, r.category) for r in files.asset_rows(assets).collect()} == {("a.png", "cap", "general"), ("b.png", "No description provided", "chart")}
    chunks = spark.createDataFrame([("d", "c1", "x"), ("d", "c2", " "), ("d", "c3", None)], "doc_id string, chunk_id string, text string")
    assert [r._id for r in files.index_rows(chunks).collect()] == ["d_c1"]
    vectors = files.index_rows(chunks.unionAll(spark.createDataFrame([("d", f"k{k}", "y" * k) for k in range(1, 30)], chunks.schema)), lambda texts: [[float(len(t)), float(len(texts))] for t in texts])
    assert {r._id: r.vector[0] for r in vectors.collect()} == {"d_c1": 1.0} | {f"d_k{k}": float(k) for k in range(1, 30)} and vectors.where("vector[1] > 10").isEmpty()


def test_pairs_and_paths(spark):
    pairs = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "pair_id int, a string, b string")
    verdicts = spark.createDataFrame([(1, " yes", ""), (2, "NO", "x"), (9, "YES", "y")], "pair_id int, verdict string, canonical string")
    assert [(r.pair_id, r.canonical) for r in resolve.verified(pairs, verdicts).collect()] == [(1, "a")]
    assert resolve.questions(pairs).first().prompt.count("\n") == 1
    found = spark.createDataFrame([(["Quench", "Martensite"],)], "nodes array<string>")
    assert graph.path_coverage(found, ["martensite", "strength"]).first().coverage == 0.5
    assert resolve.stored_already(spark.createDataFrame([("h",), ("i",)], "hash string"), spark.createDataFrame([("h",)], "hash string")).count() == 1


def test_chunks_and_tables(spark):
    text = spark.createDataFrame([("d", 0, "t")], "doc_id string, chunk int, text string")
    figures = spark.createDataFrame([("d", 4, "f", "img/a.png")], "doc_id string, line int, text string, image_path string")
    assert [(r.part, r.ordinal) for r in chunking.with_figures(text, figures).orderBy("part").collect()] == [(0, 0), (1, 4)]
    images = spark.createDataFrame([("d", "img/a.png"), ("d", "img/b.png")], "doc_id string, image_path string")
    assert [r.image_path for r in chunking.unreferenced(images, figures).collect()] == ["img/b.png"]
    cells = spark.createDataFrame([("t", 0, 0, "a"), ("t", 3, 0, " "), ("t", 1, 0, "b")], "table_id string, row int, col int, value string")
    assert profile.effective_rows(cells).first().rows == 2
    assert profile.named_columns(spark.createDataFrame([(1, 2)], "`_c0` int, b int")).columns == ["Col_0", "b"]
    filled = profile.last_filled(spark.createDataFrame([("d", 0, None), ("d", 1, 5), ("d", 2, None)], "k string, o int, v int"), "k", "o", "v")
    assert [r.v for r in filled.orderBy("o").collect()] == [None, 5, 5]
    assert spark.range(1).select(chunking.chunk_id(F.lit("d"), F.lit(1), F.lit("x")).alias("c")).first().c.startswith("chunk_")


def test_streams_and_search(spark):
    last = spark.sql("SELECT 'a' AS key, TIMESTAMP '2024-01-01 00:00:00' AS ts UNION ALL SELECT 'b', TIMESTAMP '2024-01-01 00:15:00'")
    assert [r.key for r in streams.idle_since(last, F.lit("2024-01-01 00:16:00").cast("timestamp")).collect()] == ["a"]
    box = spark.sql("SELECT named_struct('x0', 0.1, 'y0', 0.2, 'x1', 0.5, 'y1', 1.0) AS b").select(nested.page_points(F.col("b"), F.lit(100.0), F.lit(200.0)).alias("p")).first().p
    assert (box.x0, box.y1) == (10.0, 200.0)
    queries = spark.createDataFrame([(1, "tensile strength of q345b")], "query_id int, query string")
    synonyms = spark.createDataFrame([("strength", f"s{k}") for k in range(12)], "term string, synonym string")
    clauses = search.query_clauses(queries, synonyms)
    assert clauses.where("clause = 'strength' AND term RLIKE '^s[0-9]+$'").count() == 8 and clauses.where("clause = 'q345b' AND term = '345'").count() == 1
    assert spark.range(1).select(T.file_safe(F.lit("a b/ü")).alias("f")).first().f == "a_b_ü"

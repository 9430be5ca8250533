import random

from pyspark.sql import functions as F

from veinstone.operators import chunking, graph, profile, resolve, search, sessions


def test_page_map_and_mode(spark):
    lines = ["# 第一章 绪论", "a", "b", "![](_page_2_figure1.png)", "c", "", "## 第二章 实验方法"]
    docs = spark.createDataFrame([("d", "\n".join(lines), [("第一章 绪论", 0), ("第二章 实验方法", 4)])], "doc_id string, text string, toc array<struct<title:string,page_id:int>>")
    pages = chunking.page_map(docs)
    assert [r.page for r in pages.orderBy("line").collect()] == [1, 1, 1, 3, 3, 3, 5]
    given = spark.createDataFrame([("d", k, p) for k, p in enumerate([1, 1, 1, 3, 3, 3, 5, 5, 5])], "doc_id string, line int, page int")
    spans = [(0, 2, 1), (3, 5, 3), (2, 4, 3), (0, 8, 1), (7, 7, 5), (-5, 2, 1), (7, 999, 5), (300, 400, -1)]
    chunks = spark.createDataFrame([("d", k, a, b) for k, (a, b, _) in enumerate(spans)], "doc_id string, chunk int, start int, end int")
    assert [r.page for r in chunking.chunk_pages(chunks, given).orderBy("chunk").collect()] == [p for *_, p in spans]


def test_packing(spark):
    docs = spark.createDataFrame([("d", "aaa\n\nbb\n\ncccc"), ("e", "")], "doc_id string, text string")
    assert [r.text for r in chunking.pack(docs, 5, 2).orderBy("chunk").collect()] == ["aaa\n\nbb", "bb\n\ncccc"]


def test_headings_and_figures(spark):
    text = "# A\nx\n## B\ny\n# C\nz"
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    assert [(r.context, r.text) for r in chunking.by_heading(docs).collect()] == [("C", text)]
    # A heading closes what is over half full, under its own path; a full chunk is closed under the path it has.
    assert [(r.context, r.text) for r in chunking.by_heading(docs, 6).orderBy("chunk").collect()] == [("A > B", "# A\nx"), ("C", "## B\ny"), ("C", "# C\nz")]
    assert [(r.context, r.text) for r in chunking.by_heading(docs, 4).orderBy("chunk").collect()] == [("A", "# A\nx"), ("A > B", "## B"), ("C", "y\n# C"), ("C", "z")]
    assert chunking.by_heading(spark.createDataFrame([("d", " \n"), ("e", "")], "doc_id string, text string")).collect() == []
    figure = spark.createDataFrame([("d", "before\n![alt](img/a.png)\n\n图 1 组织\nafter")], "doc_id string, text string")
    found = chunking.figure_text(chunking.figures(figure)).first()
    assert (found.caption, found.context_above, found.image_path) == ("图 1 组织", "before", "img/a.png")
    assert "图 1 组织" in found.text and "before" in found.text


def test_headed_paragraphs_and_grids(spark):
    paragraphs = spark.createDataFrame([("d", 0, "Heading 1", "H"), ("d", 1, "Normal", "a"), ("d", 2, "Normal", "b"), ("d", 3, "Heading 2", "empty"), ("d", 4, "Heading 1", "I"), ("d", 5, "Normal", "c")], "doc_id string, pos int, style string, text string")
    assert [(r.heading, r.text) for r in chunking.under_headings(paragraphs).orderBy("section").collect()] == [("H", "a\nb"), ("I", "c")]
    cells = spark.createDataFrame([("t", r, c, v) for r, row in enumerate([["name", "size"], ["1", "2"], ["3", "4"]]) for c, v in enumerate(row)], "table_id string, row int, col int, text string")
    assert [r.text for r in chunking.grid_key_values(cells).orderBy("row").collect()] == ["name: 1;size: 2\nname: 3;size: 4"]
    wide = spark.createDataFrame([("t", r, c, v) for r, row in enumerate([["a", "b", "c", "d"], ["e", "b", "", "f"], ["1", "2", "3", "4"], ["x y", "x z", "zz", "w w"], ["5", "6", "", "8"]]) for c, v in enumerate(row)], "table_id string, row int, col int, text string")
    assert [(r.row, r.text) for r in chunking.grid_key_values(wide).orderBy("row").collect()] == [(1, "a: e;b: b;d: f"), (2, "a: 1;b: 2;c: 3;d: 4"), (3, "a: x y;b: x z;c: zz;d: w w"), (4, "a: 5;b: 6;d: 8")]
    tables = spark.createDataFrame([("d", 0, "k: v"), ("d", 1, " ")], "doc_id string, table_id int, text string")
    assert [(r.kind, r.text) for r in chunking.under_headings(paragraphs, tables).orderBy("kind", "section").collect()] == [("paragraph", "a\nb"), ("paragraph", "c"), ("table", "k: v")]


def test_duplicate_pairs(spark):
    rows = [(0, "n1", "Material", [1.0, 0.0, 0.0]), (1, "n2", "Material", [1.0, 0.0, 0.0]), (2, "n3", "Equipment", [0.0, 1.0, 0.0]), (3, "n4", "Process", [1.0, 0.0, 0.0]), (4, "n1", "Material", [1.0, 0.0, 0.0])]
    nodes = spark.createDataFrame(rows, "row int, id string, label string, vector array<double>")
    assert sorted((r.i, r.j) for r in resolve.similar_pairs(nodes, 0.9).collect()) == [(0, 1), (1, 4)]


def test_upsert(spark):
    rows = [(1, "Q345 Steel", "Material", "has_property", "强度", "Property", "m1", "", "d1"), (2, "q345 steel", "Material", "has_property", "强度", "Property", "m2", "", "d1"), (3, "Q345 Steel", "Material", "has_property", "", "Property", "x", "", "d1"), (4, "a", "Alloy", "has_property", "b", "Property", "x", "", "d1")]
    triplets = spark.createDataFrame(rows, "seq long, subject string, subject_type string, relation string, object string, object_type string, mechanism string, context string, doc_id string")
    good, bad = graph.checked_triplets(triplets)
    assert sorted((r.label, r.id, r.name) for r in graph.upsert_nodes(good).collect()) == [("Material", "q345_steel", "Q345 Steel"), ("Property", "强度", "强度")]
    edge = graph.upsert_edges(good).collect()
    assert [(e.type, e.mechanism, e.weight) for e in edge] == [("HAS_PROPERTY", "m2", 2)] and [r.subject for r in bad.collect()] == ["a"]
    again = graph.upsert_edges(good, graph.upsert_edges(good)).first()
    assert again.weight == 4


def test_trails(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (2, "b", "a"), (3, "b", "c")], "edge_id long, src string, dst string")
    starts = spark.createDataFrame([("a",)], "node string")
    assert sorted("".join(r.nodes) for r in graph.paths(edges, starts).collect()) == ["ab", "aba", "abc"]
    assert sorted("".join(r.nodes) for r in graph.paths(edges, spark.createDataFrame([("b",)], "node string")).collect()) == ["ba", "bab", "babc", "bc"]


def test_fusion(spark):
    items = [(0, k, True, c, None, c) for k, c in enumerate("abc")] + [(1, k, True, c, None, c) for k, c in enumerate("bd")] + [(1, 2, True, None, "x", "n"), (1, 3, False, None, "unknown", "u")]
    lists = spark.createDataFrame(items, "list int, rank int, has_chunk_id boolean, chunk_id string, doc_id string, payload string")
    fused = search.fuse_lists(lists).orderBy(F.desc("score")).collect()
    assert [r.uid for r in fused] == ["b", "a", "d", "c"] and abs(fused[0].score - (1 / 62 + 1 / 61)) < 1e-8


def test_column_types(spark):
    columns = {"a": ["1", "2", "x"], "b": ["1.5", "2.5", "3"], "c": ["yes", "是", "no"], "d": ["1", "x"], "e": ["", ""], "f": ["9223372036854775808", "1"], "g": ["10", "3.5", "11"]}
    cells = spark.createDataFrame([(c, v) for c, vs in columns.items() for v in vs], "column string, value string")
    assert {r.column: r.type for r in profile.column_types(cells).collect()} == {"a": "int", "b": "float", "c": "bool", "d": "int", "e": "float", "f": "float", "g": "int"}
    assert profile.simple_headers(["a ", "", None]) == ["a", "Column_2", "Column_3"] and profile.field_name("Size (mm)/x", "float") == "size_flt"


def test_merged_headers(spark):
    cells = spark.createDataFrame([("t", 0, 0, "Load"), ("t", 0, 1, None), ("t", 1, 0, "min"), ("t", 1, 1, "max"), ("t", 2, 0, "1"), ("t", 2, 1, "2")], "table_id string, row int, col int, value string")
    merges = spark.createDataFrame([("t", 0, 0, 0, 1)], "table_id string, r1 int, c1 int, r2 int, c2 int")
    headers = profile.header_rows(cells)
    assert headers.first().header_rows == 2
    assert {r.col: r.header for r in profile.merged_headers(cells, merges, headers).collect()} == {0: "Load-min", 1: "Load-max"}


def test_history(spark):
    turns = spark.createDataFrame([("s", k, "x" * 100) for k in range(20)] + [("t", 0, "y" * 5000)], "session string, turn long, text string")
    found = sessions.folded_history(turns, 500)
    assert found.where("session = 's' AND seq >= 0").count() == 10 and "10" in found.where("session = 's' AND seq < 0").first().text
    assert [r.seq for r in found.where("session = 't'").collect()] == [-1]


def test_representatives(spark):
    pairs = spark.createDataFrame([(k, k + 1) for k in range(12)] + [(20, 21)], "a long, b long")
    assert {r.node: r.representative for r in resolve.representatives(pairs).collect()} == {**{k: 0 for k in range(13)}, 20: 20, 21: 20}


def test_representatives_of_long_chains(spark):
    """Two chains of 300 nodes: one in order, one shuffled."""
    order = list(range(1000, 1300))
    random.Random(5).shuffle(order)
    pairs = spark.createDataFrame([(k, k + 1) for k in range(299)] + list(zip(order, order[1:])), "a long, b long")
    assert {r.node: r.representative for r in resolve.representatives(pairs).collect()} == {**{k: 0 for k in range(300)}, **{k: 1000 for k in range(1000, 1300)}}


def test_merge_undirected_and_registry(spark):
    columns = "src string, dst string, weight double, description string, keywords string, source_id string, seq int"
    base, new = spark.createDataFrame([("b", "a", None, "old", "k", "1", 0)], columns), spark.createDataFrame([("a", "b", None, "new", "", "2", 0)], columns)
    merged = graph.merge_undirected(base, new).first()
    assert (merged.a, merged.b, merged.weight, merged.description, merged.keywords, merged.source_ids) == ("a", "b", 1.0, "old<SEP>new", "k", "1,2")
    columns = "node string, kind string, description string, source_id string, seq int"
    nodes, _ = graph.merge_subgraph(spark.createDataFrame([("a", "X", "one", "1", 0), ("c", "Z", None, "3", 1)], columns), base, spark.createDataFrame([("a", "Y", "two", "2", 0)], columns), new)
    assert {tuple(r) for r in nodes.collect()} == {("a", "X", "one<SEP>two", "1,2", 1), ("c", "Z", "", "3", 0)}
    from veinstone.registry import Entry, Registry

    tools = Registry()
    tools.register(lambda x: 10 // x, Entry("divide", "divides ten", "math", "quotient", should_defer=False))
    assert tools.call("divide", 5)["result"] == 2 and tools.call("divide", 0)["status"] == "error" and tools.names(deferred=False) == ["divide"]
    assert search.catalog_search(tools.catalog(spark), "divide quotient").first().score == 14

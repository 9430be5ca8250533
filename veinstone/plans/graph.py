"""Graph, duplicate and entity queries over the relational tables, documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.operators import graph, resolve
from veinstone.operators.edge_index import EdgeIndex
from veinstone.operators.tables import settled
from veinstone.plans.tables import kept_at, table
from veinstone.sources import files


def _triplets(spark: SparkSession, d: str) -> DataFrame:
    """Supplies as triplets: many repeat, some are invalid or incomplete."""
    item = table(spark, d, "lineitem")
    return item.select(
        F.when(F.col("l_suppkey") % 50 != 0, F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string"))).alias("subject"),
        F.when(F.col("l_suppkey") % 17 == 0, "Person").otherwise("Equip ment").alias("subject_type"),
        F.when(F.col("l_returnflag") == "R", "degrades").otherwise("produces").alias("relation"),
        F.concat(F.lit(" Part "), F.col("l_partkey").cast("string")).alias("object"), F.lit("Material").alias("object_type"),
        F.concat_ws("-", "l_returnflag", F.col("l_linenumber").cast("string"), F.col("l_orderkey").cast("string")).alias("mechanism"), F.col("l_linestatus").alias("context"),
        F.when(F.col("l_linestatus") == "O", F.lit("doc_open")).alias("doc_id"), _seq().alias("seq"),
    )


def _seq():
    """A total order of line items, repeated keys included."""
    price = F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long")
    return (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000_000 + F.pmod(price + F.col("l_partkey") * 7919 + F.col("l_suppkey") * 31, F.lit(100_000_000))


_TRIPLETS = """
raw AS (
  SELECT CASE WHEN l_suppkey % 50 <> 0 THEN 'supplier_' || l_suppkey END AS subject, CASE WHEN l_suppkey % 50 <> 0 THEN 'Supplier ' || l_suppkey END AS sname, l_suppkey % 17 = 0 AS bad,
         CASE WHEN l_returnflag = 'R' THEN 'DEGRADES' ELSE 'PRODUCES' END AS type, 'part_' || l_partkey AS object, 'Part ' || l_partkey AS oname,
         concat_ws('-', l_returnflag, l_linenumber, l_orderkey) AS mechanism, l_linestatus AS context, CASE WHEN l_linestatus = 'O' THEN 'doc_open' ELSE 'global_storage_router' END AS doc_id,
         (l_orderkey * 10 + l_linenumber) * 100000000 + (CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) + l_partkey * 7919 + l_suppkey * 31) % 100000000 AS seq
  FROM lineitem),
good AS (SELECT * FROM raw WHERE subject IS NOT NULL AND NOT bad)"""


def graph_upsert_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.upsert_edges(graph.checked_triplets(_triplets(spark, d))[0])


def graph_upsert_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.upsert_nodes(graph.checked_triplets(_triplets(spark, d))[0])


def graph_rejects(spark: SparkSession, d: str) -> DataFrame:
    return graph.checked_triplets(_triplets(spark, d))[1].groupBy("subject").agg(F.count("*").alias("n"))


def _places(spark: SparkSession, d: str) -> DataFrame:
    """order -> customer -> nation -> region, with edge numbers."""
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    orders = table(spark, d, "orders").select((F.col("o_orderkey") * 4).alias("edge_id"), node("o", "o_orderkey").alias("src"), F.lit("BOUGHT_BY").alias("type"), node("c", "o_custkey").alias("dst"))
    customers = table(spark, d, "customer").select((F.col("c_custkey") * 4 + 1).alias("edge_id"), node("c", "c_custkey").alias("src"), F.lit("LIVES_IN").alias("type"), node("n", "c_nationkey").alias("dst"))
    nations = table(spark, d, "nation").select((F.col("n_nationkey").cast("long") * 4 + 2).alias("edge_id"), node("n", "n_nationkey").alias("src"), F.lit("LIES_IN").alias("type"), node("r", "n_regionkey").alias("dst"))
    return orders.unionByName(customers).unionByName(nations)


_PLACES = """
places AS (
  SELECT o_orderkey * 4 AS edge_id, 'o' || o_orderkey AS src, 'BOUGHT_BY' AS type, 'c' || o_custkey AS dst FROM orders
  UNION ALL SELECT c_custkey * 4 + 1, 'c' || c_custkey, 'LIVES_IN', 'n' || c_nationkey FROM customer
  UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 4 + 2, 'n' || n_nationkey, 'LIES_IN', 'r' || n_regionkey FROM nation)"""


def edge_index(spark: SparkSession, d: str) -> EdgeIndex:
    """The stored edges of the places; whoever asks first writes them."""
    index = EdgeIndex(spark, kept_at(spark, d, "orders", "customer", "nation"))
    if not index.versions.latest():
        index.add(_places(spark, d))
    return index


def one_hop(direction: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        """Relations of the first ten nations and a customer, from the stored edges."""
        return edge_index(spark, d).relations([*(f"n{k}" for k in range(10)), "c77"], direction).select("node", "type", "other", "direction")

    return query


def _one_hop_sql(direction: str) -> str:
    out = "SELECT src AS node, type, dst AS other, 'out' AS direction FROM places WHERE regexp_full_match(src, 'n[0-9]') OR src = 'c77'"
    into = "SELECT dst AS node, type, src AS other, 'in' AS direction FROM places WHERE regexp_full_match(dst, 'n[0-9]') OR dst = 'c77'"
    return f"WITH {_PLACES} " + {"out": out, "in": into, "both": f"{out} UNION ALL {into}"}[direction]


def impact_paths(spark: SparkSession, d: str) -> DataFrame:
    """Trails of up to three hops from orders whose number is divisible by 100."""
    starts = table(spark, d, "orders").where("o_orderkey % 100 = 0").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"))
    found = graph.paths(_places(spark, d), starts, 3)
    return found.select("start", F.col("hops").cast("long").alias("hops"), F.array_join("nodes", " -> ").alias("path"))


def _place_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the places' graph: id, label and name."""
    of = lambda name, kind, key, label, shown: table(spark, d, name).select(F.concat(F.lit(kind), F.col(key).cast("string")).alias("id"), F.lit(label).alias("label"), F.col(shown).cast("string").alias("name"))
    return of("orders", "o", "o_orderkey", "Order", "o_orderstatus").unionByName(of("customer", "c", "c_custkey", "Customer", "c_name")).unionByName(of("nation", "n", "n_nationkey", "Nation", "n_name")).unionByName(of("region", "r", "r_regionkey", "Region", "r_name"))


_PLACE_NODES = """
place_nodes AS (
  SELECT 'o' || o_orderkey AS id, 'Order' AS label, o_orderstatus AS name FROM orders UNION ALL SELECT 'c' || c_custkey, 'Customer', c_name FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'Nation', n_name FROM nation UNION ALL SELECT 'r' || r_regionkey, 'Region', r_name FROM region)"""


def ego_graph(spark: SparkSession, d: str) -> DataFrame:
    """Links at nation 3, and the nodes at their ends, as one listing."""
    links, nodes = graph.ego(_places(spark, d), _place_nodes(spark, d), F.col("id") == "n3")
    return links.select(F.lit("link").alias("kind"), F.concat_ws(" ", "src", "type", "dst").alias("item")).unionByName(nodes.select(F.lit("node").alias("kind"), F.col("id").alias("item")))


def neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    """What is at the nation whose name the first customer's nation has, by name, with the properties of both ends."""
    found = graph.neighbourhood(_places(spark, d), _place_nodes(spark, d), "FRANCE").unionByName(graph.neighbourhood(_places(spark, d), _place_nodes(spark, d), "r1"))
    return found.select("node", "type", "other", "direction", F.get_json_object("node_properties", "$.name").alias("name"), F.get_json_object("other_properties", "$.label").alias("label"))


def property_scan(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and edges with a property that holds one of two parts."""
    parts = ["c77", "MIDDLE"]
    nodes = graph.property_hits(_place_nodes(spark, d), parts).select(F.col("id").alias("item"))
    return nodes.unionByName(graph.property_hits(_places(spark, d), parts).select(F.concat_ws(" ", "src", "type", "dst").alias("item")))


def relations_to(spark: SparkSession, d: str) -> DataFrame:
    found = graph.relations_to(_places(spark, d), _place_nodes(spark, d), F.col("type") == "LIES_IN", ["EAST", "ASIA"])
    return found.select("src", "dst")


def listed_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.listed_nodes(_place_nodes(spark, d))


def entity_matches(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that a name means: by id, name, or name whatever the case."""
    names = ["R1", "france", "Customer#000000007", "unheard of"]
    found = None
    for name in names:
        part = _place_nodes(spark, d).where(graph.matches(name)).select(F.lit(name).alias("asked"), "id")
        found = part if found is None else found.unionByName(part)
    return found


def relation_block(spark: SparkSession, d: str) -> DataFrame:
    """The first three relations of each region as a tool shows them."""
    into = graph.relations(_places(spark, d), F.col("node").startswith("r"), "in")
    text = graph.relation_text(graph.labelled(F.col("other"), F.lit("Nation")), F.col("type"), graph.labelled(F.col("node"), F.lit("Region")), F.lit("tpch"), F.when(F.col("edge_id") % 3 == 0, F.col("type")), F.when(F.col("edge_id") % 2 == 0, F.lit("map")).otherwise(""))
    return graph.relation_lines(into, "node", text, [F.asc("edge_id")], 3)


def path_block(spark: SparkSession, d: str) -> DataFrame:
    """Trails from every customer as numbered lines."""
    starts = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    return graph.path_lines(graph.paths(_places(spark, d), starts, 3), "start", [F.asc("hops"), F.asc("nodes")])


def path_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How many of three names stand in the trails from customers."""
    starts = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    found = graph.path_coverage(graph.paths(_places(spark, d), starts, 2), ["R1", "n1", "C2"])
    return found.select("start", F.array_join("nodes", ">").alias("path"), F.array_join("hit", ",").alias("hit"), "coverage")


def _described(spark: SparkSession, d: str, status: str) -> DataFrame:
    item = table(spark, d, "lineitem").where(F.col("l_linestatus") == status)
    return item.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("node"), F.col("l_returnflag").alias("kind"), F.when(F.col("l_linenumber") != 3, F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))).alias("description"), F.col("l_orderkey").alias("source_id"), _seq().alias("seq"))


def subgraph_merge(spark: SparkSession, d: str) -> DataFrame:
    """Parts and suppliers as two graphs merged: nodes with kind, texts and rank."""
    edges = lambda flag: _undirected(spark, d, flag)
    nodes, _ = graph.merge_subgraph(_described(spark, d, "O"), edges("A"), _described(spark, d, "F"), edges("R"))
    return nodes.select("node", "kind", F.md5("description").alias("description"), F.md5("source_ids").alias("source_ids"), "rank")


def export_statements(spark: SparkSession, d: str) -> DataFrame:
    """Nations and regions as statements for a graph shell."""
    nodes = table(spark, d, "region").select(F.col("r_name").alias("node"), F.lit("Big Place-1").alias("kind"), F.concat(F.lit("it's "), "r_name").alias("description"), F.col("r_regionkey").alias("rank"))
    edges = table(spark, d, "nation").select(F.col("n_name").alias("a"), F.col("n_regionkey").cast("string").alias("b"), F.when(F.col("n_nationkey") % 2 == 0, F.lit(2.0)).alias("weight"), F.lit(None).cast("string").alias("description"))
    return files.merge_statements(nodes, edges)


def reindex(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each store after the orders of priority 1 are indexed anew, under customers a million higher."""
    chunks = table(spark, d, "orders").select(F.col("o_orderpriority").alias("doc_id"), "o_orderkey")
    edges = table(spark, d, "orders").select(F.col("o_orderpriority").alias("doc_id"), F.col("o_orderkey").cast("string").alias("src"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("dst"))
    nodes = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    urgent, moved = F.col("doc_id") == "1-URGENT", F.concat(F.lit("c1"), F.substring("dst", 2, 20))
    stores = graph.reindexed(urgent, chunks, edges, nodes, chunks.where(urgent), edges.where(urgent).withColumn("dst", moved), edges.where(urgent).select(moved.alias("node")))
    found = [store.agg(F.count("*").alias("rows")).select(F.lit(name).alias("store"), "rows") for name, store in zip(("chunks", "edges", "nodes"), stores)]
    return found[0].unionByName(found[1]).unionByName(found[2])


def impact_paths_first(spark: SparkSession, d: str) -> DataFrame:
    """The first ten trails of each region and nation down to orders: hubs, of which all trails are thousands of times as many."""
    down = _places(spark, d).select("edge_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    starts = down.where(F.col("src").rlike("^[rn]")).select(F.col("src").alias("node")).distinct()
    found = graph.first_paths(down, starts, 10)
    return found.select("start", F.col("nth").cast("long").alias("nth"), F.col("hops").cast("long").alias("hops"), F.array_join("nodes", " -> ").alias("path"))


def table_functions(spark: SparkSession, d: str) -> DataFrame:
    """Nations, relations and trails by table functions in SQL; every region leads back to a nation and to itself, so there are cycles and loops."""
    from veinstone import registry

    catalog = table(spark, d, "part").select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), F.lit("part of a machine").alias("description"), F.lit("parts").alias("category"), F.lit("small red ring").alias("search_hint")).distinct()
    back = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("k"), F.explode(F.array(F.lit("n"), F.lit("r"))).alias("to"))
    back = back.select((-1 - F.col("k") * 2 - F.when(F.col("to") == "n", 0).otherwise(1)).alias("edge_id"), F.concat(F.lit("r"), F.col("k").cast("string")).alias("src"), F.lit("LEADS_TO").alias("type"), F.concat("to", F.col("k").cast("string")).alias("dst"))
    registry.register_tables(spark, {"relations": _places(spark, d).unionByName(back), "catalog": catalog})
    return spark.sql("SELECT 'relation' AS kind, concat_ws(' ', node, type, other, direction) AS item FROM graph_relations('n3') UNION ALL SELECT 'path', path FROM impact_path('c77') UNION ALL SELECT 'path', path FROM impact_path('r1') UNION ALL SELECT 'tool', concat_ws(' ', name, score) FROM search_tools('ring', 5)")


def graph_sample(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 edges by number, with their ends."""
    edges = graph.first_edges(_places(spark, d), 200, ["edge_id"])
    return edges.select("edge_id", "src", "dst", graph.relation_text(F.col("src"), F.col("type"), F.col("dst"), F.lit("tpch")).alias("text"))


def _undirected(spark: SparkSession, d: str, flag: str) -> DataFrame:
    item = table(spark, d, "lineitem").where(F.col("l_returnflag") == flag)
    return item.select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("weight"),
        F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("description"), F.when(F.col("l_linenumber") != 2, F.col("l_linestatus")).alias("keywords"), F.col("l_orderkey").alias("source_id"), _seq().alias("seq"),
    )


def graph_merge_undirected(spark: SparkSession, d: str) -> DataFrame:
    return graph.merge_undirected(_undirected(spark, d, "A"), _undirected(spark, d, "R"))


def degree_rank(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_places(spark, d))


def orphan_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Customers without dear orders, by graph."""
    nodes = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    dear = table(spark, d, "orders").where("o_totalprice > 250000").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("src"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("dst"))
    return graph.orphans(nodes, dear)


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """What deleting the orders of priority 1 takes: rows, edges, and customers left without an edge."""
    chunks = table(spark, d, "orders").withColumn("doc_id", F.col("o_orderpriority"))
    edges = chunks.select("doc_id", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("src"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("dst"))
    nodes = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    return graph.cascade_delete(F.col("doc_id") == "1-URGENT", chunks, edges, nodes)[3]


def verify_storage(spark: SparkSession, d: str) -> DataFrame:
    """Documents against their conversations as chunks and labels as edges."""
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 10 != 0).alias("has_meta"))
    chunks = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"))
    return graph.verify_storage(docs, chunks, table(spark, d, "labels"))


def update_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = graph.update_edges(_places(spark, d), F.col("type") == "LIVES_IN", "type", F.lit("RESIDES_IN"))
    return edges.groupBy("type").agg(F.count_if("updated").alias("updated"), F.count("*").alias("edges"))


def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return resolve.exact_duplicates(table(spark, d, "documents"))


def embedding_pairs(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    return resolve.similar_pairs(nodes, 0.30)


def embedding_classes(spark: SparkSession, d: str) -> DataFrame:
    """The class of each vector along links of 0.34 or more within a label, and its number of links; every seventh vector is a copy of another."""
    vectors = table(spark, d, "embeddings")
    copies = vectors.where("vec_id % 7 = 0").withColumn("vec_id", F.col("vec_id") + 1_000_000)
    return resolve.similar_classes(vectors.unionByName(copies).select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector")), 0.34)


def er_rule_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Names of parts that may be one, within their last word."""
    names = table(spark, d, "part").select(F.col("p_name").alias("name"))
    return resolve.rule_pairs(names, F.substring_index("name", " ", -1))


def merge_apply(spark: SparkSession, d: str) -> DataFrame:
    """Customers of one nation and segment merged along pairs of neighbours; their orders' edges rewired."""
    customer = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 3).alias("b"), "c_nationkey")
    pairs = customer.where("c_nationkey < 12").select("a", "b")
    canon = resolve.representatives(pairs)
    edges = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.lit("BOUGHT").alias("type"), (-F.col("o_orderkey") - 1).alias("dst"))
    return resolve.merge_nodes(edges, canon).groupBy("src", "type", "orig_type").agg(F.count("*").alias("edges"))


def scan_report(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    pairs = settled(resolve.similar_pairs(nodes, 0.30), "scanned-pairs")
    numbered = pairs.select(F.struct("i", "j").alias("pair_id"), F.col("i").cast("string").alias("a"), F.col("j").cast("string").alias("b"), "similarity")
    verdicts = numbered.select("pair_id", F.when(F.col("similarity") >= 0.35, " yes ").otherwise("NO").alias("verdict"), F.lit("").alias("canonical"))
    return resolve.scan_report(numbered, resolve.verified(numbered, verdicts), nodes)


_UNIT = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))))"
_PAIRS = f"SELECT a.vec_id AS i, b.vec_id AS j, round({_UNIT}, 4) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_UNIT} >= 0.30"
_ER = """
WITH n AS (SELECT DISTINCT p_name AS name, split_part(p_name, ' ', 2) AS block FROM part)
SELECT a.name AS a, b.name AS b FROM n a JOIN n b ON a.block = b.block AND a.name < b.name
WHERE levenshtein(a.name, b.name) <= least(length(a.name), length(b.name)) // 2
  AND NOT regexp_matches(a.name || b.name, '[0-9]')
"""
_MERGE = """
WITH RECURSIVE pairs AS (SELECT c_custkey AS a, c_custkey + 3 AS b FROM customer WHERE c_custkey % 3 = 0 AND c_nationkey < 12),
firsts AS (SELECT a AS node, a AS rep FROM pairs WHERE a NOT IN (SELECT b FROM pairs) UNION ALL SELECT b, rep FROM firsts JOIN pairs ON a = node),
e AS (SELECT o_custkey AS src, rep FROM orders LEFT JOIN firsts ON node = o_custkey)
SELECT coalesce(rep, src) AS src, CASE WHEN rep <> src THEN 'MERGED_FROM' ELSE 'BOUGHT' END AS type, 'BOUGHT' AS orig_type, count(*) AS edges FROM e GROUP BY ALL
"""

QUERIES = {
    "graph_upsert_edges": (graph_upsert_edges, f"WITH {_TRIPLETS} SELECT subject, 'Equipment' AS subject_label, type, object, 'Material' AS object_label, doc_id, arg_max(mechanism, seq) AS mechanism, arg_max(context, seq) AS context, count(*) AS weight FROM good GROUP BY ALL"),
    "graph_upsert_nodes": (graph_upsert_nodes, f"WITH {_TRIPLETS} SELECT DISTINCT 'Equipment' AS label, subject AS id, sname AS name FROM good UNION SELECT 'Material', object, oname FROM good"),
    "graph_rejects": (graph_rejects, f"WITH {_TRIPLETS} SELECT sname AS subject, count(*) AS n FROM raw WHERE subject IS NOT NULL AND bad GROUP BY 1"),
    "one_hop_out": (one_hop("out"), _one_hop_sql("out")),
    "one_hop_in": (one_hop("in"), _one_hop_sql("in")),
    "one_hop_both": (one_hop("both"), _one_hop_sql("both")),
    "impact_paths": (impact_paths, f"WITH RECURSIVE {_PLACES}, t AS (SELECT src AS start, dst AS last, 1 AS hops, src || ' -> ' || dst AS path, [edge_id] AS used FROM places WHERE src IN (SELECT 'o' || o_orderkey FROM orders WHERE o_orderkey % 100 = 0) UNION ALL SELECT start, dst, hops + 1, path || ' -> ' || dst, list_append(used, edge_id) FROM t JOIN places ON src = last WHERE hops < 3 AND NOT list_contains(used, edge_id)) SELECT start, hops, path FROM t"),
    "ego_graph": (ego_graph, f"WITH {_PLACES}, e AS (SELECT * FROM places WHERE src = 'n3' OR dst = 'n3') SELECT 'link' AS kind, concat_ws(' ', src, type, dst) AS item FROM e UNION ALL SELECT 'node', node FROM (SELECT src AS node FROM e UNION SELECT dst FROM e)"),
    "graph_sample": (graph_sample, f"WITH {_PLACES} SELECT edge_id, src, dst, '(' || src || ') -[' || type || ']-> (' || dst || ') [Source: tpch]' AS text FROM places ORDER BY edge_id LIMIT 200"),
    "graph_merge_undirected": (graph_merge_undirected, """
SELECT least(s, p) AS a, greatest(s, p) AS b, sum(coalesce(w, part)) AS weight, string_agg(text, '<SEP>' ORDER BY part, seq) AS description, coalesce(string_agg(kw, ',' ORDER BY part, seq), '') AS keywords, string_agg(CAST(k AS VARCHAR), ',' ORDER BY part, seq) AS source_ids
FROM (SELECT 's' || l_suppkey AS s, 'p' || l_partkey AS p, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS w, l_orderkey || '/' || l_linenumber AS text, CASE WHEN l_linenumber <> 2 THEN l_linestatus END AS kw, l_orderkey AS k, CASE l_returnflag WHEN 'A' THEN 0 ELSE 1 END AS part,
        (l_orderkey * 10 + l_linenumber) * 100000000 + (CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) + l_partkey * 7919 + l_suppkey * 31) % 100000000 AS seq FROM lineitem WHERE l_returnflag IN ('A', 'R'))
GROUP BY ALL"""),
    "degree_rank": (degree_rank, f"WITH {_PLACES} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM places UNION ALL SELECT dst FROM places) GROUP BY 1"),
    "orphan_nodes": (orphan_nodes, "SELECT 'c' || c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)"),
    "cascade_delete": (cascade_delete, "SELECT (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT') AS chunks, (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT') AS edges, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority <> '1-URGENT')) AS orphans"),
    "verify_storage": (verify_storage, "SELECT d.doc_id, coalesce(c.n, 0) AS chunks, coalesce(l.n, 0) AS edges, CASE WHEN coalesce(c.n, 0) = 0 THEN 'no chunks' WHEN d.doc_id % 10 = 0 THEN 'no metadata' ELSE 'ok' END AS verdict FROM documents d LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) c ON conv_id = d.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id"),
    "update_edges": (update_edges, f"WITH {_PLACES} SELECT CASE WHEN type = 'LIVES_IN' THEN 'RESIDES_IN' ELSE type END AS type, count(*) FILTER (type = 'LIVES_IN') AS updated, count(*) AS edges FROM places GROUP BY ALL"),
    "exact_duplicates": (exact_duplicates, "SELECT doc_id AS id, sha256(text) AS hash, min(doc_id) OVER (PARTITION BY text) AS first_id, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY text) THEN 'new' ELSE 'fast_resume' END AS status FROM documents"),
    "embedding_pairs": (embedding_pairs, _PAIRS),
    "embedding_classes": (embedding_classes, """
WITH RECURSIVE e AS (
  SELECT id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u
  FROM (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings UNION ALL SELECT vec_id + 1000000, label, CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id % 7 = 0)),
links AS MATERIALIZED (SELECT a.id AS i, b.id AS j FROM e a JOIN e b ON a.label = b.label AND a.id <> b.id WHERE list_dot_product(a.u, b.u) >= 0.34),
reach(i, j) AS (SELECT i, j FROM links UNION SELECT r.i, l.j FROM reach r JOIN links l ON r.j = l.i),
c AS (SELECT i, min(j) AS least FROM reach GROUP BY 1), n AS (SELECT i, count(*) AS links FROM links GROUP BY 1)
SELECT id, least(id, coalesce(least, id)) AS class_id, coalesce(links, 0) AS links FROM e LEFT JOIN c ON c.i = id LEFT JOIN n ON n.i = id"""),
    "er_rule_pairs": (er_rule_pairs, _ER),
    "merge_apply": (merge_apply, _MERGE),
    "scan_report": (scan_report, f"SELECT (SELECT count(*) FROM embeddings) AS nodes, count(*) AS candidates, count(*) FILTER (similarity >= 0.35) AS confirmed, count(*) FILTER (similarity < 0.35) AS rejected, (SELECT count(*) FROM embeddings) - count(*) FILTER (similarity >= 0.35) AS estimated_after FROM ({_PAIRS})"),
    "neighbourhood": (neighbourhood, f"""
WITH {_PLACES}, {_PLACE_NODES},
ways AS (SELECT src AS node, type, dst AS other, 'out' AS direction FROM places UNION ALL SELECT dst, type, src, 'in' FROM places)
SELECT b.node, b.type, b.other, b.direction, a.name, o.label FROM ways b JOIN place_nodes a ON a.id = b.node JOIN place_nodes o ON o.id = b.other WHERE a.name = 'FRANCE' OR a.id = 'r1'"""),
    "property_scan": (property_scan, f"""
WITH {_PLACES}, {_PLACE_NODES}
SELECT id AS item FROM place_nodes WHERE contains(id, 'c77') OR contains(id, 'MIDDLE') OR contains(name, 'c77') OR contains(name, 'MIDDLE')
UNION ALL SELECT src || ' ' || type || ' ' || dst FROM places WHERE contains(src, 'c77') OR contains(dst, 'c77') OR contains(type, 'MIDDLE')"""),
    "relations_to": (relations_to, "SELECT 'n' || n_nationkey AS src, 'r' || r_regionkey AS dst FROM nation JOIN region ON n_regionkey = r_regionkey WHERE contains(r_name, 'EAST') OR contains(r_name, 'ASIA')"),
    "listed_nodes": (listed_nodes, f"WITH {_PLACE_NODES} SELECT * FROM place_nodes ORDER BY label, name, id"),
    "entity_matches": (entity_matches, f"""
WITH {_PLACE_NODES}, asked AS (SELECT unnest(['R1', 'france', 'Customer#000000007', 'unheard of']) AS asked)
SELECT asked, id FROM asked, place_nodes WHERE id = lower(asked) OR lower(name) = lower(asked)"""),
    "relation_block": (relation_block, f"""
WITH {_PLACES}, n AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY edge_id) AS nth FROM places WHERE dst[1] = 'r'),
t AS (SELECT dst, nth, '(' || src || ' (Nation)) -[' || type || ']-> (' || dst || ' (Region)) [Source: tpch]' || CASE WHEN edge_id % 3 = 0 THEN chr(10) || '  - Mechanism: ' || type ELSE '' END || CASE WHEN edge_id % 2 = 0 THEN chr(10) || '  - Context: map' ELSE '' END AS said FROM n WHERE nth <= 3)
SELECT dst AS node, 'Found ' || count(*) || ' relations:' || chr(10) || string_agg(said, chr(10) ORDER BY nth) AS text FROM t GROUP BY 1"""),
    "path_block": (path_block, """
SELECT 'c' || c_custkey AS start, 'Found 2 impact paths:' || chr(10) || 'Path 1: c' || c_custkey || ' -> n' || n_nationkey || chr(10) || 'Path 2: c' || c_custkey || ' -> n' || n_nationkey || ' -> r' || n_regionkey AS text
FROM customer JOIN nation ON c_nationkey = n_nationkey"""),
    "path_coverage": (path_coverage, """
WITH p AS (
  SELECT 'c' || c_custkey AS start, ['c' || c_custkey, 'n' || c_nationkey] AS nodes FROM customer
  UNION ALL SELECT 'c' || c_custkey, ['c' || c_custkey, 'n' || c_nationkey, 'r' || n_regionkey] FROM customer JOIN nation ON c_nationkey = n_nationkey),
h AS (SELECT *, list_filter(['R1', 'n1', 'C2'], lambda x: len(list_filter(nodes, lambda n: contains(n, lower(x)))) > 0) AS hit FROM p)
SELECT start, array_to_string(nodes, '>') AS path, array_to_string(hit, ',') AS hit, round(len(hit) / 3, 2) AS coverage FROM h"""),
    "subgraph_merge": (subgraph_merge, """
WITH raw AS (SELECT *, (l_orderkey * 10 + l_linenumber) * 100000000 + (CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) + l_partkey * 7919 + l_suppkey * 31) % 100000000 AS seq, CASE l_linestatus WHEN 'O' THEN 0 ELSE 1 END AS part FROM lineitem),
ends AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_returnflag IN ('A', 'R')),
ranks AS (SELECT 'p' || p AS node, count(*) AS rank FROM ends GROUP BY 1)
SELECT 'p' || l_partkey AS node, arg_min(l_returnflag, (part, seq)) AS kind, md5(coalesce(string_agg(CASE WHEN l_linenumber <> 3 THEN l_orderkey || '/' || l_linenumber END, '<SEP>' ORDER BY part, seq), '')) AS description,
       md5(string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY part, seq)) AS source_ids, coalesce(any_value(rank), 0) AS rank
FROM raw LEFT JOIN ranks ON node = 'p' || l_partkey GROUP BY l_partkey"""),
    "export_statements": (export_statements, """
WITH q AS (SELECT chr(39) AS q, chr(92) AS b), e AS (SELECT *, CASE WHEN n_nationkey % 2 = 0 THEN '2.0' ELSE '1.0' END AS w FROM nation),
n AS (SELECT r_name, r_regionkey, 'it' || b || q || 's ' || r_name AS said, q FROM region, q)
SELECT 'node' AS kind, 'MERGE (n:Big_Place1 {name: ' || q || r_name || q || '}) ON CREATE SET n.description = ' || q || said || q || ', n.rank = ' || r_regionkey || ' ON MATCH SET n.description = n.description + ' || q || '<SEP>' || q || ' + ' || q || said || q || ', n.rank = ' || r_regionkey AS statement FROM n
UNION ALL SELECT 'edge', 'MATCH (a {name: ' || q || n_name || q || '}), (b {name: ' || q || n_regionkey || q || '}) MERGE (a)-[r:RELATED_TO]->(b) ON CREATE SET r.weight = ' || w || ', r.description = ' || q || q || ' ON MATCH SET r.weight = r.weight + ' || w || ', r.description = r.description + ' || q || '<SEP>' || q || ' + ' || q || q FROM e, q"""),
    "reindex": (reindex, """
WITH kept AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority <> '1-URGENT'), moved AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT 'chunks' AS store, (SELECT count(*) FROM orders) AS rows UNION ALL SELECT 'edges', (SELECT count(*) FROM orders) UNION ALL SELECT 'nodes', (SELECT count(*) FROM (SELECT 'c' || o_custkey AS node FROM kept UNION SELECT 'c1' || o_custkey FROM moved))"""),
    "impact_paths_first": (impact_paths_first, f"""
WITH RECURSIVE {_PLACES}, down AS (SELECT edge_id, dst AS src, src AS dst FROM places),
t AS (SELECT src AS start, dst AS last, 1 AS hops, src || ' -> ' || dst AS path, [edge_id] AS used, [{{'dst': dst, 'edge_id': edge_id}}] AS along FROM down WHERE src LIKE 'r%' OR src LIKE 'n%'
  UNION ALL SELECT start, dst, hops + 1, path || ' -> ' || dst, list_append(used, edge_id), list_append(along, {{'dst': dst, 'edge_id': edge_id}}) FROM t JOIN down ON src = last WHERE hops < 3 AND NOT list_contains(used, edge_id))
SELECT start, nth, hops, path FROM (SELECT start, CAST(hops AS BIGINT) AS hops, path, row_number() OVER (PARTITION BY start ORDER BY hops, along) AS nth FROM t) WHERE nth <= 10"""),
    "table_functions": (table_functions, f"""
WITH RECURSIVE {_PLACES}, c AS (SELECT DISTINCT replace(p_name, ' ', '_') AS name FROM part),
links AS (SELECT * FROM places UNION ALL SELECT -1 - CAST(r_regionkey AS BIGINT) * 2, 'r' || r_regionkey, 'LEADS_TO', 'n' || r_regionkey FROM region UNION ALL SELECT -2 - CAST(r_regionkey AS BIGINT) * 2, 'r' || r_regionkey, 'LEADS_TO', 'r' || r_regionkey FROM region),
t AS (SELECT dst AS last, 1 AS hops, src || ' -> ' || dst AS path, [edge_id] AS used FROM links WHERE src IN ('c77', 'r1')
  UNION ALL SELECT dst, hops + 1, path || ' -> ' || dst, list_append(used, edge_id) FROM t JOIN links ON src = last WHERE hops < 3 AND NOT list_contains(used, edge_id))
SELECT 'relation' AS kind, src || ' ' || type || ' ' || dst || ' out' AS item FROM links WHERE src = 'n3' UNION ALL SELECT 'relation', dst || ' ' || type || ' ' || src || ' in' FROM links WHERE dst = 'n3' AND src <> dst
UNION ALL SELECT 'path', path FROM t
UNION ALL SELECT 'tool', name || ' ' || score FROM (SELECT name, CASE WHEN list_contains(string_split(name, '_'), 'ring') THEN 10 WHEN contains(name, 'ring') THEN 5 ELSE 0 END + 4 AS score FROM c ORDER BY score DESC, name LIMIT 5)"""),
}

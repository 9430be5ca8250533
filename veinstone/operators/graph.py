"""The property graph: upsert, traversal, projection, merge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinstone.functions import lexicons as L, text as T
from veinstone.operators.tables import settled


def checked_triplets(triplets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Triplets to write, and those rejected: an unknown label or relation. Rows without subject, object or relation are skipped."""
    present = T.not_blank(F.col("subject")) & T.not_blank(F.col("object")) & T.not_blank(F.col("relation"))
    label = lambda c: F.replace(F.col(c), F.lit(" "), F.lit("")).isin(L.NODE_LABELS)
    allowed = F.coalesce(label("subject_type") & label("object_type") & F.col("relation").isin(L.RELATIONS), F.lit(False))
    known = triplets.where(present)
    return known.where(allowed), known.where(~allowed)


def upsert_nodes(triplets: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(label, id, name): nodes by label and id; the first name stays. triplets carry seq; known nodes come before them."""
    ends = [
        triplets.select(F.replace(f"{end}_type", F.lit(" "), F.lit("")).alias("label"), T.entity_id(F.col(end)).alias("id"), T.trim_all(F.col(end)).alias("name"), F.struct(F.col("seq").cast("long"), F.lit(place)).alias("at"))
        for place, end in enumerate(("subject", "object"))
    ]
    nodes = ends[0].unionByName(ends[1])
    if known is not None:
        nodes = nodes.unionByName(known.select("label", "id", "name", F.struct(F.lit(-1).cast("long").alias("seq"), F.lit(0)).alias("at")))
    return nodes.groupBy("label", "id").agg(F.min_by("name", "at").alias("name"))


def upsert_edges(triplets: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(subject, subject_label, type, object, object_label, doc_id, mechanism, context, weight): the last mechanism and context stay, weights add up."""
    key = ["subject", "subject_label", "type", "object", "object_label", "doc_id"]
    edges = triplets.select(
        T.entity_id(F.col("subject")).alias("subject"), F.replace("subject_type", F.lit(" "), F.lit("")).alias("subject_label"), F.upper("relation").alias("type"),
        T.entity_id(F.col("object")).alias("object"), F.replace("object_type", F.lit(" "), F.lit("")).alias("object_label"), F.coalesce("doc_id", F.lit("global_storage_router")).alias("doc_id"),
        F.coalesce("mechanism", F.lit("")).alias("mechanism"), F.coalesce("context", F.lit("")).alias("context"), F.lit(1).cast("long").alias("weight"), F.col("seq").cast("long").alias("seq"),
    )
    if known is not None:
        edges = edges.unionByName(known.select(*key, "mechanism", "context", F.coalesce("weight", F.lit(1)).cast("long").alias("weight"), F.lit(-1).cast("long").alias("seq")))
    last = F.max_by(F.struct("mechanism", "context"), "seq")
    return edges.groupBy(*key).agg(last.alias("last"), F.sum("weight").alias("weight")).select(*key, "last.mechanism", "last.context", "weight")


def matches(name: str, id_column: str = "id", name_column: str = "name") -> Column:
    wanted = name.strip().lower()
    return (F.col(id_column) == wanted.replace(" ", "_")) | (F.col(name_column) == name) | (F.lower(name_column) == name.lower())


def relations(edges: DataFrame, start: Column, direction: str = "both") -> DataFrame:
    """edges (src, type, dst, ...) at the nodes that ``start``, a predicate over ``node``, chooses; with node, other and direction.

    ``both`` reports the chosen node first, and a loop once.
    """
    out = edges.withColumns({"node": F.col("src"), "other": F.col("dst"), "direction": F.lit("out")})
    into = edges.withColumns({"node": F.col("dst"), "other": F.col("src"), "direction": F.lit("in")})
    found = {"out": out, "in": into, "both": out.unionByName(into.where("src <> dst"))}[direction]
    return found.where(start)


def paths(edges: DataFrame, starts: DataFrame, hops: int = 3) -> DataFrame:
    """(start, hops, nodes, edge_ids): directed trails of 1 to ``hops`` edges (edge_id, src, dst); no edge twice, nodes may repeat.

    One join for each hop, on the trail's last node; edges are never collected.
    """
    step = edges.select("edge_id", "src", "dst")
    trail = starts.select(F.col("node").alias("start"), F.array("node").alias("nodes"), F.expr("CAST(array() AS ARRAY<BIGINT>)").alias("edge_ids"), F.col("node").alias("last"))
    found = None
    for k in range(1, hops + 1):
        trail = trail.join(step, (F.col("last") == F.col("src")) & ~F.array_contains("edge_ids", F.col("edge_id"))).select(
            "start", F.array_append("nodes", F.col("dst")).alias("nodes"), F.array_append("edge_ids", F.col("edge_id").cast("long")).alias("edge_ids"), F.col("dst").alias("last")
        )
        part = trail.select("start", F.lit(k).alias("hops"), "nodes", "edge_ids")
        found = part if found is None else found.unionByName(part)
    return found


def first_paths(edges: DataFrame, starts: DataFrame, limit: int = 10, hops: int = 3) -> DataFrame:
    """(start, nth, hops, nodes, edge_ids): the first ``limit`` trails of each start, those of fewer hops first, then by the nodes and edges along them.

    paths() of this order, cut, but never built in full: a start with enough trails of some length isn't followed any further, so one that is has fewer than
    ``limit`` trails; and of a node's edges no more can be among the first than ``limit``, and those that a trail may have used already. So a hop makes at
    most limit * (limit + hops) rows for each start, and a hub hands over its first edges only, chosen where they are read.
    """
    first = F.row_number().over(Window.partitionBy("src").orderBy("dst", "edge_id"))
    step = edges.select("edge_id", "src", "dst").withColumn("nth", first).where(F.col("nth") <= limit + hops - 1).drop("nth")
    kind = dict(edges.dtypes)
    along = f"CAST(array() AS ARRAY<STRUCT<dst: {kind['dst']}, edge_id: BIGINT>>)"
    trail = starts.select(F.col("node").alias("start"), F.expr(along).alias("along"), F.col("node").alias("last"), F.lit(0).alias("had")).distinct()
    by_start, found = Window.partitionBy("start"), None
    for k in range(1, hops + 1):
        used = F.exists("along", lambda x: x["edge_id"] == F.col("edge_id"))
        longer = trail.join(step, F.col("last") == F.col("src")).where(~used)
        longer = longer.select("start", "had", F.array_append("along", F.struct("dst", F.col("edge_id").cast("long").alias("edge_id"))).alias("along"), F.col("dst").alias("last"))
        kept = longer.withColumn("nth", F.row_number().over(by_start.orderBy("along"))).where(F.col("nth") <= limit).where(F.col("had") + F.col("nth") <= limit)
        kept = settled(kept.withColumn("n", F.count("*").over(by_start)), "trails")
        part = kept.select("start", (F.col("had") + F.col("nth")).cast("int").alias("nth"), F.lit(k).alias("hops"), "along")
        found = part if found is None else found.unionByName(part)
        trail = kept.where(F.col("had") + F.col("n") < limit).select("start", "along", "last", (F.col("had") + F.col("n")).cast("int").alias("had"))
    nodes = F.concat(F.array("start"), F.transform("along", lambda x: x["dst"]))
    return found.select("start", "nth", "hops", nodes.alias("nodes"), F.transform("along", lambda x: x["edge_id"]).alias("edge_ids"))


def path_lines(found: DataFrame, by: str, order: list[Column], limit: int = 10) -> DataFrame:
    """(by, text): the first ``limit`` trails (by, nodes, ...) of each start as numbered lines below their number."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    some = found.withColumn("nth", nth).where(F.col("nth") <= limit)
    line = F.concat(F.lit("Path "), F.col("nth").cast("string"), F.lit(": "), F.array_join("nodes", " -> "))
    listed = some.groupBy(by).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("nth", line.alias("line")))).alias("lines"))  # ``limit`` at most
    return listed.select(by, F.concat(F.lit("Found "), F.col("n").cast("string"), F.lit(" impact paths:\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("text"))


def relation_text(subject: Column, relation: Column, obj: Column, doc: Column, mechanism: Column | None = None, context: Column | None = None) -> Column:
    """One relation, with lines for mechanism and context where they are known."""
    text = F.concat(F.lit("("), subject, F.lit(") -["), relation, F.lit("]-> ("), obj, F.lit(") [Source: "), doc, F.lit("]"))
    for name, value in (("Mechanism", mechanism), ("Context", context)):
        if value is not None:
            text = F.concat(text, F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"\n  - {name}: "), value)).otherwise(""))
    return text


def labelled(name: Column, label: Column) -> Column:
    return F.concat(name, F.lit(" ("), label, F.lit(")"))


def relation_lines(found: DataFrame, by: str, text: Column, order: list[Column], limit: int = 20) -> DataFrame:
    """(by, text): the first ``limit`` relations of each node as text below their number."""
    some = ranked(found.withColumn("said", text), by, order, limit)
    listed = some.groupBy(by).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("nth", "said"))).alias("lines"))
    return listed.select(by, F.concat(F.lit("Found "), F.col("n").cast("string"), F.lit(" relations:\n"), F.array_join(F.transform("lines", lambda x: x["said"]), "\n")).alias("text"))


def neighbourhood(edges: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """Edges (src, type, dst, ...) at the nodes (id, name, ...) of exactly that id or name, whichever way they go, with both ends' properties as JSON."""
    chosen = nodes.where((F.col("id") == name) | (F.col("name") == name)).select(F.col("id").alias("node"))
    at = relations(edges, F.lit(True)).join(chosen, "node")
    properties = nodes.select(F.col("id").alias("_id"), F.to_json(F.struct(*nodes.columns)).alias("properties"))
    near = at.join(properties.select(F.col("_id").alias("node"), F.col("properties").alias("node_properties")), "node", "left")
    return near.join(properties.select(F.col("_id").alias("other"), F.col("properties").alias("other_properties")), "other", "left")


def ego(edges: DataFrame, nodes: DataFrame, chosen: Column) -> tuple[DataFrame, DataFrame]:
    """Links (src, type, dst, doc_id, ...) with a chosen node (id, name, ...) at either end, and the nodes at their ends, each once."""
    starts = nodes.where(chosen).select(F.col("id").alias("node"))
    at = edges.join(starts.withColumnRenamed("node", "src"), "src", "left_semi").unionByName(edges.join(starts.withColumnRenamed("node", "dst"), "dst", "left_semi").join(starts.withColumnRenamed("node", "src"), "src", "left_anti"))
    return at, nodes.join(endpoints(at).withColumnRenamed("node", "id"), "id", "left_semi")


def property_hits(rows: DataFrame, parts: list[str]) -> DataFrame:
    """Rows of nodes or edges of which any property, as text, holds one of the parts."""
    values = F.array(*(F.col(f"`{c}`").cast("string") for c in rows.columns))
    return rows.where(F.exists(values, lambda v: F.coalesce(T.any_of(v, parts), F.lit(False))))


def relations_to(edges: DataFrame, names: DataFrame, start: Column, parts: list[str]) -> DataFrame:
    """Edges from chosen nodes to those whose name (id, name) holds one of the parts."""
    wanted = names.where(T.any_of(F.col("name"), parts)).select(F.col("id").alias("dst"))
    return edges.where(start).join(wanted, "dst", "left_semi")


def listed_nodes(nodes: DataFrame) -> DataFrame:
    """All nodes (label, name, ...) in order of label and name."""
    return nodes.orderBy("label", "name", *(c for c in nodes.columns if c not in ("label", "name")))


def endpoints(edges: DataFrame) -> DataFrame:
    """(node): each end of the edges once."""
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree); a loop counts twice."""
    return edges.select(F.col("src").alias("node")).unionAll(edges.select("dst")).groupBy("node").agg(F.count("*").alias("degree"))


def _said(part: int, *columns: str) -> Column:
    return F.struct(F.lit(part).alias("part"), F.col("seq").cast("long").alias("seq"), *(F.col(c).cast("string").alias(c) for c in columns))


def _all_said(column: str, separator: str) -> Column:
    """What was said, in order; nothing and empty texts are left out."""
    some = F.filter(F.transform("said", lambda x: x[column]), lambda v: F.coalesce(v, F.lit("")) != "")
    return F.array_join(some, separator).alias(column)


def merge_undirected(base: DataFrame, new: DataFrame) -> DataFrame:
    """(a, b, weight, description, keywords, source_ids): edges (src, dst, weight, description, keywords, source_id, seq) by unordered ends.

    Weights add up (a missing one counts 0 in base, 1 in new); descriptions, keywords and sources that aren't empty are joined in
    order, base first.
    """
    def part(edges: DataFrame, number: int, missing: float) -> DataFrame:
        return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.coalesce(F.col("weight").cast("double"), F.lit(missing)).alias("weight"), _said(number, "description", "keywords", "source_id").alias("said"))

    both = part(base, 0, 0.0).unionByName(part(new, 1, 1.0)).groupBy("a", "b").agg(F.sum("weight").alias("weight"), F.sort_array(F.collect_list("said")).alias("said"))
    return both.select("a", "b", "weight", _all_said("description", "<SEP>"), _all_said("keywords", ","), _all_said("source_id", ",").alias("source_ids"))


def merge_described(base: DataFrame, new: DataFrame) -> DataFrame:
    """(node, kind, description, source_ids): nodes (node, kind, description, source_id, seq) of both, the first kind staying; texts are joined as for edges."""
    part = lambda nodes, number: nodes.select("node", F.struct(F.lit(number).alias("part"), F.col("seq").cast("long").alias("seq")).alias("at"), "kind", _said(number, "description", "source_id").alias("said"))
    both = part(base, 0).unionByName(part(new, 1)).groupBy("node").agg(F.min_by("kind", "at").alias("kind"), F.sort_array(F.collect_list("said")).alias("said"))
    return both.select("node", "kind", _all_said("description", "<SEP>"), _all_said("source_id", ",").alias("source_ids"))


def merge_subgraph(base_nodes: DataFrame, base_edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merged nodes, with their degree as ``rank``, and merged undirected edges; see merge_described and merge_undirected."""
    edges = merge_undirected(base_edges, new_edges)
    rank = degrees(edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("degree", "rank")
    nodes = merge_described(base_nodes, new_nodes).join(rank, "node", "left").withColumn("rank", F.coalesce("rank", F.lit(0)))
    return nodes, edges


def orphans(nodes: DataFrame, edges: DataFrame, key: str = "node") -> DataFrame:
    return nodes.join(endpoints(edges).withColumnRenamed("node", key), key, "left_anti")


def update_edges(edges: DataFrame, chosen: Column, column: str, value: Column) -> DataFrame:
    """edges with a property changed where ``chosen``; ``updated`` tells which."""
    chosen = F.coalesce(chosen, F.lit(False))
    return edges.withColumn("updated", chosen).withColumn(column, F.when(F.col("updated"), value).otherwise(F.col(column)))


def path_coverage(found: DataFrame, expected: list[str]) -> DataFrame:
    """(hit, coverage) of (nodes): the expected names that are substrings of a node, and their share, of 2 places."""
    wanted = F.array(*map(F.lit, expected))
    hit = F.filter(wanted, lambda name: F.exists("nodes", lambda node: F.contains(F.lower(node), F.lower(name))))
    return found.withColumn("hit", hit).withColumn("coverage", F.round(F.size("hit") / len(expected), 2))


def verify_storage(docs: DataFrame, chunks: DataFrame, edges: DataFrame, edges_available: bool = True) -> DataFrame:
    """(doc_id, chunks, edges, verdict) of documents (doc_id, has_meta): no chunk or no metadata fails; no edge is fine."""
    by_doc = lambda rows, name: rows.groupBy("doc_id").agg(F.count("*").alias(name))
    counted = docs.join(by_doc(chunks, "chunks"), "doc_id", "left").join(by_doc(edges, "edges"), "doc_id", "left")
    number = lambda name: F.coalesce(name, F.lit(0))
    verdict = F.when(number("chunks") == 0, "no chunks").when(~F.col("has_meta"), "no metadata").otherwise("ok")
    return counted.select("doc_id", number("chunks").alias("chunks"), (number("edges") if edges_available else F.lit(-1).cast("long")).alias("edges"), verdict.alias("verdict"))


def cascade_delete(doc_id: Column, chunks: DataFrame, edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """chunks, edges and nodes without a document's, nodes left without edges, and a report of what went."""
    gone = F.coalesce(doc_id, F.lit(False))
    kept_edges = edges.where(~gone)
    kept_nodes = nodes.join(endpoints(kept_edges), "node", "left_semi")
    report = chunks.where(gone).agg(F.count("*").alias("chunks")).crossJoin(edges.where(gone).agg(F.count("*").alias("edges"))).crossJoin(nodes.join(endpoints(kept_edges), "node", "left_anti").agg(F.count("*").alias("orphans")))
    return chunks.where(~gone), kept_edges, kept_nodes, report


def deletion_report(doc_id: str, stores: dict[str, Callable[[], int]], last: Callable[[], int]) -> list[str]:
    """Deletes a document from every store, and its metadata last; a store that fails is reported, and doesn't keep the others from it."""
    report = []
    for name, delete in stores.items():
        try:
            report.append(f"{name}: {delete()}")
        except Exception as error:  # noqa: BLE001  what fails in one store is part of the report
            report.append(f"{name}: failed ({error})")
    return [*report, f"metadata: {last()}"]


def reindexed(doc_id: Column, chunks: DataFrame, edges: DataFrame, nodes: DataFrame, new_chunks: DataFrame, new_edges: DataFrame, new_nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """chunks, edges and nodes (node) after a document's are deleted, orphans with them, and its new ones come in."""
    kept_chunks, kept_edges, kept_nodes, _ = cascade_delete(doc_id, chunks, edges, nodes)
    return kept_chunks.unionByName(new_chunks), kept_edges.unionByName(new_edges), kept_nodes.unionByName(new_nodes).dropDuplicates(["node"])


def first_edges(edges: DataFrame, limit: int, order: list[str]) -> DataFrame:
    return edges.orderBy(*order).limit(limit)


def ranked(found: DataFrame, by: str, order: list[Column], limit: int) -> DataFrame:
    """``limit`` rows of each group, in a total order."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return found.withColumn("nth", nth).where(F.col("nth") <= limit)

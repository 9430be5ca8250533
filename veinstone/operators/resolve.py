"""Duplicates, candidate pairs and entity merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinstone.functions import nested, text as T
from veinstone.operators import blocks
from veinstone.operators.tables import dropped, looked_up, settled


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, hash, first_id, status): documents of equal content resume that with the smallest id.

    First ids come from an aggregation, which combines copies before they move, and meet the documents by hash; a text with a great share of all documents is dealt out.
    """
    hashed = docs.select(F.col(id_column).alias("id"), nested.content_hash(F.coalesce(text_column, F.lit(""))).alias("hash"))
    firsts = hashed.groupBy("hash").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    return looked_up(hashed, firsts, "hash", "copies", F.col("id")).withColumn("status", F.when(F.col("id") == F.col("first_id"), "new").otherwise("fast_resume"))


#: Vectors of a label that meet in one task; larger labels are dealt out in pairs of pieces of this size.
PIECE = 4096


def _dealt(unit: DataFrame, sizes: DataFrame, piece: int) -> DataFrame:
    """Vectors (label, row, id, ...) with own, their piece of their label (label, n), and a, b: each pair of pieces that theirs is one of."""
    cut = unit.join(sizes.select("label", F.ceil(F.col("n") / piece).cast("int").alias("pieces")), "label").withColumn("own", F.pmod(F.xxhash64("row", "id"), F.col("pieces")).cast("int"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    return met.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")}).drop("pieces", "other")


def similar_pairs(nodes: DataFrame, threshold: float = 0.85, places: int = 4, *, piece: int = PIECE) -> DataFrame:
    """(i, j, similarity) of rows (row, id, label, vector): same label, different id, i < j, cosine at or above the threshold.

    Only vectors of one label meet. A label with over ``piece`` vectors is cut into pieces, and each pair of pieces is a key of its
    own: every pair is compared once, by products of blocks (see blocks), and no task has all of a large label. Vectors are brought to unit length once.
    """
    unit = nodes.select("row", "id", "label", nested.normalised(F.col("vector")).alias("unit")).where("row IS NOT NULL AND id IS NOT NULL AND label IS NOT NULL AND unit IS NOT NULL")
    sizes = nodes.groupBy("label").agg(F.count("*").alias("n"))
    found = blocks.pairs(_dealt(unit, sizes, piece), threshold).where("id <> id_2 AND row <> row_2")
    return found.select(F.least("row", "row_2").alias("i"), F.greatest("row", "row_2").alias("j"), F.round("cosine", places).alias("similarity"))


def similar_classes(nodes: DataFrame, threshold: float = 0.85, *, piece: int = PIECE) -> DataFrame:
    """(id, class_id, links) of every row (id, label, vector): the smallest id that links of similar_pairs lead to, and to how many rows it links itself.

    Equal vectors of one label are one in the comparison, and never make pairs among each other: of thousands of copies one is compared. Its links count for all of
    them, those to copies with their number; copies link to each other if the threshold is one or less. Vectors without a direction, or null ones, link to nothing. Ids are unique.
    Pairs don't leave the task that finds them: it counts a row's links and hands over the row with one that it is joined to (see blocks.linked).
    """
    units = nodes.select("id", "label", nested.normalised(F.col("vector")).alias("unit"))
    keyed = settled(units.withColumn("key", F.xxhash64("unit", "label")), "units")
    distinct = keyed.where("unit IS NOT NULL AND label IS NOT NULL").groupBy("label", "unit").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    distinct = settled(distinct.withColumn("key", F.xxhash64("unit", "label")), "distinct-units")
    compared = distinct.where("first IS NOT NULL").select("label", F.col("first").alias("row"), F.col("first").alias("id"), "copies", "unit")
    met = settled(blocks.linked(_dealt(compared, compared.groupBy("label").agg(F.count("*").alias("n")), piece), threshold), "linked")
    others = met.groupBy(F.col("row").alias("first")).agg(F.sum("links").alias("others"))
    names = representatives(met.where("row <> root").select(F.col("row").alias("a"), F.col("root").alias("b")))
    known = distinct.join(others, "first", "left").join(names.withColumnRenamed("node", "first"), "first", "left")
    itself = F.aggregate(F.transform("unit", lambda x: x * x), F.lit(0.0), lambda a, b: a + b) >= threshold - 1e-9
    links = F.coalesce("others", F.lit(0)) + F.when(itself, F.col("copies") - 1).otherwise(0)
    known = known.select("unit", "label", "copies", F.coalesce("representative", F.when(itself, F.col("first"))).alias("class_id"), links.alias("links"), "key")
    joined = looked_up(keyed, known.select("key", "class_id", "links", "copies"), "key", "copies", F.col("id"))
    return joined.select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def rule_pairs(names: DataFrame, block: Column) -> DataFrame:
    """(a, b) of names (name) that the entity rule takes for one; only names of one block are compared."""
    left = names.select(F.col("name").alias("a"), block.alias("block")).distinct()
    right = left.select(F.col("a").alias("b"), "block")
    return left.join(right, "block").where(F.col("a") < F.col("b")).where(T.same_entity(F.col("a"), F.col("b"))).select("a", "b")


def verified(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Pairs (pair_id, a, b) that a verifier confirmed: verdicts (pair_id, verdict, canonical); the canonical name defaults to a."""
    said = verdicts.where(F.upper(F.trim("verdict")) == "YES").select("pair_id", "canonical")
    return pairs.join(said, "pair_id").select("pair_id", "a", "b", F.coalesce(F.nullif("canonical", F.lit("")), "a").alias("canonical"))


def representatives(pairs: DataFrame) -> DataFrame:
    """(node, representative): the smallest node that pairs (a, b) lead to, by spreading minima until nothing changes.

    Minima go to neighbours and to the neighbours' representatives, and each node takes over its representative's
    representative, so that the rounds grow far slower than the length of a chain. Nodes of a giant component, and links of a hub, are dealt out over tasks.
    """
    ends = pairs.select("a", "b").where("a is not null and b is not null")
    links = settled(ends.unionAll(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = settled(links.groupBy("a").agg(F.least("a", F.min("b")).alias("representative")).withColumnRenamed("a", "node"), "labels")
    degree = settled(links.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("degree")), "degrees")
    while True:
        near = looked_up(links, label.join(degree, "node").select(F.col("node").alias("b"), "representative", "degree"), "b", "degree", F.col("a")).groupBy("a").agg(F.min("representative").alias("near"))
        near = near.withColumnRenamed("a", "node").join(label, "node")
        said = near.select("node", "near").unionAll(near.select(F.col("representative").alias("node"), "near"))
        spread = label.join(said.groupBy("node").agg(F.min("near").alias("near")), "node", "left")
        spread = settled(spread.select("node", F.least("representative", "near").alias("representative"), F.col("representative").alias("before")), "labels")
        led = spread.groupBy("representative").agg(F.count("*").alias("led"))
        further = led.join(spread.select(F.col("node").alias("representative"), F.col("representative").alias("further")), "representative")
        label = settled(looked_up(spread, further, "representative", "led", F.col("node")).select("node", F.least("representative", "further").alias("representative"), "before"), "labels")
        dropped(pairs.sparkSession, [spread])
        if label.where("representative < before").isEmpty():
            return label.drop("before")
        label = label.drop("before")


def merge_nodes(edges: DataFrame, canon: DataFrame) -> DataFrame:
    """Edges (src, type, dst, ...) with ends replaced by representatives (node, representative).

    Changed edges get the type MERGED_FROM and keep theirs in orig_type; edges within one entity go.
    """
    new = canon.where("node <> representative")
    out = edges.join(new.select(F.col("node").alias("src"), F.col("representative").alias("new_src")), "src", "left")
    out = out.join(new.select(F.col("node").alias("dst"), F.col("representative").alias("new_dst")), "dst", "left")
    changed = F.col("new_src").isNotNull() | F.col("new_dst").isNotNull()
    out = out.withColumns({"orig_type": F.col("type"), "type": F.when(changed, "MERGED_FROM").otherwise(F.col("type")), "src": F.coalesce("new_src", "src"), "dst": F.coalesce("new_dst", "dst")})
    return out.where(~(changed & (F.col("src") == F.col("dst")))).drop("new_src", "new_dst")


def scan_report(candidates: DataFrame, confirmed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(nodes, candidates, confirmed, rejected, estimated_after)."""
    one = lambda rows, name: rows.agg(F.count("*").alias(name))
    counts = one(nodes, "nodes").crossJoin(one(candidates, "candidates")).crossJoin(one(confirmed, "confirmed"))
    return counts.withColumns({"rejected": F.col("candidates") - F.col("confirmed"), "estimated_after": F.col("nodes") - F.col("confirmed")})


def questions(pairs: DataFrame) -> DataFrame:
    """(prompt): one text with a numbered question for each pair (pair_id, a, b)."""
    line = F.concat(F.lit("Pair "), F.col("pair_id").cast("string"), F.lit(": is "), "a", F.lit(" the same entity as "), "b", F.lit("?"))
    return pairs.select(F.struct("pair_id", line.alias("line")).alias("said")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("said")), lambda x: x["line"]), "\n").alias("prompt"))


def stored_already(new: DataFrame, stored: DataFrame) -> DataFrame:
    """New contents (hash) that are stored."""
    return new.join(stored.select("hash").distinct(), "hash", "left_semi")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the last in the order."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")

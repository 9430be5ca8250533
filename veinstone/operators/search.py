"""Lexical and dense search, rank fusion, hybrid scores."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinstone.functions import lexicons as L, nested, text as T
from veinstone.operators import blocks
from veinstone.operators.tables import settled

K1, B, RRF_K = 1.2, 0.75, 60
#: Queries, terms or other rows of a stated set that may be broadcast at once; larger sets go in blocks of this size, or by shuffle.
BLOCK = 10_000


def in_blocks(rows: DataFrame, key: str, found: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The union of ``found`` over blocks of a stated set of rows, each small enough to broadcast; key: what rows are dealt by."""
    blocks = max(1, -(-rows.count() // BLOCK))
    if blocks == 1:
        return found(F.broadcast(rows))
    parts = [found(F.broadcast(rows.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == k))) for k in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def held(rows: DataFrame) -> DataFrame:
    """A side of a join, broadcast if it has BLOCK rows at most."""
    return F.broadcast(rows) if rows.limit(BLOCK + 1).count() <= BLOCK else rows


def postings(docs: DataFrame, terms: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, term, tf, size) of the terms (term) asked for, and a row with a null term for each document: written, and read as often as needed.

    The texts are scanned and cut into words once; only matching words leave the scan.
    """
    words = docs.select(F.col(id_column).alias("id"), T.tokens(F.col(text_column)).alias("words"))
    each = words.select("id", F.size("words").alias("size"), F.explode(F.concat(F.array(F.lit(None).cast("string")), "words")).alias("found"))
    wanted = settled(terms.select("term").distinct().unionAll(docs.sparkSession.createDataFrame([(None,)], "term string")), "terms")
    counted = each.join(held(wanted), F.col("found").eqNullSafe(F.col("term"))).groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("size").alias("size"))
    return settled(counted, "postings")


def bm25_clauses(docs: DataFrame, clauses: DataFrame, k: int, *, id_column: str = "doc_id", text_column: str = "text", least_share: float = 0.6, places: int = 6) -> DataFrame:
    """(query_id, id, score, rank): the best k documents of each query by boosted BM25.

    clauses: (query_id, clause, term, boost). A document must match ``least_share`` of a query's clauses, rounded down, and at
    least one; a clause matches by any of its terms, whose scores add up.
    """
    clauses = settled(clauses.groupBy("query_id", "clause", "term").agg(F.sum("boost").alias("boost")), "clauses")
    index = postings(docs, clauses, id_column, text_column)
    totals = index.where("term IS NULL").agg(F.count("*").alias("n"), F.avg("size").alias("mean"))
    found = index.where("term IS NOT NULL")
    frequency = found.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = settled(clauses.join(frequency, "term").crossJoin(F.broadcast(totals)).select("query_id", "clause", "term", (idf * F.col("boost")).alias("weight"), "mean"), "weights")  # totals: one row
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    scored = found.join(held(weights), "term").groupBy("query_id", "id").agg(F.round(F.sum(part), places).alias("score"), F.count_distinct("clause").alias("matched"))
    wanted = clauses.groupBy("query_id").agg(F.count_distinct("clause").alias("wanted"))
    kept = scored.join(wanted, "query_id").where(F.col("matched") >= F.greatest(F.lit(1), F.floor(F.col("wanted") * least_share + 1e-9)))
    return best(kept.select("query_id", "id", "score"), k)


def bm25(docs: DataFrame, queries: DataFrame, k: int, *, query_text: str = "query", **settings) -> DataFrame:
    """(query_id, id, score, rank): the best k documents of each query by BM25 over its distinct terms; see bm25_clauses."""
    terms = queries.select("query_id", F.explode(F.array_distinct(T.tokens(F.col(query_text)))).alias("term"))
    return bm25_clauses(docs, terms.select("query_id", F.col("term").alias("clause"), "term", F.lit(1.0).alias("boost")), k, **settings)


def best(scored: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): k rows of each query by score, ties by id; ranks from 0.

    The limit stands on the bare row number, so that each task keeps k rows of a query before any are moved.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).select("query_id", "id", "score", (F.col("nth") - 1).alias("rank"))


def knn(vectors: DataFrame, queries: DataFrame, k: int, *, id_column: str = "vec_id", vector_column: str = "embedding", places: int = 6) -> DataFrame:
    """(query_id, id, score, rank): exact cosine neighbours; queries (query_id, vector) meet all vectors in blocks, which keep what may be among the best."""
    unit = vectors.select(F.col(id_column).alias("id"), nested.normalised(F.col(vector_column)).alias("v"))
    asked = queries.select("query_id", nested.normalised(F.col("vector")).alias("q"))
    near = blocks.nearest(*blocks.dealt(unit, asked), k, 2 * 10.0**-places)
    return best(near.select("query_id", "id", F.round("score", places).alias("score")), k)


def containing(docs: DataFrame, queries: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(query_id, id): documents whose text holds a query's text (query_id, query) as it is.

    A query's inner words stand in such a document as whole words. The longest of them is the key of an equi-join with the
    documents' distinct words; only pairs that share it are compared. Queries of one or two words meet all documents in blocks.
    """
    words = F.filter(F.split("query", r"\s+"), lambda w: w != "")
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    keyed = queries.select("query_id", "query", F.get(F.sort_array(F.transform(inner, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), F.lit(0))["w"].alias("key"))
    keyed = settled(keyed.where(F.col("query").isNotNull()), "queries")
    text = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    each = text.select("id", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("key"))  # without the text, which pairs that share a key fetch
    long, short = keyed.where("key IS NOT NULL"), keyed.where("key IS NULL")
    pairs = settled(each.join(held(long), "key").select(F.col("id").alias("of"), "query_id", "query").distinct(), "pairs")
    found = text.join(held(pairs), F.col("id").eqNullSafe(F.col("of"))).where(F.contains("text", "query")).select("query_id", "id")
    return found.unionByName(in_blocks(short.drop("key"), "query_id", lambda block: text.join(block, F.contains("text", "query")).select("query_id", "id")))


def fuse_legs(legs: list[DataFrame], k: int = RRF_K, places: int = 9) -> DataFrame:
    """(query_id, id, score, rank): reciprocal rank fusion of ranked legs (query_id, id, rank); ties by leg, then rank."""
    union = None
    for number, leg in enumerate(legs):
        part = leg.select("query_id", "id", (F.lit(1.0) / (F.lit(k) + F.col("rank") + 1)).alias("part"), F.struct(F.lit(number).alias("leg"), F.col("rank").cast("long").alias("rank")).alias("seen"))
        union = part if union is None else union.unionByName(part)
    fused = union.groupBy("query_id", "id").agg(F.round(F.sum("part"), places).alias("score"), F.min("seen").alias("seen"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "seen")
    return fused.withColumn("rank", F.row_number().over(order) - 1).select("query_id", "id", "score", "rank")


def fuse_lists(items: DataFrame, k: int = RRF_K, places: int = 9) -> DataFrame:
    """(uid, score, payload) from (list, rank, chunk_id, doc_id, payload): lists are ranked already, repeats add up, the first payload stays.

    uid is chunk_id where the item has one, present or not (has_chunk_id), else doc_id; items without either, or named unknown, are left out.
    """
    uid = F.when(F.col("has_chunk_id"), F.col("chunk_id")).otherwise(F.col("doc_id"))
    named = items.withColumn("uid", uid).where(F.col("uid").isNotNull() & ~F.col("uid").isin("", "unknown"))
    return named.groupBy("uid").agg(F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank") + 1)), places).alias("score"), F.min_by("payload", F.struct("list", "rank")).alias("payload"))


def hybrid(docs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 5, synonyms: DataFrame | None = None, index=None, cells=None) -> DataFrame:
    """(query_id, rank, doc_id, score, citation): a lexical leg of expanded queries and a dense leg, 2k each, fused; queries (query_id, query, vector).

    index: a TextIndex of the documents, cells: a VectorIndex of the vectors; these are searched where they are given.
    """
    clauses = query_clauses(queries, synonyms)
    lexical = index.search(clauses, 2 * k) if index is not None else bm25_clauses(docs, clauses, 2 * k)
    dense = cells.search(queries, 2 * k).drop("candidates") if cells is not None else knn(vectors, queries, 2 * k)
    top = settled(fuse_legs([lexical, dense]).where(F.col("rank") < k), "hybrid")
    cited = T.citation(F.col("source"), F.lit(-1), F.lit("text"))
    return docs.join(held(top), F.col("doc_id") == F.col("id")).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score", cited.alias("citation"))


def with_relations(queries: DataFrame, relations: DataFrame) -> DataFrame:
    """queries (query_id, query, ...) with what the graph says of their entities added; relations (query_id, seq, subject, relation, object).

    The relations are joined in order; signs of the query language become spaces. A query without relations stays as it is.
    """
    said = F.struct("seq", F.concat_ws(" ", "subject", "relation", "object").alias("said"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(said)), lambda x: x["said"]), "，")
    more = relations.groupBy("query_id").agg(F.regexp_replace(joined, L.QUERY_SIGNS, " ").alias("more"))
    both = F.when(F.coalesce("more", F.lit("")) != "", F.concat("query", F.lit("。相关背景："), "more")).otherwise(F.col("query"))
    return queries.join(more, "query_id", "left").withColumn("query", both).drop("more")


def any_word(rows: DataFrame, words: list[str], columns: list[str]) -> DataFrame:
    """Rows in which a column holds one of the words as a whole token."""
    tokens = F.concat(*(T.tokens(F.col(c).cast("string")) for c in columns))
    return rows.where(F.arrays_overlap(tokens, F.array(*(F.lit(w.lower()) for w in words))))


def result_block(doc_id: Column, citation: Column, kind: Column, text: Column, image: Column, link: str) -> Column:
    """What a search shows of one result; the image's path goes, quoted, behind ``link``."""
    quoted = F.replace(F.replace(F.url_encode(image), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    picture = F.when(F.coalesce(image, F.lit("")) != "", F.concat(F.lit("\nImage: ![" ), kind, F.lit(f"图表]({link}"), quoted, F.lit(")"))).otherwise("")
    return F.concat(F.lit("Doc: "), doc_id.cast("string"), F.lit(" "), citation, F.lit(" (Type: "), kind, F.lit(")\nContent: "), text, picture)


def result_text(results: DataFrame, block: Column) -> DataFrame:
    """(query_id, text): a query's few results (query_id, rank, ...) as one text."""
    listed = F.sort_array(F.collect_list(F.struct("rank", block.alias("block"))))
    return results.groupBy("query_id").agg(F.array_join(F.transform(listed, lambda x: x["block"]), "\n\n---\n\n").alias("text"))


def token_features(weighted: DataFrame, group: str) -> DataFrame:
    """(group, feature, value) of (group, pos, term, weight): 0.4 w for each term, 0.6 max(w, w') for each pair of neighbours."""
    follow = Window.partitionBy(group).orderBy("pos")
    paired = weighted.withColumns({"next": F.lead("term").over(follow), "next_weight": F.lead("weight").over(follow)})
    single = F.struct(F.col("term").alias("feature"), (0.4 * F.col("weight")).alias("value"))
    double = F.struct(F.concat("term", "next").alias("feature"), (0.6 * F.greatest("weight", "next_weight")).alias("value"))
    both = paired.select(group, F.explode(F.when(F.col("next").isNull(), F.array(single)).otherwise(F.array(single, double))).alias("f"))
    return both.groupBy(group, F.col("f.feature").alias("feature")).agg(F.sum("f.value").alias("value"))


def token_similarity(queries: DataFrame, docs: DataFrame, places: int = 6) -> DataFrame:
    """(query_id, id, similarity): the share of a query's feature weight that a document has, of those that have any.

    queries: (query_id, pos, term, weight), a stated set; docs: (id, pos, term). All other documents have 1e-9 over the total.
    """
    wanted = settled(token_features(queries, "query_id"), "features")
    have = token_features(docs.withColumn("weight", F.lit(1.0)), "id").select("id", "feature")
    total = wanted.groupBy("query_id").agg(F.sum("value").alias("total"))
    shared = have.join(held(wanted), "feature").groupBy("query_id", "id").agg(F.sum("value").alias("shared"))
    return shared.join(held(total), "query_id").select("query_id", "id", F.round((1e-9 + F.col("shared")) / (1e-9 + F.col("total")), places).alias("similarity"))


def similarity_to_texts(queries: DataFrame, docs: DataFrame, places: int = 6) -> DataFrame:
    """As token_similarity, for documents as (id, words array<string>): only features of a query leave the scan."""
    wanted = settled(token_features(queries, "query_id"), "features")
    words = F.col("words")
    doubled = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda one, two: F.concat(one, two))
    have = docs.select("id", F.explode(F.array_distinct(F.concat(words, doubled))).alias("feature"))
    have = have.join(held(wanted.select("feature").distinct()), "feature").distinct()
    total = wanted.groupBy("query_id").agg(F.sum("value").alias("total"))
    shared = have.join(held(wanted), "feature").groupBy("query_id", "id").agg(F.sum("value").alias("shared"))
    return shared.join(held(total), "query_id").select("query_id", "id", F.round((1e-9 + F.col("shared")) / (1e-9 + F.col("total")), places).alias("similarity"))


def linear_hybrid(vectors: DataFrame, queries: DataFrame, similarities: DataFrame, places: int = 6) -> DataFrame:
    """(query_id, id, score) of every query (query_id, vector) with every vector (id, vector): 0.85 cosine + 0.15 token similarity, tokens alone where all cosines of a query are 0.

    similarities: of token_similarity, 0 for documents that aren't there. The pairs are made where they are scored, in blocks, and don't move.
    """
    rows, asked, said = blocks.dealt(vectors.select("id", F.col("vector").alias("v")), queries.select("query_id", F.col("vector").alias("q")), similarities)
    every = blocks.cosines(rows, asked.join(settled(blocks.known(rows, asked), "known"), "query_id"), said)
    return every.select("query_id", "id", F.round(F.when(F.col("known"), 0.85 * F.col("cosine") + 0.15 * F.col("similarity")).otherwise(F.col("similarity")), places).alias("score"))


def term_weights(terms: DataFrame, group: str, places: int = 6) -> DataFrame:
    """(group, term, weight): weights of distinct terms from estimated frequencies, summing to 1 within a group.

    Without dictionaries a frequency is estimated from the kind of term: numbers are rare, Latin words common, and others
    as their parts.
    """
    term = F.col("term")
    number, latin = term.rlike(r"^[0-9. -]{2,}$"), term.rlike(r"^[a-z. -]+$")
    parts = T.fine_tokens(term)
    part_frequency = F.array_min(F.transform(parts, lambda p: F.when(p.rlike(r"^[0-9. -]{2,}$"), 3.0).when(p.rlike(r"^[a-z. -]+$"), 300.0).otherwise(10.0)))
    several = F.size(parts) > 1
    frequency = F.when(number, 3.0).when(latin, 300.0).when(several, F.greatest(part_frequency / 6, F.lit(10.0))).otherwise(10.0)
    documents = F.when(number, 5.0).when(latin, 300.0).when(several, F.greatest(F.lit(3.0), part_frequency / 6)).otherwise(3.0)
    entity = F.when(term.rlike(r"^[0-9,.]{2,}$"), 2.0).when(term.rlike(r"^[a-z]{1,2}$"), 0.01).otherwise(1.0)
    tag = F.when(term.rlike("^[0-9-]"), 2.0).otherwise(1.0)

    def idf(s: Column, n: float) -> Column:
        return F.log10(10 + (n - s + 0.5) / (s + 0.5))

    raw = terms.select(group, "term").distinct().withColumn("raw", (0.3 * idf(frequency, 1e7) + 0.7 * idf(documents, 1e9)) * entity * tag)
    total = F.sum("raw").over(Window.partitionBy(group))
    return raw.select(group, "term", F.round(F.when(total > 0, F.col("raw") / total).otherwise(1.0 / F.count("*").over(Window.partitionBy(group))), places).alias("weight"))


def term_weights_of(terms: DataFrame, group: str, counts: DataFrame, kinds: DataFrame | None = None, places: int = 6) -> DataFrame:
    """(group, term, weight): as term_weights, with counts (term, count) of known terms, and what kinds (term, kind) of them weigh more.

    A known term is as frequent as its count; of an unknown one of four characters or more, that isn't all letters, the rarest of its parts decides.
    """
    asked = settled(terms.select(group, "term").distinct(), "terms")
    each = asked.select("term").distinct().withColumn("part", F.explode(F.array_union(F.array("term"), F.filter(T.fine_tokens(F.col("term")), lambda p: F.length(p) > 1))))
    each = each.join(counts.select(F.col("term").alias("part"), "count"), "part", "left")
    part, count = F.col("part"), F.coalesce("count", F.lit(0))
    number, latin = part.rlike(r"^[0-9. -]{2,}$"), part.rlike(r"^[a-z. -]+$")
    frequency = F.when(number, 3.0).when(latin & (count == 0), 300.0).otherwise(F.greatest(count, F.lit(10)).cast("double"))
    documents = F.when(number, 5.0).when(F.col("count").isNotNull(), count + 3.0).when(latin, 300.0).otherwise(3.0)
    whole = lambda value: F.max(F.when(part == F.col("term"), value))
    least = lambda value: F.min(F.when(part != F.col("term"), value))
    plain = whole(~number & ~latin & F.col("count").isNull()) & (F.length("term") >= 4) & (F.count("*") > 2)
    known = each.withColumns({"f": frequency, "g": documents}).groupBy("term").agg(
        F.when(plain, F.greatest(least(F.col("f")) / 6, F.lit(10.0))).otherwise(whole(F.col("f"))).alias("f"),
        F.when(plain, F.greatest(least(F.col("g")) / 6, F.lit(3.0))).otherwise(whole(F.col("g"))).alias("g"),
    )
    term = F.col("term")
    kind = F.lit(1.0)
    if kinds is not None:
        known = known.join(kinds.groupBy("term").agg(F.min("kind").alias("kind")), "term", "left")
        for name, weight in L.KIND_WEIGHTS.items():
            kind = F.when(F.col("kind") == name, float(weight)).otherwise(kind)
    entity = F.when(term.rlike(r"^[0-9,.]{2,}$"), 2.0).when(term.rlike(r"^[a-z]{1,2}$"), 0.01).otherwise(kind)
    tag = F.when(term.rlike("^[0-9-]"), 2.0).otherwise(1.0)
    idf = lambda s, n: F.log10(10 + (n - s + 0.5) / (s + 0.5))
    raw = asked.join(known.select("term", ((0.3 * idf(F.col("f"), 1e7) + 0.7 * idf(F.col("g"), 1e9)) * entity * tag).alias("raw")), "term")
    sums = raw.groupBy(group).agg(F.sum("raw").alias("total"), F.count("*").alias("n"))
    return raw.join(sums, group).select(group, "term", F.round(F.when(F.col("total") > 0, F.col("raw") / F.col("total")).otherwise(1.0 / F.col("n")), places).alias("weight"))


def query_clauses(queries: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """(query_id, clause, term, boost): weighted clauses of each query: the term, its synonyms at a fifth, its parts at half.

    A query is cut into segments, the first 256 of which count; a term's weight is its share within its segment, as often as
    it stands in one. Parts of one character are left out. synonyms: (term, synonym), a dictionary; eight for each term.
    """
    plain = T.without_signs(T.half_width(F.lower(F.coalesce("query", F.lit("")))))
    terms = queries.select("query_id", F.posexplode(F.slice(T.segments(plain), 1, 256)).alias("segment", "text")).select("query_id", "segment", F.explode(T.tokens(F.col("text"))).alias("term"))
    grouped = terms.select(F.struct("query_id", "segment").alias("of"), "term")
    weighted = term_weights(grouped, "of").select("of.query_id", "term", "weight")
    clauses = weighted.select("query_id", F.col("term").alias("clause"), "term", F.col("weight").alias("boost"))
    parts = weighted.select("query_id", F.col("term").alias("clause"), F.explode(T.fine_tokens(F.col("term"))).alias("part"), "weight").where("part <> clause AND length(part) > 1")
    clauses = clauses.unionByName(parts.select("query_id", "clause", F.col("part").alias("term"), (0.5 * F.col("weight")).alias("boost")))
    if synonyms is not None:
        first = F.row_number().over(Window.partitionBy("term").orderBy("synonym"))
        near = weighted.join(held(synonyms.withColumn("nth", first).where(F.col("nth") <= 8).drop("nth")), "term")
        clauses = clauses.unionByName(near.select("query_id", F.col("term").alias("clause"), F.col("synonym").alias("term"), (0.2 * F.col("weight")).alias("boost")))
    return clauses


def query_phrases(queries: DataFrame) -> DataFrame:
    """(query_id, clause, words, slop, boost): of each weighted term of several parts, the parts side by side, and at half the boost with up to two places between.

    These are what a query's clauses hold besides terms; parts of one character are left out. See text_index.Phrases.
    """
    plain = T.without_signs(T.half_width(F.lower(F.coalesce("query", F.lit("")))))
    terms = queries.select("query_id", F.posexplode(F.slice(T.segments(plain), 1, 256)).alias("segment", "text")).select("query_id", "segment", F.explode(T.tokens(F.col("text"))).alias("term"))
    weighted = term_weights(terms.select(F.struct("query_id", "segment").alias("of"), "term"), "of").select("of.query_id", "term", "weight")
    parts = weighted.select("query_id", F.col("term").alias("clause"), F.filter(T.fine_tokens(F.col("term")), lambda p: (p != F.col("term")) & (F.length(p) > 1)).alias("words"), "weight").where("size(words) > 0")
    kinds = F.array(F.struct(F.lit(0).alias("slop"), F.lit(1.0).alias("share")), F.struct(F.lit(2).alias("slop"), F.lit(0.5).alias("share")))
    return parts.select("query_id", "clause", "words", F.col("weight"), F.inline(kinds)).select("query_id", "clause", "words", "slop", (F.col("weight") * F.col("share")).alias("boost"))


def keywords(queries: DataFrame, synonyms: DataFrame | None = None, enough: int = 32) -> DataFrame:
    """(query_id, keywords): segments, and while there are fewer than ``enough`` keywords before them, the parts and synonyms of their terms.

    The bound is looked at before keywords are added, so there may be some more. Each keyword once, in order.
    """
    plain = T.without_signs(T.half_width(F.lower(F.coalesce("query", F.lit("")))))
    each = queries.select("query_id", F.posexplode(F.slice(T.segments(plain), 1, 256)).alias("segment", "text"))
    each = each.withColumn("parts", F.flatten(F.transform(T.tokens(F.col("text")), lambda t: F.filter(T.fine_tokens(t), lambda p: (p != t) & (F.length(p) > 1)))))
    if synonyms is not None:
        said = F.struct("at", "synonym")
        near = each.select("query_id", "segment", F.posexplode(T.tokens(F.col("text"))).alias("at", "term")).join(held(synonyms), "term")
        near = near.groupBy("query_id", "segment").agg(F.transform(F.sort_array(F.collect_list(said)), lambda x: x["synonym"]).alias("near"))  # of one segment
        each = each.join(near, ["query_id", "segment"], "left").withColumn("parts", F.concat("parts", F.coalesce("near", F.array().cast("array<string>"))))
    listed = each.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("segment", "text", "parts"))).alias("all"))  # 256 segments at most
    start = F.array().cast("array<string>")
    found = F.aggregate("all", start, lambda so_far, x: F.concat(so_far, F.array(x["text"]), F.when(F.size(so_far) + 1 < enough, x["parts"]).otherwise(F.array().cast("array<string>"))))
    return listed.select("query_id", F.array_distinct(found).alias("keywords"))


def catalog_search(catalog: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """(name, score): entries of a catalog (name, description, category, search_hint) by keywords.

    ``select:a,b`` names entries, whatever their case: all of them, in the order asked. ``+word`` is required somewhere. An exact part of the name counts 10, else a substring
    of it 5; a word of the hint 4, a substring of the category 3, a word of the description 2.
    """
    name = F.lower("name")
    if query.startswith("select:"):
        names = [part.strip().lower() for part in query.removeprefix("select:").split(",") if part.strip()]
        return catalog.where(name.isin(names)).select("name", F.lit(0).alias("score")).orderBy(F.array_position(F.lit(names), name), "name")
    words = query.lower().split()
    required, terms = [w[1:] for w in words if w.startswith("+") and len(w) > 1], [w.lstrip("+") for w in words if w.lstrip("+")]
    parts = T.name_parts(F.col("name"))
    score = F.lit(0)
    for word in terms:
        in_name = F.when(F.array_contains(parts, word), 10).when(F.contains(name, F.lit(word)), 5).otherwise(0)
        in_hint = F.when(F.array_contains(F.split(F.lower("search_hint"), r"\W+"), word), 4).otherwise(0)
        in_category = F.when(F.contains(F.lower("category"), F.lit(word)), 3).otherwise(0)
        in_description = F.when(F.array_contains(F.split(F.lower("description"), r"\W+"), word), 2).otherwise(0)
        score = score + in_name + in_hint + in_category + in_description
    everywhere = F.lower(F.concat_ws(" ", "name", "description", "search_hint"))
    for word in required:
        catalog = catalog.where(F.contains(everywhere, F.lit(word)))
    return catalog.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "name").limit(limit).select("name", "score")


def vocabulary_hits(queries: DataFrame, vocabulary: DataFrame, grams: int = 3) -> DataFrame:
    """(query_id, entity): entities (entity) that are substrings of a query, whatever the case.

    An entity's first characters, ``grams`` of them or all, are among the query's n-grams: these are the key of an equi-join.
    """
    lower = F.lower("query")
    every = F.flatten(F.array(*(T.grams(lower, n) for n in range(1, grams + 1))))
    asked = queries.select("query_id", lower.alias("text"), F.explode(F.array_distinct(every)).alias("key"))
    named = vocabulary.select("entity", F.left(F.lower("entity"), F.lit(grams)).alias("key"))
    return asked.join(named, "key").where(F.contains("text", F.lower("entity"))).select("query_id", "entity").distinct()


def query_entities(queries: DataFrame, vocabulary: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, entity): entities of each query, the longest first; candidates (query_id, entity) take the place of the vocabulary where any of them hits."""
    found = vocabulary_hits(queries, vocabulary)
    if candidates is not None:
        own = queries.join(candidates, "query_id").where(F.contains(F.lower("query"), F.lower("entity"))).select("query_id", "entity").distinct()
        found = found.join(own.select("query_id").distinct(), "query_id", "left_anti").unionByName(own)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.length("entity")), "entity")
    return found.withColumn("rank", (F.row_number().over(order) - 1).cast("long"))

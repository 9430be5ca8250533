"""Search and text queries over documents, embeddings and benchmark."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veinstone.functions import lexicons as L, text as T
from veinstone.operators import evaluate, search, segment
from veinstone.operators.tables import settled, shared_folder
from veinstone.operators.text_index import FORMAT, Phrases, TextIndex
from veinstone.operators.vector_index import VectorIndex
from veinstone.plans.tables import kept_at, table

LATIN = r"[0-9a-z\x{00DF}-\x{00F6}\x{00F8}-\x{024F}]+"


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _asked_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def text_index(spark: SparkSession, d: str) -> TextIndex:
    """The stored index of the documents; whoever asks first makes it."""
    index = TextIndex(spark, f"{kept_at(spark, d, 'documents')}-{FORMAT}")
    if not index.versions.latest():
        index.upsert(table(spark, d, "documents"))
    return index


def vector_index(spark: SparkSession, d: str) -> VectorIndex:
    index = VectorIndex(spark, kept_at(spark, d, "embeddings"))
    if not index.versions.latest():
        index.upsert(table(spark, d, "embeddings"))
    return index


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    found = text_index(spark, d).bm25(_questions(spark, d), 10)
    return found.select("query_id", F.col("id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


_BM25 = f"""
toks AS (SELECT doc_id, regexp_extract_all(lower(text), '{LATIN}') AS w FROM documents),
sized AS (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM toks),
totals AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM toks),
terms AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '{LATIN}'))) AS term FROM benchmark),
wanted AS (SELECT query_id, count(*) AS wanted FROM terms GROUP BY 1),
found AS (SELECT doc_id, term, count(*) AS tf, any_value(size) AS size FROM sized WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM found GROUP BY 1),
scored AS (
  SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * size / mean))), 6) AS score, count(*) AS matched
  FROM found JOIN terms USING (term) JOIN df USING (term), totals GROUP BY ALL),
lexical AS (
  SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank
  FROM scored JOIN wanted USING (query_id) WHERE matched >= greatest(1, floor(wanted * 0.6 + 1e-9)))"""


def knn_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    found = search.knn(table(spark, d, "embeddings"), _asked_vectors(spark, d), 10)
    return found.select("query_id", F.col("id").alias("vec_id"), "score", F.col("rank").cast("long").alias("rank"))


_KINDS = "regexp_full_match(term, '[0-9. -]{2,}') AS number, regexp_full_match(term, '[a-z. -]+') AS latin"
_RAW = """(0.3 * log10(10 + (1e7 - f + 0.5) / (f + 0.5)) + 0.7 * log10(10 + (1e9 - g + 0.5) / (g + 0.5)))
    * CASE WHEN regexp_full_match(term, '[0-9,.]{2,}') THEN 2.0 WHEN regexp_full_match(term, '[a-z]{1,2}') THEN 0.01 ELSE 1.0 END
    * CASE WHEN regexp_matches(term, '^[0-9-]') THEN 2.0 ELSE 1.0 END"""
_FREQUENCIES = "CASE WHEN number THEN 3.0 WHEN latin THEN 300.0 ELSE 10.0 END AS f, CASE WHEN number THEN 5.0 WHEN latin THEN 300.0 ELSE 3.0 END AS g"
_TERM_WEIGHTS = f"""
WITH terms AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{LATIN}')) AS term FROM benchmark),
kinds AS (SELECT *, {_KINDS} FROM terms),
raw AS (SELECT query_id, term, {_RAW} AS raw FROM (SELECT *, {_FREQUENCIES} FROM kinds))
SELECT query_id, term, round(raw / sum(raw) OVER (PARTITION BY query_id), 6) AS weight FROM raw
"""


def _clauses(questions: str) -> str:
    """CTEs up to ``weighted`` (query_id, segment, term, weight) of questions (query_id, query)."""
    return rf"""
asked AS (SELECT query_id, trim(regexp_replace(regexp_replace(lower(query), '[ :|\r\n\t,，。？?/`!！&^%()\[\]{{}}<>]+', ' ', 'g'), '[ \t]+', ' ', 'g')) AS t FROM ({questions})),
pieces AS (SELECT query_id, list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '') AS x FROM asked),
each AS (SELECT query_id, unnest(x) AS word, unnest(range(len(x))) AS pos FROM pieces),
neighbours AS (SELECT *, regexp_matches(word, '[a-zA-Z]$') AND coalesce(regexp_matches(lag(word) OVER (PARTITION BY query_id ORDER BY pos), '[a-zA-Z]$'), false) AS joined FROM each),
segmented AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY query_id ORDER BY pos) AS segment FROM neighbours),
said AS (SELECT DISTINCT query_id, segment, unnest(regexp_extract_all(word, '{LATIN}')) AS term FROM segmented WHERE segment <= 256),
raws AS (SELECT query_id, segment, term, {_RAW} AS raw FROM (SELECT *, {_FREQUENCIES} FROM (SELECT *, {_KINDS} FROM said))),
weighted AS (SELECT query_id, term, round(raw / sum(raw) OVER (PARTITION BY query_id, segment), 6) AS weight FROM raws),
inner_parts AS (
  SELECT query_id, term AS clause, unnest(p) AS term, 0.5 * weight AS boost FROM (SELECT *, regexp_extract_all(term, '[0-9]+|[a-zA-Z]+') AS p FROM weighted)
  WHERE length(term) > 2 AND len(p) > 1 AND NOT regexp_full_match(term, '\p{{L}}+'))"""


_EXPANDED = _clauses("SELECT item_id AS query_id, text AS query FROM benchmark WHERE item_id IN (SELECT vec_id FROM embeddings)") + f""",
clauses AS (SELECT query_id, clause, term, sum(boost) AS boost FROM (SELECT query_id, term AS clause, term, weight AS boost FROM weighted UNION ALL SELECT query_id, clause, term, boost FROM inner_parts) GROUP BY ALL),
toks AS (SELECT doc_id, regexp_extract_all(lower(text), '{LATIN}') AS w FROM documents),
sized AS (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM toks),
totals AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM toks),
found AS (SELECT doc_id, term, count(*) AS tf, any_value(size) AS size FROM sized WHERE term IN (SELECT term FROM clauses) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM found GROUP BY 1),
scored AS (
  SELECT query_id, doc_id, round(sum(boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * size / mean))), 6) AS score, count(DISTINCT clause) AS matched
  FROM found JOIN clauses USING (term) JOIN df USING (term), totals GROUP BY ALL),
wanted AS (SELECT query_id, count(DISTINCT clause) AS wanted FROM clauses GROUP BY 1),
lexical AS (
  SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank
  FROM scored JOIN wanted USING (query_id) WHERE matched >= greatest(1, floor(wanted * 0.6 + 1e-9)))"""


def _dense(queries: str) -> str:
    cosine = "list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.vector AS DOUBLE[])) / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.vector AS DOUBLE[]), CAST(q.vector AS DOUBLE[]))))"
    return f"""
dense AS (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank
  FROM (SELECT q.query_id, e.vec_id, round({cosine}, 6) AS score FROM embeddings e, ({queries}) q))"""


def index_upserts(spark: SparkSession, d: str) -> DataFrame:
    """BM25 after two upserts and a deletion: the first has most documents, some with another text; the second those again and the rest."""
    docs, index = table(spark, d, "documents"), TextIndex(spark, f"{shared_folder(spark)}/upserts-{uuid.uuid4().hex}")
    changed = F.col("doc_id") % 3 == 0
    index.upsert(docs.where("doc_id % 5 <> 0").withColumn("text", F.when(changed, F.concat_ws(" ", F.reverse("text"), "source")).otherwise(F.col("text"))))
    index.upsert(docs.where("doc_id % 3 = 0 OR doc_id % 5 = 0"))
    index.delete(docs.where("doc_id % 7 = 0").select("doc_id"))
    found = settled(index.bm25(_questions(spark, d), 5).select("query_id", F.col("id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank")), "upserts")
    index.versions.remove()
    return found


def phrase_search(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold the third and fourth word of a benchmark passage side by side, or at half the boost up to two places off."""
    words = _questions(spark, d).select("query_id", F.slice(T.tokens(F.col("query")), 3, 2).alias("words")).where("size(array_distinct(words)) = 2")
    rows = words.select("query_id", F.lit("phrase").alias("clause"), "words", F.explode(F.array(F.lit(0), F.lit(2))).alias("slop")).withColumn("boost", F.when(F.col("slop") == 0, 1.0).otherwise(0.5))
    none = spark.createDataFrame([], "query_id long, clause string, term string, boost double")
    found = text_index(spark, d).search(none, 10, Phrases.of(rows))
    return found.select("query_id", F.col("id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


_PHRASES = f"""
toks AS (SELECT doc_id, regexp_extract_all(lower(text), '{LATIN}') AS w FROM documents),
totals AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM toks),
asked AS (SELECT query_id, w[3] AS a, w[4] AS b FROM (SELECT item_id AS query_id, regexp_extract_all(lower(text), '{LATIN}') AS w FROM benchmark) WHERE len(w) >= 4 AND w[3] <> w[4]),
terms AS (SELECT a AS term FROM asked UNION SELECT b FROM asked),
places AS (SELECT * FROM (SELECT doc_id, len(w) AS size, unnest(w) AS term, unnest(range(len(w))) AS p FROM toks) WHERE term IN (SELECT term FROM terms)),
idf AS (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(DISTINCT doc_id) AS df FROM places GROUP BY term), totals),
met AS (
  SELECT query_id, x.doc_id, any_value(x.size) AS size, bool_or(y.p - x.p = 1) AS exact, bool_or(abs(y.p - 1 - x.p) <= 2) AS near
  FROM asked JOIN places x ON x.term = a JOIN places y ON y.term = b AND y.doc_id = x.doc_id GROUP BY query_id, x.doc_id),
scored AS (
  SELECT query_id, doc_id, round(CASE WHEN exact THEN 1.5 ELSE 0.5 END * (i.idf + j.idf) * 2.2 / (1 + 1.2 * (1 - 0.75 + 0.75 * size / mean)), 6) AS score
  FROM met JOIN asked USING (query_id) JOIN idf i ON i.term = a JOIN idf j ON j.term = b, totals WHERE near)"""


def knn_cells(spark: SparkSession, d: str) -> DataFrame:
    """Approximate neighbours of the vectors whose number is divisible by 100, from stored cells, with how many vectors were compared."""
    found = vector_index(spark, d).search(_asked_vectors(spark, d), 10)
    return found.select("query_id", F.col("id").alias("vec_id"), "score", F.col("rank").cast("long").alias("rank"), "candidates")


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    queries = _questions(spark, d).join(vectors, "query_id")
    return search.hybrid(table(spark, d, "documents"), table(spark, d, "embeddings"), queries, 5, index=text_index(spark, d))


_FUSED = """
parts AS (
  SELECT query_id, doc_id AS id, rank, 0 AS leg FROM lexical WHERE rank < 10 AND query_id IN (SELECT vec_id FROM embeddings)
  UNION ALL SELECT query_id, vec_id, rank, 1 FROM dense WHERE rank < 10),
fused AS (SELECT query_id, id, round(sum(1.0 / (60 + rank + 1)), 9) AS score, min(leg * 1000 + rank) AS seen FROM parts GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) - 1 AS rank FROM fused)"""


def rrf_two_leg(spark: SparkSession, d: str) -> DataFrame:
    """Fusion of orders' two rankings within each priority: by price and by date."""
    orders = table(spark, d, "orders").select(F.col("o_orderpriority").alias("query_id"), F.col("o_orderkey").alias("id"), "o_totalprice", F.unix_timestamp("o_orderdate").cast("double").alias("day"))
    legs = [search.best(orders.select("query_id", "id", F.col(c).alias("score")), 100) for c in ("o_totalprice", "day")]
    fused = search.fuse_legs(legs)
    return fused.select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


def rrf_generic(spark: SparkSession, d: str) -> DataFrame:
    """Fusion of event types' rankings of users: a list for each type, by value."""
    events = table(spark, d, "events")
    order = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    items = events.select(
        F.col("event_type").alias("list"), (F.row_number().over(order) - 1).alias("rank"), (F.col("user_id") % 3 != 0).alias("has_chunk_id"),
        F.when(F.col("user_id") % 7 != 0, F.col("user_id").cast("string")).alias("chunk_id"), F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("doc_id"), F.col("event_id").alias("payload"),
    )
    return search.fuse_lists(items)


def _weighted_terms(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark, d).select("query_id", F.explode(T.tokens(F.col("query"))).alias("term"))


def term_weights(spark: SparkSession, d: str) -> DataFrame:
    return search.term_weights(_weighted_terms(spark, d), "query_id")


def term_weights_table(spark: SparkSession, d: str) -> DataFrame:
    """Weights of the questions' terms, mixed names among them, by how often documents use terms of an even number of letters; the names' parts are of a kind."""
    terms = _mixed_questions(spark, d).select("query_id", F.explode(T.tokens(F.col("query"))).alias("term"))
    counts = table(spark, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("term")).where("length(term) % 2 = 0").groupBy("term").agg(F.count("*").alias("count"))
    kinds = counts.where("count % 5 = 0").select("term", F.when(F.col("count") % 2 == 0, "corp").otherwise("toxic").alias("kind"))
    return search.term_weights_of(terms, "query_id", counts, kinds)


#: Characters that stand for the letters a to z.
_CJK = "".join(chr(0x4E00 + 37 * k) for k in range(26))
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def cjk_segments(spark: SparkSession, d: str) -> DataFrame:
    """Words of the conversations' texts, written in CJK characters, by a dictionary of the beginnings and ends of the questions' words: how often each comes out."""
    in_cjk = lambda text: F.translate(F.lower(text), _LETTERS, _CJK)
    words = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("w"))
    parts = words.select(F.explode(F.array(F.left("w", F.lit(2)), F.left("w", F.lit(3)), F.right("w", F.lit(2)), F.right("w", F.lit(4)))).alias("w"))
    dictionary = parts.groupBy(F.translate("w", _LETTERS, _CJK).alias("word")).agg(F.count("*").alias("frequency"))
    turns = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), in_cjk(F.col("text")).alias("text"))
    found = segment.tokens(turns, dictionary, for_search=False).select(F.explode("words").alias("word"))
    return found.where(F.col("word").rlike(segment.CJK)).groupBy(F.translate("word", _CJK, _LETTERS).alias("word")).agg(F.count("*").alias("n"))


def _mixed_questions(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages with a name of letters and digits each."""
    name = F.concat(F.lit(" 1cr"), (F.col("query_id") % 20 + 10).cast("string"), F.lit("ni9ti."))
    return _questions(spark, d).withColumn("query", F.concat("query", name))


#: A small dictionary.
SYNONYMS = [("the", "this"), ("the", "that"), ("of", "from"), ("18", "eighteen")]


_MIXED = "SELECT item_id AS query_id, text || ' 1cr' || (item_id % 20 + 10) || 'ni9ti.' AS query FROM benchmark"
_SYNONYMS = "synonyms(term, synonym) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in SYNONYMS) + ")"


def query_clauses(spark: SparkSession, d: str) -> DataFrame:
    return search.query_clauses(_mixed_questions(spark, d), spark.createDataFrame(SYNONYMS, "term string, synonym string"))


def query_keywords(spark: SparkSession, d: str) -> DataFrame:
    found = search.keywords(_mixed_questions(spark, d), spark.createDataFrame(SYNONYMS, "term string, synonym string"))
    return found.select("query_id", F.size("keywords").cast("long").alias("n"), F.array_contains("keywords", "ti").alias("has_part"), F.array_contains("keywords", "that").alias("has_synonym"))


def _query_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of the benchmark items whose number is divisible by 100, the queries of the stated set."""
    asked = table(spark, d, "benchmark").where("item_id % 100 = 0")
    return asked.select(F.col("item_id").alias("query_id"), F.posexplode(T.tokens(F.col("text"))).alias("pos", "term")).withColumn("weight", (1 + F.col("pos") % 3).cast("double"))


def token_similarity(spark: SparkSession, d: str) -> DataFrame:
    """How much of the terms and pairs of each query's benchmark item each document has."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), T.tokens(F.col("text")).alias("words"))
    return search.similarity_to_texts(_query_terms(spark, d), docs)


_TOKEN_SIMILARITY = f"""
q AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{LATIN}')) AS term, unnest(range(len(regexp_extract_all(lower(text), '{LATIN}')))) AS pos FROM benchmark WHERE item_id % 100 = 0),
qw AS (SELECT query_id, pos, term, CAST(1 + pos % 3 AS DOUBLE) AS weight FROM q),
qn AS (SELECT *, lead(term) OVER (PARTITION BY query_id ORDER BY pos) AS nt, lead(weight) OVER (PARTITION BY query_id ORDER BY pos) AS nw FROM qw),
qf AS (SELECT query_id, feature, sum(value) AS value FROM (SELECT query_id, term AS feature, 0.4 * weight AS value FROM qn UNION ALL SELECT query_id, term || nt, 0.6 * greatest(weight, nw) FROM qn WHERE nt IS NOT NULL) GROUP BY ALL),
dt AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '{LATIN}') AS w FROM documents),
df AS (SELECT DISTINCT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || w[i + 1]))) AS feature FROM dt),
alike AS (
  SELECT query_id, id, round((1e-9 + sum(value)) / (1e-9 + any_value(total)), 6) AS similarity
  FROM df JOIN qf USING (feature) JOIN (SELECT query_id, sum(value) AS total FROM qf GROUP BY 1) USING (query_id) GROUP BY ALL)"""


def hybrid_linear(spark: SparkSession, d: str) -> DataFrame:
    """Vectors whose number is divisible by 100, with the benchmark item of that number, against all vectors and documents."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search.linear_hybrid(vectors, _asked_vectors(spark, d), token_similarity(spark, d))


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Recall and MRR at 5 of BM25 for benchmark passages, against the documents that contain them."""
    docs, asked = table(spark, d, "documents"), _questions(spark, d)
    relevant = search.containing(docs, asked)
    return evaluate.ranking_quality(text_index(spark, d).bm25(asked, 5), relevant, 5)


def keyword_recall(spark: SparkSession, d: str) -> DataFrame:
    """Keyword recall and MRR of BM25's best 5, expecting the first six words of each passage."""
    docs, asked = table(spark, d, "documents"), _questions(spark, d)
    expected = asked.select("query_id", F.slice(F.split("query", " "), 1, 6).alias("expected"))
    best = search.held(settled(text_index(spark, d).bm25(asked, 5), "best"))  # some rows of each query, which go to the texts
    found = docs.select(F.col("doc_id").alias("id"), "text").join(best, "id").join(search.held(expected), "query_id")
    scored = evaluate.keyword_recall(found)
    return scored.select("query_id", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


def text_profile(spark: SparkSession, d: str) -> DataFrame:
    """Scalars of every document: every third as plain ASCII, others with some full-width and Chinese characters behind them, some of these with the note of an empty answer."""
    x = F.col("x")
    text, note = F.concat("text", F.lit(" ＡＢ１２　钢铁 材料")), F.lit(f" {L.NO_CONTENT}")
    said = F.when(F.col("doc_id") % 3 == 0, F.concat(F.regexp_replace("text", r"[^\x00-\x7F]", "?"), F.lit(" !?"))).when(F.col("doc_id") % 5 == 2, F.concat(text, note)).otherwise(text)
    docs = table(spark, d, "documents").select("doc_id", "source", said.alias("x"))
    return docs.select(
        "doc_id", F.md5(T.half_width(x)).alias("half_width"), F.round(T.cjk_ratio(x), 6).alias("cjk"), T.has_long_ascii_run(x).alias("long_run"), T.token_estimate(x).alias("tokens"),
        F.md5(T.without_controls(x)).alias("clean"), F.md5(T.without_signs(x)).alias("plain"), T.head(x, 100, " [more]").alias("head"), T.tail(x, 50, "[...]").alias("tail"),
        T.block_type(x).alias("block"), F.size(T.simple_tokens(x)).cast("long").alias("simple"), T.is_ascii(x).alias("ascii"), T.has_citation(x).alias("cites"),
        T.is_useful(x).alias("useful"), T.has_no_result(x).alias("empty"), F.md5(T.entity_id(x)).alias("entity"), T.file_safe(F.concat("source", F.lit(" a/b"))).alias("file"),
    )


_TEXT_PROFILE = rf"""
WITH t AS (
  SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, '[^\x00-\x7F]', '?', 'g') || ' !?' ELSE text || ' ＡＢ１２　钢铁 材料' || CASE WHEN doc_id % 5 = 2 THEN ' Worker completed but produced no textual output' ELSE '' END END AS x FROM documents)
SELECT doc_id, md5(replace(replace(replace(replace(replace(x, 'Ａ', 'A'), 'Ｂ', 'B'), '１', '1'), '２', '2'), '　', ' ')) AS half_width,
  round(len(regexp_extract_all(x, '[\x{{4e00}}-\x{{9fff}}]')) / length(replace(replace(x, ' ', ''), chr(10), '')), 6) AS cjk, regexp_matches(x, '[a-zA-Z]{{50,}}') AS long_run, length(x) // 2 AS tokens,
  md5(regexp_replace(x, '[\x00-\x08\x0B\x0C\x0E-\x1F]', ' ', 'g')) AS clean,
  md5(trim(regexp_replace(regexp_replace(x, '[ :|\r\n\t,，。？?/`!！&^%()\[\]{{}}<>]+', ' ', 'g'), '[ \t]+', ' ', 'g'))) AS plain,
  CASE WHEN length(x) > 100 THEN left(x, 100) || ' [more]' ELSE x END AS head, CASE WHEN length(x) > 50 THEN '[...]' || right(x, 50) ELSE x END AS tail,
  CASE WHEN len(regexp_extract_all(x, '[\x{{4e00}}-\x{{9fff}}]+|[a-zA-Z0-9]+')) BETWEEN 4 AND 11 THEN 'Tx' WHEN len(regexp_extract_all(x, '[\x{{4e00}}-\x{{9fff}}]+|[a-zA-Z0-9]+')) > 11 THEN 'Lx' ELSE 'Ot' END AS block,
  len(regexp_extract_all(x, '[\x{{4e00}}-\x{{9fff}}]+|[a-zA-Z0-9]+')) AS simple, regexp_full_match(x, '[\x00-\x7F]*') AS ascii,
  regexp_matches(x, '(?i)p\.\s*\d+|pp\.\s*\d+|\[?\d+\]|Figure\s*\d+|page\s*\d+|fig\.\s*\d+') AS cites,
  NOT contains(x, 'Worker completed but produced no textual output') AS useful, contains(lower(x), 'no results') OR contains(lower(x), 'no documents') OR contains(lower(x), 'empty') AS empty,
  md5(replace(lower(regexp_replace(x, '^\s+', '')), ' ', '_')) AS entity, source || '_a_b' AS file
FROM t
"""


def fine_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Parts of the names of parts, customers and suppliers."""
    names = table(spark, d, "part").select(F.concat(F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")), F.lit("x"), F.col("p_size").cast("string")).alias("name")).distinct()
    return names.select("name", F.array_join(T.fine_tokens(F.col("name")), " ").alias("parts"))


def catalog_search(spark: SparkSession, d: str) -> DataFrame:
    """Parts as a catalog: the best of distinct names for a query with a required word."""
    catalog = table(spark, d, "part").select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), F.lit("part of a machine").alias("description"), F.lit("parts").alias("category"), F.lit("small red ring").alias("search_hint")).distinct()
    return search.catalog_search(catalog, "+ring red", 8).select("name", F.col("score").cast("long").alias("score"))


_CATALOG = """
WITH c AS (SELECT DISTINCT replace(p_name, ' ', '_') AS name FROM part)
SELECT name, CAST(CASE WHEN list_contains(string_split(name, '_'), 'ring') THEN 10 WHEN contains(name, 'ring') THEN 5 ELSE 0 END
     + CASE WHEN list_contains(string_split(name, '_'), 'red') THEN 10 WHEN contains(name, 'red') THEN 5 ELSE 0 END + 8 AS BIGINT) AS score
FROM c ORDER BY score DESC, name LIMIT 8
"""


def vocabulary_hits(spark: SparkSession, d: str) -> DataFrame:
    """Words of part names within the benchmark's passages."""
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("entity")).distinct()
    asked = _questions(spark, d).withColumn("query", F.concat("query", F.lit(" "), F.element_at(F.array(F.lit("A RED Ring"), F.lit("big widget")), (F.col("query_id") % 2 + 1).cast("int"))))
    return search.vocabulary_hits(asked, words)


def query_entities(spark: SparkSession, d: str) -> DataFrame:
    """Words of part names in passages, the longest first; every third passage names candidates of its own, of which half hit."""
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("entity")).distinct()
    asked = _questions(spark, d).withColumn("query", F.concat("query", F.lit(" A RED Ring, big widget")))
    own = asked.where("query_id % 3 = 0").select("query_id", F.explode(F.when(F.col("query_id") % 2 == 0, F.array(F.lit("red ring"), F.lit("Big"), F.lit("none"))).otherwise(F.array(F.lit("absent")))).alias("entity"))
    return search.query_entities(asked, words, own)


def graph_expanded(spark: SparkSession, d: str) -> DataFrame:
    """Passages with two relations each, as a query of the lexical leg sees them."""
    asked = _questions(spark, d)
    relations = table(spark, d, "nation").select((F.col("n_nationkey").cast("long") % 10).alias("query_id"), F.col("n_nationkey").cast("long").alias("seq"), F.col("n_name").alias("subject"), F.lit("lies-in").alias("relation"), F.concat(F.lit("region ("), F.col("n_regionkey").cast("string"), F.lit(")")).alias("object"))
    return search.with_relations(asked, relations)


def graph_search(spark: SparkSession, d: str) -> DataFrame:
    """The best documents for passages with what the graph says of them: the expanded text is what is searched."""
    found = text_index(spark, d).bm25(graph_expanded(spark, d), 5)
    return found.select("query_id", F.col("id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


_EXPANDED_TERMS = f"""terms AS (SELECT item_id AS query_id, unnest(list_distinct(list_concat(regexp_extract_all(lower(text), '{LATIN}'), CASE WHEN contains(text, '相关背景') THEN ['相关', '关背', '背景'] ELSE [] END))) AS term FROM expanded),
"""


def boolean_search(spark: SparkSession, d: str) -> DataFrame:
    """Documents, by text or source, with one of two words."""
    return search.any_word(table(spark, d, "documents"), ["worthless", "src7"], ["text", "source"]).select("doc_id")


def result_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Nations as the results of a query for each region."""
    rows = table(spark, d, "nation").select(F.col("n_regionkey").alias("query_id"), F.col("n_nationkey").alias("rank"), "n_name")
    block = search.result_block(F.col("rank"), T.citation(F.col("n_name"), F.col("rank"), F.lit("text")), F.lit("text_chunk"), F.lower("n_name"), F.when(F.col("rank") % 2 == 0, F.concat(F.lit("img/a b+"), "n_name", F.lit(".png"))), "http://localhost/images?path=")
    return search.result_text(rows, block)


def pre_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of the passages without punctuation, and short tokens of their words merged."""
    asked = _questions(spark, d).withColumn("query", F.concat(F.lit("a bc "), "query", F.lit(" 1 2 b3 c d e f long 7")))
    words = F.filter(F.split(F.lower("query"), r"\s+"), lambda w: w != "")
    return asked.select("query_id", F.array_join(T.pretokens(F.col("query"), ["the"]), " ").alias("pre"), F.array_join(T.merged_tokens(words, ["of"]), "|").alias("merged"), F.array_join(T.segments(F.col("query")), "|").alias("segments"))


_MERGED = r"""
WITH RECURSIVE asked AS (SELECT item_id AS query_id, 'a bc ' || text || ' 1 2 b3 c d e f long 7' AS q FROM benchmark),
w AS (SELECT query_id, q, list_filter(regexp_split_to_array(lower(q), '\s+'), lambda x: x <> '') AS x FROM asked),
f AS (SELECT query_id, x, list_transform(x, lambda t: (length(t) = 1 OR regexp_full_match(t, '[0-9a-z]{1,2}')) AND t <> 'of') AS s FROM w),
-- One token, or a run of short ones, at a time: up to four are taken together, of longer runs two.
m AS (
  SELECT query_id, x, s, 1 AS i, CAST([] AS VARCHAR[]) AS done FROM f
  UNION ALL
  SELECT query_id, x, s, i + n, list_append(done, array_to_string(x[i:i + n - 1], ' ')) FROM (
    SELECT *, CASE WHEN run < 2 THEN 1 WHEN run < 5 THEN run ELSE 2 END AS n FROM (
      SELECT *, coalesce(list_position(s[i:], false), len(x) - i + 2) - 1 AS run FROM m WHERE i <= len(x)))),
merged AS (SELECT query_id, array_to_string(done, '|') AS merged FROM m WHERE i > len(x)),
words AS (SELECT query_id, unnest(x) AS word, unnest(range(len(x))) AS pos FROM (SELECT query_id, list_filter(regexp_split_to_array(q, '\s+'), lambda t: t <> '') AS x FROM asked)),
glued AS (SELECT *, CASE WHEN regexp_matches(word, '[a-zA-Z]$') AND coalesce(regexp_matches(lag(word) OVER (PARTITION BY query_id ORDER BY pos), '[a-zA-Z]$'), false) THEN ' ' WHEN pos > 0 THEN '|' ELSE '' END AS glue FROM words),
segments AS (SELECT query_id, string_agg(glue || word, '' ORDER BY pos) AS segments FROM glued GROUP BY 1)
SELECT query_id, array_to_string(list_filter(regexp_extract_all(lower(regexp_replace(q, '[~—\t @#%!<>,.?":;''{}\[\]_=()|&`×\\/]', '', 'g')), '__LATIN__'), lambda t: t <> 'the' AND NOT regexp_full_match(t, '[0-9]')), ' ') AS pre, merged, segments
FROM asked JOIN merged USING (query_id) JOIN segments USING (query_id)
""".replace("__LATIN__", LATIN)


QUERIES = {
    "hybrid_search": (hybrid_search, f"WITH {_EXPANDED},{_dense('SELECT item_id AS query_id, e.embedding AS vector FROM benchmark JOIN embeddings e ON e.vec_id = item_id')},{_FUSED} SELECT query_id, rank, id AS doc_id, score, '[来源: ' || source || ']' AS citation FROM ranked JOIN documents ON doc_id = id WHERE rank < 5"),
    "bm25_topk": (bm25_topk, f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM lexical WHERE rank < 10"),
    "knn_cosine_topk": (knn_cosine_topk, f"WITH {_dense('SELECT vec_id AS query_id, embedding AS vector FROM embeddings WHERE vec_id % 100 = 0')} SELECT query_id, vec_id, score, rank FROM dense WHERE rank < 10"),
    "rrf_two_leg": (rrf_two_leg, """
WITH legs AS (
  SELECT o_orderpriority AS query_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank, 0 AS leg FROM orders
  UNION ALL SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) - 1, 1 FROM orders),
fused AS (SELECT query_id, id, round(sum(1.0 / (60 + rank + 1)), 9) AS score, min(leg * 1000 + rank) AS seen FROM legs WHERE rank < 100 GROUP BY ALL)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) - 1 AS rank FROM fused"""),
    "rrf_generic": (rrf_generic, """
WITH items AS (
  SELECT event_type AS list, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) - 1 AS rank, event_id AS payload,
         CASE WHEN user_id % 3 <> 0 THEN CASE WHEN user_id % 7 <> 0 THEN CAST(user_id AS VARCHAR) END ELSE 'd' || user_id END AS uid FROM events)
SELECT uid, round(sum(1.0 / (60 + rank + 1)), 9) AS score, arg_min(payload, (list, rank)) AS payload FROM items WHERE uid IS NOT NULL GROUP BY uid"""),
    "term_weights": (term_weights, _TERM_WEIGHTS),
    "query_clauses": (query_clauses, f"""
WITH {_clauses(_MIXED)}, {_SYNONYMS}
SELECT query_id, term AS clause, term, weight AS boost FROM weighted UNION ALL SELECT query_id, clause, term, boost FROM inner_parts WHERE length(term) > 1
UNION ALL SELECT query_id, term, synonym, 0.2 * weight FROM weighted JOIN synonyms USING (term)"""),
    "query_keywords": (query_keywords, f"""
WITH {_clauses(_MIXED)}, {_SYNONYMS},
texts AS (SELECT query_id, segment, string_agg(word, ' ' ORDER BY pos) AS text FROM segmented WHERE segment <= 256 GROUP BY ALL),
tokens AS (SELECT query_id, segment, word, pos, unnest(regexp_extract_all(word, '{LATIN}')) AS term, unnest(range(len(regexp_extract_all(word, '{LATIN}')))) AS nth FROM segmented WHERE segment <= 256),
split AS (SELECT *, regexp_extract_all(term, '[0-9]+|[a-zA-Z]+') AS p FROM tokens),
more AS (
  SELECT query_id, segment, 0 AS kind, pos * 1000 + nth AS at, unnest(list_filter(p, lambda x: length(x) > 1)) AS word, unnest(range(len(list_filter(p, lambda x: length(x) > 1)))) AS n FROM split WHERE length(term) > 2 AND len(p) > 1 AND NOT regexp_full_match(term, '\\p{{L}}+')
  UNION ALL SELECT query_id, segment, 1, pos * 1000 + nth, synonym, 0 FROM tokens JOIN synonyms USING (term)),
sizes AS (SELECT t.query_id, t.segment, count(m.word) AS n FROM texts t LEFT JOIN more m USING (query_id, segment) GROUP BY ALL),
listed AS (SELECT query_id, list(n ORDER BY segment) AS n FROM sizes GROUP BY 1),
-- Keywords so far before each segment's parts and synonyms are looked at.
walked(query_id, n, i, total, taken) AS (
  SELECT query_id, n, 1, 1 + CASE WHEN 1 < 32 THEN n[1] ELSE 0 END, 1 < 32 FROM listed
  UNION ALL SELECT query_id, n, i + 1, total + 1 + CASE WHEN total + 1 < 32 THEN n[i + 1] ELSE 0 END, total + 1 < 32 FROM walked WHERE i < len(n)),
words AS (SELECT query_id, text AS word FROM texts UNION SELECT m.query_id, m.word FROM more m JOIN walked k ON k.query_id = m.query_id AND k.i = m.segment AND k.taken)
SELECT query_id, count(*) AS n, bool_or(word = 'ti') AS has_part, bool_or(word = 'that') AS has_synonym FROM words GROUP BY 1""".replace("WITH ", "WITH RECURSIVE ", 1)),
    "token_similarity": (token_similarity, f"WITH {_TOKEN_SIMILARITY} SELECT query_id, id, similarity FROM alike"),
    "index_upserts": (index_upserts, "WITH kept AS (SELECT * FROM documents WHERE doc_id % 7 <> 0)," + _BM25.replace("FROM documents", "FROM kept") + " SELECT query_id, doc_id, score, rank FROM lexical WHERE rank < 5"),
    "phrase_search": (phrase_search, f"WITH {_PHRASES} SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM scored) WHERE rank < 10"),
    "knn_cells": (knn_cells, None),
    "term_weights_table": (term_weights_table, f"""
WITH asked AS (SELECT query_id, unnest(regexp_extract_all(lower(query), '{LATIN}')) AS term FROM ({_MIXED})),
terms AS (SELECT DISTINCT query_id, term FROM asked),
counts AS (SELECT term, count(*) AS c FROM (SELECT unnest(regexp_extract_all(lower(text), '{LATIN}')) AS term FROM documents) WHERE length(term) % 2 = 0 GROUP BY 1),
parts AS (
  SELECT term, term AS part FROM (SELECT DISTINCT term FROM terms) UNION
  SELECT term, unnest(list_filter(p, lambda x: length(x) > 1)) FROM (SELECT DISTINCT term, regexp_extract_all(term, '[0-9]+|[a-zA-Z]+') AS p FROM terms) WHERE length(term) > 2 AND len(p) > 1 AND NOT regexp_full_match(term, '\\p{{L}}+')),
each AS (
  SELECT p.term, part, c, regexp_full_match(part, '[0-9. -]{{2,}}') AS number, regexp_full_match(part, '[a-z. -]+') AS latin FROM parts p LEFT JOIN counts ON counts.term = part),
valued AS (
  SELECT *, CASE WHEN number THEN 3.0 WHEN latin AND c IS NULL THEN 300.0 ELSE CAST(greatest(coalesce(c, 0), 10) AS DOUBLE) END AS f,
    CASE WHEN number THEN 5.0 WHEN c IS NOT NULL THEN c + 3.0 WHEN latin THEN 300.0 ELSE 3.0 END AS g FROM each),
known AS (
  SELECT term, CASE WHEN plain AND n > 2 THEN greatest(fp / 6, 10.0) ELSE fw END AS f, CASE WHEN plain AND n > 2 THEN greatest(gp / 6, 3.0) ELSE gw END AS g
  FROM (SELECT term, count(*) AS n, bool_or(part = term AND NOT number AND NOT latin AND c IS NULL) AND length(term) >= 4 AS plain, max(f) FILTER (part = term) AS fw, max(g) FILTER (part = term) AS gw,
      min(f) FILTER (part <> term) AS fp, min(g) FILTER (part <> term) AS gp FROM valued GROUP BY term)),
raws AS (
  SELECT query_id, t.term, (0.3 * log10(10 + (1e7 - f + 0.5) / (f + 0.5)) + 0.7 * log10(10 + (1e9 - g + 0.5) / (g + 0.5)))
    * CASE WHEN regexp_full_match(t.term, '[0-9,.]{{2,}}') THEN 2.0 WHEN regexp_full_match(t.term, '[a-z]{{1,2}}') THEN 0.01 WHEN c % 10 = 0 THEN 3.0 WHEN c % 5 = 0 THEN 2.0 ELSE 1.0 END
    * CASE WHEN regexp_matches(t.term, '^[0-9-]') THEN 2.0 ELSE 1.0 END AS raw
  FROM terms t JOIN known k ON k.term = t.term LEFT JOIN counts ON counts.term = t.term)
SELECT query_id, term, round(raw / sum(raw) OVER (PARTITION BY query_id), 6) AS weight FROM raws"""),
    "cjk_segments": (cjk_segments, """
WITH RECURSIVE words AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM benchmark),
dictionary AS (SELECT word, count(*) AS f FROM (SELECT unnest([w[:2], w[:3], w[-2:], w[-4:]]) AS word FROM words) GROUP BY 1),
size AS (SELECT sum(f) AS total, max(length(word)) AS longest FROM dictionary),
runs AS (SELECT run, count(*) AS times FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS run FROM conversations) GROUP BY 1),
pieces AS (SELECT run, start, n, run[start + 1 : start + n] AS word FROM (SELECT run, unnest(range(length(run))) AS start FROM runs), (SELECT unnest(range(1, longest + 1)) AS n FROM size) WHERE start + n <= length(run)),
edges AS (SELECT run, start, start + n AS ending, word, CAST(round(1000000 * ln(coalesce(f, 1) / total)) AS BIGINT) AS weight FROM pieces LEFT JOIN dictionary USING (word), size WHERE f IS NOT NULL OR n = 1),
paths AS (
  SELECT run, 0 AS here, CAST(0 AS BIGINT) AS total, CAST([] AS VARCHAR[]) AS words, CAST([] AS BIGINT[]) AS back FROM runs
  UNION ALL SELECT p.run, ending, total + weight, list_append(words, word), list_prepend(start, back) FROM paths p JOIN edges e ON e.run = p.run AND e.start = p.here),
best AS (SELECT run, words FROM (SELECT run, words, row_number() OVER (PARTITION BY run ORDER BY total DESC, back) AS nth FROM paths WHERE here = length(run)) WHERE nth = 1)
SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (SELECT unnest(words) AS word, times FROM best JOIN runs USING (run)) GROUP BY 1"""),
    "hybrid_linear": (hybrid_linear, f"""
WITH {_TOKEN_SIMILARITY},{_dense('SELECT vec_id AS query_id, embedding AS vector FROM embeddings WHERE vec_id % 100 = 0').replace(', 6) AS score', ', 15) AS score')}
SELECT d.query_id, vec_id AS id, round(0.85 * score + 0.15 * coalesce(similarity, 0), 6) AS score FROM dense d LEFT JOIN alike a ON a.id = vec_id AND a.query_id = d.query_id"""),
    "recall_at_k": (recall_at_k, f"""
WITH {_BM25},
relevant AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
hits AS (SELECT query_id, count(*) AS hits, min(rank) AS first FROM lexical JOIN relevant USING (query_id, doc_id) WHERE rank < 5 GROUP BY 1)
SELECT query_id, round(coalesce(any_value(hits), 0) / count(*), 6) AS recall, round(coalesce(1.0 / (any_value(first) + 1), 0), 6) AS mrr FROM relevant LEFT JOIN hits USING (query_id) GROUP BY query_id"""),
    "keyword_recall": (keyword_recall, f"""
WITH {_BM25},
asked AS (SELECT item_id AS query_id, string_split(text, ' ')[1:6] AS expected FROM benchmark),
hits AS (SELECT query_id, rank, expected, list_filter(expected, lambda k: contains(lower(text), lower(k))) AS hit FROM lexical JOIN documents USING (doc_id) JOIN asked USING (query_id) WHERE rank < 5)
SELECT query_id, round(len(list_distinct(flatten(list(hit)))) / len(any_value(expected)), 6) AS recall, round(coalesce(1.0 / (min(CASE WHEN len(hit) > 0 THEN rank END) + 1), 0), 6) AS mrr FROM hits GROUP BY query_id"""),
    "text_profile": (text_profile, _TEXT_PROFILE),
    "fine_tokens": (fine_tokens, "SELECT DISTINCT name, CASE WHEN len(p) > 1 THEN array_to_string(p, ' ') ELSE name END AS parts FROM (SELECT name, regexp_extract_all(name, '[0-9]+|[a-zA-Z]+') AS p FROM (SELECT replace(lower(p_brand), '#', '') || 'x' || p_size AS name FROM part))"),
    "catalog_search": (catalog_search, _CATALOG),
    "vocabulary_hits": (vocabulary_hits, "SELECT item_id AS query_id, entity FROM benchmark, (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS entity FROM part) WHERE contains(lower(text || ' ' || CASE WHEN item_id % 2 = 0 THEN 'a red ring' ELSE 'big widget' END), lower(entity))"),
    "query_entities": (query_entities, """
WITH asked AS (SELECT item_id AS query_id, lower(text || ' A RED Ring, big widget') AS q FROM benchmark),
own AS (SELECT query_id, unnest(CASE WHEN query_id % 2 = 0 THEN ['red ring', 'Big', 'none'] ELSE ['absent'] END) AS entity FROM asked WHERE query_id % 3 = 0),
hit AS (SELECT DISTINCT query_id, entity FROM own JOIN asked USING (query_id) WHERE contains(q, lower(entity))),
found AS (
  SELECT * FROM hit
  UNION ALL SELECT query_id, entity FROM asked, (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS entity FROM part) WHERE contains(q, lower(entity)) AND query_id NOT IN (SELECT query_id FROM hit))
SELECT query_id, entity, row_number() OVER (PARTITION BY query_id ORDER BY length(entity) DESC, entity) - 1 AS rank FROM found"""),
    "graph_expanded": (graph_expanded, """
WITH r AS (SELECT n_nationkey % 10 AS query_id, string_agg(n_name || ' lies in region  ' || n_regionkey || ' ', '，' ORDER BY n_nationkey) AS more FROM nation GROUP BY 1)
SELECT item_id AS query_id, text || coalesce('。相关背景：' || more, '') AS query FROM benchmark LEFT JOIN r ON query_id = item_id"""),
    "graph_search": (graph_search, """
WITH r AS (SELECT n_nationkey % 10 AS query_id, string_agg(n_name || ' lies in region  ' || n_regionkey || ' ', '，' ORDER BY n_nationkey) AS more FROM nation GROUP BY 1),
expanded AS (SELECT item_id, text || coalesce('。相关背景：' || more, '') AS text FROM benchmark LEFT JOIN r ON query_id = item_id),""" + re.sub(r"(?m)^terms AS .*\n", lambda _: _EXPANDED_TERMS, _BM25) + " SELECT query_id, doc_id, score, rank FROM lexical WHERE rank < 5"),
    "boolean_search": (boolean_search, f"SELECT doc_id FROM documents WHERE list_contains(regexp_extract_all(lower(text || ' ' || source), '{LATIN}'), 'worthless') OR list_contains(regexp_extract_all(lower(text || ' ' || source), '{LATIN}'), 'src7')"),
    "result_blocks": (result_blocks, """
SELECT n_regionkey AS query_id, string_agg('Doc: ' || n_nationkey || ' [来源: ' || n_name || CASE WHEN n_nationkey > 0 THEN ', p.' || n_nationkey ELSE '' END || '] (Type: text_chunk)' || chr(10) || 'Content: ' || lower(n_name)
  || CASE WHEN n_nationkey % 2 = 0 THEN chr(10) || 'Image: ![text_chunk图表](http://localhost/images?path=img/a%20b%2B' || replace(n_name, ' ', '%20') || '.png)' ELSE '' END, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n_nationkey) AS text
FROM nation GROUP BY 1"""),
    "pre_tokens": (pre_tokens, _MERGED),
}

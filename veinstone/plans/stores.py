"""Sinks, memories, sessions and evaluation: what goes into stores, and what comes back out."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veinstone import registry
from veinstone.functions import nested
from veinstone.operators import chunking, evaluate, resolve, search, sessions
from veinstone.operators.stores import Deletions, KeyedStore
from veinstone.operators.tables import settled, shared_folder
from veinstone.plans.tables import table
from veinstone.sources import files
from veinstone.streaming import events as streams


def _turn_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Turns as chunks, every fourth of them blank."""
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_id"), F.when(F.col("turn") % 4 == 3, "  \n").otherwise(F.col("text")).alias("text"))


def index_upsert(spark: SparkSession, d: str) -> DataFrame:
    """An index of all turns after those of even conversations came once more, longer."""
    rows = files.index_rows(_turn_chunks(spark, d)).withColumn("seq", F.lit(0))
    new = rows.where("doc_id % 2 = 0").withColumns({"text": F.concat("text", F.lit(" again")), "seq": F.lit(1)})
    return files.upsert(rows, new, ["_id"], "seq").select("_id", F.md5("text").alias("text"))


def numbered_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("chunks"))
    return chunking.numbered_rows(docs).select("_id", "chunk_id", F.md5("text").alias("text"))


def chunk_report(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their lines as chunks and their conversation's turns as images."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    chunks = chunking.lines(docs).select("doc_id", F.col("line").alias("chunk"), "text")
    images = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn")
    found = chunking.chunk_report(docs, chunks, images, 1000)
    return found.select("doc_id", "characters", "chunks", "size", "images", F.md5(F.array_join("preview", "|")).alias("preview"))


def asset_store(spark: SparkSession, d: str) -> DataFrame:
    """Pages as assets, paired by position with what was said of every second one."""
    pages = table(spark, d, "pages").select(
        (F.col("page_id") % 10).alias("doc_id"), F.floor(F.col("page_id") / 10).alias("position"), F.col("url").alias("image_path"), F.when(F.col("page_id") % 4 != 0, F.lit(" a caption ")).otherwise("").alias("caption"),
        F.when(F.col("page_id") % 7 != 0, F.base64(F.left("html", F.lit(20)).cast("binary"))).alias("data"), F.when(F.col("page_id") % 11 != 0, F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".png"))).otherwise(" ").alias("filename"),
    )
    said = pages.where("position % 2 = 0").select("doc_id", "position", F.when(F.col("position") % 4 == 0, "chart").alias("category"), F.when(F.col("position") % 6 == 0, F.concat(F.lit("shows "), F.col("position").cast("string"))).otherwise(" ").alias("description"))
    return files.asset_rows(files.with_results(pages, said)).select("filename", "category", "text")


def memory_writes(spark: SparkSession, d: str) -> DataFrame:
    """Nations' memories after a write to each region's even ones, and to new scopes."""
    old = table(spark, d, "nation").select(F.lit("project").alias("scope"), F.col("n_nationkey").cast("string").alias("scope_id"), F.col("n_name").alias("content"))
    entry = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.when(F.col("n_nationkey") % 4 == 0, "project").otherwise("session").alias("scope"), F.col("n_nationkey").cast("string").alias("scope_id"), F.lit("more").alias("content"))
    now = F.lit("2024-05-06 07:08:09").cast("timestamp")
    return files.memory_log(old, entry, now).unionByName(files.memory_log(old, entry, now, append=False).withColumn("scope", F.concat(F.lit("over "), "scope")))


def memory_preload(spark: SparkSession, d: str) -> DataFrame:
    """The memory of three regions, cut to their last characters."""
    memory = table(spark, d, "region").select(F.col("r_name").alias("scope"), F.when(F.col("r_name") != "ASIA", F.repeat(F.concat(F.lower("r_name"), F.lit("-")), F.lit(30))).otherwise(" ").alias("content"))
    return sessions.memory_context(memory, {"EUROPE": 50, "ASIA": 40, "AFRICA": 4000})


def sub_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Conversations with the first customers' names as results of sub-tasks of theirs."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session"), "turn", "text")
    results = table(spark, d, "nation").select(F.concat(F.lit("sub_"), (F.col("n_nationkey") % 5).cast("string")).alias("task"), F.col("n_name").alias("text"))
    found = sessions.append_sub_tasks(turns, results.withColumn("task", F.col("task")))
    return found.select("session", "turn", F.md5("text").alias("text"))


def patch_texts(spark: SparkSession, d: str) -> DataFrame:
    """Turns as patches of their conversation; every third conversation closes with a separator, every third with a fence."""
    end = F.when(F.col("conv_id") % 3 == 0, "\n---\n").when(F.col("conv_id") % 3 == 1, "\n``` ").otherwise("")
    parts = table(spark, d, "conversations").select(F.col("conv_id").alias("task_id"), F.col("turn").alias("seq"), F.concat("text", end).alias("patch"))
    return streams.patches(parts).select("task_id", F.md5("text").alias("text"), "closed")


def idle_keys(spark: SparkSession, d: str) -> DataFrame:
    """Users without an event in the last two days of January 2024's first week, as far as the events go."""
    last = table(spark, d, "events").select(F.col("user_id").alias("key"), "ts")
    return streams.idle_since(last, F.lit("2024-01-20 00:00:00").cast("timestamp"), "172800 seconds")


def loops_by_type(spark: SparkSession, d: str) -> DataFrame:
    """The largest loop number in the logs of each type of event; purchases have none."""
    said = F.when(F.col("event_type") != "purchase", F.concat(F.lit("[Evaluator] Loop "), (F.col("event_id") % 12).cast("string"), F.lit("/12 then [Evaluator] Loop "), (F.col("user_id") % 15).cast("string"), F.lit("/15"))).otherwise("nothing")
    return evaluate.most_loops(table(spark, d, "events").select("event_type", said.alias("text")), r"\[Evaluator\] Loop (\d+)/", ["event_type"])


def extraction_input(spark: SparkSession, d: str) -> DataFrame:
    """Turns of some conversations that are long enough to ask for an extraction."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.concat(F.lit("  \n"), "text", F.lit(" \t")).alias("text"))
    return files.long_enough(files.of_documents(turns, [1, 2, 3, 5, 8, 13])).select("doc_id", "turn")


def newest_orders(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("created_at"))
    rows, total = files.newest_first(orders)
    return rows.crossJoin(F.broadcast(total)).select("o_orderkey", "created_at", "total")  # one row


def pair_questions(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of neighbouring nations as questions."""
    pairs = table(spark, d, "nation").select(F.col("n_nationkey").alias("pair_id"), F.col("n_name").alias("a"), F.lower("n_name").alias("b"))
    return resolve.questions(pairs)


def known_contents(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose content is stored already: that of odd documents."""
    docs = table(spark, d, "documents").select("doc_id", nested.content_hash(F.col("text")).alias("hash"))
    return resolve.stored_already(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1").select("hash")).select("doc_id")


def tool_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Parts' names as a catalog: the first seven asked for by name, from the last to the first, and those that two words find, the second of them required."""
    catalog = table(spark, d, "part").groupBy(F.replace("p_name", F.lit(" "), F.lit("_")).alias("name")).agg(F.max("p_type").alias("description"), F.min("p_brand").alias("category"), F.lit("of a machine").alias("search_hint"))
    first = [row["name"] for row in catalog.select("name").orderBy("name").limit(7).collect()]
    asked = search.catalog_search(catalog, "select: " + " , ".join(name.upper() for name in reversed(first))).withColumn("at", F.monotonically_increasing_id())
    listed = asked.select(F.lit("select").alias("kind"), F.row_number().over(Window.orderBy("at")).cast("long").alias("nth"), "name", "score")  # a few names, in order
    found = search.catalog_search(catalog, "ring +small", 50)
    return listed.unionByName(found.select(F.lit("found").alias("kind"), F.row_number().over(Window.orderBy(F.desc("score"), "name")).cast("long").alias("nth"), "name", "score"))


def written_stores(spark: SparkSession, d: str) -> DataFrame:
    """What is left in stores of turns, speakers and conversations after upserts and a deletion that failed in one store and was taken up again, and what it reported."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", F.md5("text").alias("text"))
    root = f"{shared_folder(spark)}/written-{uuid.uuid4().hex}"
    chunks = KeyedStore(spark, f"{root}/chunks", ["conv_id", "turn"], "conv_id long, turn int, text string")
    speakers = KeyedStore(spark, f"{root}/speakers", ["conv_id", "role"], "conv_id long, role string, said long")
    known = KeyedStore(spark, f"{root}/known", ["conv_id"], "conv_id long, turns long")
    chunks.upsert(turns.withColumn("text", F.when(F.col("turn") % 2 == 0, "old").otherwise(F.col("text"))))
    chunks.upsert(turns.where("turn % 2 = 0"))
    speakers.upsert(turns.groupBy("conv_id", "role").agg(F.count("*").alias("said")))
    known.upsert(turns.groupBy("conv_id").agg(F.count("*").alias("turns")))
    deletions = Deletions(spark, f"{root}/journal", {"chunks": chunks, "speakers": speakers}, known, "conv_id")
    works, speakers.delete = speakers.delete, _unavailable
    reports = [deletions.delete(turns.where("conv_id % 10 = 3").select("conv_id"))]
    speakers.delete = works
    reports.append(deletions.resumed())
    said = [report.select(F.lit(f"report {k}").alias("store"), F.col("store").alias("what"), F.coalesce("rows", F.lit(-1)).alias("rows")) for k, report in enumerate(reports)]
    left = [store.read().groupBy().agg(F.count("*").alias("rows"), F.count_if(F.col("text") == "old").alias("old") if name == "chunks" else F.lit(0).alias("old")) for name, store in (("chunks", chunks), ("speakers", speakers), ("known", known))]
    left = [row.select(F.lit(name).alias("store"), F.concat(F.lit("left, old "), F.col("old").cast("string")).alias("what"), "rows") for name, row in zip(("chunks", "speakers", "known"), left)]
    return settled(reduce(DataFrame.unionByName, [*said, *left]), "written-stores")


def _unavailable(*_) -> int:
    raise ConnectionError("this store can't be reached")


def text_search(spark: SparkSession, d: str) -> DataFrame:
    """A table function's search in SQL for two words, over a written index of them."""
    terms = spark.createDataFrame([("the",), ("of",), ("la",)], "term string")
    index = search.postings(table(spark, d, "documents"), terms)
    registry.register_tables(spark, {"postings": index})
    return spark.sql("SELECT id, score, rank FROM search_text('of LA', 20)")


_SPACE = "' ' || chr(9) || chr(10) || chr(13)"
QUERIES = {
    "index_upsert": (index_upsert, f"""
SELECT conv_id || '_' || turn AS _id, md5(text || CASE WHEN conv_id % 2 = 0 THEN ' again' ELSE '' END) AS text FROM conversations WHERE turn % 4 <> 3 AND trim(text, {_SPACE}) <> ''"""),
    "numbered_rows": (numbered_rows, "SELECT doc_id || '_' || i AS _id, 'chunk_' || i AS chunk_id, md5(x) AS text FROM (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"),
    "chunk_report": (chunk_report, """
SELECT doc_id, length(text) AS characters, len(string_split(text, chr(10))) AS chunks, 1000 AS size, coalesce(n, 0) AS images, md5(array_to_string(string_split(text, chr(10))[1:3], '|')) AS preview
FROM documents LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) ON conv_id = doc_id"""),
    "asset_store": (asset_store, """
WITH p AS (SELECT page_id, page_id // 10 AS position FROM pages WHERE page_id % 7 <> 0 AND page_id % 11 <> 0)
SELECT 'p' || page_id || '.png' AS filename, CASE WHEN position % 4 = 0 THEN 'chart' ELSE 'general' END AS category,
       CASE WHEN position % 6 = 0 THEN 'shows ' || position WHEN page_id % 4 <> 0 THEN 'a caption' ELSE 'No description provided' END AS text FROM p"""),
    "memory_writes": (memory_writes, """
WITH n AS (SELECT CAST(n_nationkey AS VARCHAR) AS scope_id, n_nationkey % 4 AS k, n_name FROM nation)
SELECT 'project' AS scope, scope_id, n_name || CASE WHEN k = 0 THEN repeat(chr(10), 2) || '---' || chr(10) || '_记录于 2024-05-06 07:08_' || repeat(chr(10), 2) || 'more' ELSE '' END AS content FROM n
UNION ALL SELECT 'session', scope_id, 'more' FROM n WHERE k = 2 UNION ALL SELECT 'over project', scope_id, CASE WHEN k = 0 THEN 'more' ELSE n_name END FROM n UNION ALL SELECT 'over session', scope_id, 'more' FROM n WHERE k = 2"""),
    "memory_preload": (memory_preload, "SELECT '...' || right(repeat('europe-', 30), 50) || chr(10) || chr(10) || repeat('africa-', 30) AS context"),
    "sub_tasks": (sub_tasks, """
WITH r AS (SELECT n_nationkey % 5 AS session, string_agg(n_name, chr(10) ORDER BY n_name) AS more FROM nation GROUP BY 1), m AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1)
SELECT CAST(c.conv_id AS VARCHAR) AS session, turn, md5(text || CASE WHEN turn = last AND more IS NOT NULL THEN chr(10) || more ELSE '' END) AS text FROM conversations c JOIN m USING (conv_id) LEFT JOIN r ON session = c.conv_id"""),
    "patch_texts": (patch_texts, """
WITH p AS (SELECT conv_id, string_agg(text || CASE conv_id % 3 WHEN 0 THEN chr(10) || '---' || chr(10) WHEN 1 THEN chr(10) || '``` ' ELSE '' END, '' ORDER BY turn) AS t FROM conversations GROUP BY 1)
SELECT conv_id AS task_id, md5(t) AS text, conv_id % 3 < 2 OR contains(t, chr(10) || '---' || chr(10)) OR rtrim(t, ' ') LIKE '%```' AS closed FROM p"""),
    "idle_keys": (idle_keys, "SELECT user_id AS key, max(ts) AS ts FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-18 00:00:00'"),
    "loops_by_type": (loops_by_type, "SELECT event_type, CASE WHEN event_type = 'purchase' THEN 0 ELSE greatest(max(event_id % 12), max(user_id % 15)) END AS loops FROM events GROUP BY 1"),
    "extraction_input": (extraction_input, f"SELECT conv_id AS doc_id, turn FROM conversations WHERE conv_id IN (1, 2, 3, 5, 8, 13) AND length(trim(text, {_SPACE})) > 50"),
    "newest_orders": (newest_orders, "SELECT o_orderkey, o_orderdate AS created_at, count(*) OVER () AS total FROM orders"),
    "pair_questions": (pair_questions, "SELECT string_agg('Pair ' || n_nationkey || ': is ' || n_name || ' the same entity as ' || lower(n_name) || '?', chr(10) ORDER BY n_nationkey) AS prompt FROM nation"),
    "known_contents": (known_contents, "SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND text IN (SELECT text FROM documents WHERE doc_id % 2 = 1)"),
    "tool_catalog": (tool_catalog, """
WITH c AS (SELECT replace(p_name, ' ', '_') AS name, max(p_type) AS description FROM part GROUP BY 1),
scored AS (SELECT name, CASE WHEN list_contains(string_split(name, '_'), 'ring') THEN 10 WHEN contains(name, 'ring') THEN 5 ELSE 0 END
    + CASE WHEN list_contains(string_split(name, '_'), 'small') THEN 10 WHEN contains(name, 'small') THEN 5 ELSE 0 END + CASE WHEN lower(description) = 'small' THEN 2 ELSE 0 END AS score
  FROM c WHERE contains(name || ' ' || lower(description), 'small'))
SELECT 'select' AS kind, row_number() OVER (ORDER BY name DESC) AS nth, name, 0 AS score FROM (SELECT name FROM c ORDER BY name LIMIT 7)
UNION ALL SELECT 'found', nth, name, score FROM (SELECT row_number() OVER (ORDER BY score DESC, name) AS nth, name, score FROM scored WHERE score > 0) WHERE nth <= 50"""),
    "written_stores": (written_stores, """
WITH s AS (SELECT conv_id, role FROM conversations GROUP BY ALL), k AS (SELECT DISTINCT conv_id FROM conversations)
SELECT 'report 0' AS store, 'chunks' AS what, (SELECT count(*) FROM conversations WHERE conv_id % 10 = 3) AS rows UNION ALL SELECT 'report 0', 'speakers', -1 UNION ALL SELECT 'report 0', 'metadata', -1
UNION ALL SELECT 'report 1', 'speakers', (SELECT count(*) FROM s WHERE conv_id % 10 = 3) UNION ALL SELECT 'report 1', 'metadata', (SELECT count(*) FROM k WHERE conv_id % 10 = 3)
UNION ALL SELECT 'chunks', 'left, old 0', (SELECT count(*) FROM conversations WHERE conv_id % 10 <> 3) UNION ALL SELECT 'speakers', 'left, old 0', (SELECT count(*) FROM s WHERE conv_id % 10 <> 3)
UNION ALL SELECT 'known', 'left, old 0', (SELECT count(*) FROM k WHERE conv_id % 10 <> 3)"""),
    "text_search": (text_search, """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\\x{00DF}-\\x{00F6}\\x{00F8}-\\x{024F}]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS size, len(list_filter(w, lambda x: x = 'of')) AS a, len(list_filter(w, lambda x: x = 'la')) AS b, len(list_filter(w, lambda x: x = 'the')) AS c FROM w),
n AS (SELECT count(*) AS n, avg(size) AS mean FROM p),
part AS (SELECT doc_id, size, tf, count(*) OVER (PARTITION BY term) AS df FROM (SELECT doc_id, size, 'of' AS term, a AS tf FROM p WHERE a > 0 UNION ALL SELECT doc_id, size, 'la', b FROM p WHERE b > 0)),
s AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM part, n GROUP BY 1)
SELECT doc_id AS id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s ORDER BY rank LIMIT 20"""),
}

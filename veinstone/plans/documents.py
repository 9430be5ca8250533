"""Chunking, profiling, session, streaming and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veinstone.functions import nested, text as T
from veinstone.operators import chunking, evaluate, profile, resolve, sessions
from veinstone.plans.tables import table
from veinstone.sources import files
from veinstone.streaming import events as streams


def chunk_pack_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose lines are paragraphs, with two empty ones before the last."""
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit("\n\n\n\n\n\nthe\nend")).alias("text"))
    found = chunking.pack(docs, 1000, 200)
    return found.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("chunk", "start", "end")), "text")


def _fold_sql(source: str, key: str, size: int, overlap: int, glue: str) -> str:
    """One row for each state of a fold over the list p of each key; done, done_first and done_next where a chunk is closed."""
    full = f"(cur <> '' AND length(cur) + length(p[i + 1]) > {size})"
    return f"""
fold AS (
  SELECT {key}, p, 1 AS i, p[1] AS cur, 0 AS first, CAST(NULL AS VARCHAR) AS done, CAST(NULL AS INT) AS done_first, CAST(NULL AS INT) AS done_next, -1 AS chunk FROM {source} WHERE len(p) > 0
  UNION ALL
  SELECT {key}, p, i + 1,
    CASE WHEN i >= len(p) THEN NULL WHEN {full} THEN {f"right(cur, {overlap}) || '{glue}' || p[i + 1]" if overlap else "p[i + 1]"} WHEN cur = '' THEN p[i + 1] ELSE cur || '{glue}' || p[i + 1] END,
    CASE WHEN i < len(p) AND {full} THEN i ELSE first END,
    CASE WHEN i >= len(p) OR {full} THEN cur END, CASE WHEN i >= len(p) OR {full} THEN first END, CASE WHEN i < len(p) AND {full} THEN i END,
    CASE WHEN i >= len(p) OR {full} THEN chunk + 1 ELSE chunk END
  FROM fold WHERE i <= len(p))"""


_PACKED = "WITH RECURSIVE texts AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) || repeat(chr(10), 6) || 'the' || chr(10) || 'end' AS t FROM documents), parts AS (SELECT doc_id, string_split(t, chr(10) || chr(10)) AS p FROM texts)," + _fold_sql("parts", "doc_id", 1000, 200, "' || chr(10) || chr(10) || '") + """,
closed AS (SELECT *, list_max(list_filter(range(done_first), lambda k: list_sum(list_transform(p[k + 1:done_first], lambda x: length(x) + 2)) >= 200)) AS back FROM fold WHERE done IS NOT NULL AND (done_next IS NOT NULL OR trim(done, ' ' || chr(9) || chr(10) || chr(13)) <> '')),
begun AS (SELECT *, coalesce(back, 0) AS begin, list_transform(p, lambda x: length(x) - length(replace(x, chr(10), '')) + 2) AS n FROM closed)
SELECT doc_id, chunk, done AS text, CAST(coalesce(list_sum(n[1:begin]), 0) AS BIGINT) AS start, CAST(coalesce(list_sum(n[1:done_next]) - 1, list_sum(n) - 2) AS BIGINT) AS "end" FROM begun"""


def chunk_paged(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as documents of one paragraph a turn, each with an image of page 3 k for turn k: packed chunks with their pages."""
    said = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: F.concat(F.lit("![](_page_"), (3 * x["turn"]).cast("string"), F.lit("_f.png)\n"), F.replace(x["text"], F.lit("\n\n"), F.lit("\n"))))
    docs = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(said, "\n\n").alias("text"))
    docs = docs.withColumn("toc", F.expr("CAST(array() AS ARRAY<STRUCT<title: STRING, page_id: INT>>)"))
    return chunking.paged_chunks(docs, 400, 0).select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.md5("text").alias("text"), F.col("page").cast("long").alias("page"))


#: Without overlap a chunk's lines are those of its paragraphs and the empty lines behind them, each of the page of its turn.
_PAGED_CHUNKS = "WITH RECURSIVE texts AS (SELECT conv_id, string_agg('![](_page_' || 3 * turn || '_f.png)' || chr(10) || replace(text, chr(10) || chr(10), chr(10)), chr(10) || chr(10) ORDER BY turn) AS t FROM conversations GROUP BY 1), parts AS (SELECT conv_id, string_split(t, chr(10) || chr(10)) AS p FROM texts)," + _fold_sql("parts", "conv_id", 400, 0, "' || chr(10) || chr(10) || '") + """,
closed AS (SELECT conv_id, chunk, done, p, done_first, coalesce(done_next, len(p)) AS upto FROM fold WHERE done IS NOT NULL),
each AS (SELECT conv_id, chunk, done, unnest(range(done_first, upto)) AS k, p, upto FROM closed),
lines AS (SELECT *, coalesce(CAST(nullif(regexp_extract(p[k + 1], '_page_([0-9]+)_', 1), '') AS INT) + 1, NULL) AS own, length(p[k + 1]) - length(replace(p[k + 1], chr(10), '')) + CASE WHEN k + 1 < len(p) THEN 2 ELSE 1 END AS n FROM each),
paged AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY conv_id, chunk ORDER BY k ROWS UNBOUNDED PRECEDING) AS page FROM lines),
counted AS (SELECT conv_id, chunk, any_value(done) AS done, page, sum(n) AS n, min(k) AS first FROM paged GROUP BY conv_id, chunk, page)
SELECT conv_id AS doc_id, chunk, md5(any_value(done)) AS text, arg_max(page, (n, -first)) AS page FROM counted GROUP BY ALL"""


def chunk_join(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk"), "text")
    found = chunking.join_small(chunks, 600)
    return found.select("doc_id", F.col("joined").cast("long").alias("joined"), "text", "first_chunk")


def _paged(spark: SparkSession, d: str) -> DataFrame:
    """Documents as pages: every third line has an image anchor, the table of contents names the second line's first word."""
    marked = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 2, F.concat(F.lit("![](_page_"), i.cast("string"), F.lit("_f.png)"))).otherwise(x))
    word = F.get(F.split(F.get(F.split("text", "\n"), F.lit(1)), " "), F.lit(0))
    toc = F.when(F.length(word) >= 2, F.array(F.struct(word.alias("title"), F.lit(7).alias("page_id")))).otherwise(F.expr("CAST(array() AS ARRAY<STRUCT<title: STRING, page_id: INT>>)"))
    return table(spark, d, "documents").select("doc_id", F.array_join(marked, "\n").alias("text"), toc.alias("toc"))


def page_forward_fill(spark: SparkSession, d: str) -> DataFrame:
    return chunking.page_map(_paged(spark, d)).select("doc_id", F.col("line").cast("long").alias("line"), F.col("page").cast("long").alias("page"))


_PAGES = r"""
l AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
t AS (SELECT doc_id, p, string_split(p[2], ' ')[1] AS word, unnest(range(len(p))) AS line FROM l),
m AS (SELECT *, CASE WHEN line % 3 = 2 THEN '![](_page_' || line || '_f.png)' ELSE p[line + 1] END AS text FROM t),
o AS (SELECT *, trim(regexp_replace(text, '[#*`\[\]()>_~|]', '', 'g')) AS plain FROM m),
s AS (SELECT doc_id, line, CASE WHEN line % 3 = 2 THEN line + 1 WHEN length(plain) >= 2 AND length(word) >= 2 AND contains(plain, word) THEN 8 END AS page FROM o),
pages AS (SELECT doc_id, line, coalesce(last_value(page IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING), 1) AS page FROM s)"""


def chunk_page_mode(spark: SparkSession, d: str) -> DataFrame:
    pages = chunking.page_map(_paged(spark, d))
    last = F.floor((F.size(F.split("text", "\n")) - 1) / 5) + 1
    chunks = table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk")).select("doc_id", "chunk", (F.col("chunk") * 5 - 2).alias("start"), (F.col("chunk") * 5 + 3).alias("end"))
    return chunking.chunk_pages(chunks, pages).select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("page").cast("long").alias("page"))


def row_kv_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("id", F.col("n_nationkey"))
    columns = ["id", "n_name", "r_name", "n_regionkey"]
    return rows.select("n_nationkey", chunking.key_values(rows, columns).alias("kv"), chunking.row_text(rows, columns[1:], "nations").alias("line"), profile.markdown_rows(["n_name", "r_name"]).alias("md"))


def html_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Customers with names and segments that must be escaped and trimmed."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("row"), F.concat(F.lit(" <b>\"&' "), "c_name", F.lit(" ")).alias("c_name"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("seg & ment"))
    found = profile.html_tables(rows, ["c_name", "seg & ment"], "customers")
    return found.select("part", "html")


def column_types(spark: SparkSession, d: str) -> DataFrame:
    customer = profile.long_form(table(spark, d, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    orders = profile.long_form(table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"), "o_totalprice", F.when(F.col("o_orderkey") % 2 == 0, "yes").otherwise("否").alias("flag")), ["o_orderdate", "o_totalprice", "flag"])
    found = profile.column_types(customer.unionByName(orders))
    return found.select("column", "type", *(F.col(f"n_{t}") for t in profile.TYPES))


_CELLS = """
cells AS (
  SELECT unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS "column", unnest([CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR), CAST(c_acctbal AS VARCHAR), c_mktsegment]) AS value FROM customer
  UNION ALL SELECT unnest(['o_orderdate', 'o_totalprice', 'flag']), unnest([strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), CAST(o_totalprice AS VARCHAR), CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE '否' END]) FROM orders),
kinds AS (
  SELECT "column", CASE WHEN regexp_full_match(value, '[+-]?[0-9]+') AND value[1] <> '0' THEN 'int' WHEN regexp_full_match(value, '[+-]?[0-9.]{0,19}') AND (value = '' OR value[1] <> '0') THEN 'float'
    WHEN regexp_full_match(lower(value), 'yes|true|是|no|false|否') THEN 'bool' WHEN regexp_full_match(value, '[0-9]{4}-[0-9]{2}-[0-9]{2}( [0-9:]{8})?') THEN 'datetime' ELSE 'text' END AS kind FROM cells WHERE value IS NOT NULL),
votes AS (SELECT "column", count(*) FILTER (kind = 'int') AS n_int, count(*) FILTER (kind = 'float') AS n_float, count(*) FILTER (kind = 'text') AS n_text, count(*) FILTER (kind = 'datetime') AS n_datetime, count(*) FILTER (kind = 'bool') AS n_bool FROM kinds GROUP BY 1)"""


def typed_cast(spark: SparkSession, d: str) -> DataFrame:
    """Order numbers, prices, priorities, dates in two forms and words for yes and no, through every cast."""
    key, custom = F.col("o_orderkey"), F.col("o_custkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    word = F.get(F.array(*map(F.lit, ("Yes", " no ", "是", "perhaps"))), (custom % 4).cast("int"))
    text = F.when(key % 5 == 0, custom.cast("string")).when(key % 5 == 1, F.col("o_totalprice").cast("string")).when(key % 5 == 2, F.col("o_orderpriority"))
    text = text.when(key % 5 == 3, F.when(custom % 2 == 0, day).otherwise(F.replace(day, F.lit("-"), F.lit("/")))).otherwise(word)
    return table(spark, d, "orders").select("o_orderkey", profile.typed(text, "int").alias("as_int"), profile.typed(text, "float").alias("as_float"), profile.typed(text, "bool").alias("as_bool"), profile.typed(text, "datetime").alias("as_datetime"))


def header_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each nation's customers as a grid below one to five rows of names, by the nation's number."""
    tops = F.col("n_nationkey") % 5 + 1
    nation = table(spark, d, "nation").select("n_nationkey", tops.alias("tops"))
    order = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    ranked = table(spark, d, "customer").withColumn("nth", order).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    body = ranked.select(F.col("c_nationkey").alias("table_id"), (F.col("nth") + F.col("tops")).alias("row"), F.posexplode(F.array(F.col("c_custkey").cast("string"), F.col("c_acctbal").cast("string"), F.lit("-"))).alias("col", "value"))
    names = nation.select(F.col("n_nationkey").alias("table_id"), F.explode(F.sequence(F.lit(0), F.col("tops") - 1)).alias("row"))
    top = names.select("table_id", "row", F.posexplode(F.array(F.lit("Customer"), F.lit("Balance (EUR)"), F.lit("2024"))).alias("col", "value"))
    return profile.header_rows(top.unionByName(body)).select("table_id", F.col("header_rows").cast("long").alias("header_rows"))


def robust_json(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("props")
    said = F.when(F.col("event_id") % 5 == 0, p).when(F.col("event_id") % 5 == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(F.col("event_id") % 5 == 2, F.concat(F.lit("so <answer> "), p, F.lit(" </answer> ok")))
    said = said.when(F.col("event_id") % 5 == 3, F.concat(F.lit("the result: "), p, F.lit(" as asked"))).otherwise("none")
    return table(spark, d, "events").select("event_id", F.get_json_object(nested.robust_json(said), "$.k").cast("long").alias("k"))


def triplet_payloads(spark: SparkSession, d: str) -> DataFrame:
    one = F.concat(F.lit('[{"subject":"'), "c_name", F.lit('","relation":"contains","object":"'), "c_mktsegment", F.lit('"}]'))
    said = F.when(F.col("c_custkey") % 3 == 0, one).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit('{"triplets":'), one, F.lit("}"))).otherwise("sorry")
    return table(spark, d, "customer").select("c_custkey", F.explode(nested.triplets(said)).alias("t")).select("c_custkey", "t.subject", "t.relation", "t.object")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session"), "turn", "role", "text")


def history_budget(spark: SparkSession, d: str) -> DataFrame:
    return sessions.folded_history(_turns(spark, d), 500).select("session", "seq", "text")


def last_turns(spark: SparkSession, d: str) -> DataFrame:
    return sessions.last_turns(_turns(spark, d), 3).select("session", "turn")


def session_list(spark: SparkSession, d: str) -> DataFrame:
    return sessions.listing(_turns(spark, d))


def route_decision(spark: SparkSession, d: str) -> DataFrame:
    """Whole turns with a word behind them, and every fifth turn only that word."""
    said = F.concat(F.when(F.col("turn") % 5 != 0, F.col("text")).otherwise(""), F.element_at(F.array(F.lit(""), F.lit(" chart"), F.lit(" hi"), F.lit(" 计算")), (F.col("turn") % 4 + 1).cast("int")))
    return sessions.route(_turns(spark, d).withColumn("text", said)).select("session", "turn", "route")


def synthesis_filter(spark: SparkSession, d: str) -> DataFrame:
    calls = F.when(F.col("turn") % 2 == 1, F.array(F.lit("search"))).otherwise(F.expr("CAST(array() AS ARRAY<STRING>)"))
    return sessions.for_synthesis(_turns(spark, d).withColumn("tool_calls", calls)).select("session", "turn", "role")


def original_question(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("turn") >= 4, F.concat(F.lit("[系统干预] "), "text")).otherwise(F.col("text"))
    return sessions.original_question(_turns(spark, d).select("session", F.col("turn").alias("seq"), "role", said.alias("content")))


def novelty(spark: SparkSession, d: str) -> DataFrame:
    outputs = _turns(spark, d).select(F.col("session").alias("task"), F.col("turn").alias("seq"), F.col("text").alias("content"))
    return sessions.novelty(outputs).select("task", "seq", "overlap", "stop")


def stage_latest(spark: SparkSession, d: str) -> DataFrame:
    stage = F.element_at(F.array(F.lit("parsing"), F.lit("chunking"), F.lit("indexing"), F.lit("graphing"), F.lit("other")), (F.col("event_id") % 5 + 1).cast("int"))
    return streams.current_stage(table(spark, d, "events").select(F.col("user_id").alias("doc_id"), "ts", stage.alias("stage")))


def idle_sessions(spark: SparkSession, d: str) -> DataFrame:
    return streams.idle_sessions(table(spark, d, "events"))


def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    return streams.tumbling_counts(table(spark, d, "events")).withColumn("total", F.round("total", 4))


def sliding_means(spark: SparkSession, d: str) -> DataFrame:
    return streams.sliding_means(table(spark, d, "events")).withColumn("mean", F.round("mean", 6))


def dedup_watermark(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "event_type", F.date_trunc("day", "ts").alias("ts"))
    return streams.without_repeats(events, ["user_id", "event_type", "ts"], "1 day")


def ask_reply(spark: SparkSession, d: str) -> DataFrame:
    """Clicks as asks, the next purchases of the same user as replies within an hour."""
    events = table(spark, d, "events")
    asks = events.where("event_type = 'click'").select(F.col("event_id").alias("ask"), F.col("user_id").alias("ask_id"), "ts")
    replies = events.where("event_type = 'purchase'").select(F.col("user_id").alias("ask_id"), "ts", F.col("event_id").alias("reply"))
    return streams.answered(asks.drop("ask"), replies, "3600 seconds")


def keyword_coverage(spark: SparkSession, d: str) -> DataFrame:
    expected = F.array(F.lit("THE"), F.lit("idiot"), F.lit("tion"), F.lit("password"))
    found = table(spark, d, "documents").select("doc_id", evaluate.keyword_coverage(F.col("text"), expected).alias("c"))
    return found.select("doc_id", "c.coverage", F.array_join("c.found", ",").alias("found"), F.array_join("c.missing", ",").alias("missing"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 6).cast("int").alias("quality"), F.round(F.col("n_chars") % 11 / 10, 1).alias("coverage"), F.when(F.col("doc_id") % 13 == 0, "timeout").alias("error"), (F.col("doc_id") % 2 == 0).alias("has_source"), (F.col("doc_id") % 3 == 0).alias("needs_source"), "text", F.when(F.col("doc_id") % 4 == 0, "worthless|tions? ").alias("figures"))
    return evaluate.verdict(docs)


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("doc_id", F.array_join("reasons", ",").alias("reasons"), "passed", "warned")


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    runs = _answers(spark, d).select("passed", (F.col("doc_id") % 7).cast("double").alias("seconds"), "quality", (F.col("doc_id") % 4).alias("calls"))
    return evaluate.summary(runs).withColumn("quality", F.round("quality", 6))


def by_mode(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "events").select(F.col("event_type").alias("mode"), (F.col("value") % 1).alias("recall"), (1 / (1 + F.col("user_id"))).alias("mrr"), F.col("value").alias("seconds"))
    return evaluate.by_mode(runs).select("mode", *(F.round(c, 6).alias(c) for c in ("recall", "mrr", "seconds")))


def tool_calls(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.tool_calls(table(spark, d, "pages").select(F.col("html").alias("text")), r"<([a-z0-9]+)[ >]")


def retrieval_sources(spark: SparkSession, d: str) -> DataFrame:
    item = table(spark, d, "lineitem").where("l_linenumber <= 7")
    rows = item.select((F.col("l_orderkey") * 1_000_000 + F.col("l_linenumber") * 100_000 + F.col("l_partkey")).alias("rank"), F.col("l_suppkey").alias("doc_id"), F.col("l_returnflag").alias("filename"), F.col("l_quantity").alias("score"), F.col("l_linestatus").alias("kind"), (F.col("l_linenumber") - 2).alias("page"))
    found = evaluate.sources(rows.dropDuplicates(["rank", "doc_id"]))
    return found.select("doc_id", "filename", F.array_join("pages", ",").alias("pages"))


def keyed_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Customers' latest order over the ones of an older state."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), "o_orderpriority")
    return files.upsert(orders.where("seq % 2 = 0"), orders.where("seq % 2 = 1"), ["key"], "seq")


def latest_order(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return resolve.latest(orders, ["o_custkey"], "o_orderkey")


def line_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", files.line_count(F.col("text")).cast("long").alias("lines"), T.citation(F.col("source"), (F.col("doc_id") % 3).cast("int"), F.when(F.col("doc_id") % 2 == 0, "text").otherwise("table")).alias("cited"))


_VERDICTS = """
WITH a AS (
  SELECT doc_id, n_chars % 6 AS q, round(n_chars % 11 / 10, 1) AS c, doc_id % 13 = 0 AS e, doc_id % 13 <> 0 AND doc_id % 2 <> 0 AND doc_id % 3 = 0 AS no_source,
         doc_id % 13 <> 0 AND doc_id % 4 = 0 AND NOT regexp_matches(text, '(?i)worthless|tions? ') AS no_figure FROM documents),
p AS (SELECT *, NOT (e OR c < 0.5 OR q < 2 OR (no_source AND q < 4) OR no_figure) AS passed FROM a)"""
_JSET = "list_filter(list_distinct(string_split({0}, '')), lambda c: c <> '')"

QUERIES = {
    "chunk_pack_overlap": (chunk_pack_overlap, _PACKED),
    "chunk_paged": (chunk_paged, _PAGED_CHUNKS),
    "chunk_join": (chunk_join, "WITH RECURSIVE parts AS (SELECT conv_id, list(text ORDER BY turn) AS p, list(turn ORDER BY turn) AS turns FROM conversations WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' GROUP BY 1)," + _fold_sql("parts", "conv_id", 600, 0, "' || chr(10) || chr(10) || '") + " SELECT conv_id AS doc_id, chunk AS joined, trim(done, ' ' || chr(9) || chr(10) || chr(13)) AS text, turns[done_first + 1] AS first_chunk FROM fold JOIN parts USING (conv_id) WHERE done IS NOT NULL"),
    "page_forward_fill": (page_forward_fill, f"WITH {_PAGES} SELECT doc_id, line, page FROM pages"),
    "chunk_page_mode": (chunk_page_mode, f"""WITH {_PAGES},
c AS (SELECT doc_id, unnest(range((len(string_split(text, chr(10))) - 1) // 5 + 2)) AS chunk FROM documents), z AS (SELECT doc_id, max(line) AS last FROM pages GROUP BY 1),
n AS (SELECT c.doc_id, chunk, page, count(*) AS n, min(line) AS first FROM c JOIN z USING (doc_id) JOIN pages p ON p.doc_id = c.doc_id AND line BETWEEN greatest(chunk * 5 - 2, 0) AND least(chunk * 5 + 3, last) GROUP BY ALL),
best AS (SELECT doc_id, chunk, arg_max(page, (n, -first)) AS page FROM n GROUP BY ALL)
SELECT c.doc_id, c.chunk, coalesce(b.page, s.page, -1) AS page FROM c LEFT JOIN best b ON b.doc_id = c.doc_id AND b.chunk = c.chunk LEFT JOIN pages s ON s.doc_id = c.doc_id AND s.line = c.chunk * 5 - 2"""),
    "row_kv_chunks": (row_kv_chunks, "SELECT n_nationkey, '- n_name: ' || n_name || chr(10) || '- r_name: ' || r_name || chr(10) || '- n_regionkey: ' || n_regionkey AS kv, concat_ws('; ', 'n_name：' || n_name, 'r_name：' || r_name, CASE WHEN n_regionkey <> 0 THEN 'n_regionkey：' || n_regionkey END) || ' ——nations' AS line, '| ' || n_name || ' | ' || r_name || ' |' AS md FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "html_chunks": (html_chunks, """
WITH n AS (SELECT unnest(range((SELECT count(*) // 256 + 1 FROM customer))) AS part),
b AS (SELECT c_custkey // 256 AS part, string_agg('<tr><td>&lt;b&gt;&quot;&amp;&#x27; ' || c_name || '</td><td>' || CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment ELSE '' END || '</td></tr>', '' ORDER BY c_custkey) AS body FROM customer GROUP BY 1)
SELECT part, '<table><caption>customers</caption><tr><th>c_name</th><th>seg &amp; ment</th></tr>' || coalesce(body, '') || '</table>' || chr(10) AS html FROM n LEFT JOIN b USING (part)"""),
    "column_types": (column_types, f"WITH {_CELLS} SELECT *, CASE greatest(n_int, n_float, n_text, n_datetime, n_bool) WHEN n_int THEN 'int' WHEN n_float THEN 'float' WHEN n_text THEN 'text' WHEN n_datetime THEN 'datetime' ELSE 'bool' END AS type FROM votes"),
    "typed_cast": (typed_cast, """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey END AS as_int, CASE o_orderkey % 5 WHEN 0 THEN CAST(o_custkey AS DOUBLE) WHEN 1 THEN o_totalprice END AS as_float,
    CASE WHEN o_orderkey % 5 = 4 THEN CASE o_custkey % 4 WHEN 1 THEN 'no' WHEN 3 THEN NULL ELSE 'yes' END END AS as_bool, CASE WHEN o_orderkey % 5 = 3 THEN strftime(o_orderdate, '%Y-%m-%d 00:00:00') END AS as_datetime FROM orders"""),
    "header_rows": (header_rows, """
WITH rows AS (SELECT n_nationkey, n_nationkey % 5 + 1 AS tops, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n FROM nation)
SELECT n_nationkey AS table_id, CASE WHEN n = 0 THEN tops ELSE least(tops, 5) END AS header_rows FROM rows"""),
    "robust_json": (robust_json, "SELECT event_id, CASE WHEN event_id % 5 < 4 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events"),
    "triplet_payloads": (triplet_payloads, "SELECT c_custkey, c_name AS subject, 'contains' AS relation, c_mktsegment AS object FROM customer WHERE c_custkey % 3 < 2"),
    "history_budget": (history_budget, """
WITH s AS (SELECT conv_id, turn, text, sum(length(text) // 2) OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 500 AS kept FROM conversations)
SELECT conv_id AS session, turn AS seq, text FROM s WHERE kept UNION ALL SELECT conv_id, -1, '[earlier turns left out: ' || count(*) || ']' FROM s WHERE NOT kept GROUP BY 1"""),
    "last_turns": (last_turns, "SELECT conv_id AS session, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3"),
    "session_list": (session_list, "SELECT conv_id AS session, count(*) AS turns, left(arg_max(text, turn), 60) AS title, left(arg_max(text, turn), 100) AS preview FROM conversations GROUP BY 1"),
    "route_decision": (route_decision, """
WITH m AS (SELECT conv_id, turn, CASE WHEN turn % 5 <> 0 THEN text ELSE '' END || CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN ' chart' WHEN 2 THEN ' hi' ELSE ' 计算' END AS t FROM conversations)
SELECT conv_id AS session, turn, CASE WHEN contains(lower(t), 'chart') OR contains(t, '计算') OR regexp_matches(lower(t), 'python|neo4j|trace|sandbox|plot|curve') THEN 'agent' WHEN length(t) < 15 AND regexp_matches(lower(t), 'hi|hello') THEN 'chitchat' ELSE 'rag' END AS route FROM m"""),
    "synthesis_filter": (synthesis_filter, "SELECT conv_id AS session, turn, role FROM conversations WHERE role <> 'tool' AND NOT (role = 'assistant' AND turn % 2 = 1)"),
    "original_question": (original_question, "SELECT conv_id AS session, arg_max(text, turn) AS question FROM conversations WHERE role = 'user' AND turn < 4 GROUP BY 1"),
    "novelty_jaccard": (novelty, f"""
WITH o AS (SELECT conv_id, turn, left(text, 400) AS a, lag(left(text, 400)) OVER w AS b, row_number() OVER w AS loop FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
j AS (SELECT conv_id, turn, loop, CASE WHEN b IS NOT NULL THEN round(CASE WHEN len({_JSET.format("a || b")}) = 0 THEN 0 ELSE len(list_intersect({_JSET.format("a")}, {_JSET.format("b")})) / len({_JSET.format("a || b")}) END, 6) END AS overlap FROM o)
SELECT conv_id AS task, turn AS seq, overlap, coalesce(overlap > 0.5, false) OR loop >= 12 AS stop FROM j"""),
    "stage_latest": (stage_latest, "SELECT user_id AS doc_id, CASE arg_max(event_id, ts) % 5 WHEN 1 THEN 'chunking' WHEN 2 THEN 'indexing' WHEN 3 THEN 'graphing' ELSE 'parsing' END AS stage FROM events GROUP BY 1"),
    "idle_sessions_30m": (idle_sessions, """
WITH b AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS nth FROM b)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS events FROM s GROUP BY user_id, nth"""),
    "tumbling_counts": (tumbling_counts, "SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL"),
    "sliding_means": (sliding_means, "WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) - h * INTERVAL 1 HOUR AS start, event_type, value FROM events, (SELECT unnest([0, 1]) AS h)) SELECT CAST(start AS TIMESTAMP) AS start, event_type, round(avg(value), 6) AS mean FROM w GROUP BY ALL"),
    "dedup_watermark": (dedup_watermark, "SELECT DISTINCT user_id, event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts FROM events"),
    "ask_reply_join": (ask_reply, "SELECT a.user_id AS ask_id, a.ts, r.event_id AS reply FROM events a LEFT JOIN events r ON r.event_type = 'purchase' AND r.user_id = a.user_id AND r.ts >= a.ts AND r.ts <= a.ts + INTERVAL 3600 SECOND WHERE a.event_type = 'click'"),
    "keyword_coverage": (keyword_coverage, "WITH k AS (SELECT doc_id, list_filter(['THE', 'idiot', 'tion', 'password'], lambda k: contains(lower(text), lower(k))) AS f, list_filter(['THE', 'idiot', 'tion', 'password'], lambda k: NOT contains(lower(text), lower(k))) AS m FROM documents) SELECT doc_id, round(len(f) / 4, 2) AS coverage, array_to_string(f, ',') AS found, array_to_string(m, ',') AS missing FROM k"),
    "verdicts": (verdicts, f"{_VERDICTS} SELECT doc_id, concat_ws(',', CASE WHEN e THEN 'error' END, CASE WHEN NOT e AND q < 2 THEN 'quality' END, CASE WHEN NOT e AND c < 0.5 THEN 'coverage' END, CASE WHEN no_source AND q < 4 THEN 'source' END, CASE WHEN no_figure THEN 'figure' END) AS reasons, passed, no_source AND q >= 4 AS warned FROM p"),
    "run_summary": (run_summary, f"{_VERDICTS} SELECT count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, CAST(sum(doc_id % 7) AS DOUBLE) AS seconds, round(avg(nullif(q, 0)), 6) AS quality, CAST(sum(doc_id % 4) AS BIGINT) AS calls FROM p"),
    "latency_summary": (by_mode, "SELECT event_type AS mode, round(avg(value % 1), 6) AS recall, round(avg(1 / (1 + user_id)), 6) AS mrr, round(avg(value), 6) AS seconds FROM events GROUP BY 1"),
    "tool_calls": (tool_calls, "SELECT tool, count(*) AS calls FROM (SELECT unnest(regexp_extract_all(html, '<([a-z0-9]+)[ >]', 1)) AS tool FROM pages) GROUP BY 1"),
    "retrieval_sources": (retrieval_sources, """
WITH r AS (SELECT DISTINCT ON (rank, doc_id) * FROM (SELECT l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS rank, l_suppkey AS doc_id, l_returnflag AS filename, l_linenumber - 2 AS page FROM lineitem)),
p AS (SELECT doc_id, page, min(rank) AS first FROM r WHERE page > 0 GROUP BY ALL)
SELECT doc_id, (SELECT arg_min(filename, rank) FROM r WHERE r.doc_id = p.doc_id) AS filename, string_agg(CAST(page AS VARCHAR), ',' ORDER BY first) AS pages FROM p GROUP BY doc_id"""),
    "keyed_upsert": (keyed_upsert, "SELECT o_custkey AS key, o_orderkey AS seq, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 2 DESC, o_orderkey DESC) = 1"),
    "latest_order": (latest_order, "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1"),
    "line_counts": (line_counts, "SELECT doc_id, len(string_split(text, chr(10))) AS lines, '[来源: ' || concat_ws(', ', source, CASE WHEN doc_id % 3 > 0 THEN 'p.' || doc_id % 3 END, CASE WHEN doc_id % 2 = 1 THEN '[table]' END) || ']' AS cited FROM documents"),
}

"""Headings, figures, grids and typed rows, from documents and tables put into the forms that parsers give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veinstone.functions import nested, text as T
from veinstone.operators import chunking, profile
from veinstone.plans.tables import table


def _headed(spark: SparkSession, d: str) -> DataFrame:
    """Documents of which every fourth line is a heading, of levels 1 to 3."""
    line = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 4 == 0, F.concat(F.repeat(F.lit("#"), (i / 4 % 3 + 1).cast("int")), F.lit(" "), F.left(F.trim(x), F.lit(12)))).otherwise(x))
    return table(spark, d, "documents").select("doc_id", F.array_join(line, "\n").alias("text"))


def heading_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.by_heading(_headed(spark, d), 800).select("doc_id", F.col("chunk").cast("long").alias("chunk"), "context", F.md5("text").alias("text"))


_SPACE = "' ' || chr(9) || chr(10) || chr(13)"
_HEADING_CHUNKS = rf"""
WITH RECURSIVE split AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
marked AS (SELECT doc_id, list_transform(range(len(l)), lambda i: CASE WHEN i % 4 = 0 THEN repeat('#', CAST(i // 4 % 3 + 1 AS INT)) || ' ' || left(trim(l[i + 1]), 12) ELSE l[i + 1] END) AS p FROM split),
-- One line at a time: what was gathered before it, and what is closed before (a) or behind (b) it.
walk AS (
  SELECT doc_id, p, 0 AS i, CAST(['', '', ''] AS VARCHAR[]) AS heads, CAST([] AS VARCHAR[]) AS lines, 0 AS n, CAST(NULL AS VARCHAR) AS a, CAST(NULL AS VARCHAR) AS b, '' AS context FROM marked
  UNION ALL
  SELECT doc_id, p, i + 1, heads, CASE WHEN closes THEN [] ELSE gathered END, CASE WHEN closes THEN 0 ELSE size END, early, CASE WHEN closes THEN array_to_string(gathered, chr(10)) END,
         array_to_string(list_filter(heads, lambda h: h <> ''), ' > ') FROM (
    SELECT *, size >= 800 AS closes FROM (
      SELECT doc_id, p, i, heads, CASE WHEN early IS NOT NULL THEN [line] ELSE list_append(lines, line) END AS gathered, CASE WHEN early IS NOT NULL THEN 0 ELSE n END + length(line) AS size, early FROM (
        SELECT doc_id, p, i, line, lines, n, CASE WHEN level = 0 THEN heads ELSE list_transform(range(1, 4), lambda k: CASE WHEN k = level THEN coalesce(nullif(trim(regexp_extract(line, '^#+ +(.*)', 1)), ''), chr(1)) WHEN k < level THEN heads[k] ELSE '' END) END AS heads,
               CASE WHEN level > 0 AND n > 400 THEN array_to_string(lines, chr(10)) END AS early FROM (
          SELECT *, p[i + 1] AS line, CASE WHEN regexp_matches(p[i + 1], '^#+\s') THEN length(regexp_extract(p[i + 1], '^(#+)', 1)) ELSE 0 END AS level FROM walk WHERE i < len(p)))))),
closed AS (
  SELECT doc_id, i * 2 AS nth, context, a AS text FROM walk WHERE a IS NOT NULL
  UNION ALL SELECT doc_id, i * 2 + 1, context, b FROM walk WHERE b IS NOT NULL
  UNION ALL SELECT doc_id, i * 2 + 2, array_to_string(list_filter(heads, lambda h: h <> ''), ' > '), array_to_string(lines, chr(10)) FROM walk WHERE i = len(p) AND len(lines) > 0),
kept AS (SELECT *, trim(text, {_SPACE}) AS clean FROM closed WHERE trim(text, {_SPACE}) <> '')
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY nth) - 1 AS chunk, replace(context, chr(1), '') AS context, md5(clean) AS text FROM kept
"""


def _pictured(spark: SparkSession, d: str) -> DataFrame:
    """Documents with images in every ninth line, and captions and empty lines near some of them."""
    def line(x, i):
        k = F.floor(i / 9)
        return (
            F.when(i % 9 == 4, F.concat(F.lit("see ![fig "), i.cast("string"), F.lit("](img/p"), i.cast("string"), F.lit(".png) there")))
            .when((i % 9 == 6) & (k % 3 == 0), F.concat(F.lit("Figure "), i.cast("string"), F.lit(". what it shows")))
            .when((i % 9 == 3) & (k % 3 == 1), F.lit("")).when((i % 9 == 2) & (k % 3 == 1), F.concat(F.lit("Table "), i.cast("string"), F.lit(" of values"))).otherwise(x)
        )

    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


def figure_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Figures with captions, contexts, their chunks' texts and whether they are kept."""
    found = chunking.figure_text(chunking.figures(_pictured(spark, d)))
    return found.select("doc_id", F.col("line").cast("long").alias("line"), "alt_text", "image_path", "caption", F.md5("context_above").alias("above"), F.md5("context_below").alias("below"), F.md5("text").alias("text"), T.keeps_figure(F.col("caption"), F.col("alt_text")).alias("kept"))


_FIGURES = rf"""
split AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
lined AS (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM split),
pictured AS (
  SELECT doc_id, i, CASE WHEN i % 9 = 4 THEN 'see ![fig ' || i || '](img/p' || i || '.png) there' WHEN i % 9 = 6 AND i // 9 % 3 = 0 THEN 'Figure ' || i || '. what it shows'
                         WHEN i % 9 = 3 AND i // 9 % 3 = 1 THEN '' WHEN i % 9 = 2 AND i // 9 % 3 = 1 THEN 'Table ' || i || ' of values' ELSE x END AS x FROM lined),
kinds AS (SELECT *, regexp_matches(x, '!\[(.*?)\]\((.+?)\)') AS image, regexp_matches(trim(x, {_SPACE}), '^(图\s*|Figure|FIG\.?|Fig\.?|表\s*|Table|TABLE)\s*[\d.\-]+') AS caption FROM pictured),
near AS (
  SELECT f.doc_id, f.i, f.x, n.i - f.i AS off, n.x AS nx, n.image, n.caption,
         min(CASE WHEN n.i > f.i AND n.image THEN n.i END) OVER (PARTITION BY f.doc_id, f.i) AS stop, max(CASE WHEN n.i < f.i AND n.image THEN n.i END) OVER (PARTITION BY f.doc_id, f.i) AS last
  FROM kinds f LEFT JOIN kinds n ON n.doc_id = f.doc_id AND n.i BETWEEN f.i - 6 AND f.i + 4 AND n.i <> f.i WHERE f.image),
found AS (
  SELECT doc_id, i, any_value(x) AS x, arg_min(trim(nx, {_SPACE}), off) FILTER (off > 0 AND caption AND (stop IS NULL OR i + off < stop)) AS below,
         max(CASE WHEN off = -1 THEN CASE WHEN caption THEN trim(nx, {_SPACE}) END END) AS one, bool_or(off = -1 AND trim(nx, {_SPACE}) = '') AS gap, max(CASE WHEN off = -2 AND caption THEN trim(nx, {_SPACE}) END) AS two,
         coalesce(string_agg(nx, chr(10) ORDER BY off) FILTER (off < 0 AND (last IS NULL OR i + off > last)), '') AS up, coalesce(string_agg(nx, chr(10) ORDER BY off) FILTER (off BETWEEN 1 AND 3 AND NOT caption), '') AS down
  FROM near GROUP BY doc_id, i),
figures AS (
  SELECT doc_id, i AS line, regexp_extract(x, '!\[(.*?)\]\((.+?)\)', 1) AS alt_text, regexp_extract(x, '!\[(.*?)\]\((.+?)\)', 2) AS image_path, coalesce(below, one, CASE WHEN gap THEN two END, '') AS caption,
         trim(up, {_SPACE}) AS above, trim(down, {_SPACE}) AS below FROM found),
said AS (SELECT *, concat_ws(chr(10) || chr(10), CASE WHEN caption <> '' THEN '【图注】' || caption END, CASE WHEN above <> '' THEN '【上文】' || right(above, 100) END, CASE WHEN below <> '' THEN '【下文】' || left(below, 100) END) AS said FROM figures)"""


def unreferenced_images(spark: SparkSession, d: str) -> DataFrame:
    """Images of lines 4 and 5 of each ninth, of which only the first are referred to, as chunks behind the figures."""
    lines = chunking.lines(_pictured(spark, d)).where("line % 9 IN (4, 5)")
    images = lines.select("doc_id", F.concat(F.lit("img/p"), F.col("line").cast("string"), F.lit(".png")).alias("image_path"))
    figures = chunking.figures(_pictured(spark, d))
    left = chunking.unreferenced(images, figures)
    text = table(spark, d, "documents").select("doc_id", F.lit(0).alias("chunk"), F.lit("body").alias("text"))
    both = chunking.with_figures(text, figures.select("doc_id", "line", F.col("image_path").alias("text")))
    return both.select("doc_id", "part", F.col("ordinal").cast("long").alias("ordinal"), "text").unionByName(left.select("doc_id", F.lit(2).alias("part"), F.lit(0).cast("long").alias("ordinal"), F.col("image_path").alias("text")))


def styled_sections(spark: SparkSession, d: str) -> DataFrame:
    """Documents' lines as paragraphs, every fifth a heading of some style, with the conversations' turns as tables behind them."""
    style = F.element_at(F.array(F.lit("Heading 1"), F.lit("Normal"), F.lit("标题 2"), F.lit("heading 3")), (F.col("line") / 5 % 4 + 1).cast("int"))
    paragraphs = chunking.lines(table(spark, d, "documents")).select("doc_id", F.col("line").alias("pos"), F.when(F.col("line") % 5 == 0, style).otherwise("Body").alias("style"), "text")
    tables = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("table_id"), "text")
    return chunking.under_headings(paragraphs, tables).select("doc_id", "kind", "section", "heading", F.md5("text").alias("text"))


def _grids(spark: SparkSession, d: str) -> DataFrame:
    """Each nation's customers as a grid of three or four columns, with a row of names before every seventh."""
    order = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    ranked = table(spark, d, "customer").withColumn("nth", order)
    row = F.col("nth") + F.floor(F.col("nth") / 6) + 1
    columns = lambda *four: F.when(F.col("c_nationkey") % 2 == 0, F.array(*four)).otherwise(F.array(*four[:3]))
    cells = ranked.select(F.col("c_nationkey").alias("table_id"), row.alias("row"), F.posexplode(columns(F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 10 == 0, F.lit("")).otherwise(F.floor("c_acctbal").cast("string")), F.col("c_nationkey").cast("string"), F.lit("7"))).alias("col", "text"))
    heads = ranked.where("nth % 6 = 0").select(F.col("c_nationkey").alias("table_id"), (row - 1).alias("row"), F.posexplode(columns(F.lit("key of it"), F.concat(F.lit("balance "), F.when(F.col("nth") % 12 == 0, "now").otherwise("then")), F.lit("nation of it"), F.lit("seven"))).alias("col", "text"))
    return cells.unionByName(heads)


def grid_lines(spark: SparkSession, d: str) -> DataFrame:
    found = chunking.grid_key_values(_grids(spark, d))
    return found.select("table_id", F.col("row").cast("long").alias("row"), "text")


def typed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Customers as chunks with typed fields; a type that doesn't fit leaves a value out."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name (full)"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal").cast("string")).otherwise("n/a").alias("balance/EUR"), F.when(F.col("c_custkey") % 3 == 0, "Yes").when(F.col("c_custkey") % 3 == 1, "否").alias("flag"))
    found = chunking.row_chunks(rows, {"id": "int", "key": "int", "name (full)": "text", "balance/EUR": "float", "flag": "bool"}, "customers.csv", profile.field_name, profile.typed)
    return found.select("file", F.md5("text").alias("text"), F.size("data").cast("long").alias("n"), "key_long", F.col("name_tks").alias("name_tks"), "balance_flt", "flag_kwd")


def merged_header_names(spark: SparkSession, d: str) -> DataFrame:
    """Regions over their nations as merged headers of one table, over a row of numbers, which are no names."""
    nations = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 regions
    at = F.row_number().over(Window.orderBy("n_regionkey", "n_nationkey")) - 1  # 25 nations
    placed = nations.withColumn("col", at)
    first = F.min("col").alias("c1")
    spans = placed.groupBy("r_name").agg(first, F.max("col").alias("c2"))
    top = spans.select(F.lit(0).alias("row"), F.col("c1").alias("col"), F.col("r_name").alias("value"))
    cells = top.unionByName(placed.select(F.lit(1).alias("row"), "col", F.concat(F.lit(" "), "n_name").alias("value"))).unionByName(placed.select(F.lit(2).alias("row"), "col", F.col("n_nationkey").cast("string").alias("value"))).withColumn("table_id", F.lit(1))
    merges = spans.select(F.lit(1).alias("table_id"), F.lit(0).alias("r1"), "c1", F.lit(0).alias("r2"), "c2")
    blank = cells.select("table_id", (F.col("row") + 5).alias("row"), "col", F.lit(" ").alias("value"))
    found = profile.merged_headers(cells, merges, spark.createDataFrame([(1, 3)], "table_id int, header_rows int"))
    rows = profile.effective_rows(cells.unionByName(blank))
    return found.join(rows, "table_id").select(F.col("col").cast("long").alias("col"), "header", F.col("rows").cast("long").alias("rows"))


def text_rules(spark: SparkSession, d: str) -> DataFrame:
    """Predicates and fields of every turn: instructions left out, pages in points, base64, parameters, envelopes."""
    turn, x = F.col("turn"), F.col("text")
    items = F.array(x, F.when(turn % 2 == 0, F.concat(F.lit("please IGNORE "), x)).otherwise("You are here"))
    only = F.when(turn % 3 == 0, F.array(F.lit("system prompt"))).otherwise(items)
    box = F.struct(F.lit(0.1).alias("x0"), F.lit(0.2).alias("y0"), (turn / 10).alias("x1"), F.lit(0.9).alias("y1"))
    said = F.concat(F.lit('```json\n[{"key": "a b", "value": '), F.when(turn % 4 == 0, "0").when(turn % 4 == 1, F.concat(F.lit('"'), turn.cast("string"), F.lit('"'))).when(turn % 4 == 2, "true").otherwise("null"), F.lit('}, {"key": "", "value": 1}, {"key": "z", "value": [1, 2]}]\n```'))
    envelope = F.from_json(F.to_json(F.struct(F.lit("patch").alias("type"), turn.alias("task_id"), F.left(x, F.lit(9)).alias("patch"))), "type string, task_id long, patch string")
    return table(spark, d, "conversations").select(
        "conv_id", "turn", F.md5(F.array_join(T.without_instructions(only, "nothing"), "|")).alias("kept"), F.round(nested.page_points(box, F.lit(600.0), F.lit(800.0))["x1"], 6).alias("x1"),
        F.md5(nested.decoded(F.concat(F.lit("data:text/plain;base64,"), nested.encoded(x.cast("binary")))).cast("string")).alias("decoded"), F.length(nested.encoded(x.cast("binary"))).cast("long").alias("size"),
        F.array_join(F.transform(nested.parameters(said), lambda p: F.concat_ws("=", p["key"], p["value"])), ";").alias("parameters"), envelope["patch"].alias("patch"),
        T.is_caption(F.concat(F.when(turn % 2 == 0, " Fig. ").otherwise("see Fig. "), turn.cast("string"))).alias("caption"), F.md5(T.simplified(F.concat(x, F.lit("鋼鐵")), "鋼鐵ab", "钢铁xy")).alias("simplified"),
    )


QUERIES = {
    "heading_chunks": (heading_chunks, _HEADING_CHUNKS),
    "figure_chunks": (figure_chunks, f"""WITH {_FIGURES}
SELECT doc_id, line, alt_text, image_path, caption, md5(above) AS above, md5(below) AS below, md5(CASE WHEN said <> '' THEN said ELSE regexp_extract(image_path, '[^/]*$') END) AS text,
       caption <> '' OR regexp_matches(lower(alt_text), '图|表|fig|chart|graph|photo|sem|tem') AS kept FROM said"""),
    "unreferenced_images": (unreferenced_images, f"""WITH {_FIGURES}
SELECT doc_id, 0 AS part, 0 AS ordinal, 'body' AS text FROM documents UNION ALL SELECT doc_id, 1, line, image_path FROM figures
UNION ALL SELECT doc_id, 2, 0, 'img/p' || i || '.png' FROM lined WHERE i % 9 = 5"""),
    "styled_sections": (styled_sections, rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
p AS (SELECT doc_id, i, trim(x, {_SPACE}) AS x, i % 5 = 0 AND i // 5 % 4 <> 1 AS head FROM l WHERE trim(x, {_SPACE}) <> ''),
s AS (SELECT *, CAST(sum(CAST(head AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS section FROM p)
SELECT doc_id, 'paragraph' AS kind, section, coalesce(max(CASE WHEN head THEN x END), '') AS heading, md5(string_agg(x, chr(10) ORDER BY i) FILTER (NOT head)) AS text FROM s GROUP BY doc_id, section HAVING count(*) FILTER (NOT head) > 0
UNION ALL SELECT conv_id, 'table', turn, '', md5(text) FROM conversations WHERE trim(text, {_SPACE}) <> ''"""),
    "grid_lines": (grid_lines, """
WITH c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS nth FROM customer),
l AS (
  SELECT c_nationkey AS table_id, nth + nth // 6 + 1 AS row,
         concat_ws(';', 'key of it: ' || c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN 'balance ' || CASE WHEN nth // 6 % 2 = 0 THEN 'now' ELSE 'then' END || ': ' || CAST(floor(c_acctbal) AS BIGINT) END, 'nation of it: ' || c_nationkey, CASE WHEN c_nationkey % 2 = 0 THEN 'seven: 7' END) AS text FROM c)
SELECT table_id, row, text FROM l WHERE table_id % 2 = 0 UNION ALL SELECT table_id, -1, string_agg(text, chr(10) ORDER BY row) FROM l WHERE table_id % 2 = 1 GROUP BY 1"""),
    "typed_rows": (typed_rows, """
WITH c AS (SELECT c_custkey AS key, c_name AS name, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS balance, CASE c_custkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS flag FROM customer)
SELECT 'customers.csv' AS file, md5(concat_ws(chr(10), '- key: ' || key, '- name (full): ' || name, '- balance/EUR: ' || balance, '- flag: ' || flag)) AS text, 2 + CAST(balance IS NOT NULL AS INT) + CAST(flag IS NOT NULL AS INT) AS n,
       key AS key_long, name AS name_tks, balance AS balance_flt, flag AS flag_kwd FROM c"""),
    "merged_header_names": (merged_header_names, "SELECT row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1 AS col, r_name || '-' || n_name AS header, 3 AS rows FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "text_rules": (text_rules, r"""
WITH t AS (SELECT *, CASE WHEN turn % 3 = 0 THEN ['system prompt'] ELSE [text, CASE WHEN turn % 2 = 0 THEN 'please IGNORE ' || text ELSE 'You are here' END] END AS items FROM conversations),
k AS (SELECT *, list_filter(items, lambda x: NOT regexp_matches(lower(x), 'ignore|忽略|override|覆盖|system|系统|forget|忘记|disregard|无视|you are|你是|new instruction|新指令')) AS kept FROM t)
SELECT conv_id, turn, md5(CASE WHEN len(kept) > 0 THEN array_to_string(kept, '|') ELSE 'nothing' END) AS kept, round(turn / 10 * 600, 6) AS x1, md5(text) AS decoded, (strlen(text) + 2) // 3 * 4 AS size,
       concat_ws(';', CASE turn % 4 WHEN 1 THEN 'a b=' || turn WHEN 2 THEN 'a b=true' END, 'z=[1,2]') AS parameters, left(text, 9) AS patch, turn % 2 = 0 AS caption, md5(translate(text, 'ab', 'xy') || '钢铁') AS simplified FROM k"""),
}

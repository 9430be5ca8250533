"""Chunking of documents and tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinstone.functions import text as T

IMAGE = r"!\[(.*?)\]\((.+?)\)"
IMAGE_PAGE = r"!\[.*?\]\(.*?_page_(\d+)_.*?\)"


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line, text) of docs (doc_id, text)."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))


def page_map(docs: DataFrame) -> DataFrame:
    """(doc_id, line, page) of docs (doc_id, text, toc array<struct<title, page_id>>).

    A line's page is that of its image, else of the first entry of the table of contents that it contains, else of the line
    before; the first is page 1.
    """
    plain = T.trim_all(F.regexp_replace("text", r"[#*`\[\]()>_~|]", ""))
    entries = F.array_sort(F.transform("toc", lambda x, i: F.struct(x["page_id"].alias("page_id"), i.alias("i"), x["title"].alias("title"))))
    named = docs.select("doc_id", entries.alias("toc"), F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("plain", plain)
    image = F.regexp_extract("text", IMAGE_PAGE, 1)
    entry = F.filter("toc", lambda x: (F.length(x["title"]) >= 2) & F.contains(F.col("plain"), x["title"]))
    page = F.when(image != "", image.cast("int") + 1).when(F.length("plain") >= 2, F.get(entry, F.lit(0))["page_id"] + 1)
    filled = F.last(page, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line"))
    return named.select("doc_id", "line", F.coalesce(filled, F.lit(1)).alias("page"))


def chunk_pages(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, chunk, page) of chunks (doc_id, chunk, start, end): the most frequent page of their lines, the earliest of ties.

    Spans are clamped to the document; an empty one takes the page of its start, or -1 beyond the document.
    """
    last = pages.groupBy("doc_id").agg(F.max("line").alias("last"))
    spans = chunks.join(last, "doc_id", "left").withColumns({"lo": F.greatest("start", F.lit(0)), "hi": F.least("end", "last")})
    p = pages.select(F.col("doc_id").alias("d"), "line", "page")
    counted = spans.join(p, (F.col("doc_id") == F.col("d")) & F.col("line").between(F.col("lo"), F.col("hi"))).groupBy("doc_id", "chunk", "page").agg(F.count("*").alias("n"), F.min("line").alias("first"))
    mode = counted.groupBy("doc_id", "chunk").agg(F.max_by("page", F.struct("n", -F.col("first"))).alias("mode"))
    start = p.select("d", F.col("line").alias("start_line"), F.col("page").alias("start_page"))
    return spans.join(mode, ["doc_id", "chunk"], "left").join(start, (F.col("doc_id") == F.col("d")) & (F.col("start") == F.col("start_line")), "left").select("doc_id", "chunk", F.coalesce("mode", "start_page", F.lit(-1)).alias("page"))


def _fold(parts: Column, size: int, overlap: int, glue: str) -> Column:
    """array<struct<text, first, next>>: parts packed in order while they fit; first and next are the indices of the first part that is new, and of the one that didn't fit."""
    done = "array<struct<text:string,first:int,next:int>>"
    start = F.struct(F.lit([]).cast(done).alias("done"), F.lit("").alias("text"), F.lit(-1).alias("first"), F.lit(0).alias("at"))
    closed = lambda state, after: F.array_append(state["done"], F.struct(state["text"].alias("text"), state["first"].alias("first"), after.alias("next")))

    def step(state: Column, part: Column) -> Column:
        full = (F.length(state["text"]) > 0) & (F.length(state["text"]) + F.length(part) > size)
        rest = F.right(state["text"], F.lit(overlap)) if overlap else F.lit("")
        before = F.when(full, rest).otherwise(state["text"])
        text = F.when(F.length(before) > 0, F.concat(before, F.lit(glue), part)).otherwise(part)
        return F.struct(
            F.when(full, closed(state, state["at"])).otherwise(state["done"]).alias("done"), text.alias("text"),
            F.when(full | (state["first"] < 0), state["at"]).otherwise(state["first"]).alias("first"), (state["at"] + 1).alias("at"),
        )

    return F.aggregate(parts, start, step, lambda state: F.when(T.trim_all(state["text"]) != "", closed(state, F.lit(None).cast("int"))).otherwise(state["done"]))


def pack(docs: DataFrame, size: int = 1000, overlap: int = 200, separator: str = "\n\n") -> DataFrame:
    """(doc_id, chunk, text, start, end): paragraphs packed to ``size`` characters, each chunk beginning with the last ``overlap`` of the one before.

    A paragraph that is longer stays whole, and empty ones are paragraphs like others; a last chunk without text is left out. start and
    end are the lines of the chunk: from the paragraph in which its overlap begins (walking back over paragraphs and separators) to
    the line before the paragraph that didn't fit. The fold is over one document's paragraphs, in the executor that has them.
    """
    glue, breaks = len(separator), separator.count("\n")
    parts = F.split("text", re.escape(separator))
    # Characters and lines before each paragraph, and before the end.
    before = F.aggregate("parts", F.struct(F.array(F.lit(0)).alias("chars"), F.array(F.lit(0)).alias("lines")), lambda state, p: F.struct(
        F.array_append(state["chars"], F.try_element_at(state["chars"], F.lit(-1)) + F.length(p) + glue).alias("chars"),
        F.array_append(state["lines"], F.try_element_at(state["lines"], F.lit(-1)) + F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit(""))) + breaks).alias("lines")))
    marked = docs.withColumn("parts", parts).withColumn("before", before).withColumn("folded", _fold(F.col("parts"), size, overlap, separator))
    each = marked.select("doc_id", "before", F.posexplode("folded").alias("chunk", "c"))
    first, chars, lines = F.col("c.first"), F.col("before.chars"), F.col("before.lines")
    # The last paragraph from whose beginning to the new one there are at least ``overlap`` characters.
    back = F.array_max(F.filter(F.transform(chars, lambda x, k: F.when((k < first) & (F.get(chars, first) - x >= overlap), k)), lambda k: k.isNotNull()))
    begin = F.when(first == 0, 0).when(F.lit(overlap) > 0, F.coalesce(back, F.lit(0))).otherwise(first)
    last = F.when(F.col("c.next").isNotNull(), F.get(lines, F.col("c.next")) - 1).otherwise(F.get(lines, F.size(lines) - 1) - breaks)
    return each.select("doc_id", "chunk", "c.text", F.get(lines, begin).alias("start"), last.alias("end"))


def paged_chunks(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(doc_id, chunk, text, page) of docs (doc_id, text, toc): packed paragraphs, each chunk with the most frequent page of its lines."""
    chunks = pack(docs, size, overlap)
    pages = chunk_pages(chunks.select("doc_id", "chunk", "start", "end"), page_map(docs))
    return chunks.join(pages, ["doc_id", "chunk"]).select("doc_id", "chunk", "text", "page")


def join_small(chunks: DataFrame, target: int = 5000) -> DataFrame:
    """(doc_id, joined, text, first_chunk) of chunks (doc_id, chunk, text): neighbours joined while they fit; blank ones left out."""
    listed = chunks.where(T.not_blank(F.col("text"))).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "text"))).alias("c"))
    found = listed.select("doc_id", "c", F.posexplode(_fold(F.transform("c", lambda x: x["text"]), target, 0, "\n\n")).alias("joined", "j"))
    return found.select("doc_id", "joined", T.trim_all(F.col("j.text")).alias("text"), F.get("c", F.col("j.first"))["chunk"].alias("first_chunk"))


def by_heading(docs: DataFrame, size: int = 800) -> DataFrame:
    """(doc_id, chunk, context, text): lines gathered until they reach ``size`` characters, or until a heading comes and they are over half of it.

    A chunk's context is the path of headings as it stands when the chunk is closed: a heading that closes one is in it already, and
    ends those of deeper levels. Line ends don't count; a chunk without text is left out.
    """
    empty_heads = F.array(*(F.lit(None).cast("string") for _ in range(6)))
    done = "array<struct<context:string,text:string>>"
    start = F.struct(F.lit([]).cast(done).alias("done"), F.array().cast("array<string>").alias("lines"), F.lit(0).alias("length"), empty_heads.alias("heads"))

    def flushed(state: Column, heads: Column) -> Column:
        text = T.trim_all(F.array_join(state["lines"], "\n"))
        context = F.array_join(F.filter(heads, lambda h: h.isNotNull()), " > ")
        return F.when(text != "", F.array_append(state["done"], F.struct(context.alias("context"), text.alias("text")))).otherwise(state["done"])

    def step(state: Column, line: Column) -> Column:
        level = F.length(F.regexp_extract(line, r"^(#{1,6})\s+", 1))
        title = F.trim(F.regexp_extract(line, r"^#{1,6}\s+(.*)", 1))
        heads = F.when(level > 0, F.transform(state["heads"], lambda h, k: F.when(k + 1 == level, title).when(k + 1 < level, h))).otherwise(state["heads"])
        early = (level > 0) & (state["length"] > 0.5 * size)
        none = F.array().cast("array<string>")
        opened = F.struct(F.when(early, flushed(state, heads)).otherwise(state["done"]).alias("done"), F.array_append(F.when(early, none).otherwise(state["lines"]), line).alias("lines"), (F.when(early, 0).otherwise(state["length"]) + F.length(line)).alias("length"), heads.alias("heads"))
        closed = lambda s: F.when(s["length"] >= size, F.struct(flushed(s, s["heads"]).alias("done"), none.alias("lines"), F.lit(0).alias("length"), s["heads"].alias("heads"))).otherwise(s)
        return F.get(F.transform(F.array(opened), closed), F.lit(0))

    chunks = F.aggregate(F.split("text", "\n"), start, step, lambda state: flushed(state, state["heads"]))
    return docs.select("doc_id", F.posexplode(chunks).alias("chunk", "c")).select("doc_id", "chunk", "c.context", "c.text")


def figures(docs: DataFrame) -> DataFrame:
    """(doc_id, line, alt_text, image_path, caption, context_above, context_below): one figure of each line with an image.

    The caption is the first caption line of the next four, as far as another image, else of the two lines before, nearest
    first, as far as a line that is neither. Context above reaches back six lines, to the image before; context below is
    the next three lines without captions.
    """
    order = Window.partitionBy("doc_id").orderBy("line")
    around = lines(docs).withColumns({
        "before": F.collect_list("text").over(order.rowsBetween(-6, -1)), "after": F.collect_list("text").over(order.rowsBetween(1, 4)),
    }).where(F.col("text").rlike(IMAGE))
    image = lambda x: x.rlike(IMAGE)
    after, before = F.col("after"), F.col("before")
    stop = F.transform(F.filter(F.transform(after, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: image(s["x"])), lambda s: s["i"])
    reach = F.slice(after, F.lit(1), F.coalesce(F.get(stop, F.lit(0)), F.size(after)))
    below = F.get(F.filter(reach, lambda x: T.is_caption(x)), F.lit(0))
    near = F.try_element_at(before, F.lit(-1))
    second = F.try_element_at(before, F.lit(-2))
    above = F.when(T.is_caption(near), near).when(T.trim_all(near) == "", F.when(T.is_caption(second), second))
    images_before = F.transform(F.filter(F.transform(before, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: image(s["x"])), lambda s: s["i"])
    last_image = F.coalesce(F.array_max(images_before) + 1, F.lit(0))
    return around.select(
        "doc_id", "line", F.regexp_extract("text", IMAGE, 1).alias("alt_text"), F.regexp_extract("text", IMAGE, 2).alias("image_path"),
        F.coalesce(T.trim_all(below), T.trim_all(above), F.lit("")).alias("caption"),
        T.trim_all(F.array_join(F.slice(before, last_image + 1, F.size(before)), "\n")).alias("context_above"),
        T.trim_all(F.array_join(F.filter(F.slice(after, 1, 3), lambda x: ~T.is_caption(x)), "\n")).alias("context_below"),
    )


def figure_text(figures: DataFrame) -> DataFrame:
    """figures with their chunk's text: caption, the last 100 characters above, the first 100 below; else the file's name."""
    part = lambda mark, c: F.when(c != "", F.concat(F.lit(mark), c))
    said = F.concat_ws("\n\n", part("【图注】", F.col("caption")), part("【上文】", F.right("context_above", F.lit(100))), part("【下文】", F.left("context_below", F.lit(100))))
    return figures.withColumn("text", F.when(said != "", said).otherwise(F.element_at(F.split("image_path", "/"), -1)))


def unreferenced(images: DataFrame, figures: DataFrame) -> DataFrame:
    """Images (doc_id, image_path) that no figure refers to."""
    return images.join(figures.select("doc_id", "image_path").distinct(), ["doc_id", "image_path"], "left_anti")


def under_headings(paragraphs: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """(doc_id, kind, section, heading, text) of paragraphs (doc_id, pos, style, text): bodies joined by line, then tables (doc_id, table_id, text).

    A heading without body is left out, and its body goes under the last heading before it.
    """
    head = F.contains("style", F.lit("Heading")) | F.contains("style", F.lit("heading")) | F.contains("style", F.lit("标题"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    grouped = paragraphs.where(T.not_blank(F.col("text"))).withColumn("head", F.coalesce(head, F.lit(False))).withColumn("section", F.sum(F.col("head").cast("int")).over(order))
    body = F.sort_array(F.collect_list(F.when(~F.col("head"), F.struct("pos", T.trim_all(F.col("text")).alias("text")))))
    found = grouped.groupBy("doc_id", "section").agg(F.coalesce(F.max(F.when(F.col("head"), T.trim_all(F.col("text")))), F.lit("")).alias("heading"), body.alias("body"))
    chunks = found.where(F.size("body") > 0).select("doc_id", F.lit("paragraph").alias("kind"), F.col("section").cast("long").alias("section"), "heading", F.array_join(F.transform("body", lambda x: x["text"]), "\n").alias("text"))
    if tables is None:
        return chunks
    return chunks.unionByName(tables.where(T.not_blank(F.col("text"))).select("doc_id", F.lit("table").alias("kind"), F.col("table_id").cast("long").alias("section"), F.lit("").alias("heading"), "text"))


def _shown(columns: list[str]) -> list[str]:
    return [c for c in columns if c not in ("id", "_id", "index", "idx")]


def key_values(rows: DataFrame, columns: list[str]) -> Column:
    """A line "- column: value" for each value that is not empty; id columns are left out."""
    return F.concat_ws("\n", *(F.when(F.col(c).cast("string") != "", F.concat(F.lit(f"- {c}: "), F.col(c).cast("string"))) for c in _shown(columns)))


def row_chunks(rows: DataFrame, kinds: dict[str, str], filename: str, field_name: Callable[[str, str], str], typed: Callable[[Column, str], Column]) -> DataFrame:
    """(file, data, text, one typed field for each column): rows as chunks for search; rows without a value are left out.

    kinds: the type of each column, of profile.column_types; names must not repeat.
    """
    shown = _shown(list(kinds))
    cells = {c: typed(F.col(c).cast("string"), kinds[c]) for c in shown}
    text = F.concat_ws("\n", *(F.when(v.cast("string") != "", F.concat(F.lit(f"- {c}: "), v.cast("string"))) for c, v in cells.items()))
    entries = F.filter(F.array(*(F.struct(F.lit(c).alias("key"), v.cast("string").alias("value")) for c, v in cells.items())), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    fields = [v.alias(field_name(c, kinds[c])) for c, v in cells.items()]
    return rows.select(F.lit(filename).alias("file"), F.map_from_entries(entries).alias("data"), text.alias("text"), *fields).where(F.col("text") != "")


def row_text(rows: DataFrame, columns: list[str], sheet: str) -> Column:
    """"column：value; ..." of values that are neither empty nor 0 nor false; the sheet's name at the end unless it is a default one."""
    def shown(c: str) -> Column:
        value = F.col(c).cast("string")
        return F.when(value.isNotNull() & ~value.isin("", "0", "0.0", "false"), F.concat(F.lit(f"{c}："), value))

    text = F.concat_ws("; ", *map(shown, columns))
    return text if "sheet" in sheet.lower() else F.concat(text, F.lit(f" ——{sheet}"))


def grid_key_values(cells: DataFrame) -> DataFrame:
    """(table_id, row, text) of grids (table_id, row, col, text): "header: value" of each row below the header rows, joined by ";".

    Row 0 is a header; where most cells below it are numbers, so is every row whose commonest type is another. A data row takes the run of
    headers right above it, each part once. Grids of three columns at most become one text, with the row -1. Grids of one row are left out.
    """
    typed = cells.withColumn("type", T.block_type(F.col("text")))
    votes = typed.where("row > 0").groupBy("table_id", "type").agg(F.count("*").alias("n"), F.min(F.struct("row", "col")).alias("at"))
    majority = votes.groupBy("table_id").agg(F.max_by("type", F.struct("n", -F.col("at.row"), -F.col("at.col"))).alias("common"))
    by_row = typed.groupBy("table_id", "row", "type").agg(F.count("*").alias("n"), F.min("col").alias("at")).groupBy("table_id", "row").agg(F.max_by("type", F.struct("n", -F.col("at"))).alias("row_type"))
    rows = by_row.join(majority, "table_id").withColumn("header", (F.col("row") == 0) | ((F.col("common") == "Nu") & (F.col("row_type") != "Nu")))
    order = Window.partitionBy("table_id").orderBy("row")
    rows = rows.withColumn("run", F.sum((F.col("header") & ~F.coalesce(F.lag("header").over(order), F.lit(False))).cast("int")).over(order))
    marked = cells.join(rows.select("table_id", "row", "header", "run"), ["table_id", "row"])
    parts = F.array_distinct(F.filter(F.transform(F.sort_array(F.collect_list(F.struct("row", T.trim_all(F.col("text")).alias("text")))), lambda x: x["text"]), lambda t: t != ""))
    names = marked.where("header").groupBy("table_id", "run", "col").agg(F.array_join(parts, ",").alias("name"))
    named = marked.where("NOT header").join(names, ["table_id", "run", "col"], "left").where(F.col("text") != "")
    line = F.when(F.coalesce("name", F.lit("")) != "", F.concat("name", F.lit(": "), "text")).otherwise(F.col("text"))
    by_row = named.groupBy("table_id", "row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", line.alias("line")))), lambda x: x["line"]), ";").alias("text"))
    columns = cells.groupBy("table_id").agg((F.max("col") + 1).alias("columns"))
    sized = by_row.join(columns, "table_id")
    small = sized.where("columns <= 3").groupBy("table_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return sized.where("columns > 3").select("table_id", "row", "text").unionByName(small.select("table_id", F.lit(-1).alias("row"), "text"))


def with_figures(text: DataFrame, figures: DataFrame) -> DataFrame:
    """Text chunks, then figure chunks, each in its order: (doc_id, part, ordinal, text)."""
    return text.select("doc_id", F.lit(0).alias("part"), F.col("chunk").alias("ordinal"), "text").unionByName(figures.select("doc_id", F.lit(1).alias("part"), F.col("line").alias("ordinal"), "text"))


def chunk_id(doc_id: Column, ordinal: Column, text: Column) -> Column:
    """The same for the same chunk, however often it is made."""
    return F.concat(F.lit("chunk_"), F.left(F.sha2(F.concat_ws("\x1f", doc_id.cast("string"), ordinal.cast("string"), text), 256), F.lit(12)))


def chunk_report(docs: DataFrame, chunks: DataFrame, images: DataFrame, size: int) -> DataFrame:
    """(doc_id, characters, chunks, size, images, preview) of docs (doc_id, text), chunks (doc_id, chunk, text) and images (doc_id, ...): counts, and the first three chunks."""
    counted = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    first = chunks.where("chunk < 3").groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "text"))), lambda x: x["text"]).alias("preview"))  # three at most
    pictures = images.groupBy("doc_id").agg(F.count("*").alias("images"))
    found = docs.join(counted, "doc_id", "left").join(pictures, "doc_id", "left").join(first, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return found.select("doc_id", F.length("text").cast("long").alias("characters"), zero("chunks"), F.lit(size).alias("size"), zero("images"), F.coalesce("preview", F.array().cast("array<string>")).alias("preview"))


def numbered_rows(docs: DataFrame, kind: str = "text_chunk") -> DataFrame:
    """(_id, doc_id, chunk_id, text, source_type) of docs (doc_id, chunks array<string>): rows of the older index, whose chunk_id is only unique within a document."""
    each = docs.select("doc_id", F.posexplode("chunks").alias("nth", "text"))
    number = F.col("nth").cast("string")
    return each.select(F.concat_ws("_", F.col("doc_id").cast("string"), number).alias("_id"), "doc_id", F.concat(F.lit("chunk_"), number).alias("chunk_id"), "text", F.lit(kind).alias("source_type"))

"""Readers for files whose encoding or kind is not known, document containers, parser providers, and keyed writers."""

from __future__ import annotations

import csv
import io
import json
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veinstone.functions import text as T

ENCODINGS = ["utf-8", "gbk", "gb2312", "gb18030", "big5", "latin-1"]
#: Bytes that a sheet's or document's part may have when unpacked, against archives that are made to burst memory.
MOST_UNPACKED = 1 << 30


def contents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content, hash) of whole files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content", F.sha2("content", 256).alias("hash"))


def is_workbook(content: Column) -> Column:
    """Whether the first bytes are those of a spreadsheet file."""
    return F.hex(F.substring(content, 1, 4)).isin("504B0304", "D0CF11E0")


def sniffed(data: bytes, detector: Callable[[bytes], str | None] | None = None) -> str:
    """The encoding of some bytes: what a detector says of the first 10,000, else the first of ENCODINGS that decodes them all."""
    if detector is not None and (said := detector(data[:10_000])):
        return said
    for name in ENCODINGS:
        try:
            data.decode(name)
            return name
        except UnicodeDecodeError:
            continue
    return "utf-8"


def encoding(content: Column, detector: Callable[[bytes], str | None] | None = None) -> Column:
    """The encoding of each file's bytes; an Arrow function, as the JVM replaces what it can't decode."""
    @F.pandas_udf("string")
    def found(files: pd.Series) -> pd.Series:
        return files.map(lambda data: None if data is None else sniffed(bytes(data), detector))

    return found(content)


def decoded(data: bytes, detector: Callable[[bytes], str | None] | None = None) -> str:
    """Text of some bytes by the encoding found, then utf-8, gbk and latin-1."""
    for name in (sniffed(data, detector), "utf-8", "gbk", "latin-1"):
        try:
            return data.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
    raise ValueError("no encoding fits")


def _csv_rows(data: bytes, detector: Callable[[bytes], str | None] | None) -> Iterator[tuple[str, int, list[str | None]]]:
    """Rows of a CSV file, its header first: rows with more cells than the header are left out, short ones padded, empty ones skipped."""
    width = None
    nth = 0
    for row in csv.reader(io.StringIO(decoded(data, detector), newline="")):
        if not row or width is not None and len(row) > width:
            continue
        width = width or len(row)
        yield "Data", nth, [x or None for x in row] + [None] * (width - len(row))
        nth += 1


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINKS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _part(archive: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    if name not in archive.namelist():
        return None
    if archive.getinfo(name).file_size > MOST_UNPACKED:
        raise ValueError(f"{name} unpacks to over {MOST_UNPACKED} bytes")
    return ElementTree.fromstring(archive.read(name))


def _related(archive: zipfile.ZipFile, name: str) -> dict[str, str]:
    """Parts that a part links to, by the link's id."""
    folder, base = posixpath.split(name)
    links = _part(archive, f"{folder}/_rels/{base}.rels")
    return {} if links is None else {link.get("Id"): posixpath.normpath(posixpath.join(folder, link.get("Target"))).lstrip("/") for link in links}


def _sheets(archive: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of a workbook's sheets."""
    book, links = _part(archive, "xl/workbook.xml"), _related(archive, "xl/workbook.xml")
    return [(sheet.get("name"), links[sheet.get(f"{_LINKS}id")]) for sheet in book.iter(f"{_MAIN}sheet")]


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match("[A-Z]*", reference)[0]:
        number = 26 * number + ord(letter) - 64
    return number - 1


def _workbook_rows(data: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row, cells) of an xlsx file, as text; a formula's cell has its stored value."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        strings = _part(archive, "xl/sharedStrings.xml")
        shared = [] if strings is None else ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in strings.findall(f"{_MAIN}si")]
        for name, part in _sheets(archive):
            rows: dict[int, dict[int, str | None]] = {}
            for r, row in enumerate(_part(archive, part).iter(f"{_MAIN}row")):
                cells = rows.setdefault(int(row.get("r", r + 1)) - 1, {})
                for c, cell in enumerate(row.findall(f"{_MAIN}c")):
                    value = cell.findtext(f"{_MAIN}v")
                    if cell.get("t") == "s" and value is not None:
                        value = shared[int(value)]
                    elif cell.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                    elif cell.get("t") == "b":
                        value = {"1": "True", "0": "False"}.get(value, value)
                    cells[_column_number(cell.get("r", "")) if cell.get("r") else c] = value
            width = max((max(cells, default=-1) + 1 for cells in rows.values()), default=0)
            for nth in range(max(rows, default=-1) + 1):
                yield name, nth, [rows.get(nth, {}).get(c) for c in range(width)]


def tables(files: DataFrame, detector: Callable[[bytes], str | None] | None = None) -> DataFrame:
    """(path, sheet, row, cells, error) of files (path, content): rows of every sheet of xlsx files and of CSV files in any encoding.

    Row 0 is the header, in which empty names become Col_i. Sheets without rows below it are left out. A file that can't be read
    is one row with the error.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                data, rows, error = bytes(content or b""), [], None
                try:
                    if data[:4] == b"\xd0\xcf\x11\xe0":
                        raise ValueError("a workbook of the old binary format")
                    found = _workbook_rows(data) if data[:4] == b"PK\x03\x04" else _csv_rows(data, detector)
                    by_sheet: dict[str, list[list[str | None]]] = {}
                    for sheet, _, cells in found:
                        by_sheet.setdefault(sheet, []).append(cells)
                    for sheet, of in by_sheet.items():
                        if len(of) > 1:
                            of[0] = [name or f"Col_{k}" for k, name in enumerate(of[0])]
                            rows += [(path, sheet, nth, cells, None) for nth, cells in enumerate(of)]
                except Exception as failure:  # noqa: BLE001  a file that can't be read is reported
                    rows, error = [], f"{type(failure).__name__}: {failure}"
                if error:
                    rows = [(path, None, None, None, error)]
                for at in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[at : at + 10_000], columns=["path", "sheet", "row", "cells", "error"]).astype({"row": "Int64"})

    return files.select("path", "content").mapInPandas(read, "path string, sheet string, row long, cells array<string>, error string")


def paragraphs(files: DataFrame, first_page: int = 0, last_page: int = 100_000_000) -> DataFrame:
    """(path, pos, style, page, text) of docx files (path, content): paragraphs outside tables, with the text that stands on the pages chosen.

    Pages are counted by the breaks that the last rendering left.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows, page = [], 0
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as archive:
                    styles = _part(archive, "word/styles.xml")
                    names = {} if styles is None else {x.get(f"{_WORD}styleId"): x.find(f"{_WORD}name").get(f"{_WORD}val") for x in styles.iter(f"{_WORD}style") if x.find(f"{_WORD}name") is not None}
                    for pos, p in enumerate(_part(archive, "word/document.xml").find(f"{_WORD}body").findall(f"{_WORD}p")):
                        style, begun, text = p.find(f"{_WORD}pPr/{_WORD}pStyle"), page, []
                        for run in p.iter(f"{_WORD}r"):
                            if first_page <= page < last_page:
                                text += ["\t" if t.tag == f"{_WORD}tab" else t.text or "" for t in run if t.tag in (f"{_WORD}t", f"{_WORD}tab")]
                            page += sum(1 for _ in run.iter(f"{_WORD}lastRenderedPageBreak"))
                        style_id = None if style is None else style.get(f"{_WORD}val")
                        if begun <= last_page:
                            rows.append((path, pos, names.get(style_id, style_id or "Normal"), begun, "".join(text)))
                yield pd.DataFrame(rows, columns=["path", "pos", "style", "page", "text"])

    return files.select("path", "content").mapInPandas(read, "path string, pos long, style string, page long, text string")


def document_cells(files: DataFrame) -> DataFrame:
    """(path, table_id, row, col, text) of the tables of docx files (path, content)."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = []
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as archive:
                    for number, table in enumerate(_part(archive, "word/document.xml").find(f"{_WORD}body").findall(f"{_WORD}tbl")):
                        for r, line in enumerate(table.findall(f"{_WORD}tr")):
                            rows += [(path, number, r, c, "\n".join("".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in cell.findall(f"{_WORD}p"))) for c, cell in enumerate(line.findall(f"{_WORD}tc"))]
                yield pd.DataFrame(rows, columns=["path", "table_id", "row", "col", "text"])

    return files.select("path", "content").mapInPandas(read, "path string, table_id long, row long, col long, text string")


_DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing}"
_IMAGE = "{http://schemas.openxmlformats.org/drawingml/2006/main}blip"


def embedded_images(files: DataFrame) -> DataFrame:
    """(path, sheet, name, data, row_from, col_from, row_to, col_to, span_type) of images in docx and xlsx files (path, content); places, from 1, for sheets only."""
    def of_workbook(archive: zipfile.ZipFile) -> Iterator[tuple]:
        for sheet, part in _sheets(archive):
            for drawing in (target for target in _related(archive, part).values() if "/drawings/" in target and target.endswith(".xml")):
                links = _related(archive, drawing)
                for anchor in _part(archive, drawing):
                    blip = next(anchor.iter(_IMAGE), None)
                    target = None if blip is None else links.get(blip.get(f"{_LINKS}embed"))
                    if target not in archive.namelist():
                        continue
                    corner = lambda end: tuple(int(end.findtext(f"{_DRAWING}{c}")) + 1 for c in ("row", "col"))
                    begin = anchor.find(f"{_DRAWING}from")
                    if begin is None:
                        continue
                    first = corner(begin)
                    last = first if (end := anchor.find(f"{_DRAWING}to")) is None else corner(end)
                    yield sheet, target, archive.read(target), *first, *last, "single_cell" if first == last else "multi_cell"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "sheet", "name", "data", "row_from", "col_from", "row_to", "col_to", "span_type"]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as archive:
                    if "word/document.xml" in archive.namelist():
                        found = ((None, name, archive.read(name), *[None] * 5) for name in sorted(set(_related(archive, "word/document.xml").values())) if "/media/" in name and name in archive.namelist())
                    else:
                        found = of_workbook(archive)
                    for row in found:
                        yield pd.DataFrame([(path, *row)], columns=names).astype({c: "Int64" for c in names[4:8]})

    return files.select("path", "content").mapInPandas(read, "path string, sheet string, name string, data binary, row_from long, col_from long, row_to long, col_to long, span_type string")


Parsed = tuple[str, list[str], dict]


def parsed(files: DataFrame, provider: Callable[..., Parsed], fallback: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, text, images, metadata, parser, error) of files (path, content) by a layout parser outside, with what to do when it fails.

    provider(content) gives markdown, image paths and metadata. A MemoryError is tried once more with disable_ocr=True. Files
    that aren't PDF, and those where the provider fails otherwise or again, have the pages of the fallback, joined by empty lines; where that fails
    as well, the error.
    """
    def attempt(path: str, data: bytes) -> tuple:
        if path.lower().endswith(".pdf"):
            for settings in ({}, {"disable_ocr": True}):
                try:
                    text, images, metadata = provider(data, **settings)
                    return text, images, json.dumps(metadata), "provider", None
                except MemoryError:
                    continue
                except Exception:  # noqa: BLE001  any failure of the parser leads to the fallback
                    break
        try:
            return "\n\n".join(fallback(data)), [], "{}", "fallback", None
        except Exception as error:  # noqa: BLE001  and one of both is reported
            return None, [], "{}", None, f"{type(error).__name__}: {error}"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                yield pd.DataFrame([(path, *attempt(path, bytes(content or b"")))], columns=["path", "text", "images", "metadata", "parser", "error"])

    return files.select("path", "content").mapInPandas(read, "path string, text string, images array<string>, metadata string, parser string, error string")


def parser_results(spark: SparkSession, folder: str) -> DataFrame:
    """(base, text, metadata, images) of a parser's output folder: <base>.md and <base>_meta.json, in a folder of that name or not, and the images beside them.

    Images come as png, webp, jpg and jpeg, in this order, then by name. A base without markdown has an empty text.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    name, home = F.element_at(F.split("path", "/"), -1), F.regexp_replace("path", "/[^/]*$", "")
    named = files.select("content", "path", name.alias("name"), home.alias("home"))
    text = named.where(F.col("name").endswith(".md")).select("home", F.regexp_replace("name", r"\.md$", "").alias("base"), F.decode("content", "UTF-8").alias("text"))
    meta = named.where(F.col("name").endswith("_meta.json")).select("home", F.regexp_replace("name", r"_meta\.json$", "").alias("base"), F.decode("content", "UTF-8").alias("metadata"))
    kinds = F.array(*map(F.lit, ["png", "webp", "jpg", "jpeg"]))
    kind = F.array_position(kinds, F.regexp_extract("name", r"\.([^.]+)$", 1))
    images = named.where(kind > 0).groupBy("home").agg(F.transform(F.sort_array(F.collect_list(F.struct(kind.alias("kind"), "path"))), lambda x: x["path"]).alias("images"))
    found = text.join(meta, ["home", "base"], "full").join(images, "home", "left")
    return found.select("base", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("metadata", F.lit("{}")).alias("metadata"), F.coalesce("images", F.array().cast("array<string>")).alias("images"))


def csv_rows(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Rows of large CSV files with a header, in a known encoding, by Spark's own reader; rows with more cells than the header are left out, short ones padded."""
    raw = spark.read.option("header", "true").option("encoding", encoding).option("mode", "PERMISSIVE")
    names = raw.csv(path).columns
    schema = ", ".join(f"`{name}` string" for name in [*names, "_surplus", "_corrupt"])
    rows = raw.option("columnNameOfCorruptRecord", "_corrupt").schema(schema).option("enforceSchema", "true").csv(path)
    return rows.where(F.col("_surplus").isNull()).select(*(F.col(f"`{n}`") for n in names))


def line_count(text: Column) -> Column:
    """Lines of a text, an empty last one included."""
    return F.size(F.split(text, "\n"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Old and new rows, the last of each key; write it to a new place, never over what it reads."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(order)))
    return both.withColumn("_nth", last).where("_nth = 1").drop("_nth", "_new")


def index_rows(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]] | None = None, batch: int = 10) -> DataFrame:
    """Chunks (doc_id, chunk_id, text, ...) to index: without blank ones, with _id, and with ``vector`` where an embedding provider is given.

    The provider gets ``batch`` texts at a time. Rows go into an index by upsert(index, rows, ["_id"], ...).
    """
    rows = chunks.where(T.not_blank(F.col("text"))).withColumn("_id", F.concat_ws("_", F.col("doc_id").cast("string"), F.col("chunk_id").cast("string")))
    if embed is None:
        return rows

    def embedded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            vectors = [v for at in range(0, len(some), batch) for v in embed(some["text"].iloc[at : at + batch].tolist())]
            yield some.assign(vector=vectors)

    return rows.mapInPandas(embedded, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "vector array<double>"]))


def asset_rows(assets: DataFrame) -> DataFrame:
    """Assets (image_path, description, caption, category, data, filename) to store: those with data and name; text by preference."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    kept = assets.where(T.not_blank(F.col("data")) & T.not_blank(F.col("filename")))
    return kept.withColumns({"category": F.coalesce(blank("category"), F.lit("general")), "text": F.coalesce(blank("description"), blank("caption"), F.lit("No description provided"))})


def memory_log(old: DataFrame, entry: DataFrame, now: Column, append: bool = True) -> DataFrame:
    """A memory (scope, scope_id, content) after writes (scope, scope_id, content), one for each: behind what is there and a line with the time, or instead of it."""
    joined = old.withColumnRenamed("content", "old").join(entry, ["scope", "scope_id"], "full")
    mark = F.concat(F.lit("\n\n---\n_记录于 "), F.date_format(now, "yyyy-MM-dd HH:mm"), F.lit("_\n\n"))
    both = F.when(F.col("content").isNull(), F.col("old")).when(F.col("old").isNull() | F.lit(not append), F.col("content")).otherwise(F.concat("old", mark, "content"))
    return joined.select("scope", "scope_id", both.alias("content"))


def merge_statements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, statement): an export of nodes (node, kind, description, rank) and undirected edges (a, b, weight, description) for a graph shell."""
    quoted = F.replace(F.coalesce("description", F.lit("")), F.lit("'"), F.lit("\\'"))
    label = F.replace(F.replace(F.coalesce("kind", F.lit("Entity")), F.lit(" "), F.lit("_")), F.lit("-"), F.lit(""))
    node = F.format_string(
        "MERGE (n:%s {name: '%s'}) ON CREATE SET n.description = '%s', n.rank = %d ON MATCH SET n.description = n.description + '<SEP>' + '%s', n.rank = %d",
        label, F.col("node"), quoted, F.coalesce("rank", F.lit(0)).cast("long"), quoted, F.coalesce("rank", F.lit(0)).cast("long"),
    )
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).cast("string")
    edge = F.format_string(
        "MATCH (a {name: '%s'}), (b {name: '%s'}) MERGE (a)-[r:RELATED_TO]->(b) ON CREATE SET r.weight = %s, r.description = '%s' ON MATCH SET r.weight = r.weight + %s, r.description = r.description + '<SEP>' + '%s'",
        F.col("a"), F.col("b"), weight, quoted, weight, quoted,
    )
    return nodes.select(F.lit("node").alias("kind"), node.alias("statement")).unionByName(edges.select(F.lit("edge").alias("kind"), edge.alias("statement")))


def newest_first(documents: DataFrame, by: str = "created_at") -> tuple[DataFrame, DataFrame]:
    """Documents, the newest first, and (total)."""
    return documents.orderBy(F.desc(by), *(c for c in documents.columns if c != by)), documents.agg(F.count("*").alias("total"))


def long_enough(rows: DataFrame, column: str = "text", over: int = 50) -> DataFrame:
    """Rows whose text, trimmed, has over so many characters: what extraction is asked for."""
    return rows.where(F.length(T.trim_all(F.col(column))) > over)


def of_documents(rows: DataFrame, doc_ids: list) -> DataFrame:
    """Rows of given documents; the equality reaches the scan."""
    return rows.where(F.col("doc_id").isin(doc_ids) if len(doc_ids) != 1 else F.col("doc_id") == doc_ids[0])


def with_results(assets: DataFrame, results: DataFrame) -> DataFrame:
    """Assets (doc_id, position, ...) with what a vision model said at the same position (doc_id, position, category, description); rows pair by position, not by name."""
    return assets.join(results, ["doc_id", "position"], "left")


def keeps_upload(path: Column) -> Column:
    return F.coalesce(path.endswith(".pdf"), F.lit(False))

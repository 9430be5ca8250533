"""Readers of tables and documents, from files made here."""

import zipfile

import pytest
from pyspark.sql import functions as F

from veinstone.operators import chunking
from veinstone.sources import files

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
DRAWING = "http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing"
ART = "http://schemas.openxmlformats.org/drawingml/2006/main"


def links(*targets):
    return "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="{t}"/>' for k, t in enumerate(targets)) + "</Relationships>"


@pytest.fixture
def folder(tmp_path):
    with zipfile.ZipFile(tmp_path / "book.xlsx", "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{LINKS}"><sheets><sheet name="First" r:id="r0"/><sheet name="Bare" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", links("worksheets/sheet1.xml", "worksheets/sheet2.xml"))
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}"><si><t>name</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>')
        book.writestr("xl/worksheets/sheet1.xml", f'''<worksheet xmlns="{MAIN}"><sheetData>
          <row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>size</t></is></c></row>
          <row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3" t="b"><v>1</v></c><c r="C3"><v>4.5</v></c></row></sheetData></worksheet>''')
        book.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{MAIN}"><sheetData><row r="1"><c r="A1"><v>1</v></c></row></sheetData></worksheet>')
        book.writestr("xl/worksheets/_rels/sheet1.xml.rels", links("../drawings/drawing1.xml"))
        book.writestr("xl/drawings/drawing1.xml", f'''<d:wsDr xmlns:d="{DRAWING}" xmlns:a="{ART}" xmlns:r="{LINKS}"><d:twoCellAnchor><d:from><d:col>1</d:col><d:row>2</d:row></d:from>
          <d:to><d:col>3</d:col><d:row>4</d:row></d:to><d:pic><a:blip r:embed="r0"/></d:pic></d:twoCellAnchor></d:wsDr>''')
        book.writestr("xl/drawings/_rels/drawing1.xml.rels", links("../media/image1.png"))
        book.writestr("xl/media/image1.png", b"png!")
    paragraph = lambda style, *runs: f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr>' + "".join(f"<w:r>{r}</w:r>" for r in runs) + "</w:p>"
    t = "<w:t>{}</w:t>".format
    cell = lambda x: f"<w:tc><w:p><w:r>{t(x)}</w:r></w:p></w:tc>"
    with zipfile.ZipFile(tmp_path / "text.docx", "w") as book:
        rows = "".join("<w:tr>" + "".join(map(cell, row)) + "</w:tr>" for row in (["k", "v", "w", "x"], ["1", "2", "3", "4"]))
        book.writestr("word/document.xml", f'''<w:document xmlns:w="{WORD}"><w:body>{paragraph("H1", t("Title"))}{paragraph("N", t("one"), "<w:tab/>" + t("two"))}
          <w:p><w:r><w:lastRenderedPageBreak/>{t("behind")}</w:r></w:p><w:tbl>{rows}</w:tbl>{paragraph("H1", t("Empty"))}</w:body></w:document>''')
        book.writestr("word/styles.xml", f'<w:styles xmlns:w="{WORD}"><w:style w:styleId="H1"><w:name w:val="Heading 1"/></w:style></w:styles>')
        book.writestr("word/_rels/document.xml.rels", links("media/a.png", "styles.xml"))
        book.writestr("word/media/a.png", b"word!")
    (tmp_path / "gbk.csv").write_bytes("名,,x\n马氏体,2,3\n1,2,3,4\n\n5\n".encode("gbk"))
    (tmp_path / "broken.xlsx").write_bytes(b"PK\x03\x04 not a zip")
    return tmp_path


def test_tables(spark, folder):
    found = files.tables(files.contents(spark, str(folder), "*.{xlsx,csv}")).collect()
    name = lambda r: r.path.rpartition("/")[2]
    assert {(name(r), r.sheet, r.row, tuple(r.cells)) for r in found if r.error is None} == {
        ("book.xlsx", "First", 0, ("name", "Col_1", "size")), ("book.xlsx", "First", 1, (None, None, None)), ("book.xlsx", "First", 2, ("two runs", "True", "4.5")),
        ("gbk.csv", "Data", 0, ("名", "Col_1", "x")), ("gbk.csv", "Data", 1, ("马氏体", "2", "3")), ("gbk.csv", "Data", 2, ("5", None, None)),
    }
    assert [name(r) for r in found if r.error] == ["broken.xlsx"]


def test_documents(spark, folder):
    docs = files.contents(spark, str(folder), "*.docx")
    found = files.paragraphs(docs).orderBy("pos").collect()
    assert [(r.style, r.page, r.text) for r in found] == [("Heading 1", 0, "Title"), ("N", 0, "one\ttwo"), ("Normal", 0, "behind"), ("Heading 1", 1, "Empty")]
    cells = files.document_cells(docs)
    lines = chunking.grid_key_values(cells.select(F.col("table_id"), "row", "col", "text"))
    assert [r.text for r in lines.collect()] == ["k: 1;v: 2;w: 3;x: 4"]


def test_images(spark, folder):
    found = {r.name: r for r in files.embedded_images(files.contents(spark, str(folder), "[bt]*[kt].{xlsx,docx}")).collect()}
    sheet = found["xl/media/image1.png"]
    assert (sheet.sheet, sheet.row_from, sheet.col_from, sheet.row_to, sheet.col_to, sheet.span_type, bytes(sheet.data)) == ("First", 3, 2, 5, 4, "multi_cell", b"png!")
    assert bytes(found["word/media/a.png"].data) == b"word!" and found["word/media/a.png"].row_from is None


def test_parsers(spark, tmp_path):
    for name in ("ok.pdf", "oom.pdf", "bad.pdf", "note.txt", "lost.pdf"):
        (tmp_path / name).write_bytes(name.encode())

    def provider(data, disable_ocr=False):
        if data == b"oom.pdf" and not disable_ocr:
            raise MemoryError("out of memory")
        if data in (b"bad.pdf", b"lost.pdf"):
            raise RuntimeError("no layout")
        return f"# {data.decode()} {disable_ocr}", ["a.png"], {"table_of_contents": []}

    def fallback(data):
        if data == b"lost.pdf":
            raise ValueError("unreadable")
        return ["page one", "page two"]

    found = {r.path.rpartition("/")[2]: r for r in files.parsed(files.contents(spark, str(tmp_path)), provider, fallback).collect()}
    assert (found["ok.pdf"].text, found["ok.pdf"].images, found["ok.pdf"].parser) == ("# ok.pdf False", ["a.png"], "provider")
    assert found["oom.pdf"].text == "# oom.pdf True"
    assert all((found[n].text, found[n].parser) == ("page one\n\npage two", "fallback") for n in ("bad.pdf", "note.txt"))
    assert found["lost.pdf"].text is None and "unreadable" in found["lost.pdf"].error


def test_parser_results(spark, tmp_path):
    for base, home in (("a", tmp_path / "a"), ("b", tmp_path / "other")):
        home.mkdir()
        (home / f"{base}_meta.json").write_text('{"table_of_contents": []}')
    (tmp_path / "a" / "a.md").write_text("# text")
    for name in ("z.png", "b.jpeg", "c.webp", "a.png", "no.gif"):
        (tmp_path / "a" / name).write_bytes(b"x")
    found = {r.base: r for r in files.parser_results(spark, str(tmp_path)).collect()}
    assert found["a"].text == "# text" and [i.rpartition("/")[2] for i in found["a"].images] == ["a.png", "z.png", "c.webp", "b.jpeg"]
    assert found["b"].text == "" and found["b"].images == [] and "table_of_contents" in found["b"].metadata


def test_field_names():
    from veinstone.operators import profile

    assert profile.field_name("Size (mm)/x", "float") == "size_flt"
    assert profile.field_name("钢号A（牌号）", "text", {"钢": "gang", "号": "hao"}) == "gang_hao_a_tks"


def test_deletion_report():
    from veinstone.operators import graph

    def fails():
        raise OSError("away")

    assert graph.deletion_report("d", {"index": lambda: 3, "graph": fails}, lambda: 1) == ["index: 3", "graph: failed (away)", "metadata: 1"]


def test_scalar_functions(spark):
    import pandas as pd

    from veinstone.registry import Entry, Registry

    known = Registry()

    def doubled(x: pd.Series) -> pd.Series:
        return x * 2

    known.register(doubled, Entry("doubled", "twice", "scalar", "long"))
    assert known.register_scalars(spark) == ["doubled"] and spark.sql("SELECT doubled(id) AS y FROM range(3)").agg(F.sum("y")).first()[0] == 6


def test_shared_folder_needs_one_on_a_cluster():
    from veinstone.operators import tables

    class Conf:
        def __init__(self, **values):
            self.values = values

        def get(self, name, default=None):
            return self.values.get(name.replace(".", "_"), default)

        def set(self, name, value):
            self.values[name.replace(".", "_")] = value

    class Session:
        def __init__(self, **values):
            self.conf = Conf(**values)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_folder(Session(spark_master="yarn"))
    assert tables.shared_folder(Session(spark_master="yarn", spark_checkpoint_dir="hdfs://x/y/")) == "hdfs://x/y"
    assert tables.shared_folder(Session(spark_master="local[4]")).startswith("file://")

"""Queries over built-in documents of every format, with the expected rows stated as SQL literals.

The driver's tables hold pages and texts only; these queries show what readers, scanners and writers do with the other formats.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import markdown as M
from foliant.functions import scanners as S
from foliant.functions.arrow import map_rows
from foliant.functions.html_markdown import Refusal, article_roots, body_markdown, css_hidden, is_layout, render_html, table_layout, target_class
from foliant.functions.html_tree import TEXT, parse
from foliant.operators import artifacts as A
from foliant.operators import geometry as G
from foliant.operators import inspection as I
from foliant.operators import html as H
from foliant.operators import lines as L
from foliant.operators import urls as U
from foliant.operators.routing import receipts, with_route
from foliant.plans import convert as C
from foliant.selfcheck import self_check
from foliant.sources import biff, charset, compound, mail, ole_native, packages, pdf, sinks, workbooks
from foliant.sources import synthetic as D

FILES = {
    "a.docx": D.docx(), "b.pptx": D.pptx(), "c.xlsx": D.xlsx(), "d.odt": D.odt(), "e.odp": D.odp(), "f.ods": D.ods(), "g.epub": D.epub(), "h.eml": D.EML, "i.HTML": b"<title>T</title><h1>H</h1>",
    "j.txt": "päss".encode(), "k.csv": b"a,b", "l.txt": b"\xff", "m.docx": b"no zip", "n.xls": D.compound({"Workbook": b"x"}), "o": b"x", "p.xls": D.xls(), "q.xlsb": D.xlsb(),
    "r.pdf": D.pdf(b"BT /F 10 Tf 1 0 0 1 50 700 Tm (Hello \\(PDF\\)) Tj 0 -12 Td [(wor) 20 (ld) -300 (again)] TJ 0 -12 Td (third) Tj 0 -60 Td (# far) Tj ET"), "s.pdf": b"no pdf", "t.md": b"[a](b) ![c](d.png)",
    "u.docx": D.zipped({"word/vbaProject.bin": D.vba_project()}), "v.html": b'<!-- c --><p hidden>x</p><img src="data:text/plain,hi" onclick=go()><a href=/y>k</a><script>s</script>',
}

Rows = Sequence[tuple]
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, str):
        quoted = "'" + value.replace("'", "''") + "'"
        for control in ("\n", "\r", "\t"):
            quoted = quoted.replace(control, f"' || chr({ord(control)}) || '")
        return quoted
    return repr(value)


def _sql(layout: str, rows: Rows) -> str:
    """Rows as SQL literals; ``layout`` is a Spark schema string."""
    kinds = {"long": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    fields = [f.strip().split(" ") for f in layout.split(",")]
    picked = ", ".join(f'c{i}::{kinds[kind]} AS "{name}"' for i, (name, kind) in enumerate(fields))
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"SELECT {picked} FROM (VALUES {values}) AS t({', '.join(f'c{i}' for i in range(len(fields)))})"


def _query(layout: str, rows: Rows):
    def register(build: Callable[[SparkSession], DataFrame]):
        names = [f.strip().split(" ")[0] for f in layout.split(",")]
        QUERIES[build.__name__] = (lambda spark, sf: build(spark).select(*names), _sql(layout, rows))
        return build

    return register


def _files(spark: SparkSession, names: Iterable[str] = tuple(FILES)) -> DataFrame:
    rows = [(list(FILES).index(n), n, bytearray(FILES[n])) for n in names]
    return with_route(spark.createDataFrame(rows, "source_id long, name string, content binary"))


def _named(spark: SparkSession, found: DataFrame) -> DataFrame:
    return found.join(F.broadcast(_files(spark).select("source_id", "name")), "source_id")


def _each(spark: SparkSession, inputs: Sequence, layout: str, function: Callable) -> DataFrame:
    """``function`` of each input, as rows after the input's number; inputs are strings or bytes."""
    from pyspark.sql.types import StructType

    kind = "binary" if isinstance(inputs[0], bytes) else "string"
    df = spark.createDataFrame([(i, bytearray(x) if kind == "binary" else x) for i, x in enumerate(inputs)], f"n int, v {kind}")
    return map_rows(df, StructType.fromDDL(layout), lambda n, v: ((n, *row) for row in function(v)))


# Conversion -------------------------------------------------------------------------------------------------------------


def _markdown(spark: SparkSession, *names: str, **options) -> DataFrame:
    return C.convert(_files(spark, names), body_only=True, **options)


@_query(
    "name string, markdown string",
    [
        ('a.docx', '<a id="unit-chapter-000001"></a>\n## Chapter 1: "Body"\n\nBefore\n\n<a id="unit-chapter-000002"></a>\n## Chapter 2: "Start \\*here\\*"\n\n### Start \\*here\\*\n\nOne - two\nthree\n\n| A |  |\n| --- | --- |\n| B\\| | C |\n'),
    ],
)
def docx_markdown(spark):
    return _markdown(spark, "a.docx")


@_query(
    "name string, markdown string",
    [
        ('b.pptx', '<a id="unit-slide-000001"></a>\n## Slide 1: "First"\n\n### First\n\ny\n\n<a id="unit-slide-000002"></a>\n## Slide 2: "Second"\n\n### Second\n\nx\n'),
    ],
)
def pptx_markdown(spark):
    return _markdown(spark, "b.pptx")


@_query(
    "name string, markdown string, tables long",
    [
        ('c.xlsx', '<a id="unit-sheet-000001"></a>\n## Sheet 1: "Data"\n\nSource range: C5:F8\n\n| Row | C | D | E | F |\n| --- | --- | --- | --- | --- |\n| 5 | C5: offset | D5: #DIV/0! | E5: [blank] | F5: [missing cached result] |\n| 6 |  |  |  |  |\n| 7 |  | D7: 42.0 | E7: 1.0 |  |\n| 8 |  |  | E8: 2.0 | F8: rich |\n\n<a id="unit-sheet-000002"></a>\n## Sheet 2: "Far"\n\nSource range: C5:XFD1048576\n\nRows and columns without cells are left out.\n\n| Row | C | XFD |\n| --- | --- | --- |\n| 5 | C5: 1.0 |  |\n| 1048576 |  | XFD1048576: 2.0 |\n', 2),
    ],
)
def xlsx_markdown(spark):
    return _markdown(spark, "c.xlsx").withColumn("tables", F.col("tables").cast("long"))


@_query(
    "name string, markdown string",
    [
        ('c.xlsx', '<a id="unit-sheet-000001"></a>\n## Sheet 1: "Far"\n\nSource range: C5:XFD1048576\n\nRows and columns without cells are left out.\n\n| Row | C | XFD |\n| --- | --- | --- |\n| 5 | C5: 1.0 |  |\n| 1048576 |  | XFD1048576: 2.0 |\n'),
    ],
)
def selected_sheets(spark):
    return _markdown(spark, "c.xlsx", sheets=["Far"])


@_query("name string, markdown string", [('d.odt', '<a id="unit-chapter-000001"></a>\n## Chapter 1: "Top"\n\n### Top\n\na  b\nc\n\n- i\n')])
def odt_markdown(spark):
    return _markdown(spark, "d.odt")


@_query("name string, markdown string", [('e.odp', '<a id="unit-slide-000001"></a>\n## Slide 1: "Name"\n\n### Name\n')])
def odp_markdown(spark):
    return _markdown(spark, "e.odp")


@_query(
    "name string, markdown string",
    [
        ('f.ods', '<a id="unit-sheet-000001"></a>\n## Sheet 1: "S"\n\nSource range: A1:B2\n\n| Row | A | B |\n| --- | --- | --- |\n| 1 | A1: 3.0 | B1: 3.0 |\n| 2 | A2: 3.0 | B2: 3.0 |\n'),
    ],
)
def ods_markdown(spark):
    return _markdown(spark, "f.ods")


@_query(
    "name string, markdown string",
    [
        ('g.epub', '<a id="unit-chapter-000001"></a>\n## Chapter 1: "The second"\n\n### B\n\ntext B\n\n<a id="unit-chapter-000002"></a>\n## Chapter 2: "A"\n\n### A\n\ntext A\n'),
    ],
)
def epub_markdown(spark):
    return _markdown(spark, "g.epub")


@_query(
    "name string, markdown string",
    [
        ('h.eml', '<a id="unit-chapter-000001"></a>\n## Chapter 1: "Title"\n\nFrom: Jörg &lt;j@example.org>\n\nSubject: Title\n\n```\ncafé *x*\n```\n\nAttachment: a.txt\n'),
    ],
)
def eml_markdown(spark):
    return _markdown(spark, "h.eml")


@_query(
    "name string, markdown string",
    [
        ('p.xls', '<a id="unit-sheet-000001"></a>\n## Sheet 1: "S"\n\nSource range: A1:B4\n\n| Row | A | B |\n| --- | --- | --- |\n| 1 | A1: one | B1: wide é wide é wide é |\n| 2 | A2: 2.5 | B2: 7.0 |\n| 3 | A3: #DIV/0! | B3: ok |\n| 4 | A4: 0.05 | B4: 6.0 |\n'),
    ],
)
def xls_markdown(spark):
    return _markdown(spark, "p.xls")


@_query(
    "name string, markdown string",
    [
        ('q.xlsb', '<a id="unit-sheet-000001"></a>\n## Sheet 1: "Name"\n\nSource range: C5:G5\n\n| Row | C | D | E | F | G |\n| --- | --- | --- | --- | --- | --- |\n| 5 | C5: text | D5: 1.5 | E5: true | F5: f | G5: [blank] |\n'),
    ],
)
def xlsb_markdown(spark):
    return _markdown(spark, "q.xlsb")


@_query("name string, markdown string", [('r.pdf', '<a id="unit-page-000001"></a>\n## Page 1\n\nHello (PDF)\nworld again\nthird\n\n\\# far\n')])
def pdf_markdown(spark):
    return _markdown(spark, "r.pdf")


@_query(
    "name string, reason string",
    [
        ('k.csv', 'unsupported suffix: .csv'),
        ('l.txt', 'text is not UTF-8'),
        ('m.docx', 'package unreadable: File is not a zip file'),
        ('n.xls', 'BIFF version refused'),
        ('o', 'unsupported suffix: none'),
        ('s.pdf', 'PDF header missing'),
        ('u.docx', 'package main part missing'),
    ],
)
def refused_files(spark):
    return C.convert(_files(spark)).where("not file_ok")


@_query(
    "name string, unit_kind string, units string",
    [
        ('a.docx', 'chapter', 'chapter/000001,chapter/000002'),
        ('b.pptx', 'slide', 'slide/000001,slide/000002'),
        ('c.xlsx', 'sheet', 'sheet/000001,sheet/000002'),
        ('d.odt', 'chapter', 'chapter/000001'),
        ('e.odp', 'slide', 'slide/000001'),
        ('f.ods', 'sheet', 'sheet/000001'),
        ('g.epub', 'chapter', 'chapter/000001,chapter/000002'),
        ('h.eml', 'chapter', 'chapter/000001'),
        ('i.HTML', 'chapter', 'chapter/000001'),
        ('j.txt', '', ''),
        ('p.xls', 'sheet', 'sheet/000001'),
        ('q.xlsb', 'sheet', 'sheet/000001'),
        ('r.pdf', 'page', 'page/000001'),
        ('t.md', '', ''),
        ('v.html', 'chapter', 'chapter/000001'),
    ],
)
def unit_inventory(spark):
    receipt = F.from_json("receipt", "unit_kind string, unit_keys array<string>")
    return C.convert(_files(spark)).where("file_ok").select("name", receipt["unit_kind"].alias("unit_kind"), F.array_join(receipt["unit_keys"], ",").alias("units"))


@_query(
    "name string, markdown string",
    [
        ('i.HTML', '# "i.HTML"\n\n<a id="unit-metadata"></a>\n## Metadata\n\n| Field | Value |\n| --- | --- |\n| Markdown schema | foliant.markdown/1 |\n| Source name | "i.HTML" |\n| Source suffix | .html |\n| Source bytes | 26 |\n| Source SHA-256 | d9efb5ae163e0d04069ba2acfaf62a98908ac0c33a03e19809be4c510c1ba18e |\n| Route | html |\n| Unit kind | chapter |\n| Rendered unit count | 1 |\n| Ordered selection keys | chapter/000001 |\n| Rendered body bytes | 58 |\n| Rendered body SHA-256 | 291dcd6072c1b80dd59484e0be8787dd95afcf795d360bbf435bfcf9943aec23 |\n| Tables | 0 |\n\n<a id="unit-contents"></a>\n## Contents\n\n- [Chapter 1: "T"](#unit-chapter-000001)\n\n<a id="unit-chapter-000001"></a>\n## Chapter 1: "T"\n\n### H\n'),
    ],
)
def enveloped_markdown(spark):
    return C.convert(_files(spark, ["i.HTML"]))


@_query("name string, same boolean, marked boolean", [("a.docx", True, True), ("j.txt", True, True)])
def report_markers(spark):
    """The readable part comes back whole from before a report."""
    rows = C.convert(_files(spark, ["a.docx", "j.txt"])).withColumn("report", F.lit("findings"))
    both = C.with_report(rows).select("name", "markdown", C.readable_part(F.col("markdown")).alias("back")).join(rows.select("name", F.col("markdown").alias("was")), "name")
    return both.select("name", (F.col("back") == F.col("was")).alias("same"), F.col("markdown").endswith("findings").alias("marked"))


@_query(
    "name string, receipt string",
    [
        ('j.txt', '{"byte_size":5,"file_ok":true,"name":"j.txt","source_id":9}'),
        ('k.csv', '{"byte_size":3,"file_ok":false,"name":"k.csv","reason":"unsupported suffix: .csv","source_id":10}'),
    ],
)
def receipt_lines(spark):
    facts = C.convert(_files(spark, ["j.txt", "k.csv"])).select("source_id", "name", "file_ok", "reason", "byte_size")
    return receipts(facts).join(facts.select("source_id", "name"), "source_id")


@_query("source_id long, depth long, name string, reason string", [(1, 0, "o.zip", None), (2, 0, "m.eml", None), (1, 1, "in.zip", None), (1, 1, "a.html", None), (1, 2, "x.txt", None), (2, 1, "a.txt", None)])
def nested_documents(spark):
    outer = D.zipped({"in.zip": D.zipped({"x.txt": "deep", "y.bin": "no"}), "a.html": "<p>x"})
    df = spark.createDataFrame([(1, "o.zip", bytearray(outer)), (2, "m.eml", bytearray(D.EML))], "source_id long, name string, content binary")
    return C.nested_documents(df).withColumn("depth", F.col("depth").cast("long"))


@_query("target string, sources long", [("a.md", 2)])
def colliding_names(spark):
    return sinks.colliding_names(spark.createDataFrame([("a.md",), ("A.md",), ("b",)], "name string"))


@_query("key string", [("z",)])
def unknown_keys(spark):
    return sinks.unknown_keys(spark.createDataFrame([("a",), ("z",)], "key string"), spark.createDataFrame([("a",), ("b",)], "key string"))


@_query("problems long", [(0,)])
def self_check_problems(spark):
    return spark.createDataFrame([(len(self_check(spark)),)], "problems long")


# Readers ----------------------------------------------------------------------------------------------------------------


@_query(
    "name string, part string",
    [
        ('a.docx', '_rels/.rels'),
        ('a.docx', 'word/document.xml'),
        ('b.pptx', '_rels/.rels'),
        ('b.pptx', 'ppt/_rels/presentation.xml.rels'),
        ('b.pptx', 'ppt/presentation.xml'),
        ('b.pptx', 'ppt/slides/s1.xml'),
        ('b.pptx', 'ppt/slides/s2.xml'),
    ],
)
def package_members(spark):
    return _named(spark, packages.members(_files(spark, ["a.docx", "b.pptx"])))


@_query("rid string, resolved string", [("r1", "ppt/presentation.xml"), ("a", "ppt/slides/s1.xml"), ("b", "ppt/slides/s2.xml")])
def package_relationships(spark):
    return packages.relationships(_files(spark, ["b.pptx"]))


@_query("n int, part string", [(0, "c/d.xml"), (1, None), (2, "x/y"), (3, "a/b.xml")])
def resolved_parts(spark):
    return _each(spark, ["a/b.xml ../c/d.xml#f", "a/b.xml ../../x", "a/b.xml /x/y", "a/c.xml ./b.xml"], "n int, part string", lambda v: [(packages.resolve_part(*v.split(" ")),)])


@_query("n int, verdict string", [(0, 'a'), (1, 'XML document type refused: p'), (2, 'XML unreadable: p: no element found: line 1, column 3'), (3, 'a')])
def admitted_xml(spark):
    def verdict(v):
        try:
            return [(packages.local(packages.admit_xml(v, "p").tag),)]
        except Refusal as r:
            return [(str(r),)]

    return _each(spark, [b"<x:a xmlns:x='u'/>", b'<!DOCTYPE x [<!ENTITY a "b">]><x/>', b"<a>", "<a/>".encode("utf-16")], "n int, verdict string", verdict)


@_query("path string, kind string, bytes long", [("A", "stream", 5), ("B", "stream", 300), ("C", "stream", 0)])
def compound_streams(spark):
    df = spark.createDataFrame([(1, bytearray(D.compound({"A": b"short", "B": b"y" * 300, "C": b""})))], "source_id long, content binary")
    return compound.compound_entries(df).where("kind = 'stream'").select("path", "kind", F.octet_length("content").cast("long").alias("bytes"))


@_query("n int, text string", [(0, "a" * 73), (1, "VBA container signature missing"), (2, "VBA chunk cut short"), (3, "Sub A()")])
def vba_expansion(spark):
    def text(v):
        try:
            return [(compound.decompress_vba(v).decode("ascii"),)]
        except Refusal as r:
            return [(str(r),)]

    return _each(spark, [b"\x01\x03\xb0\x02aE\x00", b"\x02abc", b"\x01\x05\xb0\x02aE\x00", D.vba_container(b"Sub A()")], "n int, text string", text)


@_query(
    "name string, key string, kind string, bytes long",
    [
        ('c.xlsx', 'formulas/sheet-000001', 'formulas', 217),
        ('h.eml', 'attachment/1.2', 'attachment', 8),
        ('u.docx', 'vba-module/Module1', 'vba-module', 18),
        ('u.docx', 'vba-project', 'vba-project', 2560),
        ('v.html', 'data-url/000001', 'data-url', 2),
    ],
)
def artifact_inventory(spark):
    return _named(spark, A.artifacts(_files(spark)).where("kind <> 'refused'")).select("name", "key", "kind", F.octet_length("content").cast("long").alias("bytes"))


@_query("name string, key string", [("h.eml", "attachment/1.2")])
def selected_artifacts(spark):
    found = A.artifacts(_files(spark, ["h.eml", "c.xlsx"]))
    return _named(spark, A.selected(found, found.where("kind = 'attachment'").select("source_id", "key")))


@_query("n int, media string, body string", [(0, "text/plain", "hi"), (1, "text/plain;charset=US-ASCII", "a b"), (4, "text/plain;charset=US-ASCII", "x,y")])
def data_urls(spark):
    given = ["data:text/plain;base64,aGk=", "data:,a%20b", "data:;base64,@@", "http://x", "DATA:,x,y"]
    return _each(spark, given, "n int, media string, body string", lambda v: [(f[0], f[1].decode())] if (f := compound.data_url(v)) else [])


@_query(
    "path string, media string, filename string, text string",
    [
        ('1', 'multipart/mixed', None, None),
        ('1.1', 'multipart/alternative', None, None),
        ('1.1.1', 'text/plain', None, 'café *x*'),
        ('1.1.2', 'text/html', None, '<p>html</p>'),
        ('1.2', 'text/plain', 'a.txt', 'attached'),
    ],
)
def mime_parts(spark):
    found = mail.mime_parts(_files(spark, ["h.eml"]))
    return found.select(F.col("mime_path").alias("path"), F.col("media_type").alias("media"), "filename", F.trim(F.col("payload").cast("string")).alias("text"))


@_query("n int, text string", [(0, "Jörg <j@example.org>"), (1, "plain"), (2, "Grüße aus")])
def mail_headers(spark):
    return _each(spark, ["=?utf-8?q?J=C3=B6rg?= <j@example.org>", "plain", "=?iso-8859-1?q?Gr=FC=DFe?= =?utf-8?b?IGF1cw==?="], "n int, text string", lambda v: [(mail.header_text(v),)])


_CELL = "sheet string, row long, col long, value_type string, value string"


def _cells_of(spark, name):
    return workbooks.workbook_cells(_files(spark, [name])).select("sheet", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value_type", "value", "formula")


@_query(
    _CELL + ", formula string",
    [
        ('Data', 5, 3, 'string', 'offset', None),
        ('Data', 5, 4, 'error', '#DIV/0!', None),
        ('Data', 5, 5, 'blank', None, None),
        ('Data', 5, 6, 'missing', None, '1/0'),
        ('Data', 7, 4, 'number', '42.0', None),
        ('Data', 7, 5, 'number', '1.0', 'D7+$A$1'),
        ('Data', 8, 5, 'number', '2.0', 'D8+$A$1'),
        ('Data', 8, 6, 'string', 'rich', None),
        ('Far', 1048576, 16384, 'number', '2.0', None),
        ('Far', 5, 3, 'number', '1.0', None),
    ],
)
def xlsx_cells(spark):
    return _cells_of(spark, "c.xlsx")


@_query(_CELL, [("S", 1, 1, "number", "3.0"), ("S", 1, 2, "number", "3.0"), ("S", 2, 1, "number", "3.0"), ("S", 2, 2, "number", "3.0")])
def ods_cells(spark):
    return _cells_of(spark, "f.ods")


@_query(
    _CELL,
    [("S", 1, 1, "string", "one"), ("S", 1, 2, "string", "wide é " * 3), ("S", 2, 1, "number", "2.5"), ("S", 2, 2, "number", "7.0"), ("S", 3, 1, "error", "#DIV/0!"), ("S", 3, 2, "string", "ok"), ("S", 4, 1, "number", "0.05"), ("S", 4, 2, "number", "6.0")],
)
def xls_cells(spark):
    return _cells_of(spark, "p.xls")


@_query(_CELL, [("Name", 5, 3, "string", "text"), ("Name", 5, 4, "number", "1.5"), ("Name", 5, 5, "boolean", "true"), ("Name", 5, 6, "string", "f"), ("Name", 5, 7, "blank", None)])
def xlsb_cells(spark):
    return _cells_of(spark, "q.xlsb")


@_query("n int, value double", [(0, 7.0), (1, 0.05), (2, -1.0), (3, 1.0), (4, 0.01)])
def rk_numbers(spark):
    """Whole numbers and the upper halves of doubles, each plain or in hundredths."""
    return _each(spark, [str(x) for x in ((7 << 2) | 2, (5 << 2) | 3, 0xFFFFFFFE, 0x3FF00000, 0x3FF00001)], "n int, value double", lambda v: [(float(biff.number_of_rk(int(v))),)])


_PAGE = b"BT /F 10 Tf 1 0 0 1 50 700 Tm (Hello) Tj 0 -12 Td (third) Tj ET"


@_query("n int, text string", [(0, "Hello|third"), (1, "Hello|third"), (2, "Hello|third"), (3, "fi-x")])
def pdf_text_layers(spark):
    """The same page plain, deflated and in hexadecimal, and a font with named differences."""
    given = [D.pdf(_PAGE), D.pdf(zlib.compress(_PAGE), filters=b"/Filter/FlateDecode"), D.pdf(_PAGE.hex().encode() + b">", filters=b"/Filter[/ASCIIHexDecode]")]
    given.append(D.pdf(b"BT /F 10 Tf 0 0 Td (ABx) Tj ET", b"/Encoding<</Differences[65/fi/endash]>>"))
    return _each(spark, given, "n int, text string", lambda v: [("|".join(x for b in pdf.pdf_units(v)[0][1] for x in b.lines),)])


@_query("page long, x0 double, top double, text string", [(1, 50.0, -700.0, "Hello (PDF)"), (1, 50.0, -688.0, "world again"), (1, 50.0, -676.0, "third"), (1, 50.0, -616.0, "# far")])
def pdf_lines(spark):
    return pdf.pdf_page_lines(_files(spark, ["r.pdf"])).select(F.col("page").cast("long").alias("page"), "x0", "top", "text")


@_query("page long, table long, row long, col long, text string", [(1, 1, 1, 1, "Name"), (1, 1, 1, 2, "Value"), (1, 1, 2, 1, "a|b"), (1, 1, 2, 2, "1 000"), (1, 1, 3, 1, "c"), (1, 1, 3, 2, "2")])
def pdf_table_cells(spark):
    found = pdf.pdf_table_cells(spark.createDataFrame([(1, bytearray(D.ruled_page()))], "source_id long, content binary"))
    return found.select(*[F.col(c).cast("long").alias(c) for c in ("page", "table", "row", "col")], "text")


@_query("name string, markdown string", [("t.pdf", "Before\n\n| Name | Value |\n| --- | --- |\n| a\\|b | 1 000 |\n| c | 2 |\n\nAfter\nboxed\n")])
def pdf_table_markdown(spark):
    src = with_route(spark.createDataFrame([(1, "t.pdf", bytearray(D.ruled_page()))], "source_id long, name string, content binary"))
    return C.convert(src, body_only=True).select("name", F.regexp_replace("markdown", r"(?s)^.*## Page 1\n\n", "").alias("markdown"))


_FORMULA = "sheet string, row long, col long, value string, formula string"


@_query(_FORMULA, [("S", 1, 2, "1.0", "A1*2"), ("S", 2, 2, "1.0", "A2+$A$1"), ("S", 3, 2, "1.0", "A3+$A$1"), ("S", 4, 2, "1.0", "SUM(S!A1:A3)"), ("S", 5, 2, "1.0", "Total/2"), ("S", 6, 2, "1.0", "")])
def xls_formulas(spark):
    """Plain and shared formulas, one over a sheet's name, one over a defined name, and one that is only marked."""
    src = with_route(spark.createDataFrame([(1, "a.xls", bytearray(D.xls_with_formulas()))], "source_id long, name string, content binary"))
    return workbooks.workbook_cells(src).where("formula is not null").withColumns({c: F.col(c).cast("long") for c in ("row", "col")})


@_query(_FORMULA, [("S", 1, 2, "8.0", "A1*2"), ("S", 1, 3, "4x", 'S!A1&"x"')])
def xlsb_formulas(spark):
    src = with_route(spark.createDataFrame([(1, "a.xlsb", bytearray(D.xlsb_with_formulas()))], "source_id long, name string, content binary"))
    return workbooks.workbook_cells(src).where("formula is not null").withColumns({c: F.col(c).cast("long") for c in ("row", "col")})


@_query("n int, data string", [(0, "abcddd"), (1, "-----A---B"), (2, "Hello"), (3, "unsupported filter")])
def pdf_filters(spark):
    given = [b"\x02abc\xfed\x80", bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01]), b"87cURD]~>", b"x"]
    names = ["RunLengthDecode", "LZWDecode", "ASCII85Decode", "DCTDecode"]

    def data(v):
        try:
            return [(pdf.unfilter(pdf.Stream({"Filter": names[given.index(v)]}, v), lambda x: x).decode(),)]
        except Refusal:
            return [("unsupported filter",)]

    return _each(spark, given, "n int, data string", data)


@_query("n int, text string, encoding string, how string", [(0, "x", "utf-8", "bom"), (1, "é", "utf-8", "utf-8"), (2, '<meta charset="windows-1251">пр', "cp1251", "meta"), (3, "été à la plage", "cp1252", "fallback")])
def html_encodings(spark):
    return _each(spark, [b"\xef\xbb\xbfx", "é".encode(), b'<meta charset="windows-1251">\xef\xf0', b"\xe9t\xe9 \xe0 la plage"], "n int, text string, encoding string, how string", lambda v: [charset.decode_html(v)])


@_query("n int, codec string", [(0, "cp1252"), (1, "gb18030"), (2, "utf-8"), (3, "koi8-r"), (4, None)])
def charset_labels(spark):
    return _each(spark, [" ISO-8859-1 ", "gb2312", "utf-16le", "KOI8-R", "no such"], "n int, codec string", lambda v: [(charset.codec_of(v),)])


# Scanners ---------------------------------------------------------------------------------------------------------------


@_query("n int, place long, target string", [(0, 0, "a.png"), (0, 1, "data:image/png;base64,xx=="), (0, 2, "b.png"), (1, 0, "x.png"), (1, 1, "y.png")])
def srcset_targets(spark):
    return _each(spark, ["a.png 1x, data:image/png;base64,xx== 2x,b.png", " ,x.png,\n y.png 100w", ""], "n int, place long, target string", lambda v: enumerate(S.srcset(v)))


@_query("n int, kind string, target string", [(0, "import", "a.css"), (0, "url", "c d.png"), (0, "url", "g.woff")])
def css_targets(spark):
    return _each(spark, ["/* url(no) */ @import 'a.css'; b{background:url( \"c\\20 d.png\" )} e{content:'url(no)'} f{src:url(g.woff)}"], "n int, kind string, target string", S.css_targets)


@_query("n int, place long, kind string, target string", [(0, 0, "link", "b"), (0, 1, "image", "j.png"), (0, 2, "reference", "/one"), (0, 3, "reference", "/one"), (0, 4, "autolink", "http://auto"), (0, 5, "bare", "http://bare.org/x")])
def markdown_link_targets(spark):
    text = "[a](b) `[no](x)` ![i](j.png) [ref][L] [l] <http://auto> http://bare.org/x.\n```\n[no](y)\n```\n[L]: /one\n[l]: /two\n"
    return _each(spark, [text], "n int, place long, kind string, target string", lambda v: ((i, *x) for i, x in enumerate(S.markdown_links(v))))


_SELF_DESCRIBED = '<title>T</title><meta name=description content="D"><script type="application/ld+json">{"@type":"Article","headline":"H","x":{"@type":"BreadcrumbList","name":"no"}}</script><noscript>D</noscript>'


@_query("n int, place long, text string", [(0, 0, "D"), (0, 1, "H")])
def embedded_texts(spark):
    return _each(spark, [_SELF_DESCRIBED, "<p>x"], "n int, place long, text string", lambda v: enumerate(S.embedded_texts(v)))


@_query("n int, url string", [(0, "https://a.org/d"), (1, None), (2, "https://a.org/b/?q"), (3, "http://b.org/")])
def resolved_urls(spark):
    return _each(spark, ["https://a.org/b/c ../d", "https://a.org javascript:x", "https://a.org/b/ ?q", "https://a.org http://b.org/"], "n int, url string", lambda v: [(S.resolve_url(*v.split(" ")),)])


@_query("n int, part string", [(0, "OPS/c.xhtml"), (1, None), (2, "x y"), (3, "a.xhtml")])
def internal_targets(spark):
    return _each(spark, ["OPS/a/b.xhtml ../c.xhtml#f", "a ../../b", "a /x%20y", "a.xhtml #f"], "n int, part string", lambda v: [(S.resolve_internal(*v.split(" ")),)])


@_query("n int, hidden boolean", [(0, True), (1, False), (2, True), (3, False), (4, True)])
def hidden_styles(spark):
    given = ["display:none", "display:none;display:block", "display:none!important;display:block", "visibility: collapse", "VISIBILITY : Hidden"]
    return _each(spark, given, "n int, hidden boolean", lambda v: [(css_hidden(v),)])


@_query("n int, target_class string", [(0, "missing"), (1, "relative"), (2, "unsupported"), (3, "external"), (4, "data"), (5, "external")])
def target_classes(spark):
    return _each(spark, ["", "/a", "java\nscript:x", "HTTP://x", "data:x", "mailto:a"], "n int, target_class string", lambda v: [(target_class(v),)])


# Pages ------------------------------------------------------------------------------------------------------------------


def _shown(n) -> str:
    if n.tag == TEXT:
        return n.text
    return f"<{n.tag}>" + "".join(map(_shown, n.children)) + ("" if n.tag in ("br", "img") else f"</{n.tag}>")


_TREES = [
    ("<p>one<div>two</div>three", "<p>one</p><div>two</div>three"), ("<table><tr><td>A<td>B</table>", "<table><tbody><tr><td>A</td><td>B</td></tr></tbody></table>"),
    ("<p><b>x<br><p>y</p><p>z", "<p><b>x<br></b></p><p><b>y</b></p><p><b>z</b></p>"), ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"), ("<a>1<p>2<a>3</a>", "<a>1</a><p><a>2</a><a>3</a></p>"),
    ("<table>x<tr><td>y</table>z", "x<table><tbody><tr><td>y</td></tr></tbody></table>z"), ("<ul><li>a<li>b<ul><li>c</ul></ul>", "<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul>"),
    ("<p><i><b>a</i>b</b></p>", "<p><i><b>a</b></i><b>b</b></p>"), ("<script>\"</p>\"</script>y", "y"), ("<h1>a<h2>b", "<h1>a</h1><h2>b</h2>"), ("a &lt; b &amp; c < d", "a < b & c < d"),
]


@_query("n int, tree string", [(i, t) for i, (_, t) in enumerate(_TREES)])
def recovered_trees(spark):
    return _each(spark, [h for h, _ in _TREES], "n int, tree string", lambda v: [("".join(_shown(c) for c in parse(v).children[0].children[1].children),)])


_PAGES = [
    ("<h1>Title</h1><p>Prose</p>", "### Title\n\nProse"), ("<h5>Five</h5>", "**Heading 5: Five**"), ("<p hidden style=''>secret</p><p>x</p>", "x"), ("<p>a<b>b</b> <i>c</i></p>", "a**b** *c*"),
    ("<p><b> x </b>y</p>", "**x** y"), ("<p>see <a href='/x y'>it</a></p>", "see [it](/x%20y)"), ("<p><a href='javascript:x'>it</a></p>", "it"), ("<ul><li>a<li>b</ul>", "- a\n- b"),
    ("<ol start=3><li>a<li value=7>b<li>c</ol>", "3. a\n7. b\n8. c"), ("<ul><li>a<ul><li>b</ul><li>c</ul>", "- a\n  - b\n- c"), ("<ul><li><p>a</p><p>b</p><li>c</ul>", "- a\n\n  b\n\n- c"),
    ("<blockquote><p>q</p><pre>code</pre></blockquote>", "> q\n>\n> ```\n> code\n> ```"), ("<pre>a ``` b</pre>", "````\na ``` b\n````"), ("<table><tr><th>A<th>B<tr><td>1</table>", "| A | B |\n| --- | --- |\n| 1 |  |"),
    ("<table><caption>C</caption><tr><th rowspan=2>K<th colspan=2>V<tr><th>L<th>H</table>", "Caption: C\n\n| K | V |  |\n| --- | --- | --- |\n|  | L | H |"), ("<table><tr><td><p>a</p><p>b</p></table>", "a\n\nb"),
    ("<table><tr><th>x<td><code>&lt;x&gt; |</code></table>", '| x | Code: text="&lt;x> \\|" |\n| --- | --- |'), ("<img alt='A' src='/a.png'>", "![A](/a.png)"), ("<nav>n</nav><p>x</p><footer>f</footer>", "x"),
    ("<header><h1>Kept</h1></header><header>gone</header>", "### Kept"), ("<p># a<br>1. b", "\\# a\n1\\. b"), ("<button>b</button><p>x", "x"), ("<div role='unknown banner'>x</div><p>y", "y"),
    ("<div role=main><nav>in</nav></div><div role=navigation>out</div>", "in"), ("<ul><li>a</ul><ul><li>b</ul>", "- a\n\n* b"), ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"),
    ("<article><p><b>One.<br><p>Two</p><p>Three", "**One.**\n\n**Two**\n\n**Three**"), ("<p>AT&amp;T &amp;copy; snake_case *x* [y] &lt;z> \"q\"", 'AT&T &amp;copy; snake_case \\*x\\* \\[y\\] &lt;z> "q"'),
]


@_query("n int, markdown string", [(i, m) for i, (_, m) in enumerate(_PAGES)])
def page_markdown(spark):
    return _each(spark, [h for h, _ in _PAGES], "n int, markdown string", lambda v: [(body_markdown(render_html(v)).rstrip("\n"),)])


@_query("n int, markdown string, fallback boolean", [(0, "B", False), (1, "A\n\nin", False), (2, "x", True)])
def article_markdown(spark):
    def one(v):
        found = render_html(v, article=True)
        return [(body_markdown(found).rstrip("\n"), found.tally.article_fallback)]

    return _each(spark, ["<article>A</article><main><article>B</article></main>", "<nav>n</nav><article>A<nav>in</nav></article><p>out", "<p>x"], "n int, markdown string, fallback boolean", one)


@_query("n int, roots string", [(0, "main"), (1, "main"), (2, "article,article")])
def article_choice(spark):
    given = ["<main><p>x</p><article>B</article></main>", "<main><p>x</main><p>y", "<article>1</article><article>2</article>"]
    return _each(spark, given, "n int, roots string", lambda v: [(",".join(r.tag for r in article_roots(parse(v).children[0].children[1])),)])


@_query("n int, height long, width long, cells string, layout boolean", [(0, 2, 3, "0:0:2x1 0:1:1x2 1:1:1x1 1:2:1x1", False), (1, 1, 1, "0:0:1x1", True), (2, 2, 2, "0:0:1x1 0:1:1x1 1:0:1x1", False)])
def table_grids(spark):
    def grid(v):
        table = next(n for n in parse(v).walk() if n.tag == "table")
        height, width, cells = table_layout(table)
        return [(height, width, " ".join(f"{r}:{c}:{d}x{a}" for _, r, c, d, a in cells), is_layout(table))]

    given = ["<table><tr><th rowspan=2>K<th colspan=2>V<tr><th>L<th>H</table>", "<table><tr><td><p>a</p><p>b</p></table>", "<table><tr><td>1<td>2<tr><td>3</table>"]
    return _each(spark, given, "n int, height long, width long, cells string, layout boolean", grid)


@_query("n int, refusal string", [(0, 'HTML depth limit exceeded: 256'), (1, 'HTML table cells limit exceeded: 100000'), (2, 'HTML attribute byte limit exceeded: 1048576')])
def refused_pages(spark):
    def refusal(v):
        try:
            render_html(v)
        except Refusal as r:
            yield (str(r),)

    given = ["<div>" * 300, "<table><tr><th colspan=99999>a<tr><th rowspan=9>b</table>", f"<p title='{'x' * (1 << 20)}y'>", "<p>fine"]
    return _each(spark, given, "n int, refusal string", refusal)


_ESCAPES = [("_lead trail_ a_b 1_2 __init__", "\\_lead trail\\_ a_b 1_2 \\_\\_init\\_\\_"), ("&amp; &#45; &a_1; &; &#;", "&amp;amp; &amp;#45; &amp;a_1; &; &#;"), ("a*b [c] <d>", "a\\*b \\[c\\] &lt;d>")]
_STARTS = [("# T", "\\# T"), ("> q", "\\> q"), ("1. one", "1\\. one"), ("2) two", "2\\) two"), ("===", "\\==="), ("~~~ x", "\\~~~ x"), (":-- | --:", "\\:-- | --:"), ("1.5 kg", "1.5 kg"), (":-) smile", ":-) smile"), ("a - b # c", "a - b # c")]


@_query("n int, escaped string", [(i, m) for i, (_, m) in enumerate(_ESCAPES)])
def escaped_text(spark):
    return _each(spark, [t for t, _ in _ESCAPES], "n int, escaped string", lambda v: [(M.escape(v),)])


@_query("n int, escaped string", [(i, m) for i, (_, m) in enumerate(_STARTS)])
def escaped_starts(spark):
    return _each(spark, [t for t, _ in _STARTS], "n int, escaped string", lambda v: [(M.escape_line_start(v),)])


@_query("n int, fenced string", [(0, "```\na\n```"), (1, "````\na ``` b\n````"), (2, "`````\n````\n`````")])
def fences(spark):
    return _each(spark, ["a", "a ``` b", "````"], "n int, fenced string", lambda v: [("\n".join(M.fence(v.split("\n"))),)])


@_query("n int, target string", [(0, '/x%20y'), (1, 'a%28b%29c'), (2, 'http://%C3%A4.org/%3Cx%3E'), (3, 'a%0Ab'), (4, 'plain')])
def link_targets(spark):
    return _each(spark, ["/x y", "a(b)c", "http://ä.org/<x>", "a\nb", "plain"], "n int, target string", lambda v: [(M.target(v),)])


@_query("n int, row long, line string", [(0, 0, "| a | b |"), (0, 1, "| --- | --- |"), (0, 2, "| c |  |")])
def table_lines(spark):
    return _each(spark, ["a,b;c"], "n int, row long, line string", lambda v: enumerate(M.table([r.split(",") for r in v.split(";")])))


# Geometry ---------------------------------------------------------------------------------------------------------------

_BOX = "page long, id long, x0 double, x1 double, top double, bottom double"


@_query("page long, a_id long, b_id long", [(1, 1, 7)])
def overlapping_boxes(spark):
    a = spark.createDataFrame([(1, 1, 0.0, 100.0, 0.0, 100.0), (1, 2, 500.0, 510.0, 0.0, 9.0)], _BOX)
    b = spark.createDataFrame([(1, 7, 90.0, 300.0, 90.0, 300.0), (1, 8, 510.0, 520.0, 0.0, 9.0), (2, 9, 0.0, 9.0, 0.0, 9.0)], _BOX)
    return G.overlapping(a, b, ["page"])


@_query("page long, x double, snapped double", [(1, 1.0, 1.5), (1, 2.0, 1.5), (1, 10.0, 10.0), (2, 2.0, 2.0)])
def snapped_places(spark):
    return G.snapped(spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 10.0), (2, 2.0)], "page long, x double"), ["page"], "x")


@_query("page long, start double, lines long", [(1, 10.0, 3)])
def column_starts(spark):
    words = spark.createDataFrame([(1, 10.0, 1), (1, 11.0, 2), (1, 12.0, 3), (1, 90.0, 1)], "page long, x double, line long")
    return G.column_starts(words, ["page"], "x", "line")


@_query("line long, tabular boolean", [(1, True), (2, False), (3, True)])
def tabular_lines(spark):
    gaps = spark.createDataFrame([(1, 5.0, 1.0), (1, 6.0, 1.0), (2, 5.0, 1.0), (2, 1.0, 1.0), (3, 10.0, 4.0), (3, 11.0, 4.0), (3, 9.0, 4.0)], "line long, gap double, unit double")
    return G.tabular_lines(gaps, ["line"], "gap", "unit")


@_query("band long, is_table boolean", [(1, True), (2, False)])
def ruled_bands(spark):
    return G.ruled_bands(spark.createDataFrame([(1, 3), (1, 1), (1, 1), (2, 3), (2, 1), (2, 1), (2, 0)], "band long, filled int"), ["band"], "filled")


@_query("page long, id long, component long", [(1, 2, 2), (1, 3, 2), (1, 4, 2), (1, 5, 5), (2, 8, 8), (2, 9, 8)])
def touching_segments(spark):
    edges = spark.createDataFrame([(1, 3, 2), (1, 4, 3), (2, 8, 9)], "page long, a long, b long")
    return G.touching(edges, spark.createDataFrame([(1, 2), (1, 3), (1, 4), (1, 5), (2, 8), (2, 9)], "page long, id long"), ["page"])


@_query("text string, numeric boolean", [("1,234.5", True), ("(12)", True), ("$ 5 %", True), ("a1", False), ("", False), ("-3", True)])
def numeric_cells(spark):
    return spark.createDataFrame([("1,234.5",), ("(12)",), ("$ 5 %",), ("a1",), ("",), ("-3",)], "text string").select("text", G.numeric_text(F.col("text")).alias("numeric"))


@_query("page long, line long, band long", [(1, 1, 0), (1, 2, 0), (1, 3, 0), (1, 4, 1)])
def line_bands(spark):
    lines = spark.createDataFrame([(1, 1, 0.0, 10.0), (1, 2, 12.0, 22.0), (1, 3, 24.0, 34.0), (1, 4, 90.0, 100.0)], "page long, line long, top double, bottom double")
    return L.bands(lines, ["page"], "top", "bottom").select("page", "line", F.col("band").cast("long").alias("band"))


# Inspection -------------------------------------------------------------------------------------------------------------


@_query(
    "name string, capability string, kind string, location string, target string, text string",
    [
        ('c.xlsx', 'formulas', 'formula', 'Data!E7', None, 'D7+$A$1'),
        ('c.xlsx', 'formulas', 'formula', 'Data!E8', None, 'D8+$A$1'),
        ('c.xlsx', 'formulas', 'formula', 'Data!F5', None, '1/0'),
        ('c.xlsx', 'hidden_content', 'hidden-sheet-cell', 'Far!C5', None, '1.0'),
        ('c.xlsx', 'hidden_content', 'hidden-sheet-cell', 'Far!XFD1048576', None, '2.0'),
        ('h.eml', 'attachments', 'text/plain', 'mime/1.2', None, 'a.txt'),
        ('m.docx', 'problem', 'refused', None, None, 'package unreadable: File is not a zip file'),
        ('t.md', 'links', 'image', 'text', 'd.png', None),
        ('t.md', 'links', 'link', 'text', 'b', None),
        ('v.html', 'active_content', 'event-handler', 'html/body/img@onclick', None, 'go()'),
        ('v.html', 'active_content', 'script', 'html/body/script', None, 's'),
        ('v.html', 'comments', 'comment', 'html/-comment', None, 'c'),
        ('v.html', 'embedded_documents', 'data-url', 'html/body/img@src', None, 'text/plain'),
        ('v.html', 'hidden_content', 'p', 'html/body/p', None, None),
        ('v.html', 'images', 'data', 'html/body/img@src', 'data:text/plain,hi', None),
        ('v.html', 'links', 'relative', 'html/body/a@href', '/y', None),
    ],
)
def file_findings(spark):
    return _named(spark, I.findings(_files(spark, ["c.xlsx", "h.eml", "m.docx", "o", "t.md", "v.html"])))


@_query(
    "name string, status string, capabilities long",
    [
        ('c.xlsx', 'complete', 14),
        ('h.eml', 'complete', 14),
        ('m.docx', 'unavailable', 14),
        ('o', 'not_applicable', 14),
        ('t.md', 'complete', 14),
        ('v.html', 'complete', 14),
    ],
)
def file_coverage(spark):
    src = _files(spark, ["c.xlsx", "h.eml", "m.docx", "o", "t.md", "v.html"])
    return _named(spark, I.coverage(src, I.findings(src))).groupBy("name", "status").agg(F.count(F.lit(1)).alias("capabilities"))


@_query(
    "name string, report string",
    [
        ('m.docx', '{"byte_size":6,"complete":0,"findings":[{"seq":1,"capability":"problem","kind":"refused","text":"package unreadable: File is not a zip file"}],"n_findings":1,"name":"m.docx","not_applicable":0,"partial":0,"sha256":"0a85e2768edd3fa10386bf53cf917b0e1ad30e662cd87966d51fef5ca10ed42d","unavailable":14}'),
        ('t.md', '{"byte_size":18,"complete":14,"findings":[{"seq":1,"capability":"links","kind":"link","location":"text","target":"b"},{"seq":2,"capability":"links","kind":"image","location":"text","target":"d.png"}],"n_findings":2,"name":"t.md","not_applicable":0,"partial":0,"sha256":"980742d34e9b820518097447d881540b82938b2fadddbeecba52040c019dd5b9","unavailable":0}'),
    ],
)
def file_reports(spark):
    return _named(spark, I.reports(_files(spark, ["m.docx", "t.md"])))


@_query("name string, report string", [('t.md', '## Links\n\n- link b\n- image d.png')])
def report_sections(spark):
    return _named(spark, I.report_markdown(I.findings(_files(spark, ["t.md"]))))


_CHECKED = [
    ("<title>Just a moment...</title><script src=/cdn-cgi/cf-chl></script>", "cloudflare"), ("<p>captcha-delivery.com</p>", "datadome"), ("<form><input type=\"password\"></form>", "login"),
    ("<script>app()</script>", "shell"), ("<p>" + "words and more " * 40 + "hcaptcha.com</p>", "content"), ("<p>hcaptcha.com</p>", "hcaptcha"), ("<p>" + "plain prose of a page " * 3 + "</p>", "content"),
]


@_query("n int, page_class string", [(i, c) for i, (_, c) in enumerate(_CHECKED)])
def checked_pages(spark):
    """What a page is in place of content; each rule decides for one page."""
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(_CHECKED)], "n int, html string")
    title, visible = F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.length(F.regexp_replace(F.regexp_replace("html", "<script.*?</script>", ""), "<[^>]*>", ""))
    return df.select("n", F.coalesce(U.page_check(F.col("html"), title, visible), F.lit("content")).alias("page_class"))


@_query("ip string, public boolean", [("8.8.8.8", True), ("10.1.2.3", False), ("2001:4860:4860::8888", True), ("2001:db8::1", False), ("2002:7f00:1::", False), ("::1", False), ("fe80::1%eth0", False), ("3fff:1::", False), ("3ffe::1", True), ("no", False)])
def public_addresses_of_both_kinds(spark):
    given = ["8.8.8.8", "10.1.2.3", "2001:4860:4860::8888", "2001:db8::1", "2002:7f00:1::", "::1", "fe80::1%eth0", "3fff:1::", "3ffe::1", "no"]
    return spark.createDataFrame([(x,) for x in given], "ip string").select("ip", U.is_public(F.col("ip")).alias("public"))


def _native(kind: int, payload: bytes, tail: bytes = b"") -> bytes:
    body = b"\x02\x00a.txt\0C:\\a.txt\0" + bytes(2) + kind.to_bytes(2, "little") + (3).to_bytes(4, "little") + b"t.x"
    body += (len(payload).to_bytes(4, "little") + payload if kind == 3 else b"") + tail
    return len(body).to_bytes(4, "little") + body


_WIDE = b"".join(len(x).to_bytes(4, "little") + x.encode("utf-16-le") for x in ("t", "ä.txt", "C:\\ä.txt"))


@_query(
    "path string, status string, label string, source_path string, reason string, text string",
    [
        ("A\x01Ole10Native", "embedded", "a.txt", "C:\\a.txt", None, "hello"), ("B\x01Ole10Native", "linked", "a.txt", "C:\\a.txt", None, None), ("C\x01Ole10Native", "embedded", "ä.txt", "C:\\ä.txt", None, "hello"),
        ("D\x01Ole10Native", "embedded", None, None, None, "plain"), ("E\x01Ole10Native", "invalid", None, None, "size differs from the stream's", None), ("F\x01Ole10Native", "unsupported", "a.txt", "C:\\a.txt", "package object of kind 2", None),
    ],
)
def native_payloads(spark):
    """Packages embedded, linked and with names in Unicode, plain data, and what is refused."""
    streams = {"A": _native(3, b"hello"), "B": _native(1, b""), "C": _native(3, b"hello", _WIDE), "D": b"\x05\0\0\0plain", "E": b"\x09\0\0\0x", "F": _native(2, b"")}
    files = [D.compound({f"{k}{ole_native.STREAM}": streams[k] for k in group}) for group in ("ABC", "DEF")]
    found = ole_native.native_payloads(compound.compound_entries(spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate(files)], "source_id long, content binary")))
    return found.withColumn("text", F.col("payload").cast("string"))


_MARKED = "<p>é</p>\n<a href=/x HREF='/y'\n title=\"t&amp;u\">k</a><!-- <b> --><script a>'<i>'</script><br/>"


@_query(
    "tag_no int, tag string, attribute string, nth int, value string, char_start long, char_end long, byte_start long, byte_end long, line long, column long",
    [
        (1, "p", None, None, None, 0, 3, 0, 3, 1, 1), (2, "a", None, None, None, 9, 47, 10, 48, 2, 1), (2, "a", "href", 1, "/x", 12, 19, 13, 20, 2, 4), (2, "a", "href", 2, "/y", 20, 29, 21, 30, 2, 12),
        (2, "a", "title", 1, "t&u", 31, 46, 32, 47, 3, 2), (3, "script", None, None, None, 64, 74, 65, 75, 3, 35), (3, "script", "a", 1, None, 72, 73, 73, 74, 3, 43), (4, "br", None, None, None, 88, 93, 89, 94, 3, 59),
    ],
)
def html_locations(spark):
    return H.html_locations(spark.createDataFrame([(1, _MARKED)], "page_id long, html string"))


@_query("page long, gutter double", [(1, 105.0)])
def prose_gutters(spark):
    """Two columns of prose, a band of numbers, and line numbers before prose."""
    rows = [(1, n, 10.0, 100.0 - n % 2, "words") for n in range(4)] + [(1, n, 110.0, 190.0, "prose") for n in range(4)]
    rows += [(2, n, 10.0, 40.0, "12") for n in range(4)] + [(2, n, 110.0, 190.0, "34") for n in range(4)]
    rows += [(3, n, 10.0, 14.0, str(n)) for n in range(4)] + [(3, n, 30.0, 190.0, "a line of the text that goes on") for n in range(4)]
    return G.prose_gutters(spark.createDataFrame(rows, "page long, line long, x0 double, x1 double, text string"), ["page"], 200.0)


@_query("page long, id long, place int", [(1, 1, 0), (1, 3, 1), (1, 4, 2), (1, 2, 3), (1, 5, 4), (1, 6, 5), (2, 7, 0)])
def reading_order(spark):
    """A heading over two columns of two and one boxes, and a footer in two overlapping boxes."""
    rows = [(1, 1, 0.0, 100.0, 0.0, 10.0), (1, 2, 55.0, 100.0, 20.0, 60.0), (1, 3, 0.0, 45.0, 20.0, 38.0), (1, 4, 0.0, 45.0, 40.0, 60.0), (1, 5, 0.0, 80.0, 70.0, 90.0), (1, 6, 60.0, 100.0, 75.0, 95.0), (2, 7, 0.0, 9.0, 0.0, 9.0)]
    return G.reading_order(spark.createDataFrame(rows, _BOX), ["page"])


@_query("page long, id long, caption string", [(1, 1, "Table 1. First"), (1, 2, "Table 2. Second")])
def table_captions(spark):
    tables = spark.createDataFrame([(1, 1, 0.0, 100.0, 30.0, 60.0), (1, 2, 0.0, 100.0, 90.0, 120.0), (2, 3, 0.0, 100.0, 90.0, 120.0)], _BOX)
    lines = [(1, 1, 0.0, 50.0, 15.0, 25.0, "Table 1. First"), (1, 2, 0.0, 50.0, 75.0, 85.0, "Table 2. Second"), (1, 3, 0.0, 50.0, 62.0, 70.0, "Tables are listed here"), (2, 4, 0.0, 50.0, 10.0, 20.0, "Table 3. Too far"), (2, 5, 200.0, 250.0, 80.0, 88.0, "Table 4. Beside")]
    return G.captions(tables, spark.createDataFrame(lines, "page long, line long, x0 double, x1 double, top double, bottom double, text string"), ["page"])


@_query("source_id long, ordinal int, sheet string", [(1, 1, "A"), (1, 3, "B"), (1, 4, "C"), (1, 5, "D"), (2, 1, "X")])
def sheet_union(spark):
    layout = "source_id long, ordinal int, sheet string"
    native = spark.createDataFrame([(1, 1, "A"), (1, 3, "B")], layout)
    return workbooks.sheet_union(native, spark.createDataFrame([(1, 1, "B"), (1, 2, "C"), (1, 3, "A"), (1, 4, "D"), (2, 1, "X")], layout))

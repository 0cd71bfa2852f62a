import json
import os

import pytest
from pyspark.sql import functions as F

from foliant.functions.html_markdown import Refusal
from foliant.operators import grid as G
from foliant.plans import convert as C
from foliant.selfcheck import self_check
from foliant.sources import charset, compound, packages, sinks, workbooks
from foliant.sources.files import scan
from foliant.streaming import files as stream
from foliant.sources import synthetic as D

FILES = {
    "a.docx": D.docx(), "b.pptx": D.pptx(), "c.xlsx": D.xlsx(), "d.odt": D.odt(), "e.odp": D.odp(), "f.ods": D.ods(), "g.epub": D.epub(), "h.eml": D.EML,
    "i.HTML": b"<title>T</title><h1>H</h1>", "j.txt": "päss".encode(), "k.csv": b"a,b", "l.txt": b"\xff", "m.docx": b"no zip", "n.xls": D.compound({"Workbook": b"x"}), "o": b"x",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("in")
    for name, data in FILES.items():
        (path / name).write_bytes(data)
    return str(path)


@pytest.fixture(scope="module")
def converted(spark, folder):
    return {r.name: r for r in C.convert(scan(spark, folder), body_only=True).collect()}


def body(converted, name):
    return converted[name].markdown


def test_every_file_has_a_row(converted):
    assert set(converted) == set(FILES)
    refused = {n for n, r in converted.items() if not r.file_ok}
    assert refused == {"k.csv", "l.txt", "m.docx", "n.xls", "o"}
    assert converted["k.csv"].reason == "unsupported suffix: .csv" and "package unreadable" in converted["m.docx"].reason
    r = json.loads(converted["c.xlsx"].receipt)
    assert list(r) == sorted(r) and r["unit_keys"] == ["sheet/000001", "sheet/000002"] and r["byte_size"] == len(FILES["c.xlsx"])


def test_docx(converted):
    text = body(converted, "a.docx")
    assert '## Chapter 1: "Body"\n\nBefore' in text and '## Chapter 2: "Start \\*here\\*"\n\n### Start \\*here\\*\n\nOne - two\nthree' in text
    assert text.endswith("| A |  |\n| --- | --- |\n| B\\| | C |\n")


def test_pptx_follows_declared_order(converted):
    text = body(converted, "b.pptx")
    assert text.index('Slide 1: "First"') < text.index("### First") < text.index('Slide 2: "Second"')


def test_xlsx_grid(converted):
    text = body(converted, "c.xlsx")
    assert "Source range: C5:F8" in text and "| 5 | C5: offset | D5: #DIV/0! | E5: [blank] | F5: [missing cached result] |" in text
    assert "| 6 |  |  |  |  |" in text and "D7: 42.0" in text and "F8: rich" in text
    assert "| Row | C | XFD |" in text


def test_workbook_cells_and_formulas(spark, folder):
    cells = workbooks.workbook_cells(scan(spark, folder).where("route = 'sheet'"))
    got = {(r.sheet, r.address): (r.value_type, r.value, r.formula) for r in cells.collect()}
    assert got["Data", "E8"] == ("number", "2.0", "D8+$A$1") and got["S", "B2"] == ("number", "3.0", None)
    assert len([k for k in got if k[0] == "S"]) == 4
    r = {x.sheet: x.range for x in G.occupied_range(cells.select("sheet", "row", "col"), ["sheet"]).collect()}
    assert r == {"Data": "C5:F8", "Far": "C5:XFD1048576", "S": "A1:B2"}


def test_odf_epub_mail_text(converted):
    assert "### Top\n\na  b\nc\n\n- i" in body(converted, "d.odt") or "### Top\n\na b\nc\n\n- i" in body(converted, "d.odt")
    assert 'Slide 1: "Name"' in body(converted, "e.odp")
    text = body(converted, "g.epub")
    assert text.index('Chapter 1: "The second"') < text.index("text B") < text.index('Chapter 2: "A"') < text.index("text A")
    mail = body(converted, "h.eml")
    assert "From: Jörg &lt;j@example.org>" in mail and "```\ncafé *x*\n```" in mail and "Attachment: a.txt" in mail and "html" not in mail.split("## ")[1][20:]
    assert body(converted, "j.txt") == "päss" and "### H" in body(converted, "i.HTML")


def test_envelope_and_report(spark, folder):
    rows = C.convert(scan(spark, folder, "*.docx")).where("file_ok")
    text = rows.first().markdown
    assert text.startswith('# "a.docx"\n') and "| Route | docx |" in text and "- [Chapter 1: \"Body\"](#unit-chapter-000001)" in text
    both = C.with_report(rows.withColumn("report", F.lit("findings"))).select("markdown", C.readable_part(F.col("markdown")).alias("back")).first()
    assert both.back == text and both.markdown.endswith("findings")


def test_sheet_selection(spark, folder):
    one = C.convert(scan(spark, folder, "*.xlsx"), body_only=True, sheets=["Far", "Data"]).first()
    assert one.markdown.index('"Far"') < one.markdown.index('"Data"')
    assert not C.convert(scan(spark, folder, "*.xlsx"), sheets=["far"]).first().file_ok


def test_members_and_relationships(spark, folder):
    src = scan(spark, folder, "*.pptx")
    assert {r.part for r in packages.members(src).collect()} >= {"ppt/presentation.xml", "ppt/slides/s1.xml"}
    assert {(r.rid, r.resolved) for r in packages.relationships(src).collect()} == {("r1", "ppt/presentation.xml"), ("a", "ppt/slides/s1.xml"), ("b", "ppt/slides/s2.xml")}
    assert packages.resolve_part("a/b.xml", "../../x") is None and packages.resolve_part("a/b.xml", "../c/d.xml#f") == "c/d.xml"
    with pytest.raises(Refusal, match="document type"):
        packages.admit_xml(b'<!DOCTYPE x [<!ENTITY a "b">]><x/>', "p")


def test_compound_and_vba(spark):
    streams = {"A": b"short", "B": b"y" * 300, "C": b""}
    df = spark.createDataFrame([(1, bytearray(D.compound(streams))), (2, bytearray(b"none"))], "source_id long, content binary")
    got = compound.compound_entries(df).collect()
    assert {r.path: bytes(r.content) for r in got if r.kind == "stream"} == streams
    assert [r.reason for r in got if r.source_id == 2] == ["compound file header missing"]
    assert compound.decompress_vba(b"\x01\x03\xb0\x02aE\x00") == b"a" * 73
    with pytest.raises(Refusal):
        compound.decompress_vba(b"\x02abc")
    assert compound.data_url("data:text/plain;base64,aGk=") == ("text/plain", b"hi") and compound.data_url("data:,a%20b")[1] == b"a b"
    assert compound.data_url("data:;base64,@@") is None and compound.data_url("http://x") is None


def test_charsets():
    assert charset.decode_html(b"\xef\xbb\xbfx")[1:] == ("utf-8", "bom") and charset.decode_html("é".encode())[1:] == ("utf-8", "utf-8")
    assert charset.decode_html(b'<meta charset="windows-1251">\xef\xf0')[0].endswith("пр")
    assert charset.decode_html(b"\xe9t\xe9 \xe0 la plage")[0] == "été à la plage"


def test_nested_documents(spark):
    inner = D.zipped({"x.txt": "deep", "y.bin": "no"})
    outer = D.zipped({"in.zip": inner, "a.html": "<p>x"})
    df = spark.createDataFrame([(1, "o.zip", bytearray(outer)), (2, "m.eml", bytearray(D.EML))], "source_id long, name string, content binary")
    got = {(r.source_id, r.depth, r.name) for r in C.nested_documents(df).collect()}
    assert got == {(1, 0, "o.zip"), (2, 0, "m.eml"), (1, 1, "in.zip"), (1, 1, "a.html"), (1, 2, "x.txt"), (2, 1, "a.txt")}


def test_documents_below_the_deepest_level_are_named(spark):
    data = D.zipped({"x.txt": "deep"})
    for n in range(19):
        data = D.zipped({f"{n}.zip": data})
    df = spark.createDataFrame([(1, "o.zip", bytearray(data))], "source_id long, name string, content binary")
    got = C.nested_documents(df).collect()
    assert sorted(r.depth for r in got) == list(range(18)) and all((r.reason is None) == (r.depth <= 16) == (r.content is not None) for r in got)
    assert {r.reason for r in got if r.depth == 17} == {"nested deeper than 16 levels"}


def test_damaged_vba_is_refused():
    with pytest.raises(Refusal, match="cut short"):
        compound.decompress_vba(b"\x01\x05\xb0\x02aE\x00")
    with pytest.raises(Refusal, match="expands past 70 bytes"):
        compound.decompress_vba(b"\x01\x03\xb0\x02aE\x00", 70)


def test_stream_converts_what_arrives(spark, folder, tmp_path):
    q = stream.convert_stream(spark, folder, str(tmp_path / "out"), str(tmp_path / "cp"), "*.{docx,eml}")
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("name", "file_ok").collect()
    assert {(r.name, r.file_ok) for r in got} == {("a.docx", True), ("m.docx", False), ("h.eml", True)}


def test_stream_windows(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(str(tmp_path / "ev"))
    ev = spark.readStream.schema(spark.read.parquet(str(tmp_path / "ev")).schema).parquet(str(tmp_path / "ev"))
    q = stream.event_counts(ev).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(n) from counts").first()[0] == 1000


def test_sinks(spark, folder, tmp_path):
    sinks.write_tables(C.convert(scan(spark, folder, "*.{odt,odp}")), str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t/receipts")).count() == 2
    sinks.write_files({str(tmp_path / "a"): b"1", str(tmp_path / "b"): b"2"})
    assert sorted(os.listdir(tmp_path)) == ["a", "b", "t"]
    for bad in ({str(tmp_path / "x"): b"", str(tmp_path / "X"): b""}, {str(tmp_path): b""}):
        with pytest.raises(ValueError):
            sinks.write_files(bad)
    names = spark.createDataFrame([("a.md",), ("A.md",), ("b",)], "name string")
    assert [r.target for r in sinks.colliding_names(names).collect()] == ["a.md"]


def test_determinism_under_partitions(spark, folder):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted((r.name, r.body_sha256 or "") for r in C.convert(scan(spark, folder)).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert found[0] == found[1]


def test_self_check(spark):
    assert self_check(spark) == []

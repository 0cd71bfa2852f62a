"""Self-check: a small document of every route, converted twice under different partitions, with known content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.routing import with_route
from foliant.plans.convert import convert
from foliant.sources import synthetic as S

#: Document, its bytes, and a text that its Markdown holds.
EXPECTED = (
    ("a.html", b"<title>T</title><h1>H</h1><p>x <b>y</b></p>", "### H\n\nx **y**"),
    ("b.txt", "päss".encode(), "päss"),
    ("c.eml", S.EML, "```\ncafé *x*\n```"),
    ("d.docx", S.docx(), "### Start \\*here\\*"),
    ("e.pptx", S.pptx(), 'Slide 1: "First"'),
    ("f.xlsx", S.xlsx(), "| 5 | C5: offset | D5: #DIV/0! | E5: [blank] | F5: [missing cached result] |"),
    ("g.ods", S.ods(), "B2: 3.0"),
    ("h.odt", S.odt(), "### Top"),
    ("i.odp", S.odp(), 'Slide 1: "Name"'),
    ("j.epub", S.epub(), 'Chapter 1: "The second"'),
)


def sources(spark: SparkSession) -> DataFrame:
    rows = [(i, name, bytearray(data)) for i, (name, data, _) in enumerate(EXPECTED)]
    return with_route(spark.createDataFrame(rows, "source_id long, name string, content binary"))


def self_check(spark: SparkSession) -> list[str]:
    """What is wrong, a line each; empty if all is well."""
    wrong: list[str] = []
    found = {r.name: r for r in convert(sources(spark), body_only=True).collect()}
    for name, _, text in EXPECTED:
        row = found.get(name)
        if row is None or not row.file_ok:
            wrong.append(f"{name}: {row.reason if row else 'no row'}")
        elif text not in row.markdown:
            wrong.append(f"{name}: expected text missing")
    again = convert(sources(spark).repartition(3, F.col("name")), body_only=True).select("name", "body_sha256").collect()
    wrong += [f"{r.name}: differs when converted again" for r in again if r.body_sha256 != found[r.name].body_sha256]
    return wrong

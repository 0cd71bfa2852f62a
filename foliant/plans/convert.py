"""Sources to units, Markdown and receipts: one crossing to Python per document, then a DataFrame plan.

Refusals are rows: a source without a route, or one that breaks a limit, has ``file_ok`` false and its reason.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions import text as X
from foliant.functions.arrow import map_rows
from foliant.functions.html_markdown import Refusal, block_lines, render_html
from foliant.session import cut_lineage
from foliant.sources import mail, office, pdf, workbooks
from foliant.sources.charset import decode_html
from foliant.sources.mail import mime_parts
from foliant.sources.packages import members

SCHEMA = "foliant.markdown/1"
UNITS = T.StructType(
    [
        T.StructField("source_id", T.LongType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("label", T.StringType()),
        T.StructField("blocks", T.IntegerType()),
        T.StructField("tables", T.IntegerType()),
        T.StructField("markdown", T.StringType()),
        T.StructField("reason", T.StringType()),
    ]
)


def _html(raw: bytes, suffix: str, article: bool, links: bool) -> list:
    found = render_html(decode_html(raw)[0], article, links)
    return [(found.title, found.blocks)]


_READERS = {
    "html": _html,
    "eml": lambda raw, *_: mail.eml_units(raw),
    "docx": lambda raw, *_: office.docx_units(raw),
    "pptx": lambda raw, *_: office.pptx_units(raw),
    "odt": lambda raw, *_: office.odt_units(raw),
    "odp": lambda raw, *_: office.odp_units(raw),
    "epub": lambda raw, *_: office.epub_units(raw),
    "pdf": lambda raw, *_: pdf.pdf_units(raw),
    "sheet": lambda raw, suffix, *_: workbooks.workbook_units(raw, suffix),
}


def units(sources: DataFrame, article: bool = False, links: bool = True, sheets: list[str] | None = None) -> DataFrame:
    """Units of each routed source in order; a refused one has a single row with its reason.

    ``sheets`` selects workbook sheets by exact name, in the given order; unknown and repeated names are refused.
    """

    def rows(source_id: int, route: str | None, suffix: str, content: bytes | None):
        try:
            reader = _READERS.get(route or "")
            if reader is None:
                raise Refusal(f"unsupported suffix: {suffix or 'none'}" if route is None else f"route not available: {route}")
            try:
                found = reader(content or b"", suffix, article, links)
            except Refusal:
                raise
            except (ValueError, KeyError, IndexError, OSError, OverflowError, RecursionError, LookupError, EOFError, TypeError, AttributeError, struct.error) as exc:
                raise Refusal(f"{route} unreadable: {exc}") from exc
            if sheets is not None and route == "sheet":
                names = [label for label, _ in found]
                if len(set(sheets)) < len(sheets) or any(s not in names for s in sheets):
                    raise Refusal("sheet selection refused")
                found = [found[names.index(s)] for s in sheets]
        except Refusal as refusal:
            yield source_id, None, None, None, None, None, str(refusal)
            return
        if not found:
            yield source_id, None, None, 0, 0, None, None
        for i, (label, blocks) in enumerate(found, 1):
            yield source_id, i, label, len(blocks), sum(b.kind == "table" for b in blocks), "\n".join(block_lines(blocks)), None

    return map_rows(sources.where(F.coalesce("route", F.lit("")) != "text").select("source_id", "route", "suffix", "content"), UNITS, rows, most=256)


def bodies(sources: DataFrame, unit_rows: DataFrame) -> DataFrame:
    """(source_id, file_ok, reason, units, tables, unit_keys, body): units under their anchors and headings, text sources as they are."""
    kinds = sources.select("source_id", "unit_kind")
    u = unit_rows.join(kinds, "source_id")
    head = F.concat(
        F.lit('<a id="'), X.unit_anchor(F.col("unit_kind"), F.col("ordinal")), F.lit('"></a>\n## '), X.unit_heading(F.col("unit_kind"), F.col("ordinal"), F.col("label")), F.lit("\n\n")
    )
    part = F.when(F.col("ordinal").isNotNull(), F.struct("ordinal", F.concat(head, F.col("markdown")).alias("t"), X.unit_key(F.col("unit_kind"), F.col("ordinal")).alias("k"), "unit_kind", "label"))
    found = u.groupBy("source_id").agg(
        F.max("reason").alias("reason"), F.sum("tables").alias("tables"), F.array_sort(F.collect_list(part)).alias("_u")
    )
    text = F.array_join(F.transform("_u", lambda x: x["t"]), "\n\n")
    entry = lambda x: F.concat(F.lit("- ["), X.unit_heading(x["unit_kind"], x["ordinal"], x["label"]), F.lit("](#"), X.unit_anchor(x["unit_kind"], x["ordinal"]), F.lit(")"))
    converted = found.select(
        "source_id",
        F.col("reason").isNull().alias("file_ok"),
        "reason",
        F.when(F.col("reason").isNull(), F.size("_u")).cast("long").alias("units"),
        F.col("tables").cast("long").alias("tables"),
        F.transform("_u", lambda x: x["k"]).alias("unit_keys"),
        F.array_join(F.transform("_u", entry), "\n").alias("contents"),
        F.when(F.col("reason").isNull(), F.concat(F.regexp_replace(text, r"\n+\z", ""), F.lit("\n"))).alias("body"),
    )
    plain = sources.where("route = 'text'").select("source_id", F.is_valid_utf8(F.col("content").cast("string")).alias("file_ok"), "content")
    passed = plain.select(
        "source_id",
        "file_ok",
        F.when(~F.col("file_ok"), "text is not UTF-8").alias("reason"),
        F.lit(0).cast("long").alias("units"),
        F.lit(0).cast("long").alias("tables"),
        F.array().cast("array<string>").alias("unit_keys"),
        F.lit("").alias("contents"),
        F.when(F.col("file_ok"), F.col("content").cast("string")).alias("body"),
    )
    return converted.unionByName(passed)


def convert(sources: DataFrame, body_only: bool = False, **options) -> DataFrame:
    """One row per source: identity, outcome, Markdown (envelope and body, or body alone) and a JSON receipt."""
    made = bodies(sources, units(sources, **options))
    facts = sources.select("source_id", "name", "suffix", "route", "unit_kind", F.octet_length("content").cast("long").alias("byte_size"), F.sha2("content", 256).alias("sha256"))
    whole = facts.join(made, "source_id", "left").withColumn("body_sha256", F.sha2(F.col("body").cast("binary"), 256))
    fields = [
        ("Markdown schema", F.lit(SCHEMA)),
        ("Source name", F.concat(F.lit('"'), X.escape_markdown(F.col("name"), quoted=True), F.lit('"'))),
        ("Source suffix", F.col("suffix")),
        ("Source bytes", F.col("byte_size").cast("string")),
        ("Source SHA-256", F.col("sha256")),
        ("Route", F.col("route")),
        ("Unit kind", F.col("unit_kind")),
        ("Rendered unit count", F.col("units").cast("string")),
        ("Ordered selection keys", F.when(F.size("unit_keys") > 0, F.array_join("unit_keys", ", ")).otherwise("none")),
        ("Rendered body bytes", F.octet_length("body").cast("string")),
        ("Rendered body SHA-256", F.col("body_sha256")),
        ("Tables", F.col("tables").cast("string")),
    ]
    table = X.markdown_table(F.array(F.array(F.lit("Field"), F.lit("Value")), *[F.array(F.lit(n), F.coalesce(v, F.lit(""))) for n, v in fields]))
    envelope = F.concat(
        F.lit('# "'), X.escape_markdown(F.col("name"), quoted=True), F.lit('"\n\n<a id="unit-metadata"></a>\n## Metadata\n\n'), table,
        F.lit('\n\n<a id="unit-contents"></a>\n## Contents\n\n'), F.col("contents"), F.lit("\n\n"), F.col("body"),
    )
    markdown = F.col("body") if body_only else F.when(F.col("route") == "text", F.col("body")).otherwise(envelope)
    receipt = F.to_json(F.struct("body_sha256", "byte_size", "file_ok", "name", "reason", "route", "sha256", "tables", "unit_keys", "unit_kind", "units"))
    return whole.select("source_id", "name", "route", "file_ok", "reason", "units", "tables", "byte_size", "sha256", "body_sha256", markdown.alias("markdown"), receipt.alias("receipt"))


def with_report(converted: DataFrame, report: str = "report") -> DataFrame:
    """The Markdown followed by a marker comment (bytes and digest of the body before it) and a report column."""
    body = F.col("markdown")
    marker = F.format_string("<!-- inspection bytes=%d sha256=%s -->\n", F.octet_length(body), F.sha2(body.cast("binary"), 256))
    return converted.withColumn("markdown", F.concat(body, F.lit("\n"), marker, F.col(report)))


def readable_part(markdown: F.Column) -> F.Column:
    """The Markdown before a report marker that matches its bytes and digest; the whole text without one."""
    size = F.regexp_extract(markdown, r"\n<!-- inspection bytes=([0-9]+) sha256=[0-9a-f]{64} -->\n", 1).try_cast("int")
    digest = F.regexp_extract(markdown, r"\n<!-- inspection bytes=[0-9]+ sha256=([0-9a-f]{64}) -->\n", 1)
    head = F.substring(markdown.cast("binary"), F.lit(1), F.coalesce(size, F.lit(0))).cast("string")
    return F.when(size.isNotNull() & (F.sha2(head.cast("binary"), 256) == digest), head).otherwise(markdown)


def nested_documents(sources: DataFrame, most_depth: int = 16) -> DataFrame:
    """Sources and the documents inside their packages and messages, level by level: (source_id, parent_sha256, name, depth, sha256, content, reason).

    A child whose digest is among its ancestors' is a cycle and ends there; the loop ends when a level finds nothing. Documents
    below ``most_depth`` are listed without content, and the reason names the limit.
    """
    level = sources.select("source_id", F.lit(None).cast("string").alias("parent_sha256"), "name", F.lit(0).alias("depth"), F.sha2("content", 256).alias("sha256"), "content", F.array(F.sha2("content", 256)).alias("_above"))
    found = level.withColumn("reason", F.lit(None).cast("string"))
    for depth in range(1, most_depth + 2):
        keyed = level.withColumn("_key", F.xxhash64("source_id", "sha256", "name"))
        parents = keyed.select("_key", F.col("source_id").alias("_root"), F.col("sha256").alias("parent_sha256"), "_above")
        zipped = keyed.where(F.substring("content", 1, 4) == F.lit(b"PK\x03\x04")).select(F.col("_key").alias("source_id"), "content")
        mails = keyed.where("lower(name) like '%.eml'").select(F.col("_key").alias("source_id"), "content")
        inner = members(zipped).where(r"lower(part) rlike '\.(html?|eml|docx|xlsx|pptx|epub|odt|ods|odp|zip|txt|md)$'").select("source_id", F.col("part").alias("name"), "content")
        inner = inner.unionByName(mime_parts(mails).where("filename is not null").select("source_id", F.col("filename").alias("name"), F.col("payload").alias("content")))
        inner = inner.where("content is not null").withColumnRenamed("source_id", "_key").join(parents, "_key")
        digest = F.sha2("content", 256)
        level = inner.where(~F.array_contains("_above", digest)).select(
            F.col("_root").alias("source_id"), "parent_sha256", "name", F.lit(depth).alias("depth"), digest.alias("sha256"), "content", F.array_append("_above", digest).alias("_above")
        )
        level = cut_lineage(level)
        if level.isEmpty():
            break
        reason = F.lit(f"nested deeper than {most_depth} levels" if depth > most_depth else None).cast("string")
        listed = level.withColumn("content", F.when(reason.isNull(), F.col("content"))).withColumn("reason", reason)
        found = found.unionByName(listed)
    return found.drop("_above")


def page_units(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Pages of a table as sources of the HTML route."""
    return pages.select(
        F.col(key).alias("source_id"), F.concat(F.col(key).cast("string"), F.lit(".html")).alias("name"), F.lit(".html").alias("suffix"), F.lit("html").alias("route"), F.lit("chapter").alias("unit_kind"),
        F.col("html").cast("binary").alias("content"),
    )


def numbered_findings(findings: DataFrame, key: str = "source_id", order: str = "pre") -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return findings.withColumn("finding_id", F.format_string("f%06d", F.row_number().over(w)))

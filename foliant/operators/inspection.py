"""Inspection: findings of documents as one relation, its coverage, and the report assembled from both.

Findings come from a parser once per document; capability grids, coverage, caps and the report are DataFrame plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.arrow import map_rows
from foliant.functions.html_markdown import Refusal, hidden, target_class
from foliant.functions.html_tree import COMMENT, TEXT, parse
from foliant.functions.scanners import css_targets, markdown_links, srcset
from foliant.operators.relations import CAPABILITIES, coverage_rollup
from foliant.sources import mail
from foliant.sources.charset import decode_html
from foliant.sources.compound import data_url
from foliant.sources.packages import Package, local
from foliant.sources.workbooks import cell_rows, letters

FINDINGS = T.StructType(
    [
        T.StructField("source_id", T.LongType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("capability", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)
# Attributes that hold a target, and event attributes begin with "on".
_TARGETS = frozenset("href src action formaction data poster cite background longdesc ping manifest xlink:href".split())
MOST = 100_000


def html_evidence(source: str):
    """(capability, kind, location, target, text) of a page, by element path."""
    for node in parse(source).walk():
        path = node.tag
        up = node.parent
        while up is not None and not up.tag.startswith("-"):
            path, up = f"{up.tag}/{path}", up.parent
        if node.tag == COMMENT:
            yield "comments", "comment", path, None, node.text.strip()
            continue
        if node.tag == TEXT or node.tag.startswith("-"):
            continue
        for name, value in node.attrs.items():
            if name in _TARGETS:
                kind = "data" if value[:5].lower() == "data:" else target_class(value)
                yield ("images" if node.tag == "img" else "scripts" if node.tag == "script" else "forms" if name in ("action", "formaction") else "links"), kind, f"{path}@{name}", value, None
                if kind == "data" and (found := data_url(value)):
                    yield "embedded_documents", "data-url", f"{path}@{name}", None, found[0]
            elif name == "srcset":
                for t in srcset(value):
                    yield "images", target_class(t), f"{path}@srcset", t, None
            elif name.startswith("on"):
                yield "active_content", "event-handler", f"{path}@{name}", None, value
            elif name == "style":
                for kind, t in css_targets(value):
                    yield "styles", f"css-{kind}", f"{path}@style", t, None
        text = "".join(c.text for c in node.children if c.tag == TEXT)
        if node.tag == "script":
            yield "active_content", "script", path, node.attrs.get("src"), text if "src" not in node.attrs else None
        elif node.tag == "style":
            yield "styles", "style-sheet", path, None, text
            for kind, t in css_targets(text):
                yield "styles", f"css-{kind}", path, t, None
        elif node.tag in ("form", "input", "select", "textarea", "button"):
            yield "forms", node.tag, path, None, node.attrs.get("name")
        elif node.tag == "meta":
            yield "metadata", "meta", path, None, " ".join(f"{k}={v}" for k, v in sorted(node.attrs.items()))
            if node.attrs.get("http-equiv", "").lower() == "refresh" and "url=" in node.attrs.get("content", "").lower():
                yield "links", "refresh", path, node.attrs["content"].split("=", 1)[1].strip(" '\""), None
        elif hidden(node) and node.tag not in ("head", "template", "noscript") and node.children:
            yield "hidden_content", node.tag, path, None, None


def package_evidence(raw: bytes):
    """Relationships to the outside, macros, embedded parts, comments and scripts of a package."""
    package = Package(raw)
    for name in package.names:
        low = name.lower()
        if low.endswith("vbaproject.bin"):
            yield "active_content", "vba-project", name, None, None
        elif "/embeddings/" in low or low.endswith((".ole", ".bin")) and "/activex/" in low:
            yield "embedded_documents", "embedded-part", name, None, None
        elif low.endswith(("comments.xml", "comments1.xml")):
            yield "annotations", "comments", name, None, None
        elif "/_xmlsignatures/" in f"/{low}":
            yield "signatures", "signature", name, None, None
        elif low.endswith(".rels"):
            for e in package.xml(name).iter():
                if local(e.tag) == "Relationship" and e.get("TargetMode") == "External":
                    yield "links", e.get("Type", "").rsplit("/", 1)[-1], name, e.get("Target"), None
        elif low.endswith((".js", ".bas", ".vbs")):
            yield "scripts", "script-member", name, None, None


def evidence(route: str | None, suffix: str, raw: bytes):
    match route:
        case "html":
            yield from html_evidence(decode_html(raw)[0])
        case "text":
            for kind, target in markdown_links(raw.decode("utf-8", "replace")) if suffix == ".md" else ():
                yield "links", kind, "text", target, None
        case "eml":
            for path, _, part in mail.parts_of(raw):
                if part.get_content_disposition() == "attachment" or part.get_filename():
                    yield "attachments", part.get_content_type(), f"mime/{path}", None, part.get_filename()
                elif part.get_content_type() == "text/html":
                    for capability, kind, at, target, text in html_evidence((part.get_payload(decode=True) or b"").decode(part.get_content_charset() or "utf-8", "replace")):
                        yield capability, kind, f"mime/{path}/{at}", target, text
        case "docx" | "pptx" | "epub" | "odt" | "odp":
            yield from package_evidence(raw)
        case "sheet":
            if raw[:2] == b"PK":
                yield from package_evidence(raw)
            for _, sheet, state, row, col, _, value, formula, _ in cell_rows(raw, suffix):
                if formula:
                    yield "formulas", "formula", f"{sheet}!{letters(col)}{row}", None, formula
                if state != "visible":
                    yield "hidden_content", "hidden-sheet-cell", f"{sheet}!{letters(col)}{row}", None, value


def findings(sources: DataFrame) -> DataFrame:
    """Findings of each routed source (source_id, route, suffix, content), numbered in order.

    More than ``MOST`` findings, or a document that can't be read, end in one row of the capability ``problem``.
    """

    def rows(source_id: int, route: str | None, suffix: str, content: bytes | None):
        n = 0
        try:
            for n, found in enumerate(evidence(route, suffix, content or b""), 1):
                if n > MOST:
                    raise Refusal(f"finding limit exceeded: {MOST}")
                yield source_id, n, *found
        except Refusal as refusal:
            yield source_id, n + 1, "problem", "refused", None, None, str(refusal)
        except (ValueError, LookupError, OSError, EOFError, TypeError, RecursionError) as exc:
            yield source_id, n + 1, "problem", "unreadable", None, None, str(exc)

    return map_rows(sources.select("source_id", "route", "suffix", "content"), FINDINGS, rows)


def coverage(sources: DataFrame, found: DataFrame) -> DataFrame:
    """(source_id, capability, status): complete; partial or unavailable after a problem; not_applicable without a route."""
    grid = sources.select("source_id", "route", F.explode(F.array(*map(F.lit, CAPABILITIES))).alias("capability"))
    per = found.where("capability <> 'problem'").groupBy("source_id", "capability").agg(F.count(F.lit(1)).alias("_n"))
    bad = found.where("capability = 'problem'").groupBy("source_id").agg(F.first("text").alias("_reason"))
    joined = grid.join(per, ["source_id", "capability"], "left").join(bad, "source_id", "left")
    status = (
        F.when(F.col("route").isNull(), "not_applicable").when(F.col("_reason").isNotNull() & F.col("_n").isNotNull(), "partial").when(F.col("_reason").isNotNull(), "unavailable").otherwise("complete")
    )
    return joined.select("source_id", "capability", status.alias("status"), F.coalesce("_n", F.lit(0)).cast("long").alias("findings"), F.col("_reason").alias("reason"))


def reports(sources: DataFrame, most_bytes: int = 16 << 20) -> DataFrame:
    """One JSON report per source: identity, status counts and findings; over the byte limit the findings are left out and counted."""
    found = findings(sources)
    identity = sources.select("source_id", "name", F.octet_length("content").cast("long").alias("byte_size"), F.sha2("content", 256).alias("sha256"))
    counts = coverage_rollup(coverage(sources, found))
    item = F.struct("seq", "capability", "kind", "location", "target", "text")
    listed = found.groupBy("source_id").agg(F.array_sort(F.collect_list(item)).alias("findings"), F.count(F.lit(1)).alias("n_findings"))
    whole = identity.join(counts, "source_id").join(listed, "source_id", "left")
    body = lambda f: F.to_json(F.struct("byte_size", "complete", f.alias("findings"), F.coalesce("n_findings", F.lit(0)).alias("n_findings"), "name", "not_applicable", "partial", "sha256", "unavailable"))
    full, bare = body(F.col("findings")), body(F.lit(None).cast("array<string>"))
    return whole.select("source_id", F.when(F.octet_length(full) <= most_bytes, full).otherwise(bare).alias("report"))


def report_markdown(found: DataFrame) -> DataFrame:
    """(source_id, report): findings grouped as links, active content and the rest, a line each."""
    group = F.when(F.col("capability") == "links", "Links").when(F.col("capability").isin("active_content", "scripts"), "Active content").otherwise("Extracted content")
    line = F.concat_ws(" ", F.concat(F.lit("- "), F.col("kind")), F.col("target"), F.col("text"))
    parts = found.where("capability <> 'problem'").groupBy("source_id", group.alias("heading")).agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("l")))).alias("_l"))
    section = F.concat(F.lit("## "), F.col("heading"), F.lit("\n\n"), F.array_join(F.transform("_l", lambda x: x["l"]), "\n"))
    order = F.when(F.col("heading") == "Links", 0).when(F.col("heading") == "Active content", 1).otherwise(2)
    whole = F.array_sort(F.collect_list(F.struct(order.alias("o"), section.alias("s"))))
    return parts.groupBy("source_id").agg(F.array_join(F.transform(whole, lambda x: x["s"]), "\n\n").alias("report"))

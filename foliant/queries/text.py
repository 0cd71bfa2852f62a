"""Queries over ``documents``, ``conversations`` and ``benchmark``: the text route, cleanup, Markdown writing, furniture and units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators import lines as L
from foliant.operators import routing as R
from foliant.operators.relations import capped


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/conversations.parquet")


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    """The text tables as files of several suffixes, one of them without a route."""
    table = lambda n, key, text, suffix: spark.read.parquet(f"{sf}/{n}.parquet").select(
        F.concat(F.lit(f"{n}/"), F.col(key).cast("string"), F.lit(suffix)).alias("name"), F.col(text).cast("binary").alias("content")
    )
    return table("pages", "page_id", "html", ".HTML").unionByName(table("documents", "doc_id", "text", ".txt")).unionByName(table("benchmark", "item_id", "text", ".csv"))


def route_inventory(spark, sf):
    routed = R.identity(R.with_route(_sources(spark, sf)))
    return routed.groupBy("suffix", F.coalesce("route", F.lit("none")).alias("route")).agg(F.count(F.lit(1)).alias("sources"), F.sum("byte_size").alias("bytes"))


def source_identity(spark, sf):
    return R.identity(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.col("html").alias("content"))).drop("content")


def text_passthrough(spark, sf):
    """Strict UTF-8 sources pass byte for byte; digests of the source and of what comes out agree."""
    raw = _docs(spark, sf).select("doc_id", F.col("text").cast("binary").alias("content")).where(F.is_valid_utf8(F.col("content").cast("string")))
    return raw.select("doc_id", F.sha2("content", 256).alias("sha256"), F.sha2(F.decode("content", "UTF-8").cast("binary"), 256).alias("body_sha256"))


def sanitise_counters(spark, sf):
    counts = X.loss_counts(F.col("text"))
    return _docs(spark, sf).select("doc_id", *[c.alias(n) for n, c in counts.items()])


def sanitised_text(spark, sf):
    clean = _docs(spark, sf).select("doc_id", X.sanitise_text("text").alias("r"))
    return clean.select("doc_id", F.sha2(F.col("r.text").cast("binary"), 256).alias("sha256"), F.col("r.non_ascii_replaced").alias("non_ascii_replaced"))


def digit_mask(spark, sf):
    return _docs(spark, sf).select("doc_id", F.sha2(X.mask_digits(F.col("text")).cast("binary"), 256).alias("masked_sha256"))


def whitespace_collapse(spark, sf):
    return _docs(spark, sf).select("doc_id", F.length(X.collapse_space(F.col("text"))).cast("long").alias("chars"))


def escape_markdown(spark, sf):
    return _docs(spark, sf).select("doc_id", F.sha2(X.escape_markdown(F.col("text")).cast("binary"), 256).alias("escaped_sha256"))


def escape_line_start(spark, sf):
    lines = L.exploded_lines(_docs(spark, sf))
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), X.escape_line_start(F.col("line")).alias("line"))


def source_html_inert(spark, sf):
    return _docs(spark, sf).select("doc_id", F.length(X.source_html(F.col("text"), raw=True)).cast("long").alias("chars"))


def literal_fence(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", X.fence(F.col("text")).alias("fenced"))


def heading_lines(spark, sf):
    level = (F.col("item_id") % 6 + 1).cast("int")
    return spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", X.heading_line(F.col("text"), level).alias("line"))


def running_heads(spark, sf):
    docs = _docs(spark, sf)
    first = docs.select("source", "doc_id", F.get(F.split("text", "\n"), F.lit(0)).alias("line"))
    return L.running_heads(first, "source", "doc_id", "line")


def drop_furniture(spark, sf):
    docs = _docs(spark, sf)
    lines = docs.select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    heads = L.running_heads(lines, "source", "doc_id", "line")
    return L.drop_furniture(lines, heads, "source", "line").groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"))


def duplicate_lines(spark, sf):
    lines = L.exploded_lines(_docs(spark, sf)).where("trim(line) <> ''")
    return lines.groupBy("line").agg(F.countDistinct("doc_id").alias("docs"), F.count(F.lit(1)).alias("times")).where("docs > 1")


def dedup_ordered(spark, sf):
    return L.first_of_equal(L.exploded_lines(_docs(spark, sf)).withColumn("line_no", F.col("line_no").cast("long")), ["doc_id", "line"], "line_no")


def exact_duplicate_docs(spark, sf):
    digest = _docs(spark, sf).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return digest.groupBy("sha256").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


def cumulative_budget(spark, sf):
    sized = _docs(spark, sf).select("source", "doc_id", F.octet_length("text").cast("long").alias("bytes"))
    return L.within_budget(sized, ["source"], ["doc_id"], "bytes", 65_536)


def report_caps(spark, sf):
    """The first eight findings-like rows of each source, as a report caps its lists."""
    return capped(_docs(spark, sf).select("source", "doc_id"), ["source"], ["doc_id"], 8)


def conversation_units(spark, sf):
    first = _turns(spark, sf).groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.min_by("text", "turn").alias("_t"))
    label = F.get(F.split("_t", "\n"), F.lit(0))
    kind = F.lit("chapter")
    rows = first.select("conv_id", "turns", (F.col("conv_id") + 1).cast("int").alias("n"), label.alias("label"))
    return rows.select(
        "conv_id", "turns", X.unit_key(kind, F.col("n")).alias("unit_key"), X.unit_anchor(kind, F.col("n")).alias("anchor"), X.unit_heading(kind, F.col("n"), F.col("label")).alias("heading")
    )


def conversation_markdown(spark, sf):
    line = F.concat(F.lit("**"), F.col("role"), F.lit(":** "), X.escape_markdown(F.col("text")))
    return L.join_lines(_turns(spark, sf).select("conv_id", "turn", line.alias("line")), ["conv_id"], "turn", "line")


def markdown_table_render(spark, sf):
    cell = F.array(F.col("turn").cast("string"), F.col("role"), F.regexp_replace("text", "\n", " "))
    rows = F.array_sort(F.collect_list(F.struct("turn", cell.alias("c"))))
    table = F.concat(F.array(F.array(F.lit("turn"), F.lit("role"))), F.transform(rows, lambda r: r["c"]))
    return _turns(spark, sf).groupBy("conv_id").agg(X.markdown_table(table).alias("markdown"))


def list_numbers(spark, sf):
    items = _turns(spark, sf).select("conv_id", "turn", F.when(F.col("turn") % 3 == 2, F.col("turn") * 10).alias("value"))
    return L.list_numbers(items, ["conv_id"], "turn", "value", F.lit(1)).select("conv_id", "turn", "number")


def chapter_assignment(spark, sf):
    blocks = _turns(spark, sf).withColumn("is_user", F.col("role") == "user")
    return L.chapters(blocks, ["conv_id"], "turn", "is_user").select("conv_id", "turn", "chapter")


def candidate_interleave(spark, sf):
    rows = _turns(spark, sf).select("conv_id", "role", "turn")
    return L.interleave(rows, ["conv_id"], "role", "turn", 3)


_HEAD = r"trim(regexp_replace(trim({}), '\d+', '#', 'g'))"
_LINE = "SELECT doc_id, source, unnest(range(0, len(s))) AS line_no, unnest(s) AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS s FROM documents)"
_ESCAPED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '&(#?[0-9A-Za-z_]+;)', '&amp;\1', 'g'), '([\\`*\[\]])', '\\\1', 'g'), '<', '&lt;', 'g'), '[\r\n\t]', ' ', 'g')"""
_STARTS = r"""CASE WHEN regexp_matches(l, '^(?:[#>+|-]|=+[ \t]*$|~~~|:-+:?(?:[ \t]*\|[ \t]*:?-+:?)*[ \t]*\|?[ \t]*$)') THEN '\' || l
 ELSE regexp_replace(l, '^([0-9]+)([.)])([ \t]|$)', '\1\\\2\3') END"""

QUERIES = {
    "route_inventory": (
        route_inventory,
        """SELECT suffix, route, count(*) AS sources, sum(b)::BIGINT AS bytes FROM (
 SELECT '.html' AS suffix, 'html' AS route, octet_length(encode(html)) AS b FROM pages UNION ALL SELECT '.txt', 'text', octet_length(encode(text)) FROM documents
 UNION ALL SELECT '.csv', 'none', octet_length(encode(text)) FROM benchmark) GROUP BY suffix, route""",
    ),
    "source_identity": (source_identity, "SELECT page_id, octet_length(encode(html))::BIGINT AS byte_size, sha256(html) AS sha256 FROM pages"),
    "text_passthrough": (text_passthrough, "SELECT doc_id, sha256(text) AS sha256, sha256(text) AS body_sha256 FROM documents"),
    "sanitise_counters": (
        sanitise_counters,
        r"""SELECT doc_id, len(regexp_extract_all(t, '[\x00-\x08\x0b-\x1f\x7f-\x9f]'))::BIGINT AS control_chars, (length(t) - length(replace(t, chr(173), '')))::BIGINT AS soft_hyphens,
 (length(t) - length(replace(t, chr(160), '')))::BIGINT AS nbsp, len(regexp_extract_all(t, '\p{Co}'))::BIGINT AS pua_glyphs, len(regexp_extract_all(text, '\(cid:\d+\)'))::BIGINT AS cid_survivors,
 len(regexp_extract_all(t, '[ﬀ-ﬆ]'))::BIGINT AS ligatures, len(regexp_extract_all(text, '[A-Za-z]+š[A-Za-z]*|[A-Za-z]*š[A-Za-z]+'))::BIGINT AS broken_words
 FROM (SELECT doc_id, text, regexp_replace(text, '\(cid:\d+\)', '', 'g') AS t FROM documents)""",
    ),
    "sanitised_text": (
        sanitised_text,
        r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(strip_accents(replace(text, 'ß', '?')), '[ \t]{2,}', ' ', 'g'), '[ \t]+(\n|$)', '\1', 'g')) AS sha256,
 (length(text) - length(replace(text, 'ß', '')))::BIGINT AS non_ascii_replaced FROM documents""",
    ),
    "digit_mask": (digit_mask, r"SELECT doc_id, sha256(regexp_replace(text, '\d+', '#', 'g')) AS masked_sha256 FROM documents"),
    "whitespace_collapse": (whitespace_collapse, r"SELECT doc_id, length(regexp_replace(text, '[ \t\r\n\f]+', ' ', 'g'))::BIGINT AS chars FROM documents"),
    "escape_markdown": (escape_markdown, rf"SELECT doc_id, sha256({_ESCAPED.format('text')}) AS escaped_sha256 FROM documents"),
    "escape_line_start": (escape_line_start, rf"SELECT doc_id, line_no, {_STARTS} AS line FROM (SELECT doc_id, line_no, ltrim(line, ' ' || chr(9)) AS l FROM ({_LINE}))"),
    "source_html_inert": (
        source_html_inert,
        r"""SELECT doc_id, length(replace(regexp_replace(regexp_replace(text, '&(#?[0-9A-Za-z_]+;)', '&amp;\1', 'g'), '^( {0,3})(```|~~~)', '\1\\\2'), '<', '&lt;'))::BIGINT AS chars FROM documents""",
    ),
    "literal_fence": (literal_fence, "SELECT item_id, '```' || chr(10) || text || chr(10) || '```' AS fenced FROM benchmark"),
    "heading_lines": (
        heading_lines,
        r"""SELECT item_id, CASE WHEN item_id % 6 + 1 > 4 THEN '**Heading ' || (item_id % 6 + 1) || ': ' || text || '**'
 ELSE repeat('#', (item_id % 6 + 3)::INT) || ' ' || text END AS line FROM benchmark""",
    ),
    "running_heads": (
        running_heads,
        rf"""SELECT source, head, count(DISTINCT doc_id) AS pages FROM (SELECT source, doc_id, {_HEAD.format("split_part(text, chr(10), 1)")} AS head FROM documents)
 WHERE head <> '' GROUP BY source, head HAVING count(DISTINCT doc_id) >= 3""",
    ),
    "drop_furniture": (
        drop_furniture,
        rf"""WITH l AS (SELECT doc_id, source, {_HEAD.format('line')} AS head FROM ({_LINE})),
 h AS (SELECT source, head FROM l WHERE head <> '' GROUP BY source, head HAVING count(DISTINCT doc_id) >= 3)
 SELECT doc_id, count(*) AS lines FROM l WHERE (source, head) NOT IN (SELECT (source, head) FROM h) GROUP BY doc_id""",
    ),
    "duplicate_lines": (duplicate_lines, f"SELECT line, count(DISTINCT doc_id) AS docs, count(*) AS times FROM ({_LINE}) WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT doc_id) > 1"),
    "dedup_ordered": (dedup_ordered, f"SELECT doc_id, line, min(line_no) AS line_no FROM ({_LINE}) GROUP BY doc_id, line"),
    "exact_duplicate_docs": (exact_duplicate_docs, "SELECT sha256(text) AS sha256, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1"),
    "cumulative_budget": (
        cumulative_budget,
        """SELECT * FROM (SELECT source, doc_id, octet_length(encode(text))::BIGINT AS bytes,
 (sum(octet_length(encode(text))) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS used FROM documents) WHERE used <= 65536""",
    ),
    "report_caps": (report_caps, "SELECT source, doc_id, place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents) WHERE place <= 8"),
    "conversation_units": (
        conversation_units,
        rf"""SELECT conv_id, turns, format('chapter/{{:06d}}', conv_id + 1) AS unit_key, format('unit-chapter-{{:06d}}', conv_id + 1) AS anchor,
 'Chapter ' || (conv_id + 1) || ': "' || replace({_ESCAPED.format("split_part(t, chr(10), 1)")}, '"', '&quot;') || '"' AS heading
 FROM (SELECT conv_id, count(*) AS turns, arg_min(text, turn) AS t FROM conversations GROUP BY conv_id)""",
    ),
    "conversation_markdown": (
        conversation_markdown,
        rf"SELECT conv_id, string_agg('**' || role || ':** ' || {_ESCAPED.format('text')}, chr(10) ORDER BY turn) || chr(10) AS markdown FROM conversations GROUP BY conv_id",
    ),
    "markdown_table_render": (
        markdown_table_render,
        r"""SELECT conv_id, '| turn | role |  |' || chr(10) || '| --- | --- | --- |' || chr(10)
 || string_agg('| ' || turn || ' | ' || role || ' | ' || replace(replace(text, chr(10), ' '), '|', '\|') || ' |', chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id""",
    ),
    "list_numbers": (
        list_numbers,
        """WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN turn * 10 END AS v FROM conversations),
 g AS (SELECT *, count(v) OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM r)
 SELECT conv_id, turn, least(greatest(coalesce(max(v) OVER (PARTITION BY conv_id, k), 1) + row_number() OVER (PARTITION BY conv_id, k ORDER BY turn) - 1, 0), 999999999)::BIGINT AS number FROM g""",
    ),
    "chapter_assignment": (
        chapter_assignment,
        "SELECT conv_id, turn, (sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS chapter FROM conversations",
    ),
    "candidate_interleave": (
        candidate_interleave,
        """SELECT conv_id, role, turn, place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k, role) AS place FROM (
 SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations)) WHERE place <= 3""",
    ),
}

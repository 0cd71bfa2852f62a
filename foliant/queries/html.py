"""Queries over ``pages``: the HTML route and its inspection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.arrow import spread
from foliant.functions.text import collapse_space
from foliant.operators import html as H
from foliant.operators import inspection as I
from foliant.operators import urls
from foliant.operators.relations import CAPABILITIES
from foliant.plans.convert import convert, page_units


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return H.html_nodes(_pages(spark, sf))


def html_markdown(spark, sf):
    return H.html_markdown(_pages(spark, sf)).withColumnRenamed("source_id", "page_id")


def html_article_markdown(spark, sf):
    return H.html_markdown(_pages(spark, sf), article=True).withColumnRenamed("source_id", "page_id")


def html_blocks(spark, sf):
    return H.html_blocks(_pages(spark, sf)).withColumnRenamed("source_id", "page_id")


def html_nodes(spark, sf):
    return _nodes(spark, sf).drop("attrs")


def html_title(spark, sf):
    return H.first_titles(H.page_elements(_pages(spark, sf), ("title",))).withColumnRenamed("source_id", "page_id")


def html_lang(spark, sf):
    return H.page_elements(_pages(spark, sf), ("html",), texts=False).select(F.col("source_id").alias("page_id"), F.col("attrs")["lang"].alias("lang"))


def html_meta_charset(spark, sf):
    found = H.page_elements(_pages(spark, sf), ("meta",), texts=False).select("source_id", "pre", F.col("attrs")["charset"].alias("charset")).where("charset is not null")
    return found.groupBy(F.col("source_id").alias("page_id")).agg(F.lower(F.min_by("charset", "pre")).alias("charset"))


def html_links(spark, sf):
    return H.links(H.page_elements(_pages(spark, sf), ("a",), texts=False)).withColumnRenamed("source_id", "page_id")


def html_link_counts(spark, sf):
    return H.links(H.page_elements(_pages(spark, sf), ("a",), texts=False)).groupBy(F.col("source_id").alias("page_id"), "target_class").agg(F.count(F.lit(1)).alias("n"))


def html_tag_histogram(spark, sf):
    return H.tag_histogram(_nodes(spark, sf))


def html_comments(spark, sf):
    found = _nodes(spark, sf).where("tag = 'comment'")
    return found.select(F.col("source_id").alias("page_id"), F.trim("text").alias("comment"))


def _raw_inventory(spark, sf, tag):
    found = H.page_elements(_pages(spark, sf), (tag,))
    return found.select(F.col("source_id").alias("page_id"), F.length("text").cast("long").alias("chars"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


def html_scripts(spark, sf):
    return _raw_inventory(spark, sf, "script")


def html_styles(spark, sf):
    return _raw_inventory(spark, sf, "style")


def html_headings(spark, sf):
    found = H.page_elements(_pages(spark, sf), ("h1",))
    return found.select(F.col("source_id").alias("page_id"), F.trim(collapse_space(F.col("text"))).alias("heading"))


def html_chrome(spark, sf):
    """Elements of page chrome: landmarks outside the main content."""
    top = _nodes(spark, sf).where("chrome and tag in ('nav', 'footer', 'header', 'aside')")
    return top.groupBy(F.col("source_id").alias("page_id")).agg(F.count(F.lit(1)).alias("landmarks"))


def html_visible_length(spark, sf):
    return H.page_lengths(_pages(spark, sf)).withColumnRenamed("source_id", "page_id")


def html_sibling_index(spark, sf):
    return H.sibling_index(_nodes(spark, sf)).where("tag = 'li'").groupBy(F.col("source_id").alias("page_id")).agg(F.max("nth").alias("items"))


def page_check(spark, sf):
    pages = spread(_pages(spark, sf).select("page_id", "html")).withColumn("facts", H.page_facts(F.col("html")))
    return pages.select("page_id", F.coalesce(urls.page_check(F.col("html"), F.col("facts.title"), F.coalesce("facts.visible_chars", F.lit(0))), F.lit("content")).alias("page_class"))


def url_parts(spark, sf):
    return _pages(spark, sf).select("page_id", *[c.alias(n) for n, c in urls.parts(F.col("url")).items()])


def url_redacted(spark, sf):
    return _pages(spark, sf).select("page_id", urls.redacted(F.col("url")).alias("shown"))


def url_query_pairs(spark, sf):
    return urls.query_pairs(_pages(spark, sf), "page_id")


def url_hosts(spark, sf):
    return _pages(spark, sf).groupBy(urls.parts(F.col("url"))["host"].alias("host")).agg(F.count(F.lit(1)).alias("pages"))


_TEXT = r"replace(replace(replace(replace({}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')".replace("\\", "")
_TITLE = _TEXT.format(r"regexp_extract(html, '<title>([^<]*)</title>', 1)")
_SQUEEZE = r"trim(regexp_replace({}, '[ \t\r\n\f]+', ' ', 'g'))"
_CLASS = r"""CASE WHEN href = '' THEN 'missing' WHEN regexp_extract(href, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) = '' THEN 'relative'
 WHEN lower(regexp_extract(href, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) IN ('http','https','mailto') THEN 'external'
 WHEN lower(regexp_extract(href, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) = 'data' THEN 'data' ELSE 'unsupported' END"""
_LINKS = rf"""SELECT page_id, ord, href, {_CLASS} AS target_class FROM (
 SELECT page_id, unnest(range(1, len(h) + 1)) AS ord, {_TEXT.format('unnest(h)')} AS href
 FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages))"""
_URL = r"'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$'"
_HOST = rf"lower(regexp_replace(regexp_replace(regexp_extract(url, {_URL}, 2), '^.*@', ''), ':[0-9]*$', ''))"

QUERIES = {
    "html_markdown": (html_markdown, None),
    "html_article_markdown": (html_article_markdown, None),
    "html_blocks": (html_blocks, None),
    "html_nodes": (html_nodes, None),
    "html_title": (html_title, rf"SELECT page_id, title FROM (SELECT page_id, {_SQUEEZE.format(_TITLE)} AS title FROM pages) WHERE title <> ''"),
    "html_lang": (html_lang, """SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang FROM pages"""),
    "html_meta_charset": (html_meta_charset, """SELECT page_id, lower(regexp_extract(html, '<meta charset="([^"]*)"', 1)) AS charset FROM pages"""),
    "html_links": (html_links, _LINKS),
    "html_link_counts": (html_link_counts, f"SELECT page_id, target_class, count(*) AS n FROM ({_LINKS}) GROUP BY ALL"),
    "html_tag_histogram": (html_tag_histogram, None),
    "html_comments": (html_comments, "SELECT page_id, trim(unnest(regexp_extract_all(html, '<!--(.*?)-->', 1))) AS comment FROM pages"),
    "html_scripts": (
        html_scripts,
        "SELECT page_id, length(s)::BIGINT AS chars, sha256(s) AS sha256 FROM (SELECT page_id, unnest(regexp_extract_all(html, '<script>(.*?)</script>', 1)) AS s FROM pages)",
    ),
    "html_styles": (
        html_styles,
        "SELECT page_id, length(s)::BIGINT AS chars, sha256(s) AS sha256 FROM (SELECT page_id, unnest(regexp_extract_all(html, '<style>(.*?)</style>', 1)) AS s FROM pages)",
    ),
    "html_headings": (html_headings, rf"SELECT page_id, {_SQUEEZE.format(_TEXT.format('h'))} AS heading FROM (SELECT page_id, unnest(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1)) AS h FROM pages)"),
    "html_chrome": (html_chrome, "SELECT page_id, (len(regexp_extract_all(html, '<nav')) + len(regexp_extract_all(html, '<footer')))::BIGINT AS landmarks FROM pages"),
    "html_visible_length": (html_visible_length, None),
    "html_sibling_index": (html_sibling_index, "SELECT page_id, len(regexp_extract_all(html, '<li>'))::BIGINT AS items FROM pages"),
    "page_check": (page_check, "SELECT page_id, 'content' AS page_class FROM pages"),
    "url_parts": (
        url_parts,
        rf"""SELECT page_id, lower(regexp_extract(url, {_URL}, 1)) AS scheme, {_HOST} AS host, regexp_extract(regexp_extract(url, {_URL}, 2), ':([0-9]+)$', 1) AS port,
 regexp_extract(url, {_URL}, 3) AS path, regexp_replace(regexp_extract(url, {_URL}, 4), '^\?', '') AS query, regexp_replace(regexp_extract(url, {_URL}, 5), '^#', '') AS fragment FROM pages""",
    ),
    "url_redacted": (url_redacted, r"SELECT page_id, regexp_replace(url, '[?#].*$', '') AS shown FROM pages"),
    "url_query_pairs": (
        url_query_pairs,
        r"""SELECT page_id, ord, split_part(p, '=', 1) AS name, CASE WHEN contains(p, '=') THEN substr(p, strpos(p, '=') + 1) ELSE '' END AS value FROM (
 SELECT page_id, unnest(range(0, len(q))) AS ord, unnest(q) AS p FROM (SELECT page_id, string_split(regexp_extract(url, '\?([^#]*)', 1), '&') AS q FROM pages)) WHERE p <> ''""",
    ),
    "url_hosts": (url_hosts, f"SELECT {_HOST} AS host, count(*) AS pages FROM pages GROUP BY 1"),
}


def _sources(spark, sf):
    return page_units(spark.read.parquet(f"{sf}/pages.parquet"))


def inspection_counts(spark, sf):
    found = I.findings(_sources(spark, sf))
    return found.groupBy(F.col("source_id").alias("page_id"), "capability").agg(F.count(F.lit(1)).alias("n"))


def inspection_reports(spark, sf):
    return I.reports(_sources(spark, sf)).withColumnRenamed("source_id", "page_id")


def inspection_coverage(spark, sf):
    src = _sources(spark, sf)
    return I.coverage(src, I.findings(src)).groupBy("capability", "status").agg(F.count(F.lit(1)).alias("pages"))


def converted_pages(spark, sf):
    return convert(_sources(spark, sf)).select(F.col("source_id").alias("page_id"), "file_ok", "units", "sha256", "body_sha256", "receipt")


QUERIES |= {
    "inspection_counts": (
        inspection_counts,
        r"""SELECT page_id, capability, n FROM (SELECT page_id, 'links' AS capability, len(regexp_extract_all(html, '<a href'))::BIGINT AS n FROM pages
 UNION ALL SELECT page_id, 'active_content', len(regexp_extract_all(html, '<script'))::BIGINT FROM pages UNION ALL SELECT page_id, 'styles', len(regexp_extract_all(html, '<style'))::BIGINT FROM pages
 UNION ALL SELECT page_id, 'metadata', len(regexp_extract_all(html, '<meta'))::BIGINT FROM pages UNION ALL SELECT page_id, 'comments', len(regexp_extract_all(html, '<!--'))::BIGINT FROM pages) WHERE n > 0""",
    ),
    "inspection_reports": (inspection_reports, None),
    "inspection_coverage": (
        inspection_coverage,
        f"SELECT capability, 'complete' AS status, count(*) AS pages FROM pages CROSS JOIN (SELECT unnest([{', '.join(repr(c) for c in CAPABILITIES)}]) AS capability) GROUP BY capability",
    ),
    "converted_pages": (converted_pages, None),
}

"""HTML operators: pages to node tables, and relational views of those; pages to Markdown blocks and receipts.

A page crosses to Python once, to be parsed; everything set-shaped after that is a DataFrame plan over the nodes.
"""

from __future__ import annotations

import hashlib

import re
from bisect import bisect_left
from html import unescape as _unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.arrow import map_rows
from foliant.functions.html_markdown import Refusal, block_lines, body_markdown, dropped, is_chrome, render_html
from foliant.functions.html_tree import TEXT, parse
from foliant.functions.text import collapse_space

NODES = T.StructType(
    [
        T.StructField("source_id", T.LongType()),
        T.StructField("pre", T.IntegerType()),
        T.StructField("post", T.IntegerType()),
        T.StructField("parent", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("text", T.StringType()),
        T.StructField("hidden", T.BooleanType()),
        T.StructField("chrome", T.BooleanType()),
    ]
)


def _nodes(source_id: int, html: str | None):
    root = parse(html or "")
    order = {id(n): i for i, n in enumerate(root.walk())}
    last: dict[int, int] = {}
    for n in reversed(list(root.walk())):
        last[id(n)] = max([order[id(n)], *(last[id(c)] for c in n.children)])
    state: dict[int, tuple[int, bool, bool]] = {}
    for n in root.walk():
        up = state.get(id(n.parent), (-1, False, False))
        element = not n.tag.startswith("-")
        state[id(n)] = (up[0] + 1, up[1] or element and dropped(n) and n.tag != "head", up[2] or element and is_chrome(n))
        if n is root:
            continue
        depth, out, chrome = state[id(n)]
        yield (source_id, order[id(n)], last[id(n)], order[id(n.parent)], depth, n.tag.lstrip("-") if not element else n.tag, n.attrs, n.text if not element else None, out, chrome)


def html_nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Every node of every recovered tree: preorder number, last preorder number below it, parent, tag, attributes, text.

    The limits are the conversion's alone: a page beyond them has its rows here.
    """
    return map_rows(pages.select(F.col(key).cast("long"), F.col(html)), NODES, _nodes)


ELEMENTS = T.StructType([f for f in NODES.fields if f.name in ("source_id", "pre", "tag", "attrs", "text")])


def page_elements(pages: DataFrame, tags: tuple[str, ...], texts: bool = True, key: str = "page_id", html: str = "html") -> DataFrame:
    """(source_id, pre, tag, attrs, text) of elements of some tags only, picked while a page is read; ``text`` has all text below, if asked for.

    The limits are the conversion's alone: a page beyond them has its rows here.
    """
    wanted = frozenset(tags)

    def rows(source_id: int, source: str | None):
        for pre, n in enumerate(parse(source or "").walk()):
            if n.tag in wanted:
                yield source_id, pre, n.tag, n.attrs, "".join(c.text for c in n.walk() if c.tag == TEXT) if texts else None

    return map_rows(pages.select(F.col(key).cast("long"), F.col(html)), ELEMENTS, rows, 256 if texts else 2048)


def elements(nodes: DataFrame) -> DataFrame:
    return nodes.where(~F.col("tag").isin("text", "comment"))


def tag_histogram(nodes: DataFrame) -> DataFrame:
    return elements(nodes).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def node_text(nodes: DataFrame, tag: str) -> DataFrame:
    """(source_id, pre, text) of each element of a tag, with the text of all nodes below it: an interval join within a page."""
    outer = nodes.where(F.col("tag") == tag).select("source_id", F.col("pre").alias("_at"), F.col("post").alias("_last"), F.col("attrs").alias("_own"))
    inner = nodes.where("tag = 'text'").select(F.col("source_id").alias("_source"), F.col("pre").alias("_pre"), F.col("text").alias("_text"))
    below = (F.col("source_id") == F.col("_source")) & (F.col("_pre") > F.col("_at")) & (F.col("_pre") <= F.col("_last"))
    parts = F.array_sort(F.collect_list(F.when(F.col("_pre").isNotNull(), F.struct("_pre", "_text"))))
    text = F.array_join(F.transform(parts, lambda x: x["_text"]), "").alias("text")
    return outer.join(inner, below, "left").groupBy("source_id", F.col("_at").alias("pre")).agg(F.first("_own").alias("attrs"), text)


def titles(nodes: DataFrame) -> DataFrame:
    """The first non-empty title of each page that has one."""
    return first_titles(node_text(nodes, "title"))


def first_titles(elements_: DataFrame) -> DataFrame:
    """The first non-empty text of each page among its title elements (source_id, pre, text)."""
    found = elements_.select("source_id", "pre", F.trim(collapse_space(F.col("text"))).alias("title")).where("title <> ''")
    return found.groupBy("source_id").agg(F.min_by("title", "pre").alias("title"))


def target_class(href: Column) -> Column:
    """missing, relative, data, unsupported or external, as the converter sees a link target."""
    scheme = F.lower(F.regexp_extract(F.regexp_replace(href, r"[\x00-\x20\x7f]", ""), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return (
        F.when(F.coalesce(href, F.lit("")) == "", "missing")
        .when(scheme == "", "relative")
        .when(scheme == "data", "data")
        .when(scheme.isin("http", "https", "mailto"), "external")
        .otherwise("unsupported")
    )


def links(nodes: DataFrame) -> DataFrame:
    """(source_id, ord, href, target_class) of every anchor with an href, in document order."""
    order = Window.partitionBy("source_id").orderBy("pre")
    found = nodes.where((F.col("tag") == "a") & F.col("attrs").getItem("href").isNotNull())
    return found.select(
        "source_id", F.row_number().over(order).cast("long").alias("ord"), F.col("attrs").getItem("href").alias("href"), target_class(F.col("attrs").getItem("href")).alias("target_class")
    )


def images(nodes: DataFrame) -> DataFrame:
    found = nodes.where("tag = 'img'")
    return found.select("source_id", "pre", F.col("attrs").getItem("src").alias("src"), F.col("attrs").getItem("alt").alias("alt"), target_class(F.col("attrs").getItem("src")).alias("target_class"))


def sibling_index(nodes: DataFrame) -> DataFrame:
    """(source_id, pre, tag, nth): the place of an element among its siblings of the same tag, for ``tag[n]`` paths."""
    order = Window.partitionBy("source_id", "parent", "tag").orderBy("pre")
    return elements(nodes).select("source_id", "pre", "tag", F.row_number().over(order).cast("long").alias("nth"))


def visible_length(nodes: DataFrame) -> DataFrame:
    """(source_id, visible_chars): characters of text nodes in the body that nothing hides, white space collapsed."""
    body = nodes.where("tag = 'body'").select("source_id", F.col("pre").alias("_from"), F.col("post").alias("_to"))
    text = nodes.where("tag = 'text' and not hidden")
    inside = text.join(body, "source_id").where("pre > _from and pre <= _to")
    size = F.length(F.trim(F.regexp_replace("text", r"[ \t\r\n\f]+", " ")))
    return inside.groupBy("source_id").agg(F.sum(size).cast("long").alias("visible_chars"))


_BLANKS = re.compile(r"[ \t\r\n\f]+")


def _squeezed(text: str) -> str:
    return _BLANKS.sub(" ", text).strip(" ")


def _facts(source: str | None) -> tuple[str | None, int | None]:
    """What ``titles`` and ``visible_length`` say of one page, in one walk; null where they have no row."""
    title = visible = None
    stack = [(parse(source or ""), False, False)]
    while stack:
        n, inside, out = stack.pop()
        if n.tag == TEXT:
            if inside and not out:
                visible = (visible or 0) + len(_squeezed(n.text))
            continue
        if not n.tag.startswith("-"):
            if title is None and n.tag == "title":
                title = _squeezed("".join(c.text for c in n.walk() if c.tag == TEXT)) or None
            out = out or n.tag != "head" and dropped(n)
            inside = inside or n.tag == "body"
        stack.extend([(c, inside, out) for c in reversed(n.children)])
    return title, visible


def page_facts(html: Column) -> Column:
    """(title, visible_chars) of a page, which is read once and stays in its row: no node table, no join."""
    kind = T.StructType([T.StructField("title", T.StringType()), T.StructField("visible_chars", T.LongType())])

    def run(pages: pa.Array) -> pa.Array:
        found = [_facts(p.as_py()) for p in pages]
        return pa.StructArray.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([v for _, v in found], pa.int64())], ["title", "visible_chars"])

    return F.arrow_udf(run, kind, F.ArrowUDFType.SCALAR)(html)


LENGTHS = T.StructType([T.StructField("source_id", T.LongType()), T.StructField("visible_chars", T.LongType())])


def page_lengths(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``visible_length`` of pages, each read once."""

    def rows(source_id: int, source: str | None):
        if (visible := _facts(source)[1]) is not None:
            yield source_id, visible

    return map_rows(pages.select(F.col(key).cast("long"), F.col(html)), LENGTHS, rows)


BLOCKS = T.StructType(
    [
        T.StructField("source_id", T.LongType()),
        T.StructField("block_no", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("markdown", T.StringType()),
    ]
)
RENDERED = T.StructType(
    [
        T.StructField("source_id", T.LongType()),
        T.StructField("file_ok", T.BooleanType()),
        T.StructField("reason", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("text_regions", T.LongType()),
        T.StructField("tables", T.LongType()),
        T.StructField("article_fallback", T.BooleanType()),
        T.StructField("body", T.StringType()),
        T.StructField("body_bytes", T.LongType()),
        T.StructField("body_sha256", T.StringType()),
    ]
)


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html", article: bool = False) -> DataFrame:
    """(source_id, block_no, kind, markdown) of each page's blocks in order; refused pages have none."""

    def rows(source_id: int, source: str | None):
        try:
            found = render_html(source or "", article)
        except Refusal:
            return
        for i, block in enumerate(found.blocks):
            yield source_id, i, block.kind, "\n".join(block_lines([block]))

    return map_rows(pages.select(F.col(key).cast("long"), F.col(html)), BLOCKS, rows)


def html_markdown(pages: DataFrame, key: str = "page_id", html: str = "html", article: bool = False, links: bool = True) -> DataFrame:
    """One row per page: whether it converts or why not, title, tallies, Markdown body and its digest."""

    def rows(source_id: int, source: str | None):
        try:
            found = render_html(source or "", article, links)
        except Refusal as refusal:
            yield source_id, False, str(refusal), None, 0, 0, False, None, None, None
            return
        body = body_markdown(found)
        raw = body.encode("utf-8", "surrogatepass")
        yield (
            source_id, True, None, found.title, found.tally.text_regions, found.tally.tables, found.tally.article_fallback, body, len(raw), hashlib.sha256(raw).hexdigest(),
        )

    return map_rows(pages.select(F.col(key).cast("long"), F.col(html)), RENDERED, rows)


LOCATIONS = T.StructType(
    [
        *[T.StructField("source_id", T.LongType()), T.StructField("tag_no", T.IntegerType()), T.StructField("tag", T.StringType())],
        *[T.StructField("attribute", T.StringType()), T.StructField("nth", T.IntegerType()), T.StructField("value", T.StringType())],
        *[T.StructField(n, T.LongType()) for n in ("char_start", "char_end", "byte_start", "byte_end", "line", "column")],
    ]
)
_START_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<([A-Za-z][^\s/>]*+)", re.DOTALL)
_ATTRIBUTE = re.compile(r"[\s/]*+(?:(>)|([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+)))?)")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in ("script", "style", "textarea", "title")}


def _located(source: str):
    """(tag number, tag, attribute or null, how often the tag has had it, value, start, end) of start tags and their attributes."""
    at = count = 0
    while m := _START_TAG.search(source, at):
        at = m.end()
        if not m[1]:
            continue
        count += 1
        tag, begin, seen, found = m[1].lower(), m.start(), {}, []
        while (a := _ATTRIBUTE.match(source, at)) and not a[1]:
            at = a.end()
            name = a[2].lower()
            seen[name] = seen.get(name, 0) + 1
            value = next((v for v in a.groups()[2:] if v is not None), None)
            found.append((count, tag, name, seen[name], None if value is None else _unescape(value), a.start(2), at))
        at = a.end() if a else at
        yield count, tag, None, None, None, begin, at
        yield from found
        if tag in _RAW_END:
            end = _RAW_END[tag].search(source, at)
            at = end.start() if end else len(source)


def html_locations(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Where each start tag and each attribute stands: code points and bytes (end exclusive), line and column from 1, and ``nth`` of equal
    attributes of a tag, of which the first counts."""

    def rows(source_id: int, source: str | None):
        source = source or ""
        lines = [-1, *(m.start() for m in re.finditer("\n", source))]
        found = list(_located(source))
        size, last, bytes_at = 0, 0, {}
        for place in sorted({p for f in found for p in f[5:]}):
            size += len(source[last:place].encode("utf-8", "surrogatepass"))
            last = place
            bytes_at[place] = size
        for n, tag, name, nth, value, start, end in found:
            line = bisect_left(lines, start)
            yield source_id, n, tag, name, nth, value, start, end, bytes_at[start], bytes_at[end], line, start - lines[line - 1]

    return map_rows(pages.select(F.col(key).alias("source_id"), html), LOCATIONS, rows)

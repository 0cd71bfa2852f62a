"""Scanners for targets inside attributes, style sheets, Markdown and structured data."""

from __future__ import annotations

import json
import re
from urllib.parse import unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.html_markdown import css_hidden as _css_hidden
from foliant.functions.html_tree import TEXT, parse

_FIELDS = ("headline", "name", "description", "articleBody", "text", "abstract")  # fixed values: text fields of typed objects
_NAVIGATION = frozenset({"SiteNavigationElement", "BreadcrumbList", "WPHeader", "WPFooter", "WPSideBar"})


def srcset(value: str) -> list[str]:
    """Targets of a ``srcset``: a candidate ends at white space, or at a comma that ends its address."""
    out, at = [], 0
    while m := re.compile(r"[\s,]*([^\s,]\S*)").match(value, at):
        target, at = m[1], m.end()
        if target.endswith(","):
            out.append(target.rstrip(","))
            continue
        out.append(target)
        depth = 0
        while at < len(value):
            c = value[at]
            at += 1
            depth += (c == "(") - (c == ")")
            if c == "," and depth <= 0:
                break
    return out


_CSS = re.compile(r"/\*.*?(?:\*/|\Z)|@import\s+(?:url\(\s*)?(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|\burl\(\s*(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|(?:[^\s\"'()\\]|\\.)*)\s*\)|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'", re.IGNORECASE | re.DOTALL)


def css_targets(value: str) -> list[tuple[str, str]]:
    """('import' or 'url', target) of a style sheet; comments and plain strings hold none."""
    out = []
    for m in _CSS.finditer(value):
        raw = m[1] or m[2]
        if not raw:
            continue
        bare = raw[1:-1] if raw[0] in "\"'" else raw
        bare = re.sub(r"\\([0-9A-Fa-f]{1,6})\s?", lambda h: chr(int(h[1], 16)) if int(h[1], 16) < 0x110000 else "\ufffd", bare)
        bare = re.sub(r"\\(.)", r"\1", bare, flags=re.DOTALL)
        out.append(("import" if m[0].lower().startswith("@import") else "url", bare))
    return out


_INERT = re.compile(r"^( {0,3})(`{3,}|~{3,})[^\n]*\n.*?(?:^ {0,3}\2[`~]*[ \t]*$|\Z)|(?<!`)(`+)(?!`)(?:.|\n)*?(?<!`)\3(?!`)|<!--.*?(?:-->|\Z)", re.MULTILINE | re.DOTALL)
_DEFINITION = re.compile(r"^ {0,3}\[([^\]\[]+)\]:[ \t]*(?:<([^<>\n]*)>|(\S+))", re.MULTILINE)
_LINK = re.compile(r"(!?)\[((?:[^\[\]\\]|\\.|\[[^\[\]]*\])*)\](?:\(\s*(?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\([^\s()]*\))*))(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?\s*\)|\[([^\[\]]*)\])?")
_AUTO = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*)>")
_BARE = re.compile(r"(?<![\w/(<\[\"'])https?://[^\s<>\[\]]+")


def markdown_links(source: str) -> list[tuple[str, str]]:
    """(kind, target) in order: link, image, reference, autolink, bare; code and comments are inert, the first definition wins."""
    text = _INERT.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)
    fold = lambda s: re.sub(r"\s+", " ", s.strip()).casefold()
    labels: dict[str, str] = {}
    for m in _DEFINITION.finditer(text):
        labels.setdefault(fold(m[1]), m[2] if m[2] is not None else m[3])
    text = _DEFINITION.sub(lambda m: " " * len(m[0]), text)
    found: list[tuple[int, str, str]] = []
    for m in _LINK.finditer(text):
        if m.start() and text[m.start() - 1] == "\\":
            continue
        direct = m[3] if m[3] is not None else m[4]
        if direct is not None:
            found.append((m.start(), "image" if m[1] else "link", re.sub(r"\\(.)", r"\1", direct)))
        elif (label := fold(m[5] or m[2])) in labels:
            found.append((m.start(), "reference", labels[label]))
    found += [(m.start(), "autolink", m[1]) for m in _AUTO.finditer(text)]
    covered = [(m.start(), m.end()) for p in (_LINK, _AUTO) for m in p.finditer(text)]
    found += [(m.start(), "bare", m[0].rstrip(".,;:!?)")) for m in _BARE.finditer(text) if not any(a <= m.start() < z for a, z in covered)]
    return [(kind, target) for _, kind, target in sorted(found)]


def json_ld_texts(value) -> list[str]:
    """Text fields of typed objects in document order; site navigation is passed over."""
    out: list[str] = []
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, list):
            stack += reversed(v)
        elif isinstance(v, dict):
            kinds = v.get("@type", [])
            kinds = kinds if isinstance(kinds, list) else [kinds]
            if _NAVIGATION & {k for k in kinds if isinstance(k, str)}:
                continue
            if kinds:
                out += [v[f].strip() for f in _FIELDS if isinstance(v.get(f), str) and v[f].strip()]
            stack += reversed([x for x in v.values() if isinstance(x, dict | list)])
    return out


def embedded_texts(html: str) -> list[str]:
    """What a page without visible content says of itself: description, structured data and noscript, each text once."""
    found: list[str] = []
    title = ""
    for node in parse(html).walk():
        text = " ".join("".join(c.text for c in node.walk() if c.tag == TEXT).split()) if node.tag in ("title", "noscript") else ""
        if node.tag == "title":
            title = title or text
        elif node.tag == "noscript" and text:
            found.append(re.sub(r"<[^>]*>", " ", text))
        elif node.tag == "meta" and node.attrs.get("name", node.attrs.get("property", "")).lower() in ("description", "og:description"):
            found.append(" ".join(node.attrs.get("content", "").split()))
        elif node.tag == "script" and node.attrs.get("type", "").lower() == "application/ld+json":
            try:
                found += json_ld_texts(json.loads("".join(c.text for c in node.children)))
            except ValueError:
                continue
    return [t for t in dict.fromkeys(" ".join(t.split()) for t in found) if t and t != title]


def resolve_url(base: str, ref: str) -> str | None:
    """A reference against its base, http and https only."""
    try:
        url = urljoin(base, ref.strip(" \t\r\n\f"))
        return url if urlsplit(url).scheme in ("http", "https") else None
    except ValueError:
        return None


def resolve_internal(source: str, target: str) -> str | None:
    """A package-internal target relative to a member, without leaving the package."""
    path = unquote(target.split("#", 1)[0].split("?", 1)[0])
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) or "\\" in path or "\0" in path:
        return None
    parts = [] if path.startswith("/") else source.split("/")[:-1] if path else source.split("/")
    for piece in path.split("/"):
        if piece == "..":
            if not parts:
                return None
            parts.pop()
        elif piece not in ("", "."):
            parts.append(piece)
    return "/".join(parts)


_TARGETS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("target", T.StringType())]))


def register(spark: SparkSession) -> list[str]:
    """Register the scanners as SQL functions, Arrow-batched; returns their names."""

    def each(function, kind):
        def run(s: pd.Series) -> pd.Series:
            return pd.Series([None if v is None else function(v) for v in s], dtype=object)

        return F.pandas_udf(run, kind, F.PandasUDFType.SCALAR)

    def resolve(base: pd.Series, ref: pd.Series) -> pd.Series:
        return pd.Series([None if b is None or r is None else resolve_url(b, r) for b, r in zip(base, ref)], dtype=object)

    functions = {
        "srcset_targets": each(srcset, T.ArrayType(T.StringType())),
        "css_targets": each(lambda v: [{"kind": k, "target": t} for k, t in css_targets(v)], _TARGETS),
        "markdown_links": each(lambda v: [{"kind": k, "target": t} for k, t in markdown_links(v)], _TARGETS),
        "embedded_texts": each(embedded_texts, T.ArrayType(T.StringType())),
        "css_hidden": each(_css_hidden, T.BooleanType()),
        "resolve_url": F.pandas_udf(resolve, T.StringType(), F.PandasUDFType.SCALAR),
    }
    for name, function in functions.items():
        spark.udf.register(name, function)
    return sorted(functions)

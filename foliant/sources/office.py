"""Word-processing, presentation and e-book packages as units of blocks."""

from __future__ import annotations

import posixpath
import re
import xml.etree.ElementTree as ET
from urllib.parse import unquote

from foliant.functions import markdown as md
from foliant.functions.html_markdown import Block, Refusal, Tally, blocks_of
from foliant.functions.html_tree import parse
from foliant.functions.sanitise import sanitise
from foliant.sources.packages import Package, local, resolve_part

Unit = tuple[str, list[Block]]
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_X = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
_T = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
_D = "{urn:oasis:names:tc:opendocument:xmlns:drawing:1.0}"
_PR = "{urn:oasis:names:tc:opendocument:xmlns:presentation:1.0}"
_O = "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}"


def _ascii(text: str) -> str:
    return sanitise(text)[0]


def _text_block(text: str, level: int = 0) -> Block | None:
    text = text.strip()
    return Block("text", md.text_lines(md.escape(text).replace("\x00", "\n") if "\n" not in text else "\n".join(map(md.escape, text.split("\n"))), level)) if text else None


# -- DOCX
def _doc_text(node: ET.Element) -> str:
    out = []
    skip: set[ET.Element] = set()
    for e in node.iter():
        if e in skip:
            continue
        name = local(e.tag)
        if name in ("AlternateContent",):
            choices = [c for c in e if local(c.tag) == "Choice"]
            for c in choices:
                skip.update(c.iter())
        elif name == "t":
            out.append(e.text or "")
        elif name == "tab" and e.tag.startswith(_W):
            out.append("\t")
        elif name in ("br", "cr") and e.tag.startswith(_W):
            out.append("\n")
    return _ascii("".join(out))


def _doc_level(p: ET.Element) -> int:
    style = p.find(f"{_W}pPr/{_W}pStyle")
    m = re.fullmatch(r"[Hh]eading ?([1-9])", style.get(f"{_W}val", "")) if style is not None else None
    return min(int(m[1]), 6) if m else 0


def docx_units(raw: bytes) -> list[Unit]:
    """Chapters that begin at headings; what stands before the first is the body."""
    package = Package(raw)
    body = package.xml(package.main_part()).find(f"{_W}body")
    if body is None:
        raise Refusal("document body missing")
    units: list[Unit] = []
    for e in body:
        if e.tag == f"{_W}p":
            text, level = _doc_text(e), _doc_level(e)
            if level and text.strip():
                units.append((re.sub(r"\s+", " ", text).strip(), []))
            if not units:
                units.append(("Body", []))
            if block := _text_block(text, level):
                units[-1][1].append(block)
        elif e.tag == f"{_W}tbl":
            if not units:
                units.append(("Body", []))
            rows = []
            for tr in e.findall(f"{_W}tr"):
                row: list[str] = []
                for tc in tr.findall(f"{_W}tc"):
                    span = tc.find(f"{_W}tcPr/{_W}gridSpan")
                    merge = tc.find(f"{_W}tcPr/{_W}vMerge")
                    text = " ".join(x for p in tc.iter(f"{_W}p") if (x := " ".join(_doc_text(p).split())))
                    row.append("" if merge is not None and merge.get(f"{_W}val", "continue") == "continue" else md.escape(text))
                    row += [""] * (int(span.get(f"{_W}val", "1")) - 1 if span is not None else 0)
                rows.append(row)
            if lines := md.table(rows):
                units[-1][1].append(Block("table", lines))
    return units


# -- PPTX
def _drawing_text(node: ET.Element) -> list[str]:
    lines = []
    for p in node.iter(f"{_A}p"):
        parts = []
        for e in p.iter():
            if e.tag == f"{_A}t":
                parts.append(e.text or "")
            elif e.tag == f"{_A}br":
                parts.append("\n")
        if text := _ascii("".join(parts)).strip():
            lines.append(text)
    return lines


def pptx_units(raw: bytes) -> list[Unit]:
    """Slides in declared order, hidden ones too, with tables, picture descriptions and notes."""
    package = Package(raw)
    main = package.main_part()
    rels = {r[0]: r for r in package.relationships(main)}
    units: list[Unit] = []
    for n, sid in enumerate(package.xml(main).iter(f"{_P}sldId"), 1):
        rel = rels.get(sid.get(f"{_R}id", ""))
        if rel is None or rel[4] is None or not rel[1].endswith("/slide"):
            raise Refusal(f"slide relationship missing: {n}")
        root, label, blocks = package.xml(rel[4]), f"Slide {n}", []
        for shape in root.iter():
            if shape.tag == f"{_P}sp":
                lines = _drawing_text(shape)
                holder = next(shape.iter(f"{_P}ph"), None)
                title = holder is not None and holder.get("type") in ("title", "ctrTitle") and bool(lines)
                if title:
                    label = " ".join(" ".join(lines).split())
                blocks += [b for i, x in enumerate(lines) if (b := _text_block(x, 1 if title and i == 0 else 0))]
            elif shape.tag == f"{_A}tbl":
                rows = [["" if c.get("hMerge") or c.get("vMerge") else md.escape(" ".join(_drawing_text(c))) for c in tr.findall(f"{_A}tc")] for tr in shape.findall(f"{_A}tr")]
                if lines := md.table(rows):
                    blocks.append(Block("table", lines))
            elif shape.tag == f"{_P}pic" and (p := next(shape.iter(f"{_P}cNvPr"), None)) is not None and p.get("descr"):
                blocks.append(Block("text", [f"Picture: {md.escape(_ascii(p.get('descr', '')))}"]))
        for r in package.relationships(rel[4]):
            if r[1].endswith("/notesSlide") and r[4]:
                for shape in package.xml(r[4]).iter(f"{_P}sp"):
                    holder = next(shape.iter(f"{_P}ph"), None)
                    if holder is not None and holder.get("type") == "body" and (lines := _drawing_text(shape)):
                        blocks += [Block("text", ["Notes:"]), *(b for x in lines if (b := _text_block(x)))]
        units.append((label, blocks))
    return units


# -- ODF
def _odf_text(node: ET.Element) -> str:
    out = [node.text or ""]
    for e in node:
        name = local(e.tag)
        if name == "s":
            out.append(" " * int(e.get(f"{_X}c", "1")))
        elif name == "tab":
            out.append("\t")
        elif name == "line-break":
            out.append("\n")
        elif name not in ("annotation", "note", "frame"):
            out.append(_odf_text(e))
        out.append(e.tail or "")
    return "".join(out)


def _odf_body(raw: bytes, kind: str) -> ET.Element:
    package = Package(raw)
    names = package.names
    if any(names.count(n) != 1 for n in ("mimetype", "content.xml", "META-INF/manifest.xml")):
        raise Refusal("OpenDocument members missing or repeated")
    if b"encryption-data" in package.read("META-INF/manifest.xml"):
        raise Refusal("encrypted OpenDocument")
    if kind.encode() not in package.read("mimetype"):
        raise Refusal("OpenDocument type differs from its suffix")
    body = package.xml("content.xml").find(f"{_O}body/{_O}{'text' if kind == 'text' else 'presentation'}")
    if body is None:
        raise Refusal("OpenDocument body missing")
    return body


def _odf_blocks(node: ET.Element) -> list[Block]:
    blocks: list[Block] = []
    for e in node:
        name = local(e.tag)
        if name in ("p", "h"):
            level = int(e.get(f"{_X}outline-level", "1")) if name == "h" else 0
            if block := _text_block(_odf_text(e), min(level, 6)):
                blocks.append(block)
        elif name == "list":
            items = [("- ", _odf_blocks(i)) for i in e if local(i.tag) == "list-item"]
            if items:
                blocks.append(Block("list", items=items))
        elif name == "table":
            rows = []
            for tr in e.iter(f"{_T}table-row"):
                row: list[str] = []
                for c in tr:
                    if local(c.tag) in ("table-cell", "covered-table-cell"):
                        text = " ".join(md.escape(_odf_text(p)) for p in c.findall(f"{_X}p"))
                        row += [text] * min(int(c.get(f"{_T}number-columns-repeated", "1")), 1024 if text else 1)
                rows += [row] * min(int(tr.get(f"{_T}number-rows-repeated", "1")), 1024 if any(row) else 1)
            if lines := md.table(rows):
                blocks.append(Block("table", lines))
        elif name in ("section", "text-box", "frame", "g", "custom-shape", "list-item", "list-header", "index-body", "table-of-content"):
            blocks += _odf_blocks(e)
    return blocks


def odt_units(raw: bytes) -> list[Unit]:
    units: list[Unit] = []
    for block, heading in _odf_marked(_odf_body(raw, "text")):
        if heading or not units:
            units.append((heading or "Body", []))
        units[-1][1].append(block)
    return units


def _odf_marked(body: ET.Element):
    for e in body:
        heading = " ".join(_odf_text(e).split()) if local(e.tag) == "h" else ""
        holder = ET.Element("x")
        holder.append(e)
        for block in _odf_blocks(holder):
            yield block, heading


def odp_units(raw: bytes) -> list[Unit]:
    units: list[Unit] = []
    for n, page in enumerate(_odf_body(raw, "presentation").findall(f"{_D}page"), 1):
        label, blocks = f"Slide {n}", []
        for frame in page:
            kind = frame.get(f"{_PR}class", "")
            if kind in ("header", "footer", "date-time", "page-number"):
                continue
            own = _odf_blocks(frame)
            if kind == "title" and own and own[0].lines:
                label = " ".join(" ".join(_odf_text(p) for p in frame.iter(f"{_X}p")).split())
                own[0] = Block("text", md.text_lines(own[0].lines[0], 1))
            blocks += own
        units.append((label, blocks))
    return units


# -- EPUB
def epub_units(raw: bytes) -> list[Unit]:
    """Chapters in spine order; an item that isn't XHTML is followed along its fallbacks."""
    package = Package(raw)
    for name in package.names:
        if name.startswith("/") or ".." in name.split("/"):
            raise Refusal(f"unsafe package member: {name}")
    container = package.xml("META-INF/container.xml")
    root = next((e.get("full-path") for e in container.iter() if local(e.tag) == "rootfile"), None)
    if not root:
        raise Refusal("publication package missing")
    if "META-INF/encryption.xml" in package.names and any(
        local(e.tag) == "EncryptionMethod" and "obfuscation" not in e.get("Algorithm", "").lower() and "embedding" not in e.get("Algorithm", "").lower()
        for e in package.xml("META-INF/encryption.xml").iter()
    ):
        raise Refusal("encrypted publication")
    opf = package.xml(root)
    manifest = {e.get("id", ""): e for e in opf.iter() if local(e.tag) == "item"}
    labels = _epub_labels(package, root, manifest, opf)
    units: list[Unit] = []
    for ref in (e for e in opf.iter() if local(e.tag) == "itemref"):
        item, seen = manifest.get(ref.get("idref", "")), set()
        while item is not None and item.get("media-type") != "application/xhtml+xml":
            if item.get("id") in seen:
                raise Refusal("publication fallback cycle")
            seen.add(item.get("id"))
            item = manifest.get(item.get("fallback", ""))
        if item is None:
            raise Refusal(f"spine item without readable content: {ref.get('idref')}")
        part = resolve_part(root, unquote(item.get("href", "")))
        tree = parse(package.read(part or "").decode("utf-8-sig", "replace"))
        html = next(c for c in tree.children if c.tag == "html")
        body = next(c for c in html.children if c.tag == "body")
        texts = ("".join(t.text for t in n.walk() if t.tag == "-text").strip() for tag in ("title", "h1", "h2") for n in html.walk() if n.tag == tag)
        label = labels.get(part or "") or next((" ".join(t.split()) for t in texts if t), f"Chapter {len(units) + 1}")
        units.append((label, blocks_of([body], Tally())))
    return units


def _epub_labels(package: Package, root: str, manifest: dict[str, ET.Element], opf: ET.Element) -> dict[str, str]:
    """Part to the first label that the navigation document, else the NCX, gives it."""
    labels: dict[str, str] = {}
    nav = next((i for i in manifest.values() if "nav" in i.get("properties", "").split()), None)
    if nav is not None and (part := resolve_part(root, unquote(nav.get("href", "")))):
        for a in (n for n in parse(package.read(part).decode("utf-8-sig", "replace")).walk() if n.tag == "a" and n.attrs.get("href")):
            target = resolve_part(part, unquote(a.attrs["href"]))
            text = " ".join("".join(t.text for t in a.walk() if t.tag == "-text").split())
            if target and text:
                labels.setdefault(target, text)
    ncx = next((i for i in manifest.values() if i.get("media-type") == "application/x-dtbncx+xml"), None)
    if not labels and ncx is not None and (part := resolve_part(root, unquote(ncx.get("href", "")))):
        for point in (e for e in package.xml(part).iter() if local(e.tag) == "navPoint"):
            text = next((" ".join((e.text or "").split()) for e in point.iter() if local(e.tag) == "text"), "")
            src = next((e.get("src", "") for e in point.iter() if local(e.tag) == "content"), "")
            if (target := resolve_part(part, unquote(src))) and text:
                labels.setdefault(target, text)
    return {posixpath.normpath(k): v for k, v in labels.items()}

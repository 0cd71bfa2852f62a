"""Artifacts of documents: formulas as JSON, macro projects and their modules, attachments and data URLs, with exact bytes."""

from __future__ import annotations

import hashlib
import json
import struct

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foliant.functions.arrow import map_rows
from foliant.functions.html_markdown import Refusal
from foliant.functions.html_tree import parse
from foliant.sources import mail
from foliant.sources.charset import decode_html
from foliant.sources.compound import MAGIC, Compound, data_url, decompress_vba
from foliant.sources.packages import Package
from foliant.sources.workbooks import cell_rows, letters

ARTIFACTS = T.StructType(
    [
        T.StructField("source_id", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("media_type", T.StringType()),
        T.StructField("count", T.LongType()),
        T.StructField("byte_size", T.LongType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("content", T.BinaryType()),
    ]
)
PROJECT_BYTES = 16 << 20


def vba_modules(project: bytes) -> list[tuple[str, str]]:
    """(name, source) of each module of a macro project, in directory order."""
    streams = {path.lower(): content for _, path, kind, _, content, _ in Compound(project).entries() if kind == "stream"}
    folder = next((p[: -len("dir")] for p in streams if p.endswith("vba/dir") or p == "dir"), None)
    if folder is None or streams[f"{folder}dir"] is None:
        raise Refusal("macro project directory missing")
    data, at, codec = decompress_vba(streams[f"{folder}dir"]), 0, "cp1252"
    name = stream = ""
    out: list[tuple[str, str]] = []
    while at + 6 <= len(data):
        kind, size = struct.unpack_from("<HI", data, at)
        if kind == 0x09:  # the version record is two bytes longer than it says
            size += 2
        body = data[at + 6 : at + 6 + size]
        at += 6 + size
        if kind == 0x03 and len(body) == 2:
            codec = {65001: "utf-8", 10000: "mac_roman"}.get(page := struct.unpack("<H", body)[0], f"cp{page}")
        elif kind == 0x19:
            name = body.decode(codec, "replace")
        elif kind == 0x1A:
            stream = body.decode(codec, "replace")
        elif kind == 0x31 and len(body) == 4:
            raw = streams.get(f"{folder}{stream or name}".lower())
            if raw is None:
                raise Refusal(f"macro module missing: {name}")
            out.append((name, decompress_vba(raw[struct.unpack("<I", body)[0] :]).decode(codec, "replace")))
            stream = ""
    return out


def _found(route: str | None, suffix: str, raw: bytes):
    """(key, kind, location, media type, count, bytes)."""
    if route == "sheet":
        by_sheet: dict[tuple[int, str], list[dict]] = {}
        for ordinal, sheet, _, row, col, _, value, formula, state in cell_rows(raw, suffix):
            if formula:
                by_sheet.setdefault((ordinal, sheet), []).append({"cache": state, "cell": f"{letters(col)}{row}", "formula": formula, "value": value})
        for (ordinal, sheet), cells in sorted(by_sheet.items()):
            body = json.dumps({"cells": cells, "sheet": sheet}, ensure_ascii=True, sort_keys=True, separators=(",", ":")).encode()
            yield f"formulas/sheet-{ordinal:06d}", "formulas", f"unit-sheet-{ordinal:06d}", "application/json", len(cells), body
    projects: list[tuple[str, bytes]] = []
    if raw[:2] == b"PK" and route in ("sheet", "docx", "pptx"):
        package = Package(raw)
        projects = [(n, package.read(n)) for n in package.names if n.lower().endswith("vbaproject.bin")]
    elif raw[:8] == MAGIC and any(p.lower().endswith("vba/dir") for _, p, *_ in Compound(raw).entries()):
        projects = [("compound", raw)]
    for part, project in projects:
        if len(project) > PROJECT_BYTES:
            raise Refusal(f"macro project byte limit exceeded: {PROJECT_BYTES}")
        if part != "compound":
            yield "vba-project", "vba-project", part, "application/vnd.ms-office.vbaProject", 1, project
        for name, source in vba_modules(project):
            yield f"vba-module/{name}", "vba-module", part, "text/plain; charset=utf-8", None, source.encode("utf-8", "replace")
    if route == "eml":
        for path, _, p in mail.parts_of(raw):
            if not p.is_multipart() and (p.get_content_disposition() == "attachment" or p.get_filename()):
                yield f"attachment/{path}", "attachment", f"mime/{path}", p.get_content_type(), None, p.get_payload(decode=True) or b""
    if route == "html":
        n = 0
        for node in parse(decode_html(raw)[0]).walk():
            for name in ("src", "href", "data"):
                if (value := node.attrs.get(name)) and (made := data_url(value)):
                    n += 1
                    yield f"data-url/{n:06d}", "data-url", f"{node.tag}@{name}", made[0], None, made[1]


def artifacts(sources: DataFrame) -> DataFrame:
    """Every artifact of each source; select without ``content`` for the inventory. A refused source has one row of kind ``refused``."""

    def rows(source_id: int, route: str | None, suffix: str, content: bytes | None):
        try:
            for key, kind, location, media, count, body in list(_found(route, suffix, content or b"")):
                yield source_id, key, kind, location, media, count, len(body), hashlib.sha256(body).hexdigest(), body
        except (Refusal, ValueError, LookupError, OSError, EOFError, struct.error) as exc:
            yield source_id, None, "refused", str(exc), None, None, None, None, None

    return map_rows(sources.select("source_id", "route", "suffix", "content"), ARTIFACTS, rows, most=64)


def selected(found: DataFrame, requested: DataFrame) -> DataFrame:
    """Artifacts by requested key (source_id, key)."""
    return found.join(requested, ["source_id", "key"], "left_semi")

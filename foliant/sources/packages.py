"""ZIP packages: members under budgets, admitted XML, OPC relationships. Limits refuse; they never cut a document short."""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foliant.functions.arrow import map_rows
from foliant.functions.html_markdown import Refusal

#: Bytes of a member, of a package, XML depth and elements.
MEMBER_BYTES, PACKAGE_BYTES, XML_DEPTH, XML_ELEMENTS = 32 << 20, 256 << 20, 16_384, 2_097_152
RELS = "{http://schemas.openxmlformats.org/package/2006/relationships}"
MEMBERS = T.StructType(
    [
        T.StructField("source_id", T.LongType()),
        T.StructField("member_ordinal", T.IntegerType()),
        T.StructField("part", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("crc32", T.LongType()),
        T.StructField("compression", T.IntegerType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("reason", T.StringType()),
    ]
)
RELATIONSHIPS = T.StructType(
    [
        T.StructField("source_id", T.LongType()),
        T.StructField("source_part", T.StringType()),
        T.StructField("rid", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("external", T.BooleanType()),
        T.StructField("resolved", T.StringType()),
        T.StructField("ord", T.IntegerType()),
    ]
)


class Package:
    """Members of a ZIP file, read under one budget."""

    def __init__(self, raw: bytes) -> None:
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(raw))
        except (zipfile.BadZipFile, ValueError, OSError) as exc:
            raise Refusal(f"package unreadable: {exc}") from exc
        self.used = 0

    @property
    def names(self) -> list[str]:
        return self.zip.namelist()

    def read(self, part: str) -> bytes:
        if part not in self.zip.NameToInfo:
            raise Refusal(f"package part missing: {part}")
        info = self.zip.getinfo(part)
        if info.flag_bits & 1:
            raise Refusal(f"encrypted package part: {part}")
        if info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise Refusal(f"unsupported compression: {part}")
        try:
            with self.zip.open(info) as f:
                data = f.read(MEMBER_BYTES + 1)
        except (zipfile.BadZipFile, OSError, EOFError, ValueError) as exc:
            raise Refusal(f"package part unreadable: {part}: {exc}") from exc
        self.used += len(data)
        if len(data) > MEMBER_BYTES or self.used > PACKAGE_BYTES:
            raise Refusal(f"package byte limit exceeded: {part}")
        return data

    def xml(self, part: str) -> ET.Element:
        return admit_xml(self.read(part), part)

    def relationships(self, part: str) -> list[tuple[str, str, str, bool, str | None]]:
        """(id, type, target, external, resolved part) declared for a part, in order."""
        rels = posixpath.join(posixpath.dirname(part), "_rels", posixpath.basename(part) + ".rels").lstrip("/")
        if rels not in self.zip.NameToInfo:
            return []
        out = []
        for e in self.xml(rels).iter(f"{RELS}Relationship"):
            external = e.get("TargetMode") == "External"
            target = e.get("Target", "")
            out.append((e.get("Id", ""), e.get("Type", ""), target, external, None if external else resolve_part(part, target)))
        return out

    def main_part(self) -> str:
        found = [r[4] for r in self.relationships("") if r[1].endswith("/officeDocument") and r[4]]
        if not found:
            raise Refusal("package main part missing")
        return found[-1]


def resolve_part(base: str, target: str) -> str | None:
    """A target relative to a part, without leaving the package."""
    path = target.split("#", 1)[0]
    joined = path.lstrip("/") if path.startswith("/") else posixpath.join(posixpath.dirname(base), path)
    clean = posixpath.normpath(joined)
    return None if clean.startswith("..") or clean == "." else clean


def admit_xml(data: bytes, part: str) -> ET.Element:
    """Parsed XML without a document type, within depth and element limits."""
    if re.search(rb"<!\s*(DOCTYPE|ENTITY)", data[:65536], re.IGNORECASE):
        raise Refusal(f"XML document type refused: {part}")
    depth = elements = 0
    try:
        parser = ET.XMLPullParser(("start", "end"))
        for at in range(0, len(data), 1 << 16):
            parser.feed(data[at : at + (1 << 16)])
            for event, element in parser.read_events():
                depth += 1 if event == "start" else -1
                elements += event == "start"
                if depth > XML_DEPTH or elements > XML_ELEMENTS:
                    raise Refusal(f"XML limit exceeded: {part}")
                root = element
        parser.close()
    except ET.ParseError as exc:
        raise Refusal(f"XML unreadable: {part}: {exc}") from exc
    if not elements:
        raise Refusal(f"XML unreadable: {part}")
    return root


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def members(sources: DataFrame) -> DataFrame:
    """Every member of each package; one that can't be read has a reason in place of its content."""

    def rows(source_id: int, content: bytes | None):
        try:
            package = Package(content or b"")
        except Refusal as r:
            yield source_id, None, None, None, None, None, None, str(r)
            return
        for i, info in enumerate(package.zip.infolist()):
            data = reason = None
            try:
                data = package.read(info.filename)
            except Refusal as r:
                reason = str(r)
            yield source_id, i, info.filename, info.file_size, info.CRC, info.compress_type, data, reason

    return map_rows(sources.select("source_id", "content"), MEMBERS, rows, most=64)


def relationships(sources: DataFrame) -> DataFrame:
    """Every relationship of each package with its resolved part."""

    def rows(source_id: int, content: bytes | None):
        try:
            package = Package(content or b"")
            n = 0
            for name in package.names:
                if name.endswith(".rels"):
                    folder, base = posixpath.split(name)
                    part = posixpath.join(posixpath.dirname(folder), base[: -len(".rels")])
                    for rid, kind, target, external, resolved in package.relationships(part):
                        yield source_id, part, rid, kind, target, external, resolved, n
                        n += 1
        except Refusal:
            return

    return map_rows(sources.select("source_id", "content"), RELATIONSHIPS, rows)

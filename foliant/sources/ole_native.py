"""Objects that an old container keeps in its native stream: packages with their names, links, and plain data."""

from __future__ import annotations

import struct
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foliant.functions.arrow import map_rows

STREAM = "\x01Ole10Native"
# The two kinds of package object.
LINKED, EMBEDDED = 1, 3
PAYLOADS = T.StructType(
    [
        *[T.StructField("source_id", T.LongType()), T.StructField("path", T.StringType())],
        *[T.StructField(n, T.StringType()) for n in ("status", "label", "source_path", "reason")],
        T.StructField("payload", T.BinaryType()),
    ]
)


@dataclass(frozen=True)
class Native:
    """``status`` is embedded, linked, unsupported or invalid; a reason stands beside the last two."""

    status: str
    label: str | None = None
    source_path: str | None = None
    payload: bytes | None = None
    reason: str | None = None


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def number(self, layout: str) -> int:
        size = struct.calcsize(layout)
        if self.at + size > len(self.data):
            raise ValueError("native stream cut short")
        self.at += size
        return struct.unpack_from(layout, self.data, self.at - size)[0]

    def bytes(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("native stream cut short")
        self.at += n
        return self.data[self.at - n : self.at]

    def name(self) -> str:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise ValueError("name without an end")
        return self.bytes(end + 1 - self.at)[:-1].decode("latin-1")

    def wide(self) -> str:
        return self.bytes(2 * self.number("<I")).decode("utf-16-le", "replace").rstrip("\0")


def unwrap(data: bytes) -> Native:
    """What a native stream holds. Its first number must be the size of the rest; names in Unicode win over single-byte ones."""
    r = _Reader(data)
    try:
        if r.number("<I") != len(data) - 4:
            return Native("invalid", reason="size differs from the stream's")
        if data[4:6] != b"\x02\x00":
            return Native("embedded", payload=data[4:])
        r.at = 6
        label, source = r.name(), r.name()
        r.number("<H")
        kind = r.number("<H")
        if kind not in (LINKED, EMBEDDED):
            return Native("unsupported", label, source, reason=f"package object of kind {kind}")
        if r.at < len(data):
            r.bytes(r.number("<I"))  # where it was opened from for a while
        if kind == LINKED:
            return Native("linked", label, source)
        payload = r.bytes(r.number("<I"))
        if data[r.at :] not in (b"", b"\0\0"):
            r.wide()
            if r.at < len(data):
                label, source = r.wide(), r.wide()
        if data[r.at :].strip(b"\0"):
            return Native("invalid", label, source, reason="bytes after the package")
        return Native("embedded", label, source, payload)
    except ValueError as exc:
        return Native("invalid", reason=str(exc))


def native_payloads(entries: DataFrame) -> DataFrame:
    """Payloads of the native streams among entries of compound files (source_id, path, kind, content)."""

    def rows(source_id: int, path: str, content: bytes | None):
        n = unwrap(content or b"")
        yield source_id, path, n.status, n.label, n.source_path, n.reason, n.payload

    streams = entries.where("kind = 'stream'").where(entries["path"].endswith(STREAM))
    return map_rows(streams.select("source_id", "path", "content"), PAYLOADS, rows, most=64)

"""Compound files (OLE2): directory entries and streams, with every chain checked."""

from __future__ import annotations

import base64
import struct
from urllib.parse import unquote_to_bytes

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foliant.functions.arrow import map_rows
from foliant.functions.html_markdown import Refusal

FREE, END, FAT, DIFAT = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD, 0xFFFFFFFC
MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
ENTRIES = T.StructType(
    [
        T.StructField("source_id", T.LongType()),
        T.StructField("entry", T.IntegerType()),
        T.StructField("path", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("reason", T.StringType()),
    ]
)


class Compound:
    def __init__(self, data: bytes) -> None:
        if len(data) < 512 or data[:8] != MAGIC:
            raise Refusal("compound file header missing")
        self.data = data
        shift, mini = struct.unpack_from("<HH", data, 30)
        if shift not in (9, 12) or mini != 6:
            raise Refusal("compound file sector size refused")
        self.size = 1 << shift
        self.fat_count, self.dir_start = struct.unpack_from("<I", data, 44)[0], struct.unpack_from("<I", data, 48)[0]
        self.cutoff, self.mini_start, _, difat, n_difat = struct.unpack_from("<5I", data, 56)
        places = [p for p in struct.unpack_from("<109I", data, 76) if p < DIFAT]
        seen: set[int] = set()
        while difat < DIFAT and n_difat:
            if difat in seen:
                raise Refusal("compound file sector chain loops")
            seen.add(difat)
            block = struct.unpack(f"<{self.size // 4}I", self.sector(difat))
            places += [p for p in block[:-1] if p < DIFAT]
            difat = block[-1]
        self.fat = [x for p in places for x in struct.unpack(f"<{self.size // 4}I", self.sector(p))]
        self.directory = self.chain(self.dir_start)
        self.mini_fat: list[int] = []
        if self.mini_start < DIFAT:
            raw = self.chain(self.mini_start)
            self.mini_fat = list(struct.unpack(f"<{len(raw) // 4}I", raw))
        root = self.entry(0)
        self.mini = self.chain(root[3])[: root[4]] if root[3] < DIFAT else b""

    def sector(self, n: int) -> bytes:
        part = self.data[(n + 1) * self.size : (n + 2) * self.size]
        if len(part) < self.size:
            if not part:
                raise Refusal("compound file sector missing")
            part += bytes(self.size - len(part))
        return part

    def chain(self, start: int) -> bytes:
        out, seen = [], set()
        while start < DIFAT:
            if start in seen or start >= len(self.fat):
                raise Refusal("compound file sector chain broken")
            seen.add(start)
            out.append(self.sector(start))
            start = self.fat[start]
        return b"".join(out)

    def entry(self, n: int) -> tuple[str, int, tuple[int, int, int], int, int]:
        raw = self.directory[n * 128 : n * 128 + 128]
        if len(raw) < 128:
            raise Refusal("compound file directory entry missing")
        length = struct.unpack_from("<H", raw, 64)[0]
        name = raw[: max(0, length - 2)].decode("utf-16-le", "replace")
        left, right, child = struct.unpack_from("<3I", raw, 68)
        start, size = struct.unpack_from("<I", raw, 116)[0], struct.unpack_from("<Q", raw, 120)[0]
        return name, raw[66], (left, right, child), start, size & 0xFFFFFFFF if self.size == 512 else size

    def stream(self, start: int, size: int) -> bytes:
        if size >= self.cutoff:
            raw = self.chain(start)
        else:
            out, seen = [], set()
            while start < DIFAT:
                if start in seen or start >= len(self.mini_fat):
                    raise Refusal("compound file mini chain broken")
                seen.add(start)
                out.append(self.mini[start * 64 : start * 64 + 64])
                start = self.mini_fat[start]
            raw = b"".join(out)
        if len(raw) < size:
            raise Refusal("compound file stream cut short")
        return raw[:size]

    def entries(self):
        """(entry, path, kind, size, content or None, reason or None), the tree in name order."""
        stack, seen = [(self.entry(0)[2][2], "")], set()
        while stack:
            n, above = stack.pop()
            if n >= DIFAT:
                continue
            if n in seen:
                raise Refusal("compound file directory loops")
            seen.add(n)
            name, kind, (left, right, child), start, size = self.entry(n)
            path = f"{above}/{name}" if above else name
            stack += [(right, above), (child if kind == 1 else FREE, path), (left, above)]
            if kind == 2:
                try:
                    yield n, path, "stream", size, self.stream(start, size) if size else b"", None
                except Refusal as r:
                    yield n, path, "stream", size, None, str(r)
            elif kind == 1:
                yield n, path, "storage", 0, None, None


def compound_entries(sources: DataFrame) -> DataFrame:
    """Entries of each compound file; a file that is none has a row with the reason."""

    def rows(source_id: int, content: bytes | None):
        try:
            for e in Compound(content or b"").entries():
                yield source_id, *e
        except Refusal as r:
            yield source_id, None, None, "refused", None, None, str(r)

    return map_rows(sources.select("source_id", "content"), ENTRIES, rows, most=64)


#: Bytes that a VBA container may expand to.
MOST_VBA = 32 << 20


def decompress_vba(data: bytes, most: int = MOST_VBA) -> bytes:
    """The plain bytes of an MS-OVBA compressed container; one that is cut short or expands past ``most`` is refused."""
    if not data or data[0] != 1:
        raise Refusal("VBA container signature missing")
    out, at = bytearray(), 1
    while at < len(data):
        if at + 2 > len(data):
            raise Refusal("VBA chunk header cut short")
        header = struct.unpack_from("<H", data, at)[0]
        end = at + (header & 0xFFF) + 3
        if end > len(data):
            raise Refusal("VBA chunk cut short")
        at += 2
        start = len(out)
        if start > most:
            raise Refusal(f"VBA container expands past {most} bytes")
        if not header & 0x8000:
            out += data[at:end]
            at = end
            continue
        while at < end:
            flags, at = data[at], at + 1
            for bit in range(8):
                if at >= end:
                    break
                if not flags >> bit & 1:
                    out.append(data[at])
                    at += 1
                    continue
                if at + 2 > end:
                    raise Refusal("VBA copy token cut short")
                token = struct.unpack_from("<H", data, at)[0]
                at += 2
                bits = max((len(out) - start - 1).bit_length(), 4)
                length, offset = (token & (0xFFFF >> bits)) + 3, (token >> (16 - bits)) + 1
                if offset > len(out) - start:
                    raise Refusal("VBA copy token out of range")
                for _ in range(length):
                    out.append(out[-offset])
    if len(out) > most:
        raise Refusal(f"VBA container expands past {most} bytes")
    return bytes(out)


def data_url(target: str) -> tuple[str, bytes] | None:
    """(media type, bytes) of a data: URL; null for anything else or for damaged Base64."""
    if target[:5].lower() != "data:" or "," not in target:
        return None
    head, body = target[5:].split(",", 1)
    raw = unquote_to_bytes(body)
    if head.lower().endswith(";base64"):
        head = head[:-7]
        packed = bytes(raw.translate(None, b" \t\r\n\f"))
        if len(packed) % 4 == 0:
            packed = packed.rstrip(b"=") if packed.endswith(b"=") else packed
        try:
            raw = base64.b64decode(packed + b"=" * (-len(packed) % 4), validate=True)
        except ValueError:
            return None
    return head or "text/plain;charset=US-ASCII", raw

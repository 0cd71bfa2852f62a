"""Binary workbooks: BIFF8 streams of .xls files and BIFF12 parts of .xlsb packages, as records and cells."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foliant.functions.arrow import map_rows
from foliant.functions.formula_tokens import ERRORS, Names, formula_text, sheet_label
from foliant.functions.html_markdown import Refusal
from foliant.sources.compound import Compound
from foliant.sources.packages import Package

# Record types of the two formats.
BOF, EOF, SHEET, SST, CONTINUE = 0x0809, 0x000A, 0x0085, 0x00FC, 0x003C
LABELSST, NUMBER, RK, MULRK, BOOLERR, FORMULA, STRING, LABEL, BLANK, MULBLANK, FILEPASS = 0x00FD, 0x0203, 0x027E, 0x00BD, 0x0205, 0x0006, 0x0207, 0x0204, 0x0201, 0x00BE, 0x002F
NAME, EXTERNSHEET, SHRFMLA = 0x0018, 0x0017, 0x04BC
STATES = {0: "visible", 1: "hidden", 2: "veryHidden"}
RECORDS = T.StructType([T.StructField("source_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("type", T.IntegerType()), T.StructField("size", T.IntegerType())])
Cell = tuple[int, str, str, int, int, str, str | None, str | None, str | None]


def records(data: bytes, at: int = 0) -> Iterator[tuple[int, int, bytes]]:
    """(offset, type, payload) of a BIFF stream from an offset on; a record cut short is refused."""
    while at + 4 <= len(data):
        kind, size = struct.unpack_from("<HH", data, at)
        if at + 4 + size > len(data):
            raise Refusal("BIFF record cut short")
        yield at, kind, data[at + 4 : at + 4 + size]
        at += 4 + size


def number_of_rk(rk: int) -> float:
    value = float(struct.unpack("<i", struct.pack("<I", rk))[0] >> 2) if rk & 2 else struct.unpack("<d", bytes(4) + struct.pack("<I", rk & 0xFFFFFFFC))[0]
    return value / 100 if rk & 1 else value


class _Strings:
    """Unicode strings that run over CONTINUE records; each continuation begins with its own width flag inside characters."""

    def __init__(self, parts: list[bytes]) -> None:
        self.parts, self.part, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n:
            if self.part >= len(self.parts):
                raise Refusal("shared strings cut short")
            piece = self.parts[self.part][self.at : self.at + n]
            self.at += len(piece)
            out, n = out + piece, n - len(piece)
            if n:
                self.part, self.at = self.part + 1, 0
        return out

    def string(self) -> str:
        count, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        wide, out = flags & 1, []
        while count:
            if self.part < len(self.parts) and self.at >= len(self.parts[self.part]):
                self.part, self.at = self.part + 1, 0
                wide = self.take(1)[0] & 1
            room = (len(self.parts[self.part]) - self.at) // (2 if wide else 1) if self.part < len(self.parts) else 0
            n = min(count, room)
            if not n:
                raise Refusal("shared strings cut short")
            out.append(self.take(n * 2).decode("utf-16-le", "replace") if wide else self.take(n).decode("latin-1"))
            count -= n
        self.take(4 * runs + extra)
        return "".join(out)


def _short(data: bytes) -> str:
    n, wide = data[0], data[1] & 1
    return data[2 : 2 + n * 2].decode("utf-16-le", "replace") if wide else data[2 : 2 + n].decode("latin-1")


def _long(data: bytes) -> str:
    n, wide = struct.unpack_from("<HB", data)
    return data[3 : 3 + n * 2].decode("utf-16-le", "replace") if wide & 1 else data[3 : 3 + n].decode("latin-1")


def xls_cells(raw: bytes) -> Iterator[Cell]:
    """Cells of a BIFF8 workbook with their cached values and formulas; a formula that can't be decoded is marked by an empty text."""
    book = next((c for _, path, kind, _, c, _ in Compound(raw).entries() if kind == "stream" and path.lower() in ("workbook", "book")), None)
    if book is None:
        raise Refusal("workbook stream missing")
    sheets: list[tuple[int, str, str]] = []
    shared: list[bytes] = []
    last, linked, defined = 0, b"", []
    if book[:2] != struct.pack("<H", BOF):
        raise Refusal("BIFF version refused")
    for _, kind, data in records(book):
        if kind == BOF and struct.unpack_from("<H", data)[0] != 0x0600:
            raise Refusal("BIFF version refused")
        if kind == FILEPASS:
            raise Refusal("encrypted workbook")
        if kind == SHEET and data[5] == 0:
            sheets.append((struct.unpack_from("<I", data)[0], _short(data[6:]), STATES.get(data[4] & 3, "visible")))
        elif kind == SST or kind == CONTINUE and last == SST:
            shared.append(data)
        elif kind == EXTERNSHEET:
            linked = data
        elif kind == NAME:
            defined.append(_defined_name(data))
        if kind != CONTINUE:
            last = kind
        if kind == EOF:
            break
    strings: list[str] = []
    if shared:
        unique = struct.unpack_from("<I", shared[0], 4)[0]
        reader = _Strings([shared[0][8:], *shared[1:]])
        strings = [reader.string() for _ in range(unique)]
    spans = [struct.unpack_from("<Hhh", linked, 2 + 6 * i)[1:] for i in range((len(linked) - 2) // 6)]
    labels = [sheet_label(sheets[a][1], sheets[z][1]) if 0 <= a <= z < len(sheets) else None for a, z in spans]
    for ordinal, (at, name, state) in enumerate(sheets, 1):
        waiting: tuple[int, int, str] | None = None
        depth = 0
        names = Names(defined, labels, _shared_formulas(book, at))
        for _, kind, d in records(book, at):
            depth += (kind == BOF) - (kind == EOF)
            if depth == 0:
                break
            if depth > 1:
                continue
            if kind in (LABELSST, NUMBER, RK, BOOLERR, FORMULA, LABEL, BLANK):
                row, col = (x + 1 for x in struct.unpack_from("<HH", d))
                place = (ordinal, name, state, row, col)
            if kind == LABELSST:
                index = struct.unpack_from("<I", d, 6)[0]
                if index >= len(strings):
                    raise Refusal(f"shared string missing: {name}")
                yield *place, "string", strings[index], None, None
            elif kind == NUMBER:
                yield *place, "number", repr(struct.unpack_from("<d", d, 6)[0]), None, None
            elif kind == RK:
                yield *place, "number", repr(number_of_rk(struct.unpack_from("<I", d, 6)[0])), None, None
            elif kind == LABEL:
                yield *place, "string", _long(d[6:]), None, None
            elif kind == BLANK:
                yield *place, "blank", None, None, None
            elif kind == BOOLERR:
                yield (*place, "error", ERRORS.get(d[6], "#ERR"), None, None) if d[7] else (*place, "boolean", "true" if d[6] else "false", None, None)
            elif kind in (MULRK, MULBLANK):
                row, first = struct.unpack_from("<HH", d)
                width = 6 if kind == MULRK else 2
                for i in range((len(d) - 6) // width):
                    value = repr(number_of_rk(struct.unpack_from("<I", d, 6 + 6 * i)[0])) if kind == MULRK else None
                    yield ordinal, name, state, row + 1, first + i + 1, "number" if value else "blank", value, None, None
            elif kind == FORMULA:
                value = d[6:14]
                text = formula_text(d[22 : 22 + struct.unpack_from("<H", d, 20)[0]], names, False, row - 1, col - 1) if len(d) >= 22 else ""
                if value[6:8] != b"\xff\xff":
                    yield *place, "number", repr(struct.unpack("<d", value)[0]), text, "cached"
                elif value[0] == 0:
                    waiting = (row, col, text)
                elif value[0] == 1:
                    yield *place, "boolean", "true" if value[2] else "false", text, "cached"
                elif value[0] == 2:
                    yield *place, "error", ERRORS.get(value[2], "#ERR"), text, "cached"
                else:
                    yield *place, "string", "", text, "cached"
            elif kind == STRING and waiting:
                yield ordinal, name, state, *waiting[:2], "string", _long(d), waiting[2], "cached"
                waiting = None


def _defined_name(data: bytes) -> str:
    """The name of a NAME record; built-in names are numbers and get none."""
    flags, _, count = struct.unpack_from("<HBB", data)
    if flags & 0x20 or len(data) < 15:
        return "#NAME?"
    return data[15 : 15 + 2 * count].decode("utf-16-le", "replace") if data[14] & 1 else data[15 : 15 + count].decode("latin-1")


def _shared_formulas(book: bytes, at: int) -> dict[tuple[int, int], bytes]:
    """Shared formulas of a sheet by the cell that their cells name, which is the formula before the record."""
    found: dict[tuple[int, int], bytes] = {}
    cell, depth = (0, 0), 0
    for _, kind, d in records(book, at):
        depth += (kind == BOF) - (kind == EOF)
        if depth == 0:
            break
        if kind == FORMULA:
            cell = struct.unpack_from("<HH", d)
        elif kind == SHRFMLA and len(d) >= 10:
            found[cell] = d[10 : 10 + struct.unpack_from("<H", d, 8)[0]]
    return found


def records12(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, type, payload) of a BIFF12 part."""

    def number(at: int, most: int) -> tuple[int, int]:
        value = 0
        for i in range(most):
            if at >= len(data):
                raise Refusal("BIFF12 record cut short")
            b = data[at]
            at += 1
            value |= (b & 0x7F) << (7 * i)
            if not b & 0x80:
                break
        return value, at

    at = 0
    while at < len(data):
        start = at
        kind = data[at]
        at += 1
        if kind & 0x80:
            if at >= len(data):
                raise Refusal("BIFF12 record cut short")
            kind = (kind & 0x7F) | (data[at] & 0x7F) << 7
            at += 1
        size, at = number(at, 4)
        if at + size > len(data):
            raise Refusal("BIFF12 record cut short")
        yield start, kind, data[at : at + size]
        at += size


def _wide(data: bytes, at: int) -> tuple[str, int]:
    n = struct.unpack_from("<I", data, at)[0]
    if n == 0xFFFFFFFF:
        return "", at + 4
    if at + 4 + 2 * n > len(data):
        raise Refusal("BIFF12 string cut short")
    return data[at + 4 : at + 4 + 2 * n].decode("utf-16-le", "replace"), at + 4 + 2 * n


def xlsb_cells(raw: bytes) -> Iterator[Cell]:
    package = Package(raw)
    book = package.main_part()
    rels = {r[0]: r for r in package.relationships(book)}
    strings: list[str] = []
    part = next((r[4] for r in rels.values() if r[1].endswith("/sharedStrings")), None)
    if part in package.zip.NameToInfo:
        strings = [_wide(d, 1)[0] for _, kind, d in records12(package.read(part)) if kind == 19]
    bundled, spans, defined = [], [], []
    for _, kind, d in records12(package.read(book)):
        if kind == 156:
            bundled.append(_wide(d, _wide(d, 8)[1])[0])
        elif kind == 362:
            spans = [struct.unpack_from("<Iii", d, 4 + 12 * i)[1:] for i in range((len(d) - 4) // 12)]
        elif kind == 39:
            defined.append(_wide(d, 9)[0])
    labels = [sheet_label(bundled[a], bundled[z]) if 0 <= a <= z < len(bundled) else None for a, z in spans]
    ordinal = 0
    for _, kind, d in records12(package.read(book)):
        if kind != 156:
            continue
        state = STATES.get(struct.unpack_from("<I", d)[0] & 3, "visible")
        rid, at = _wide(d, 8)
        name = _wide(d, at)[0]
        rel = rels.get(rid)
        if rel is None or not rel[1].endswith("/worksheet") or not rel[4]:
            continue
        ordinal += 1
        row = 0
        sheet = package.read(rel[4])
        names = Names(defined, labels, _shared_formulas12(sheet))
        for _, k, c in records12(sheet):
            if k == 0:
                row = struct.unpack_from("<I", c)[0] + 1
            elif 1 <= k <= 11:
                place = (ordinal, name, state, row, struct.unpack_from("<I", c)[0] + 1)
                formula, cached = (_formula12(k, c, names, row - 1, place[4] - 1), "cached") if k >= 8 else (None, None)
                if k == 1:
                    yield *place, "blank", None, None, None
                elif k == 2:
                    yield *place, "number", repr(number_of_rk(struct.unpack_from("<I", c, 8)[0])), None, None
                elif k in (3, 11):
                    yield *place, "error", ERRORS.get(c[8], "#ERR"), formula, cached
                elif k in (4, 10):
                    yield *place, "boolean", "true" if c[8] else "false", formula, cached
                elif k in (5, 9):
                    yield *place, "number", repr(struct.unpack_from("<d", c, 8)[0]), formula, cached
                elif k in (6, 8):
                    yield *place, "string", _wide(c, 8)[0], formula, cached
                else:
                    index = struct.unpack_from("<I", c, 8)[0]
                    if index >= len(strings):
                        raise Refusal(f"shared string missing: {name}")
                    yield *place, "string", strings[index], None, None


def _tokens12(kind: int, cell: bytes) -> bytes:
    """The token stream of a formula cell, after its cached value and flags."""
    at = {8: lambda: _wide(cell, 8)[1], 9: lambda: 16, 10: lambda: 9, 11: lambda: 9}[kind]() + 2
    return cell[at + 4 : at + 4 + struct.unpack_from("<I", cell, at)[0]] if at + 4 <= len(cell) else b""


def _formula12(kind: int, cell: bytes, names: Names, row: int, column: int) -> str:
    return formula_text(_tokens12(kind, cell), names, True, row, column)


def _shared_formulas12(sheet: bytes) -> dict[tuple[int, int], bytes]:
    """Shared formulas of a sheet by the cell before the record, as its cells name it."""
    found: dict[tuple[int, int], bytes] = {}
    row = column = 0
    for _, kind, d in records12(sheet):
        if kind == 0:
            row = struct.unpack_from("<I", d)[0]
        elif 8 <= kind <= 11:
            column = struct.unpack_from("<I", d)[0]
        elif kind == 427 and len(d) >= 20:
            found[row, column] = d[20 : 20 + struct.unpack_from("<I", d, 16)[0]]
    return found


def biff_records(streams: DataFrame) -> DataFrame:
    """(source_id, offset, type, size) of each record of BIFF streams (source_id, content)."""

    def rows(source_id: int, content: bytes | None):
        try:
            for at, kind, data in records(content or b""):
                yield source_id, at, kind, len(data)
        except Refusal:
            return

    return map_rows(streams.select("source_id", "content"), RECORDS, rows)

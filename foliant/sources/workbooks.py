"""Workbooks (.xlsx, .xlsm, .xlsb, .xls, .ods) as cells, and their addressed grids as blocks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions import markdown as md
from foliant.functions.arrow import map_rows
from foliant.functions.html_markdown import Block, Refusal
from foliant.operators.grid import DENSE_POSITIONS, LAST_COLUMN, LAST_ROW, shift_formula
from foliant.sources.biff import xls_cells, xlsb_cells
from foliant.sources.packages import Package, local

CELLS = T.StructType(
    [
        T.StructField("source_id", T.LongType()),
        T.StructField("sheet_ordinal", T.IntegerType()),
        T.StructField("sheet", T.StringType()),
        T.StructField("sheet_state", T.StringType()),
        T.StructField("row", T.IntegerType()),
        T.StructField("col", T.IntegerType()),
        T.StructField("address", T.StringType()),
        T.StructField("value_type", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("formula", T.StringType()),
        T.StructField("cache_state", T.StringType()),
    ]
)
_REF = re.compile(r"([A-Z]{1,3})([1-9][0-9]{0,6})")
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_T = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
_O = "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}"
_X = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"


def letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def place(address: str) -> tuple[int, int]:
    m = _REF.fullmatch(address)
    if not m:
        raise Refusal(f"cell address refused: {address}")
    col = 0
    for c in m[1]:
        col = col * 26 + ord(c) - 64
    row = int(m[2])
    if col > LAST_COLUMN or row > LAST_ROW:
        raise Refusal(f"cell address refused: {address}")
    return row, col


def _number(text: str) -> str:
    try:
        return repr(float(text))
    except ValueError:
        return text


def xlsx_cells(raw: bytes):
    """(sheet ordinal, name, state, row, col, type, value, formula, cache state) of every written cell."""
    package = Package(raw)
    book = package.main_part()
    rels = {r[0]: r for r in package.relationships(book)}
    strings: list[str] = []
    shared = next((r[4] for r in rels.values() if r[1].endswith("/sharedStrings")), None)
    if shared in package.zip.NameToInfo:
        for si in package.xml(shared).findall(f"{_MAIN}si"):
            runs = [si.findtext(f"{_MAIN}t", "")] + [r.findtext(f"{_MAIN}t", "") for r in si.findall(f"{_MAIN}r")]
            strings.append("".join(runs))
    for ordinal, sheet in enumerate(package.xml(book).iter(f"{_MAIN}sheet"), 1):
        rel = rels.get(sheet.get(_RID, ""))
        if rel is None or not rel[1].endswith("/worksheet") or rel[4] is None:
            continue
        name, state = sheet.get("name", ""), sheet.get("state", "visible")
        masters: dict[str, tuple[str, int, int]] = {}
        for c in package.xml(rel[4]).iter(f"{_MAIN}c"):
            row, col = place(c.get("r", ""))
            kind, v, f = c.get("t", "n"), c.find(f"{_MAIN}v"), c.find(f"{_MAIN}f")
            text = v.text if v is not None else None
            formula = None
            if f is not None:
                formula = f.text
                if f.get("t") == "shared":
                    index = f.get("si", "")
                    if formula:
                        masters[index] = (formula, row, col)
                    elif index in masters:
                        first, r0, c0 = masters[index]
                        formula = shift_formula(first, row - r0, col - c0)
            if kind == "s" and text is not None:
                index = int(text) if text.isdigit() else -1
                if not 0 <= index < len(strings):
                    raise Refusal(f"shared string missing: {name}!{c.get('r')}")
                yield ordinal, name, state, row, col, "string", strings[index], formula, "cached" if formula else None
            elif kind == "inlineStr":
                yield ordinal, name, state, row, col, "string", "".join(t.text or "" for t in c.iter(f"{_MAIN}t")), formula, None
            elif text is None:
                yield ordinal, name, state, row, col, "missing" if f is not None else "blank", None, formula, "missing" if f is not None else None
            else:
                what = {"b": "boolean", "e": "error", "str": "string", "d": "date"}.get(kind, "number")
                value = ("true" if text.strip() in ("1", "true") else "false") if kind == "b" else _number(text) if what == "number" else text
                yield ordinal, name, state, row, col, what, value, formula, "cached" if f is not None else None


def ods_cells(raw: bytes):
    """As ``xlsx_cells``; value repeats are written out, blank repeats are not."""
    package = Package(raw)
    root = package.xml("content.xml")
    budget = DENSE_POSITIONS
    for ordinal, table in enumerate(root.iter(f"{_T}table"), 1):
        name, row = table.get(f"{_T}name", ""), 0
        for tr in table.iter(f"{_T}table-row"):
            down, col = int(tr.get(f"{_T}number-rows-repeated", "1")), 0
            cells = []
            for cell in tr:
                if local(cell.tag) not in ("table-cell", "covered-table-cell"):
                    continue
                across = int(cell.get(f"{_T}number-columns-repeated", "1"))
                kind = cell.get(f"{_O}value-type")
                text = "\n".join("".join(p.itertext()) for p in cell.findall(f"{_X}p"))
                formula = cell.get(f"{_T}formula")
                if kind or text or formula:
                    value = {"float": lambda: _number(cell.get(f"{_O}value", "")), "percentage": lambda: _number(cell.get(f"{_O}value", "")), "currency": lambda: _number(cell.get(f"{_O}value", "")), "boolean": lambda: cell.get(f"{_O}boolean-value", ""), "date": lambda: cell.get(f"{_O}date-value", "")}.get(kind or "", lambda: text)()
                    what = "number" if kind in ("float", "percentage", "currency") else kind or "string"
                    cells += [(col + i + 1, what, value, formula) for i in range(across)]
                    budget -= down * across
                    if budget < 0:
                        raise Refusal(f"sheet cells limit exceeded: {DENSE_POSITIONS}")
                col += across
            if cells:
                for d in range(down):
                    for c, what, value, formula in cells:
                        yield ordinal, name, "visible", row + d + 1, c, what, value, formula, None
            row += down


def cell_rows(raw: bytes, suffix: str):
    """Cells of a workbook by its suffix."""
    return {".ods": ods_cells, ".xls": xls_cells, ".xlsb": xlsb_cells}.get(suffix, xlsx_cells)(raw)


def workbook_cells(sources: DataFrame) -> DataFrame:
    """Cells of each workbook source (source_id, suffix, content); refused workbooks have none."""

    def rows(source_id: int, suffix: str, content: bytes | None):
        try:
            found = list(cell_rows(content or b"", suffix))
        except Refusal:
            return
        for ordinal, name, state, row, col, what, value, formula, cache in found:
            yield source_id, ordinal, name, state, row, col, f"{letters(col)}{row}", what, value, formula, cache

    return map_rows(sources.select("source_id", "suffix", "content"), CELLS, rows)


def shown(what: str, value: str | None) -> str:
    return "[missing cached result]" if what == "missing" else "[blank]" if what == "blank" else md.escape((value or "").replace("\n", " ").strip())


def sheet_blocks(cells: list[tuple[int, int, str, str | None]]) -> list[Block]:
    """An addressed grid: row numbers and column letters around literal ``A1: value`` cells; sparse sheets leave rows and columns out."""
    if not cells:
        return [Block("text", ["Empty sheet."])]
    top, bottom = min(c[0] for c in cells), max(c[0] for c in cells)
    left, right = min(c[1] for c in cells), max(c[1] for c in cells)
    rows, cols = list(range(top, bottom + 1)), list(range(left, right + 1))
    out = [Block("text", [f"Source range: {letters(left)}{top}:{letters(right)}{bottom}"])]
    if len(rows) * len(cols) > DENSE_POSITIONS:
        rows, cols = sorted({c[0] for c in cells}), sorted({c[1] for c in cells})
        out.append(Block("text", ["Rows and columns without cells are left out."]))
    text = {(r, c): f"{letters(c)}{r}: {shown(what, value)}" for r, c, what, value in cells}
    if len(rows) * len(cols) > DENSE_POSITIONS:
        return [*out, *(Block("text", [text[k]]) for k in sorted(text))]
    grid = [["Row", *map(letters, cols)], *([str(r), *(text.get((r, c), "") for c in cols)] for r in rows)]
    return [*out, Block("table", md.table(grid))]


def workbook_units(raw: bytes, suffix: str) -> list[tuple[str, list[Block]]]:
    sheets: dict[tuple[int, str], list] = {}
    for ordinal, name, _, row, col, what, value, _, _ in cell_rows(raw, suffix):
        sheets.setdefault((ordinal, name), []).append((row, col, what, value))
    return [(name, sheet_blocks(cells)) for (_, name), cells in sorted(sheets.items())]


def sheet_union(native: DataFrame, listed: DataFrame) -> DataFrame:
    """(source_id, ordinal, sheet): sheets found in the file's own parts, then those that only the listing has, in its order.

    ``native`` and ``listed``: source_id, ordinal, sheet. A listed sheet of the same name is the same sheet.
    """
    only = listed.join(native.select("source_id", "sheet"), ["source_id", "sheet"], "left_anti")
    last = native.groupBy("source_id").agg(F.max("ordinal").alias("_last"))
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("ordinal"))
    after = only.join(last, "source_id", "left").select("source_id", (F.coalesce("_last", F.lit(0)) + place).alias("ordinal"), "sheet")
    return native.select("source_id", "ordinal", "sheet").unionByName(after)

"""Formulas of binary workbooks: token streams of BIFF8 (.xls) and BIFF12 (.xlsb) as text.

Tokens stand in postfix order, so operands wait on a stack of texts; parentheses are tokens of their own. A stream with a token,
function or name that is not known, or cut short, has no text (``Undecoded``): a caller marks the formula instead.
"""

from __future__ import annotations

import struct
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

# Operators by token, error codes, and functions by number with their count of arguments (None: as many as given).
BINARY = {0x03: "+", 0x04: "-", 0x05: "*", 0x06: "/", 0x07: "^", 0x08: "&", 0x09: "<", 0x0A: "<=", 0x0B: "=", 0x0C: ">=", 0x0D: ">", 0x0E: "<>", 0x0F: " ", 0x10: ",", 0x11: ":"}
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}
_FUNCTIONS = """0 COUNT; 1 IF; 2 ISNA 1; 3 ISERROR 1; 4 SUM; 5 AVERAGE; 6 MIN; 7 MAX; 8 ROW; 9 COLUMN; 10 NA 0; 11 NPV; 12 STDEV; 13 DOLLAR; 14 FIXED; 15 SIN 1; 16 COS 1; 17 TAN 1; 18 ATAN 1; 19 PI 0;
20 SQRT 1; 21 EXP 1; 22 LN 1; 23 LOG10 1; 24 ABS 1; 25 INT 1; 26 SIGN 1; 27 ROUND 2; 28 LOOKUP; 29 INDEX; 30 REPT 2; 31 MID 3; 32 LEN 1; 33 VALUE 1; 34 TRUE 0; 35 FALSE 0; 36 AND; 37 OR; 38 NOT 1; 39 MOD 2;
40 DCOUNT 3; 41 DSUM 3; 42 DAVERAGE 3; 43 DMIN 3; 44 DMAX 3; 45 DSTDEV 3; 46 VAR; 47 DVAR 3; 48 TEXT 2; 56 PV; 57 FV; 58 NPER; 59 PMT; 60 RATE; 61 MIRR 3; 62 IRR; 63 RAND 0; 64 MATCH; 65 DATE 3; 66 TIME 3;
67 DAY 1; 68 MONTH 1; 69 YEAR 1; 70 WEEKDAY; 71 HOUR 1; 72 MINUTE 1; 73 SECOND 1; 74 NOW 0; 75 AREAS 1; 76 ROWS 1; 77 COLUMNS 1; 78 OFFSET; 82 SEARCH; 83 TRANSPOSE 1; 86 TYPE 1; 97 ATAN2 2; 98 ASIN 1; 99 ACOS 1;
100 CHOOSE; 101 HLOOKUP; 102 VLOOKUP; 105 ISREF 1; 109 LOG; 111 CHAR 1; 112 LOWER 1; 113 UPPER 1; 114 PROPER 1; 115 LEFT; 116 RIGHT; 117 EXACT 2; 118 TRIM 1; 119 REPLACE 4; 120 SUBSTITUTE; 121 CODE 1; 124 FIND;
125 CELL; 126 ISERR 1; 127 ISTEXT 1; 128 ISNUMBER 1; 129 ISBLANK 1; 130 T 1; 131 N 1; 140 DATEVALUE 1; 141 TIMEVALUE 1; 142 SLN 3; 143 SYD 4; 144 DDB; 148 INDIRECT; 162 CLEAN 1; 163 MDETERM 1; 164 MINVERSE 1;
165 MMULT 2; 167 IPMT; 168 PPMT; 169 COUNTA; 183 PRODUCT; 184 FACT 1; 190 ISNONTEXT 1; 193 STDEVP; 194 VARP; 197 TRUNC; 198 ISLOGICAL 1; 212 ROUNDUP 2; 213 ROUNDDOWN 2; 216 RANK; 219 ADDRESS; 220 DAYS360; 221 TODAY 0;
227 MEDIAN; 228 SUMPRODUCT; 229 SINH 1; 230 COSH 1; 231 TANH 1; 252 FREQUENCY 2; 261 ERROR.TYPE 1; 269 AVEDEV; 325 LARGE 2; 326 SMALL 2; 327 QUARTILE 2; 328 PERCENTILE 2; 330 MODE; 336 CONCATENATE; 337 POWER 2;
342 RADIANS 1; 343 DEGREES 1; 344 SUBTOTAL; 345 SUMIF; 346 COUNTIF 2; 347 COUNTBLANK 1; 354 ROMAN; 359 HYPERLINK; 361 AVERAGEA; 362 MAXA; 363 MINA; 480 IFERROR 2; 481 COUNTIFS; 482 SUMIFS; 483 AVERAGEIF; 484 AVERAGEIFS"""
FUNCTIONS: Mapping[int, tuple[str, int | None]] = {
    int(p[0]): (p[1], int(p[2]) if len(p) > 2 else None) for p in (entry.split() for entry in _FUNCTIONS.split(";"))
}
MOST = 8192


class Undecoded(ValueError):
    """A formula that has no text here; the message says why."""


@dataclass(frozen=True)
class Names:
    """What indexes in tokens stand for: defined names from 1 on, and labels of sheets or spans of sheets from 0 on."""

    defined: Sequence[str] = ()
    sheets: Sequence[str | None] = ()
    shared: Mapping[tuple[int, int], bytes] = field(default_factory=dict)  # by the first cell's row and column


def sheet_label(first: str, last: str | None = None) -> str:
    """A sheet, or a span of sheets, before its exclamation mark; quoted unless it is a plain word."""
    both = first if last is None or last == first else f"{first}:{last}"
    plain = all(c.isalnum() or c in "_.:" for c in both) and not both[:1].isdigit()
    return both if plain else "'" + both.replace("'", "''") + "'"


def _letters(n: int) -> str:
    out = ""
    while n:
        n, digit = divmod(n - 1, 26)
        out = chr(65 + digit) + out
    return out


class _Tokens:
    def __init__(self, data: bytes, wide: bool, row: int, column: int) -> None:
        self.data, self.at, self.wide, self.row, self.column = data, 0, wide, row, column

    def take(self, layout: str) -> tuple:
        size = struct.calcsize("<" + layout)
        if self.at + size > len(self.data):
            raise Undecoded("token cut short")
        self.at += size
        return struct.unpack_from("<" + layout, self.data, self.at - size)

    def cell(self, row: int, column: int, offset: bool) -> str:
        """An address; in shared formulas, relative parts are distances from the cell at hand."""
        rows, columns = (1 << 20, 1 << 14) if self.wide else (1 << 16, 1 << 8)
        relative_row, relative_column, column = bool(column & 0x8000), bool(column & 0x4000), column & 0x3FFF
        if offset:
            row = (self.row + row) % rows if relative_row else row
            column = (self.column + column) % columns if relative_column else column
        return f"{'' if relative_column else '$'}{_letters(column % columns + 1)}{'' if relative_row else '$'}{row % rows + 1}"

    def reference(self, offset: bool) -> str:
        row, column = self.take("IH" if self.wide else "HH")
        return self.cell(row, column, offset)

    def area(self, offset: bool) -> str:
        top, bottom, left, right = self.take("IIHH" if self.wide else "HHHH")
        return f"{self.cell(top, left, offset)}:{self.cell(bottom, right, offset)}"

    def string(self) -> str:
        n, wide = (*self.take("H"), 1) if self.wide else self.take("BB")
        size = n * 2 if wide & 1 else n
        if self.at + size > len(self.data):
            raise Undecoded("string cut short")
        self.at += size
        return self.data[self.at - size : self.at].decode("utf-16-le" if wide & 1 else "latin-1", "replace")


def _number(value: float) -> str:
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)


def decode_formula(tokens: bytes, names: Names = Names(), *, wide: bool = False, row: int = 0, column: int = 0) -> str:
    """The text of a token stream without its equals sign; ``wide`` for BIFF12; ``row`` and ``column`` count from 0."""
    t, stack = _Tokens(tokens, wide, row, column), []

    def pop(n: int) -> list[str]:
        if n > len(stack):
            raise Undecoded("operand missing")
        found = stack[len(stack) - n :]
        del stack[len(stack) - n :]
        return found

    def sheet(index: int) -> str:
        if index >= len(names.sheets) or names.sheets[index] is None:
            raise Undecoded(f"sheet reference {index} is not known")
        return names.sheets[index]

    def called(index: int, count: int | None) -> str:
        if index not in FUNCTIONS:
            raise Undecoded(f"function {index} is not known")
        name, fixed = FUNCTIONS[index]
        n = fixed if count is None else count
        if n is None:
            raise Undecoded(f"{name} has no fixed count of arguments")
        return f"{name}({','.join(pop(n))})"

    while t.at < len(tokens):
        (kind,) = t.take("B")
        kind = kind & 0x1F | 0x20 if kind >= 0x40 else kind
        match kind:
            case 0x01:
                first = t.take("I")[0] if wide else t.take("HH")
                masters = [m for m in names.shared if m[0] == first] if wide else [m for m in names.shared if m == first]
                if len(masters) != 1:
                    raise Undecoded("shared formula missing")
                return decode_formula(names.shared[masters[0]], Names(names.defined, names.sheets), wide=wide, row=row, column=column)
            case _ if kind in BINARY:
                a, b = pop(2)
                stack.append(f"{a}{BINARY[kind]}{b}")
            case 0x12 | 0x13:
                stack.append("+-"[kind - 0x12] + pop(1)[0])
            case 0x14:
                stack.append(pop(1)[0] + "%")
            case 0x15:
                stack.append(f"({pop(1)[0]})")
            case 0x16:
                stack.append("")
            case 0x17:
                stack.append('"' + t.string().replace('"', '""') + '"')
            case 0x19:
                flags, size = t.take("BH")
                if flags & 0x04:
                    t.take("H" * (size + 1))
                elif flags & 0x10:
                    stack.append(f"SUM({pop(1)[0]})")
            case 0x1C:
                stack.append(ERRORS.get(t.take("B")[0], "#ERR"))
            case 0x1D:
                stack.append("TRUE" if t.take("B")[0] else "FALSE")
            case 0x1E:
                stack.append(str(t.take("H")[0]))
            case 0x1F:
                stack.append(_number(t.take("d")[0]))
            case 0x21:
                stack.append(called(t.take("H")[0], None))
            case 0x22:
                count, index = t.take("BH")
                if index & 0x7FFF == 255:  # the first operand is the function's name
                    name, *arguments = pop(count & 0x7F)
                    stack.append(f"{name}({','.join(arguments)})")
                else:
                    stack.append(called(index & 0x7FFF, count & 0x7F))
            case 0x23:
                index = t.take("I")[0] if wide else t.take("HH")[0]
                if not 1 <= index <= len(names.defined):
                    raise Undecoded(f"name {index} is not known")
                stack.append(names.defined[index - 1])
            case 0x24 | 0x2C:
                stack.append(t.reference(kind == 0x2C))
            case 0x25 | 0x2D:
                stack.append(t.area(kind == 0x2D))
            case 0x26 | 0x27 | 0x28:
                t.take("IH")
            case 0x29:
                t.take("H")
            case 0x2A | 0x2B:
                t.take(("IH" if wide else "HH") if kind == 0x2A else ("IIHH" if wide else "HHHH"))
                stack.append("#REF!")
            case 0x3A:
                label = sheet(t.take("H")[0])
                stack.append(f"{label}!{t.reference(False)}")
            case 0x3B:
                label = sheet(t.take("H")[0])
                stack.append(f"{label}!{t.area(False)}")
            case 0x3C | 0x3D:
                label = sheet(t.take("H")[0])
                t.take(("IH" if wide else "HH") if kind == 0x3C else ("IIHH" if wide else "HHHH"))
                stack.append(f"{label}!#REF!")
            case _:
                raise Undecoded(f"token {kind:#04x} is not known")
        if stack and len(stack[-1]) > MOST:
            raise Undecoded(f"formula longer than {MOST} characters")
    if len(stack) != 1:
        raise Undecoded("operands left over")
    return stack[0]


def formula_text(tokens: bytes, names: Names, wide: bool, row: int, column: int) -> str:
    """The text, or an empty one where there is none: the cell still counts as a formula."""
    try:
        return decode_formula(tokens, names, wide=wide, row=row, column=column)
    except Undecoded:
        return ""

import struct

import pytest

from foliant.functions import formula_tokens as F
from foliant.sources import biff
from foliant.sources import synthetic as D

REF, AREA, INT, FUNC, VAR = 0x44, 0x25, 0x1E, 0x41, 0x42
ref = lambda r, c, flags=0xC000: struct.pack("<BHH", REF, r, c | flags)
area = lambda r1, r2, c1, c2, flags=0xC000: struct.pack("<BHHHH", AREA, r1, r2, c1 | flags, c2 | flags)
whole = lambda n: struct.pack("<BH", INT, n)


@pytest.mark.parametrize(
    "tokens,want",
    [
        (ref(0, 0) + whole(1) + b"\x03", "A1+1"),
        (ref(9, 27, 0) + ref(9, 27, 0x4000) + b"\x05", "$AB$10*AB$10"),
        (ref(0, 1) + whole(2) + b"\x04\x15" + whole(3) + b"\x06", "(B1-2)/3"),
        (area(0, 4, 0, 1) + b"\x19\x10\x00\x00", "SUM(A1:B5)"),
        (ref(0, 0) + whole(0) + b"\x0d" + b'\x17\x05\x00say "' + b"\x17\x02\x01" + "äb".encode("utf-16-le") + struct.pack("<BBH", VAR, 3, 1), 'IF(A1>0,"say """,\"äb\")'),
        (whole(2) + b"\x13" + whole(50) + b"\x14\x08", "-2&50%"),
        (b"\x1f" + struct.pack("<d", 1.5) + b"\x1f" + struct.pack("<d", 3.0) + b"\x07", "1.5^3"),
        (b"\x1d\x01\x1c\x2a" + struct.pack("<BH", FUNC, 2) + struct.pack("<BBH", VAR, 2, 36), "AND(TRUE,ISNA(#N/A))"),
        (struct.pack("<BH", FUNC, 19) + b"\x16" + struct.pack("<BBH", VAR, 2, 4), "SUM(PI(),)"),
        (struct.pack("<BHH", 0x43, 1, 0) + struct.pack("<BHHH", 0x5A, 0, 0, 0xC000) + b"\x03", "Rate+'My sheet'!A1"),
        (struct.pack("<BHHHHH", 0x3B, 1, 0, 1, 0, 1), "One:Two!$A$1:$B$2"),
        (b"\x2a\0\0\0\0" + struct.pack("<BHHH", 0x3C, 0, 0, 0) + b"\x0b", "#REF!='My sheet'!#REF!"),
        (struct.pack("<BHH", 0x4C, 0xFFFF, 0xC0FF), "A2"),
    ],
)
def test_tokens(tokens, want):
    names = F.Names(["Rate"], ["'My sheet'", "One:Two"])
    assert F.decode_formula(tokens, names, row=2, column=1) == want


def test_wide_tokens():
    tokens = struct.pack("<BIH", REF, 1 << 19, 0xC000 | 16383) + b"\x17" + struct.pack("<H", 2) + "xy".encode("utf-16-le") + b"\x08"
    assert F.decode_formula(tokens, wide=True) == 'XFD524289&"xy"'


@pytest.mark.parametrize("tokens", [b"\x03", b"\x1e\x01", b"\x18", whole(1) + whole(2), struct.pack("<BH", FUNC, 9999), struct.pack("<BHH", 0x43, 7, 0), b"\x01\0\0\0\0", b""])
def test_what_cannot_be_decoded_is_said(tokens):
    with pytest.raises(F.Undecoded):
        F.decode_formula(tokens)
    assert F.formula_text(tokens, F.Names(), False, 0, 0) == ""


def test_labels():
    assert [F.sheet_label(*x) for x in (("S",), ("my sheet",), ("it's", "x"), ("1a",), ("a", "a"))] == ["S", "'my sheet'", "'it''s:x'", "'1a'", "a"]


def test_formulas_of_workbooks():
    got = {(r, c): f for _, _, _, r, c, _, _, f, _ in biff.xls_cells(D.xls_with_formulas()) if f is not None}
    assert got == {(1, 2): "A1*2", (2, 2): "A2+$A$1", (3, 2): "A3+$A$1", (4, 2): "SUM(S!A1:A3)", (5, 2): "Total/2", (6, 2): ""}
    got = {(r, c): f for _, _, _, r, c, _, _, f, _ in biff.xlsb_cells(D.xlsb_with_formulas()) if f is not None}
    assert got == {(1, 2): "A1*2", (1, 3): "S!A1&\"x\""}

"""The character encoding of an HTML document: byte-order mark, then declaration, then UTF-8, then a fallback."""

from __future__ import annotations

import codecs
import re

_MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
_META = re.compile(rb"<meta[^>]*?charset\s*=\s*[\"']?\s*([A-Za-z0-9_:.-]+)", re.IGNORECASE)
#: Labels that the web reads as another encoding.
_ALIASES = {"iso-8859-1": "cp1252", "latin1": "cp1252", "latin-1": "cp1252", "ascii": "cp1252", "us-ascii": "cp1252", "gb2312": "gb18030", "gbk": "gb18030", "shift_jis": "cp932", "ks_c_5601-1987": "cp949", "euc-kr": "cp949", "iso-8859-9": "cp1254", "iso-8859-8-i": "iso-8859-8", "x-sjis": "cp932"}


def codec_of(label: str) -> str | None:
    label = label.strip().lower()
    label = _ALIASES.get(label, label)
    if label.startswith("utf-16"):
        return "utf-8"  # a declaration that could be read is not in UTF-16
    try:
        return codecs.lookup(label).name
    except LookupError:
        return None


def decode_html(raw: bytes, header: str | None = None) -> tuple[str, str, str]:
    """(text, encoding, how it was found: bom, header, meta, utf-8 or fallback)."""
    for mark, name in _MARKS:
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name, "replace"), name, "bom"
    for label, how in ((header, "header"), *((m[1].decode("ascii"), "meta") for m in [_META.search(raw[:1024])] if m)):
        if label and (name := codec_of(label)):
            if name != "utf-8":
                try:
                    if any(b > 127 for b in raw):
                        return raw.decode("utf-8"), "utf-8", "utf-8"  # valid UTF-8 beats a single-byte label
                except UnicodeDecodeError:
                    pass
            return raw.decode(name, "replace"), name, how
    try:
        return raw.decode("utf-8"), "utf-8", "utf-8"
    except UnicodeDecodeError:
        late = _META.search(raw[:16384])
        if late and (name := codec_of(late[1].decode("ascii"))):
            return raw.decode(name, "replace"), name, "meta"
        lossy = raw.decode("utf-8", "replace")
        if sum(c > "\x7f" and c != "�" for c in lossy) > lossy.count("�"):
            return lossy, "utf-8", "fallback"
        high = [b for b in raw if b >= 0xC0]
        cyrillic = high and sum(b >= 0xC0 for b in raw) > 0.3 * max(1, sum(chr(b).isalpha() or b >= 0x80 for b in raw))
        name = "cp1251" if cyrillic else "cp1252"
        return raw.decode(name, "replace"), name, "fallback"

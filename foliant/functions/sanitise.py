"""Text cleanup with a counter for every loss: ligatures, soft hyphens, no-break spaces, private glyphs, controls, folds."""

from __future__ import annotations

import re
import unicodedata

# Ligatures, and ASCII spellings of punctuation and signs.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
FOLD = {
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"',
    "′": "'", "″": '"', "•": "-", "‣": "-", "▪": "-", "■": "-", "●": "-", "·": "-", "…": "...", "≤": "<=", "≥": ">=", "≠": "!=",
    "±": "+/-", "×": "x", "÷": "/", "°": " deg", "®": "(R)", "©": "(C)", "™": "(TM)", "€": "EUR", "£": "GBP", "²": "2", "³": "3",
    "½": "1/2", "¼": "1/4", "¾": "3/4", "→": "->", "←": "<-", "░": "#", "▒": "#", "▓": "#", "█": "#",
    "\u2007": " ", "\u202f": " ", "\u2009": " ", "\ufeff": "",
}
LOSSES = ("control_chars", "soft_hyphens", "nbsp", "pua_glyphs", "cid_survivors", "ligatures", "non_ascii_replaced")
CID = re.compile(r"\(cid:\d+\)")
BROKEN = re.compile(r"[A-Za-z]+š[A-Za-z]*|[A-Za-z]*š[A-Za-z]+")


def _fold(c: str, unicode: bool) -> tuple[str, str | None]:
    """The replacement of one character and the loss it counts as."""
    if c in LIGATURES:
        return LIGATURES[c], "ligatures"
    if c == "\xad":
        return "", "soft_hyphens"
    if c == "\xa0":
        return " ", "nbsp"
    if not unicode and c in FOLD:
        return FOLD[c], None
    match unicodedata.category(c):
        case "Co":
            return "-", "pua_glyphs"
        case "Cc" | "Cf" | "Zl" | "Zp":
            return "", "control_chars"
    if unicode:
        return c, None
    plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
    return (plain, None) if plain.isascii() and plain.strip() else ("?", "non_ascii_replaced")


_OTHER = re.compile(r"[^\n\t -~]")


def sanitise(text: str, layout: bool = False, unicode: bool = False) -> tuple[str, dict[str, int], int]:
    """The clean text, its losses by name and its number of words with a broken ligature."""
    losses = dict.fromkeys(LOSSES, 0)
    broken = len(BROKEN.findall(text))
    text, losses["cid_survivors"] = CID.subn("", text)

    def one(m: re.Match) -> str:
        new, loss = _fold(m[0], unicode)
        if loss:
            losses[loss] += 1
        return new

    text = _OTHER.sub(one, text)
    if not layout:
        text = re.sub(r"[ \t]{2,}", " ", text)
    return "\n".join(line.rstrip() for line in text.split("\n")), losses, broken

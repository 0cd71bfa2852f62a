"""Personal data by anchor expansion.

One Aho-Corasick pass over a whole text finds anchors: at-signs, plus signs, digits, scheme separators and identifier
cues. Deterministic local parsers expand an anchor to a span and validate it. Each parser keeps the place up to which
its kind is settled, accepted or not, so spans of a kind never overlap and a run of characters is read once, however many
anchors lie in it: time grows with the text's length.

Kinds, in order: email, ip, card (Luhn), phone (the base kinds), then what the cues add: ``account`` (an IBAN with its
check digits, or a number of 6 to 34 characters after a cue such as "account no"), ``secret`` (a key of 16 or more
characters after a cue such as "token =") and ``address`` (a URI that names a person: user information in its
authority, mailto, tel, sip or xmpp). Spans are (kind, start, end) in code points, end exclusive.

Defined results: a null text counts as empty, so it has no spans; an empty table gives no rows; repeated rows are
judged one by one; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.columns import each

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "secret", "address")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_BETWEEN = re.compile(r"(?:[ ]?(?:number|no\.?|nr\.?|id|#))?[ ]?[:=#]?[ ]?", re.IGNORECASE)
_NUMBER = re.compile(r"[0-9](?:[ -]?[0-9]){5,33}(?![0-9A-Za-z])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_ASSIGN = re.compile(r"""["']?[ ]?[:=][ ]?["']?""")
_KEY = re.compile(r"[A-Za-z0-9_+/=.-]{16,}")
_URI_END = re.compile(r"[^\s\"'<>`{}|\\^]+")
_AUTHORITY_END = re.compile("[/?#]")

#: Cues of an account number, of a secret, and schemes that name a person without "//".
ACCOUNT_CUES = ("account", "acct", "iban", "ssn", "passport", "konto", "cuenta", "compte")
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "api key", "access_key")
PERSON_SCHEMES = ("mailto", "tel", "sip", "xmpp")

_automaton: ahocorasick.Automaton | None = None


def _anchors() -> ahocorasick.Automaton:
    global _automaton
    if _automaton is None:
        a = ahocorasick.Automaton()
        for c in "0123456789":
            a.add_word(c, ("digit", 1))
        a.add_word("@", ("at", 1))
        a.add_word("+", ("plus", 1))
        a.add_word("://", ("uri", 3))
        for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES), ("person", tuple(f"{s}:" for s in PERSON_SCHEMES))):
            for cue in cues:
                for form in {cue, cue.upper(), cue.capitalize()}:
                    a.add_word(form, (kind, len(form)))
        a.make_automaton()
        _automaton = a
    return _automaton


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _iban_holds(code: str) -> bool:
    bare = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def find_spans(text: str) -> list[Span]:
    """All spans of a whole text, by start, then by kind as listed."""
    found: list[Span] = []
    done = dict.fromkeys(KINDS, 0)
    cards = digits = 0  # where the digit parsers go on
    keyless = 0  # up to here a run of key characters goes on that has no digit
    uri_end = uri_stop = 0  # the end of the last run of URI characters, with and without closing punctuation
    next_at = -1  # the next at-sign of a text, once looked for
    for at, (what, length) in _anchors().iter(text):
        if what == "digit":
            if at >= cards and at >= done["card"]:
                if m := _CARD.match(text, at):
                    cards = m.end()
                    number = re.sub("[ -]", "", m[0])
                    if 12 <= len(number) <= 19 and luhn(number):
                        found.append(("card", at, m.end()))
                else:
                    cards = at + 1
            if at >= digits:
                if m := _IP.match(text, at):
                    digits = m.end()
                    if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.groups()):
                        found.append(("ip", at, m.end()))
                else:
                    digits = _DIGITS.match(text, at).end()
        elif what == "at":
            start, floor = at, done["email"]
            while start > floor and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                found.append(("email", start, m.end()))
                done["email"] = m.end()
        elif what == "plus":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                done["phone"] = m.end()
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    found.append(("phone", at, m.end()))
        else:
            start, end = at + 1 - length, at + 1
            if what in ("account", "secret") and (start and text[start - 1].isalnum() or text[end : end + 1].isalnum()):
                continue
            if what == "account":
                begin = _BETWEEN.match(text, end).end()
                for parser, holds in ((_IBAN, _iban_holds), (_NUMBER, lambda code: True)):
                    if (m := parser.match(text, begin)) and holds(m[0]) and begin >= done["account"]:
                        found.append(("account", begin, m.end()))
                        done["account"] = m.end()
                        break
            elif what == "secret":
                begin = m.end() if (m := _ASSIGN.match(text, end)) else 0
                if begin >= max(keyless, done["secret"], 1) and (k := _KEY.match(text, begin)):
                    if any(c in "0123456789" for c in k[0]):
                        found.append(("secret", begin, k.end()))
                        done["secret"] = k.end()
                    else:
                        keyless = k.end()
            else:
                if what == "uri":
                    start = at - 2
                    while start > done["address"] and text[start - 1] in _SCHEME:
                        start -= 1
                elif start and text[start - 1].isalnum():
                    continue
                if start < done["address"]:
                    continue
                if end >= uri_end:
                    m = _URI_END.match(text, end)
                    uri_end = m.end() if m else end
                    uri_stop = uri_end
                    while uri_stop > end and text[uri_stop - 1] in ".,;:!?)]":
                        uri_stop -= 1
                stop = max(uri_stop, end)
                if stop > end:
                    if next_at < end:
                        next_at = at_sign if (at_sign := text.find("@", end)) >= 0 else len(text)
                    if what == "uri":
                        person = False
                        if next_at < stop and start < end - 3:
                            cut = m.start() if (m := _AUTHORITY_END.search(text, end, stop)) else stop
                            person = next_at < cut and "@" in text[end:cut].strip("@")
                    else:
                        person = next_at < stop or text[end] in "+0123456789"
                    if person:
                        found.append(("address", start, stop))
                        done["address"] = stop
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by a tag of its first kind."""
    out, at, last = [], 0, -1
    for kind, start, end in spans:
        if start < last:
            at = last = max(last, end)
            continue
        out += [text[at:start], f"<{kind.upper()}>"]
        at = last = end
    return "".join([*out, text[at:]])


def mask_personal_data(df: DataFrame, text: str = "text", n_chars: str | None = None) -> DataFrame:
    """The same columns with spans masked in the text; ``n_chars`` names a column to hold the new length. Null stays null."""
    at, columns = df.columns.index(text), df.columns
    length = columns.index(n_chars) if n_chars else None
    kind = df.schema[n_chars].dataType if n_chars else None
    arrow = {T.LongType: pa.int64(), T.IntegerType: pa.int32()}.get(type(kind), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else masked(t, find_spans(t)) for t in each(batch.column(at))]
            arrays = list(batch.columns)
            arrays[at] = pa.array(texts, pa.string())
            if length is not None:
                arrays[length] = pa.array([None if t is None else len(t) for t in texts], arrow)
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return df.mapInArrow(run, df.schema)


def personal_data(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, counts of the base kinds, all spans as an array of (kind, start, end), and their digests."""
    schema = T.StructType(
        [
            df.schema[key],
            *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS],
            T.StructField("base_sha256", T.StringType()),
            T.StructField("spans", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [find_spans(t or "") for t in each(batch.column(1))]
            base = [hashlib.sha256(joined([s for s in r if s[0] in BASE]).encode()).hexdigest() for r in rows]
            counts = [pa.array([sum(s[0] == k for s in r) for r in rows], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(base, pa.string()), pa.array([joined(r) for r in rows], pa.string())], schema.names
            )

    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, schema)

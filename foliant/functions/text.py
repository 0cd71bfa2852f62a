"""Text functions as columns: all but ``sanitise_text`` run in the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions import sanitise as _sanitise


def mask_digits(text: Column) -> Column:
    """A line's identity without its numbers: every digit run as one ``#``."""
    return F.regexp_replace(text, r"(?U)\d+", "#")


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t\r\n\f]+", " ")


def escape_markdown(text: Column, quoted: bool = False) -> Column:
    """Minimal inline escapes; entity-shaped ampersands first, so that no escape is escaped again."""
    out = F.regexp_replace(text, r"&(?=#?[0-9A-Za-z_]+;)", "&amp;")
    out = F.regexp_replace(out, r"(?U)([\\`*\[\]]|(?<![^\W_])_|_(?![^\W_]))", r"\\$1")
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    if quoted:
        out = F.replace(out, F.lit('"'), F.lit("&quot;"))
    out = F.translate(out, "\r\n\t", "   ")
    controls = out
    for code in [*range(9), 11, 12, *range(14, 32), *range(127, 160)]:
        controls = F.replace(controls, F.lit(chr(code)), F.lit(f"&#{code};"))
    return F.when(out.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"), controls).otherwise(out)


def escape_line_start(line: Column) -> Column:
    bare = F.ltrim(line, F.lit(" \t"))
    opens = r"^(?:[#>+|-]|=+[ \t]*\z|~~~|:-+:?(?:[ \t]*\|[ \t]*:?-+:?)*[ \t]*\|?[ \t]*\z)"
    return F.when(bare.rlike(opens), F.concat(F.lit("\\"), bare)).otherwise(F.regexp_replace(bare, r"\A([0-9]+)(?=[.)](?:[ \t]|\z))", r"$1\\"))


def escape_heading_end(text: Column) -> Column:
    return F.regexp_replace(text, r"(\A|[ \t])(#+[ \t]*)\z", r"$1\\$2")


def heading_line(text: Column, level: Column) -> Column:
    """Levels 1 to 4 two deeper, 5 and 6 as a bold line."""
    bold = F.concat(F.lit("**Heading "), level.cast("string"), F.lit(": "), text, F.lit("**"))
    return F.when(level > 4, bold).otherwise(F.concat(F.repeat(F.lit("#"), level + 2), F.lit(" "), escape_heading_end(text)))


def source_html(line: Column, raw: bool = False) -> Column:
    """Source tags inert; for raw routes entity shapes and fence openers too."""
    out = line
    if raw:
        out = F.regexp_replace(F.regexp_replace(out, r"&(?=#?[0-9A-Za-z_]+;)", "&amp;"), r"\A( {0,3})(?=```|~~~)", r"$1\\")
    return F.replace(out, F.lit("<"), F.lit("&lt;"))


def fence(code: Column) -> Column:
    """A text in a fence longer than any run of backticks in it."""
    runs = F.transform(F.regexp_extract_all(code, F.lit("`+"), F.lit(0)), F.length)
    mark = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))
    return F.concat(mark, F.lit("\n"), code, F.lit("\n"), mark)


def table_row(cells: Column, width: Column) -> Column:
    padded = F.concat(F.transform(cells, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), F.array_repeat(F.lit(""), width - F.size(cells)))
    return F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"))


def markdown_table(rows: Column) -> Column:
    """Ragged rows of strings as a Markdown table, the first row as header; null without any cell."""
    width = F.array_max(F.transform(rows, F.size))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.transform(rows, lambda r: table_row(r, width))
    return F.when(width > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))), "\n"))


def unit_key(kind: Column, ordinal: Column) -> Column:
    return F.format_string("%s/%06d", kind, ordinal)


def unit_anchor(kind: Column, ordinal: Column) -> Column:
    return F.format_string("unit-%s-%06d", kind, ordinal)


def unit_heading(kind: Column, ordinal: Column, label: Column) -> Column:
    titled = F.concat(F.initcap(kind), F.lit(" "), ordinal.cast("string"), F.lit(': "'), escape_markdown(label, quoted=True), F.lit('"'))
    return F.when(kind == "page", F.concat(F.lit("Page "), ordinal.cast("string"))).otherwise(titled)


def ascii_integer(value: Column, default: Column) -> Column:
    """Optionally signed ASCII digits, capped at 10^12 either way; anything else is the default."""
    trimmed = F.trim(F.coalesce(value, F.lit("")))
    digits = F.regexp_replace(trimmed, r"^[+-]?0*", "")
    size = F.when(F.length(digits) > 12, F.lit(10**12)).otherwise(F.coalesce(digits.try_cast("long"), F.lit(0)))
    return F.when(trimmed.rlike(r"^[+-]?[0-9]+$"), F.when(trimmed.startswith("-"), -size).otherwise(size)).otherwise(default)


def loss_counts(text: Column) -> dict[str, Column]:
    """The cleanup counters of ``sanitise_text`` (ASCII folding), by regular expressions."""
    rest = F.regexp_replace(text, r"\(cid:\d+\)", "")
    count = lambda pattern, t=rest: F.regexp_count(t, F.lit(pattern)).cast("long")
    return {
        "control_chars": count(r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}&&[^\t\n­﻿]]"),
        "soft_hyphens": count(r"­"),
        "nbsp": count(r" "),
        "pua_glyphs": count(r"\p{Co}"),
        "cid_survivors": count(r"\(cid:\d+\)", text),
        "ligatures": count("[ﬀ-ﬆ]"),
        "broken_words": count("[A-Za-z]+š[A-Za-z]*|[A-Za-z]*š[A-Za-z]+", text),
    }


_CLEAN = T.StructType([T.StructField("text", T.StringType()), *[T.StructField(n, T.LongType()) for n in (*_sanitise.LOSSES, "broken_words")]])


@F.pandas_udf(_CLEAN)
def sanitise_text(text: pd.Series) -> pd.DataFrame:
    """Clean ASCII text with its losses; Unicode decomposition has no JVM function."""
    rows = [(None, *[0] * 8) if t is None else (lambda r: (r[0], *[r[1][k] for k in _sanitise.LOSSES], r[2]))(_sanitise.sanitise(t)) for t in text]
    return pd.DataFrame(rows, columns=["text", *_sanitise.LOSSES, "broken_words"])

"""Workbook grids: addresses, occupied ranges, merged areas, cached values and Markdown grids."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The last row and column of a sheet, and positions of a dense grid.
LAST_ROW, LAST_COLUMN, DENSE_POSITIONS = 1_048_576, 16_384, 100_000


def column_letters(column: Column) -> Column:
    """1 to 16384 as A to XFD."""
    c = column.cast("long")
    letter = lambda n: F.char(F.lit(65) + n)
    third, second, first = F.floor((c - 27) / 676), F.floor((c - 1) / 26), (c - 1) % 26
    return (
        F.when((c < 1) | (c > LAST_COLUMN), None)
        .when(c <= 26, letter(first))
        .when(c <= 702, F.concat(letter((second - 1) % 26), letter(first)))
        .otherwise(F.concat(letter(third - 1), letter((second - 1) % 26), letter(first)))
    )


def address(row: Column, column: Column) -> Column:
    return F.concat(column_letters(column), row.cast("string"))


def column_number(letters: Column) -> Column:
    """A to XFD as 1 to 16384; anything else is null."""
    ordinal = lambda i: F.ascii(F.substring(letters, i, 1)) - 64
    value = (
        F.when(F.length(letters) == 1, ordinal(1))
        .when(F.length(letters) == 2, ordinal(1) * 26 + ordinal(2))
        .when(F.length(letters) == 3, ordinal(1) * 676 + ordinal(2) * 26 + ordinal(3))
    )
    return F.when(letters.rlike(r"^[A-Z]{1,3}$") & (value <= LAST_COLUMN), value.cast("long"))


def parse_address(text: Column) -> Column:
    """(row, col) of an A1 address with optional dollar signs; null outside the sheet."""
    letters = F.regexp_extract(text, r"^\$?([A-Z]{1,3})\$?[0-9]{1,7}$", 1)
    row = F.regexp_extract(text, r"^\$?[A-Z]{1,3}\$?([0-9]{1,7})$", 1).try_cast("long")
    col = column_number(letters)
    return F.when((row >= 1) & (row <= LAST_ROW) & col.isNotNull(), F.struct(row.alias("row"), col.alias("col")))


def occupied_range(cells: DataFrame, keys: list[str]) -> DataFrame:
    """First and last row and column, and the range as an address."""
    r = cells.groupBy(*keys).agg(*[f(F.col(c)).cast("long").alias(n) for f, c, n in ((F.min, "row", "top"), (F.min, "col", "left"), (F.max, "row", "bottom"), (F.max, "col", "right"))])
    return r.withColumn("range", F.concat(address(F.col("top"), F.col("left")), F.lit(":"), address(F.col("bottom"), F.col("right"))))


def merged_cells(cells: DataFrame, merges: DataFrame, keys: list[str]) -> DataFrame:
    """Each cell with the first merged area that holds it: an equi-join on the sheet and row bands, then containment.

    Areas are exploded into bands of 64 rows, so a cell meets only the areas of its band and not all of its sheet's. Of
    areas over the same cells only the first goes on.
    """
    merges = merges.groupBy(*keys, "top", "left", "bottom", "right").agg(F.min("ord").alias("ord"))
    band = F.explode(F.sequence(F.floor(F.col("top") / 64), F.floor(F.col("bottom") / 64))).alias("_band")
    areas = merges.select(*keys, "top", "left", "bottom", "right", "ord", band)
    inside = (F.col("row").between(F.col("top"), F.col("bottom"))) & (F.col("col").between(F.col("left"), F.col("right")))
    found = cells.withColumn("_band", F.floor(F.col("row") / 64)).join(areas, [*keys, "_band"]).where(inside)
    return found.groupBy(*keys, "row", "col").agg(F.min("ord").cast("long").alias("merge_ord"))


def with_cached(cells: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """Native cells with the cached value of their position where it is neither error nor blank."""
    usable = cached.where("value_type not in ('error', 'blank')").select(*keys, "row", "col", F.col("value").alias("cached_value"))
    return cells.join(usable, [*keys, "row", "col"], "left")


def readable_cells(native: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """What a grid shows at each position: an error before a missing result, blank, shown value, native value."""
    both = native.select(*keys, "row", "col", F.col("value").alias("_native"), "state").join(
        values.select(*keys, "row", "col", F.col("value").alias("_shown")), [*keys, "row", "col"], "full_outer"
    )
    text = (
        F.when(F.col("state") == "error", F.col("_native"))
        .when(F.col("state") == "missing", "[missing cached result]")
        .when(F.col("_shown").isNotNull(), F.col("_shown"))
        .when(F.col("state") == "blank", "[blank]")
        .otherwise(F.col("_native"))
    )
    return both.select(*keys, "row", "col", text.alias("text"))


def addressed_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """A Markdown row per occupied sheet row: the row number, then ``A1: value`` of its cells by column."""
    cell = F.concat(address(F.col("row"), F.col("col")), F.lit(": "), F.replace(F.col("text"), F.lit("|"), F.lit("\\|")))
    parts = F.array_sort(F.collect_list(F.struct("col", cell.alias("t"))))
    rows = cells.groupBy(*keys, "row").agg(F.array_join(F.transform(parts, lambda x: x["t"]), " | ").alias("_t"))
    return rows.select(*keys, "row", F.concat(F.lit("| "), F.col("row").cast("string"), F.lit(" | "), F.col("_t"), F.lit(" |")).alias("line"))


def expand_repeats(cells: DataFrame) -> DataFrame:
    """Cells with row and column repeats as one row per position; blank repeats stay one ``blank-range`` row."""
    blank = cells.where("value is null").select("*", F.lit("blank-range").alias("kind"))
    full = cells.where("value is not null")
    down = full.withColumn("_r", F.explode(F.sequence(F.lit(0), F.col("row_repeat") - 1)))
    wide = down.withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("col_repeat") - 1)))
    moved = wide.withColumns({"row": F.col("row") + F.col("_r"), "col": F.col("col") + F.col("_c")}).drop("_r", "_c")
    return moved.withColumn("kind", F.lit("cell")).unionByName(blank)


def formula_counts(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.where("formula is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("formulas"))


_TOKEN = re.compile(r"\"(?:[^\"]|\"\")*\"|'(?:[^']|'')*'!|\[[^\]]*\]|[A-Za-z_\\][A-Za-z0-9_.]*(?=\()|(?<![A-Za-z0-9_.$])(\$?)([A-Za-z]{1,3})(\$?)([0-9]{1,7})(?![A-Za-z0-9_(.])")


def shift_formula(formula: str, rows: int, columns: int) -> str:
    """Relative A1 references moved by rows and columns; strings, sheet names and functions stay; outside the sheet ``#REF!``."""

    def number(letters: str) -> int:
        n = 0
        for c in letters.upper():
            n = n * 26 + ord(c) - 64
        return n

    def letters(n: int) -> str:
        out = ""
        while n:
            n, r = divmod(n - 1, 26)
            out = chr(65 + r) + out
        return out

    def one(m: re.Match) -> str:
        if m[2] is None:
            return m[0]
        col, row = number(m[2]), int(m[4])
        if col > LAST_COLUMN or not 1 <= row <= LAST_ROW:
            return m[0]
        col, row = col if m[1] else col + columns, row if m[3] else row + rows
        if not (1 <= col <= LAST_COLUMN and 1 <= row <= LAST_ROW):
            return "#REF!"
        return f"{m[1]}{letters(col)}{m[3]}{row}"

    return _TOKEN.sub(one, formula)


@F.pandas_udf(T.StringType())
def shifted_formula(formula: pd.Series, rows: pd.Series, columns: pd.Series) -> pd.Series:
    return pd.Series([None if f is None else shift_formula(f, int(r), int(c)) for f, r, c in zip(formula, rows, columns)])


def shared_formulas(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Followers of a shared formula with their own text: a self-join on the shared index, then a shift."""
    masters = cells.where("formula is not null and shared is not null").select(*keys, "shared", F.col("formula").alias("_f"), F.col("row").alias("_r"), F.col("col").alias("_c"))
    first = masters.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "shared").orderBy("_r", "_c"))).where("_n = 1").drop("_n")
    joined = cells.join(first, [*keys, "shared"], "left")
    own = F.coalesce(F.col("formula"), F.when(F.col("_f").isNotNull(), shifted_formula("_f", F.coalesce(F.col("row") - F.col("_r"), F.lit(0)), F.coalesce(F.col("col") - F.col("_c"), F.lit(0)))))
    return joined.withColumn("formula", own).drop("_f", "_r", "_c")

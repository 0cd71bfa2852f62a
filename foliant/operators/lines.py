"""Line operators: page furniture, duplicates in order, bands, runs, list numbers, and units of ordered blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import mask_digits


def exploded_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line), lines numbered from 0."""
    return docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))


def running_heads(lines: DataFrame, group: str, page: str, line: str, least: int = 3) -> DataFrame:
    """(group, head, pages): lines that, digits masked, stand on ``least`` different pages or more of a group."""
    masked = lines.select(group, page, mask_digits(F.trim(F.col(line))).alias("head")).where("head <> ''")
    return masked.groupBy(group, "head").agg(F.countDistinct(page).alias("pages")).where(F.col("pages") >= least)


def drop_furniture(lines: DataFrame, heads: DataFrame, group: str, line: str) -> DataFrame:
    """The lines that are no running head: an anti-join on the masked line."""
    return lines.withColumn("_head", mask_digits(F.trim(F.col(line)))).join(heads.select(group, F.col("head").alias("_head")), [group, "_head"], "left_anti").drop("_head")


def first_of_equal(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, order): the first place of each distinct value, so that distinct rows keep their order."""
    return rows.groupBy(*keys).agg(F.min(order).alias(order))


def longest_run(flags: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """(keys, start, length) of the longest run of true flags, the earliest of equals: gaps and islands."""
    w = Window.partitionBy(*keys).orderBy(order)
    numbered = flags.withColumn("_n", F.row_number().over(w)).where(flag)
    island = numbered.withColumn("_island", F.col("_n") - F.row_number().over(w))
    runs = island.groupBy(*keys, "_island").agg(F.min("_n").alias("start"), F.count(F.lit(1)).alias("length"))
    best = F.max_by(F.struct("start", "length"), F.struct("length", -F.col("start"))).alias("r")
    return runs.groupBy(*keys).agg(best).select(*keys, F.col("r.start").cast("long").alias("start"), F.col("r.length").cast("long").alias("length"))


def bands(lines: DataFrame, keys: list[str], top: str, bottom: str, factor: float = 1.6) -> DataFrame:
    """A band number per line: a new band where the gap to the line above exceeds ``factor`` times the median pitch."""
    w = Window.partitionBy(*keys).orderBy(top)
    gaps = lines.withColumn("_gap", F.col(top) - F.lag(bottom).over(w)).withColumn("_pitch", F.col(top) - F.lag(top).over(w))
    pitch = gaps.groupBy(*keys).agg(F.median("_pitch").alias("_median"))
    split = F.when(F.col("_gap") > factor * F.col("_median"), 1).otherwise(0)
    return gaps.join(pitch, keys).withColumn("band", F.sum(split).over(w).cast("long")).drop("_gap", "_pitch", "_median")


def list_numbers(items: DataFrame, keys: list[str], order: str, value: str, start: Column, step: int = 1) -> DataFrame:
    """Ordered-list numbers: a given value restarts the count; clamped to 0..999999999."""
    w = Window.partitionBy(*keys).orderBy(order)
    group = items.withColumn("_restart", F.count(value).over(w))
    g = Window.partitionBy(*keys, "_restart").orderBy(order)
    base = F.coalesce(F.first(value).over(g), start)
    number = base + step * (F.row_number().over(g) - 1)
    return group.withColumn("number", F.least(F.greatest(number, F.lit(0)), F.lit(999_999_999)).cast("long")).drop("_restart")


def chapters(blocks: DataFrame, keys: list[str], order: str, is_heading: str) -> DataFrame:
    """A chapter number per block: 0 before the first heading, then one more at each."""
    w = Window.partitionBy(*keys).orderBy(order)
    return blocks.withColumn("chapter", F.sum(F.when(F.col(is_heading), 1).otherwise(0)).over(w).cast("long"))


def interleave(rows: DataFrame, keys: list[str], family: str, order: str, most: int) -> DataFrame:
    """The first ``most`` rows of a group with its families taking turns."""
    w = Window.partitionBy(*keys, family).orderBy(order)
    turn = rows.withColumn("_turn", F.row_number().over(w))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_turn", family))
    return turn.withColumn("place", place.cast("long")).where(F.col("place") <= most).drop("_turn")


def join_lines(rows: DataFrame, keys: list[str], order: str, line: str, name: str = "markdown") -> DataFrame:
    """A group's lines in order, with one final line break."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("l"))))
    return rows.groupBy(*keys).agg(F.concat(F.array_join(F.transform(parts, lambda x: x["l"]), "\n"), F.lit("\n")).alias(name))


def within_budget(rows: DataFrame, keys: list[str], order: list[str], amount: str, limit: int) -> DataFrame:
    """Rows up to which the running sum of an amount stays within an inclusive limit."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("used", F.sum(amount).over(w).cast("long")).where(F.col("used") <= limit)

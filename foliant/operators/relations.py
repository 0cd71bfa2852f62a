"""Reference-shaped joins: relationships by id, fallback chains, inherited attributes, versions, first-wins labels, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.session import cut_lineage


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by order, as one grouped maximum (no window sort)."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others])


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.col(order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others])


def by_label(references: DataFrame, definitions: DataFrame, label: str, order: str) -> DataFrame:
    """References with the first definition of their label, white space folded and case ignored."""
    folded = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    first = first_wins(definitions.withColumn("_label", folded(F.col(label))).drop(label), ["_label"], order).drop(order)
    return references.withColumn("_label", folded(F.col(label))).join(first, "_label", "left").drop("_label")


def ambiguous(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, matches) of keys that don't have exactly one row."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("matches")).where("matches <> 1")


def inherited(nodes: DataFrame, value: str, key: str = "id", parent: str = "parent", order: str = "path") -> DataFrame:
    """The nearest own or ancestor value: a join with exploded ancestor paths, the deepest wins.

    Values and results grow with the nodes, so both joins are merge joins: what looks small compressed would be broadcast otherwise.
    """
    up = nodes.select(key, F.posexplode(order).alias("_depth", "_up"))
    own = nodes.where(F.col(value).isNotNull()).select(F.col(key).alias("_up"), F.col(value).alias("_v"))
    best = up.join(own.hint("merge"), "_up").groupBy(key).agg(F.max_by("_v", "_depth").alias(value))
    return nodes.drop(value).join(best.hint("merge"), key, "left")


def fallback_chain(spark: SparkSession, items: DataFrame) -> DataFrame:
    """(id, target): follow ``fallback`` until an item is ``usable``; null at a cycle or a dead end.

    Each round doubles the hops that a row has behind it, so chains of any length close in log2 rounds; what is open after as
    many hops as there are items is on a cycle. An id with different rows is an error.
    """
    rows = items.select("id", "usable", "fallback").distinct()
    n, ids = rows.agg(F.count("id"), F.countDistinct("id")).first()
    if n != ids:
        raise ValueError("an id has different fallbacks")
    known = rows.select(F.col("id").alias("fallback"), F.lit(True).alias("_known"))
    onward = F.coalesce(~F.col("usable") & F.col("_known"), F.lit(False))
    start = rows.join(known, "fallback", "left")
    state = cut_lineage(start.select("id", F.when(onward, F.col("fallback")).otherwise(F.col("id")).alias("at"), onward.alias("open"), F.coalesce("usable", F.lit(False)).alias("good")))
    hops = 1
    while hops < n and not state.where("open").isEmpty():
        ahead = state.select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("open").alias("_open"), F.col("good").alias("_good"))
        moved = state.where("open").select("id", "at").join(ahead, "at").select("id", F.col("_at").alias("at"), F.col("_open").alias("open"), F.col("_good").alias("good"))
        state = cut_lineage(state.where("not open").unionByName(moved))
        hops *= 2
    return state.select("id", F.when(~F.col("open") & F.col("good"), F.col("at")).alias("target"))


def multiset_anti(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of the left that the right has no equal for, each right row answering for one left row."""
    place = lambda df: df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return place(left).join(place(right).select(*keys, "_n"), [*keys, "_n"], "left_anti").drop("_n")


def versions(rows: DataFrame, keys: list[str], precedence: str) -> DataFrame:
    """The row of the lowest precedence number per key."""
    return first_wins(rows, keys, precedence)


def paired(tokens: DataFrame, keys: list[str], order: str, kind: str, opening: str, closing: str) -> DataFrame:
    """Opening and closing tokens paired by nesting depth: the n-th opening of a depth closes at the n-th closing of it."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = F.when(F.col(kind) == opening, 1).when(F.col(kind) == closing, -1).otherwise(0)
    depth = F.sum(step).over(w) + F.when(F.col(kind) == closing, 1).otherwise(0)
    marked = tokens.withColumn("_depth", depth).where(F.col(kind).isin(opening, closing))
    nth = F.row_number().over(Window.partitionBy(*keys, "_depth", kind).orderBy(order))
    numbered = marked.withColumn("_n", nth)
    a = numbered.where(F.col(kind) == opening).select(*keys, "_depth", "_n", F.col(order).alias("begin"))
    b = numbered.where(F.col(kind) == closing).select(*keys, "_depth", "_n", F.col(order).alias("end"))
    return a.join(b, [*keys, "_depth", "_n"]).select(*keys, F.col("_depth").cast("long").alias("depth"), "begin", "end")


#: The capabilities of an inspection report, in report order.
CAPABILITIES = (
    "links", "images", "scripts", "styles", "forms", "metadata", "comments", "hidden_content", "embedded_documents", "attachments", "active_content",
    "formulas", "annotations", "signatures",
)


def evidence_grid(documents: DataFrame, findings: DataFrame, key: str = "source_id") -> DataFrame:
    """Each document times each capability (a list of fixed length) with its number of findings."""
    grid = documents.select(key, F.explode(F.array(*map(F.lit, CAPABILITIES))).alias("capability"))
    counts = findings.groupBy(key, "capability").agg(F.count(F.lit(1)).alias("_n"))
    return grid.join(counts, [key, "capability"], "left").select(key, "capability", F.coalesce("_n", F.lit(0)).cast("long").alias("findings"))


def fold_coverage(events: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Status per key from ordered events (status, failed, recovered, reason): once failed, always partial or unavailable."""
    failed, found = F.bool_or("failed"), F.bool_or("recovered")
    reasons = F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct(F.col(order).alias("o"), F.col("reason").alias("r")))))
    return events.groupBy(*keys).agg(
        F.when(failed & found, "partial").when(failed, "unavailable").otherwise(F.max_by("status", order)).alias("status"),
        F.array_join(F.transform(reasons, lambda x: x["r"]), "; ").alias("reason"),
    )


def coverage_rollup(coverage: DataFrame, key: str = "source_id") -> DataFrame:
    """Number of capabilities by status, a column each."""
    states = ("complete", "partial", "unavailable", "not_applicable")
    return coverage.groupBy(key).agg(*[F.count_if(F.col("status") == s).cast("long").alias(s) for s in states])


def capped(rows: DataFrame, keys: list[str], order: list[str | Column], most: int) -> DataFrame:
    """The first rows of each key, as a report caps its lists; Spark keeps the same number in each task before it shuffles."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place", place.cast("long")).where(F.col("place") <= most)

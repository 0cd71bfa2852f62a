"""Sources, routes and receipts: which converter takes a file, what it is, and what became of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The closed route table (suffix, route, unit kind, encoding of the Markdown, whether the route writes markup).
ROUTES = (
    (".html", "html", "chapter", "utf-8", True),
    (".txt", "text", "", "utf-8", False),
    (".md", "text", "", "utf-8", False),
    (".eml", "eml", "chapter", "utf-8", True),
    (".docx", "docx", "chapter", "ascii", False),
    (".pptx", "pptx", "slide", "ascii", False),
    (".epub", "epub", "chapter", "utf-8", True),
    (".odt", "odt", "chapter", "utf-8", False),
    (".odp", "odp", "slide", "utf-8", False),
    (".xlsx", "sheet", "sheet", "utf-8", False),
    (".xlsm", "sheet", "sheet", "utf-8", False),
    (".xls", "sheet", "sheet", "utf-8", False),
    (".xlsb", "sheet", "sheet", "utf-8", False),
    (".ods", "sheet", "sheet", "utf-8", False),
    (".pdf", "pdf", "page", "ascii", False),
)


def suffix_of(name: Column) -> Column:
    """The last suffix in lower case, empty without one."""
    return F.lower(F.regexp_extract(name, r"[^/](\.[^./]*)$", 1))


def routes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROUTES, "suffix string, route string, unit_kind string, encoding string, markup boolean")


def with_route(sources: DataFrame, name: str = "name") -> DataFrame:
    """Suffix and route of each source by a join with the 15-row route table; no route means refused."""
    table = F.broadcast(routes(sources.sparkSession).withColumnRenamed("suffix", "_suffix"))
    return sources.withColumn("suffix", suffix_of(F.col(name))).join(table, F.col("suffix") == F.col("_suffix"), "left").drop("_suffix")


def identity(sources: DataFrame, content: str = "content") -> DataFrame:
    """Byte size and SHA-256 of each source; without them the scan never reads the content."""
    raw = F.col(content).cast("binary")
    return sources.withColumns({"byte_size": F.octet_length(raw).cast("long"), "sha256": F.sha2(raw, 256)})


def receipts(rendered: DataFrame) -> DataFrame:
    """One JSON line per source, keys in order, absent facts left out."""
    keys = sorted(rendered.columns)
    return rendered.select(*[c for c in ("source_id",) if c in keys], F.to_json(F.struct(*keys)).alias("receipt"))

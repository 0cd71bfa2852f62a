"""File scans: a folder of documents as sources, in batch or as a stream. Content is read only where a plan asks for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.routing import with_route


def _sources(files: DataFrame) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    named = files.select(F.xxhash64("path").alias("source_id"), "path", name.alias("name"), F.col("length").alias("byte_size"), "content")
    return with_route(named)


def scan(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(source_id, path, name, byte_size, content, suffix, route, unit_kind, encoding, markup) of each file below a path."""
    return _sources(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path))


def scan_stream(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """The same as a stream; a file arrives whole, so per-document operators need no state."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return _sources(spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(path))

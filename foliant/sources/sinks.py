"""Sinks: converted documents and receipts as tables, and single files written whole or not at all."""

from __future__ import annotations

import os
import tempfile
import unicodedata
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def colliding_names(converted: DataFrame, name: str = "name") -> DataFrame:
    """Target names that more than one source would write, compared without case."""
    return converted.groupBy(F.lower(F.col(name)).alias("target")).agg(F.count(F.lit(1)).alias("sources")).where("sources > 1")


def write_tables(converted: DataFrame, folder: str) -> None:
    """Markdown as Parquet and receipts as text, one JSON line per source; Spark's committer makes each appear whole."""
    converted.drop("receipt").write.mode("errorifexists").parquet(f"{folder}/documents")
    converted.select(F.col("receipt").alias("value")).write.mode("errorifexists").text(f"{folder}/receipts")


def write_files(targets: Mapping[str, bytes], sources: tuple[str, ...] = ()) -> None:
    """Write every target or none: stage and sync beside each, then replace; what was replaced is restored on failure."""
    folded = [unicodedata.normalize("NFC", os.path.realpath(t)).casefold() for t in targets]
    if len(set(folded)) < len(folded):
        raise ValueError("two outputs name one file")
    if set(folded) & {unicodedata.normalize("NFC", os.path.realpath(s)).casefold() for s in sources}:
        raise ValueError("an output names a source")
    for t in targets:
        if os.path.lexists(t) and not os.path.isfile(t):
            raise ValueError(f"not a regular file: {t}")
    staged: dict[str, str] = {}
    held: dict[str, bytes | None] = {}
    try:
        for t, data in targets.items():
            fd, path = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(t)), prefix=".staged-")
            staged[t] = path
            with os.fdopen(fd, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
        for t, path in staged.items():
            if os.path.exists(t):
                with open(t, "rb") as f:
                    held[t] = f.read()
            else:
                held[t] = None
            os.replace(path, t)
    except OSError:
        for t, old in held.items():
            if old is None:
                os.path.exists(t) and os.unlink(t)
            else:
                with open(t, "wb") as f:
                    f.write(old)
        raise
    finally:
        for path in staged.values():
            if os.path.exists(path):
                os.unlink(path)


def unknown_keys(requested: DataFrame, listed: DataFrame, key: str = "key") -> DataFrame:
    """Requested artifact keys that no source lists."""
    return requested.join(listed.select(key), key, "left_anti")

"""Every registered query of the library, by name, with its oracle where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.queries import fixtures, html, platform, relations, text

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (html, text, relations, platform, fixtures)


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, (query, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}

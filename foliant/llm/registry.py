"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.session import bound_batches

Query = Callable[[SparkSession, str], DataFrame]

MODULES: dict[str, str] = {
    "op1_personal_data": "op1",
    "op2_perplexity_quality": "op2",
    "op3_main_text": "op3",
    "op4_preference_format": "op4",
    "op5_packing": "op5",
    "op6_language_id": "op6",
    "op7_simhash": "op7",
    "op8_decontamination": "op8",
    "op9_quality_rules": "op9",
    "op10_toxicity": "op10",
}


def _bounded(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    import corpus_pipeline

    found = {name: _bounded(getattr(importlib.import_module(f"foliant.llm.queries.{m}"), name)) for name, m in MODULES.items()}
    return {**found, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {name: getattr(importlib.import_module(f"foliant.llm.queries.{m}"), "SQL", None) for name, m in MODULES.items()}
    found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {name: sql for name, sql in found.items() if sql}

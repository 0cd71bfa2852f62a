"""op3_main_text: the main text of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm.pages import extract_main_text


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))

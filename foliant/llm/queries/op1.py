"""op1_personal_data: spans of personal data in every whole document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm.pii import personal_data


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

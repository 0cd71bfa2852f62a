"""op8_decontamination: test items found in the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm.decontaminate import find_leaks


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

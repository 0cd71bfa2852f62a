"""op2_perplexity_quality: perplexity of every document under a model of documents labelled as good."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm.perplexity import judge_quality


def op2_perplexity_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return judge_quality(docs, trusted)

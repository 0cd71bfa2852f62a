"""op6_language_id: learned from documents outside the held-out quarter, predicted for all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.language import fit_language, predict_language
from foliant.llm.sampling import held_out


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_language(docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id"))))
    kept_out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict_language(kept_out, model)

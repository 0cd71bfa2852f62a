"""op10_toxicity: learned from labels outside the held-out quarter, scored over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.sampling import held_out
from foliant.llm.toxicity import fit_toxicity, score_toxicity


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    model = fit_toxicity(docs, labels.where(~held_out(F.col("doc_id"))))
    scored = score_toxicity(docs.withColumn("held_out", held_out(F.col("doc_id"))), model)
    return scored.select("doc_id", "held_out", "score", "predicted")

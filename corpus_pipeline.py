"""Corpus preparation: five stages over ``documents``, each a call of an operator of ``foliant.llm``.

language: documents without letters, or whose best language has a calibrated probability under ``LEAST_LANGUAGE``, go.
near_dedup: one document of each component of near copies stays, the one of the least id.
decontamination: documents that hold a benchmark item go.
personal_data: spans of personal data are masked, and ``n_chars`` follows.
packing: the rest is tokenised and packed; one row per piece.

Defined results: null and empty texts are rejected by the first stage, since no language can be read from them; an empty
table gives an empty result in every stage; repeated rows are near copies of each other; further columns, whatever their
names, are carried through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import decontaminate, language, packing, pii, simhash
from foliant.llm.columns import free_name
from foliant.llm.sampling import held_out
from foliant.session import bound_batches, cut_lineage

LEAST_LANGUAGE = 0.35


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    model = language.fit_language(docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id"))))
    predicted, score = free_name(docs, "_predicted"), free_name(docs, "_score")
    found = language.with_language(docs, model, names=(predicted, score))
    return found.where((F.col(predicted) != language.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE)).drop(predicted, score)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return simhash.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return pii.mask_personal_data(docs, n_chars="n_chars" if "n_chars" in docs.columns else None)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

#: The stages hold a trained model, fingerprints and a tokeniser, which SQL can't express; tests/llm/test_pipeline.py has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; each stage's rows are written to the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

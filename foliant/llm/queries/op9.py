"""op9_quality_rules: the rule ledger and its v1 verdicts over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm.rules import apply_policy, evaluate_rules


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return apply_policy(evaluate_rules(docs), "v1").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_bits"
    )


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM w)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM f) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup
      FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d)
      WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(l.n_dup, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
             coalesce(l.n_lines, 0)::BIGINT AS n_lines,
             (length(t) - length(replace(t, '|', '')))::BIGINT AS n_pipes, upper(t) <> t AS has_lower
      FROM w LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN l ON l.doc_id = w.doc_id),
b AS (SELECT *, ((n_words < 50)::BIGINT | ((100 * n_repeat_words > 50 * n_words)::BIGINT << 1)
             | ((n_words > 100000)::BIGINT << 2) | ((word_chars < 2 * n_words OR word_chars > 12 * n_words)::BIGINT << 3)
             | ((10 * n_symbols > n_words)::BIGINT << 4) | ((10 * n_dup_lines > 3 * n_lines)::BIGINT << 5)
             | ((NOT has_lower)::BIGINT << 6) | ((5 * n_pipes > n_words)::BIGINT << 7)) AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       ((failed_bits & (1 + 2 + 8 + 16 + 32)) = 0) AS kept, failed_bits
FROM b
"""

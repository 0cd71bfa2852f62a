"""op4_preference_format: conversations paired by their first turns as prompt and masked completions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm.chat import format_conversations


def op4_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = r"""
WITH t AS (SELECT conv_id, conv_id - (conv_id % 1024 + 1024) % 1024 AS b, role, text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k
           FROM conversations WHERE conv_id IS NOT NULL),
f AS (SELECT conv_id, b, role, text, row_number() OVER (PARTITION BY b, role, text ORDER BY conv_id) <=
             count(*) OVER (PARTITION BY b, role, text) // 2 * 2 AS alike FROM t WHERE k = 1),
g AS (SELECT conv_id, row_number() OVER w AS r, lag(conv_id) OVER w AS before FROM f
      WINDOW w AS (PARTITION BY b, alike, CASE WHEN alike THEN role END, CASE WHEN alike THEN text END ORDER BY conv_id)),
c AS (SELECT CASE WHEN r % 2 = 1 THEN conv_id ELSE before END AS pair_id, (r - 1) % 2 AS side, role, text, k FROM t JOIN g USING (conv_id)),
h AS (SELECT *, '<|im_start|>' || replace(coalesce(role, ''), '<|im_', '< |im_') || chr(10) AS head,
             replace(coalesce(text, ''), '<|im_', '< |im_') || '<|im_end|>' AS body FROM c),
s AS (SELECT pair_id, count(*) FILTER (side = 0) AS nc, count(*) FILTER (side = 1) AS nr FROM c GROUP BY pair_id),
e AS (SELECT a.pair_id, a.k FROM c a JOIN c b ON a.pair_id = b.pair_id AND a.side = 0 AND b.side = 1 AND a.k = b.k
      AND a.role IS NOT DISTINCT FROM b.role AND a.text IS NOT DISTINCT FROM b.text),
p AS (SELECT s.pair_id, nc, nr, (SELECT count(*) FROM (SELECT k, row_number() OVER (ORDER BY k) AS r FROM e WHERE e.pair_id = s.pair_id) WHERE k = r) AS n FROM s)
SELECT p.pair_id,
       CASE WHEN nc = 0 OR nr = 0 THEN 'unpaired' WHEN n = nc AND n = nr THEN 'identical' ELSE 'paired' END AS status,
       n::BIGINT AS n_prompt_turns,
       coalesce(string_agg(head || body || chr(10), '' ORDER BY k) FILTER (side = 0 AND k <= n), '') AS prompt,
       CASE WHEN nc > 0 THEN coalesce(string_agg(head || body || chr(10), '' ORDER BY k) FILTER (side = 0 AND k > n), '') END AS chosen,
       CASE WHEN nr > 0 THEN coalesce(string_agg(head || body || chr(10), '' ORDER BY k) FILTER (side = 1 AND k > n), '') END AS rejected,
       CASE WHEN nc > 0 THEN coalesce(string_agg(length(head) || 'x0,' || length(body) || CASE WHEN role = 'assistant' THEN 'x1,' ELSE 'x0,' END || '1x0', ',' ORDER BY k)
            FILTER (side = 0 AND k > n), '') END AS chosen_mask,
       CASE WHEN nr > 0 THEN coalesce(string_agg(length(head) || 'x0,' || length(body) || CASE WHEN role = 'assistant' THEN 'x1,' ELSE 'x0,' END || '1x0', ',' ORDER BY k)
            FILTER (side = 1 AND k > n), '') END AS rejected_mask
FROM p JOIN h ON h.pair_id = p.pair_id GROUP BY p.pair_id, nc, nr, n
"""

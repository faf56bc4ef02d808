"""The queries of this subpackage, by name, and the SQL that states the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embedding_dedup, exact_dedup, hmm, language, line_dedup, packing, quality, simhash, token_codes


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.content_sort(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_near_dedup": simhash.op1,
        "op2_token_codes": token_codes.op2,
        "op3_language_id": language.op3,
        "op4_bpe": bpe.op4,
        "op5_exact_dedup": op5,
        "op6_embedding_near_dedup": embedding_dedup.op6,
        "op7_hmm_scoring": hmm.op7,
        "op8_line_dedup": line_dedup.op8,
        "op9_quality": quality.op9,
        "op10_packing": packing.op10,
    }


_OP5 = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""

_OP6 = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), good AS (
  SELECT vec_id, e FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id AS id, vec_id AS root FROM v
  UNION
  SELECT l.b, r.root FROM reach r JOIN link l ON r.id = l.a
), top AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, top.component_id, v.vec_id = top.component_id AS kept
FROM v JOIN top ON v.vec_id = top.id LEFT JOIN n ON n.a = v.vec_id
"""

_OP8 = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos
  FROM documents
), s AS (
  SELECT doc_id, pos, line, regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS stripped FROM l
), k AS (
  SELECT doc_id, pos, line, translate(stripped, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM s
), bad AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE key IN (SELECT key FROM bad)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE key NOT IN (SELECT key FROM bad)), '')) AS kept_sha256
FROM k GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": _OP5, "op6_embedding_near_dedup": _OP6, "op8_line_dedup": _OP8}

"""op4: words of repeated passages in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm.sqltext import SPACED
from marlstone.llm.substring import repeated_substrings


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_substring_dedup": op4_substring_dedup}

ORACLE_SQL = {
    "op4_substring_dedup": f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
windows AS (
  SELECT doc_id, s, array_to_string(w[s:s+19], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM words WHERE len(w) >= 20)),
later AS (
  SELECT doc_id, s FROM windows
  QUALIFY row_number() OVER (PARTITION BY x ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM later),
lost AS (SELECT doc_id, list(i) AS l FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(len(l), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN l IS NULL THEN w
         ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(l, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM words w LEFT JOIN lost ON lost.doc_id = w.doc_id
""",
}

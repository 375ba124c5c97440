"""op1: benchmark windows in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm.decontaminate import contamination
from marlstone.llm.sqltext import ASCII_LOWER, TERMS


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(documents, benchmark).drop("items")


QUERIES = {"op1_decontamination": op1_decontamination}

_WORDS = f"regexp_extract_all({ASCII_LOWER.format('coalesce(text, \'\')')}, '{TERMS}')"

ORACLE_SQL = {
    "op1_decontamination": f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wanted AS (
  SELECT DISTINCT item_id, k, array_to_string(w[s:s+k-1], ' ') AS x
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s
        FROM items WHERE len(w) > 0)),
spots AS (
  SELECT d.doc_id, d.s, d.k, x.item_id
  FROM (SELECT doc_id, k, s, array_to_string(w[s:s+k-1], ' ') AS x
        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s
              FROM docs, (SELECT DISTINCT k FROM wanted) WHERE len(w) >= k)) d
  JOIN wanted x ON x.x = d.x AND x.k = d.k),
hits AS (
  SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS i FROM spots) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS l
  FROM spots GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(n.n, 0)::BIGINT AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits h ON h.doc_id = d.doc_id LEFT JOIN named n ON n.doc_id = d.doc_id
""",
}

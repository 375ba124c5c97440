"""op7: the mix of all documents' sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm.mixing import DRAWS, SEED, mix
from marlstone.llm.sqltext import SPACED


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_source_mixing": op7_source_mixing}

ORACLE_SQL = {
    "op7_source_mixing": f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{SPACED}'))::BIGINT AS size
  FROM documents),
ranked AS (
  SELECT source, source_size, rk, w, 2 * source_size AS full_size, (2 * source_size)::DOUBLE / w AS ratio,
         sum(source_size) OVER () AS total
  FROM (SELECT source, source_size, rk, [3, 1, 2][rk % 3 + 1] AS w
        FROM (SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk
              FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)))),
levels AS (
  SELECT *, (total * 1.5::DOUBLE - coalesce(sum(full_size) OVER (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY ratio, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
chosen_level AS (
  SELECT level FROM levels WHERE level * w <= full_size ORDER BY ratio, rk LIMIT 1),
targets AS (
  SELECT source, source_size, coalesce(least(full_size::DOUBLE, (SELECT level FROM chosen_level) * w), full_size::DOUBLE) AS target
  FROM levels),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets),
draws AS (
  SELECT s.doc_id, s.size, r.source, r.source_size, r.target, r.rate, 8 * j + i AS k,
         ('0x' || substr(digest, 8 * i + 1, 8))::UBIGINT / 4294967296.0::DOUBLE AS u
  FROM (SELECT *, sha256('{SEED}:' || j::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '')) AS digest FROM sized, range({DRAWS} // 8) t(j)) s
  JOIN rates r ON s.source IS NOT DISTINCT FROM r.source, range(8) v(i)),
best AS (
  SELECT source, k FROM (
    SELECT source, k, abs(any_value(source_size) * floor(any_value(rate)) + sum(CASE WHEN u < rate - floor(rate) THEN size ELSE 0 END) - any_value(target)) AS miss
    FROM draws GROUP BY source, k)
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY miss, k) = 1)
SELECT d.doc_id, d.size, d.source_size, d.target,
       (floor(d.rate) + CASE WHEN d.u < d.rate - floor(d.rate) THEN 1 ELSE 0 END)::BIGINT AS copies,
       (d.size * (floor(d.rate) + CASE WHEN d.u < d.rate - floor(d.rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM draws d JOIN best b ON d.source IS NOT DISTINCT FROM b.source AND d.k = b.k
""",
}

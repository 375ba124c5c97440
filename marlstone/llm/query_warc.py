"""op10: all pages through WARC archives and their index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm.warc import archive_roundtrip


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return archive_roundtrip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op10_warc": op10_warc}

ORACLE_SQL = {
    "op10_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS n,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS winner
  FROM pages)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> winner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> winner THEN winner END AS refers_to
FROM p
""",
}

"""op9: license notices of all documents (no SQL: conditional compression)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm.licenses import license_notices


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_notices(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_notices", "licenses", "exact")


QUERIES = {"op9_license_scan": op9_license_scan}
ORACLE_SQL: dict[str, str] = {}

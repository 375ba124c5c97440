"""op5: quality of all documents (no SQL: a fitted model)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm.quality import score_quality


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op5_quality_classifier": op5_quality_classifier}
ORACLE_SQL: dict[str, str] = {}

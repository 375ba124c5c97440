"""op6: toxicity of all documents (no SQL: a fitted model)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm.toxicity import score_toxicity


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLE_SQL: dict[str, str] = {}

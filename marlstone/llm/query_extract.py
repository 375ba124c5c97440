"""op2: main text of all pages (no SQL: tree parsing)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm.extract import extract_main_text


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op2_html_extraction": op2_html_extraction}
ORACLE_SQL: dict[str, str] = {}

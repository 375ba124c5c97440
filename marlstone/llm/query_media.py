"""op8: all documents stored as GIF samples (no SQL: a codec)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm.media import store_media


def op8_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_media(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_media=False)


QUERIES = {"op8_gif_media": op8_gif_media}
ORACLE_SQL: dict[str, str] = {}

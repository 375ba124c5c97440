"""Streaming variants of ingestion (an extension: the batch operators are the contract)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from marlstone.operators.rank import first_per_key
from marlstone.sources.landing import path_exists, usable_raw
from marlstone.sources.schemas import RAW


def landing_stream(spark: SparkSession, path: str, *, delay: str = "1 day", files_per_batch: int = 1000) -> DataFrame:
    """New JSON-lines files of a landing folder, each request once within the delay."""
    raw = spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_batch).json(path)
    return usable_raw(raw).withWatermark("loaded_at", delay).dropDuplicatesWithinWatermark(["source", "request_hash", "source_record_id"])


def latest_sink(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """B02 for ``foreachBatch``: a table of the last delivery of each key, a version a batch.

    A batch writes a new version beside the old one and a reader takes the last
    complete version, so a batch that is run again after a failure gives the
    same version.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/v={number - 1}"
        rows = batch if not path_exists(spark, f"{before}/_SUCCESS") else spark.read.schema(batch.schema).parquet(before).unionByName(batch)
        first_per_key(rows, keys, [F.desc_nulls_last("loaded_at"), F.desc_nulls_last("id")]).write.mode("overwrite").parquet(f"{path}/v={number}")

    return write


def read_latest(spark: SparkSession, path: str, number: int, schema=RAW) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/v={number}")


def windowed_usage(events: DataFrame, *, at: str = "ts", window: str = "1 day", delay: str = "1 day", key: str = "event_type") -> DataFrame:
    """L01 over event time: calls by key and window; late rows within the delay still count."""
    return events.withWatermark(at, delay).groupBy(F.window(at, window), key).agg(F.count("*").alias("used")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), key, "used"
    )


def start_latest(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Run the landing stream into the latest-per-key table until it has read what is there."""
    return stream.writeStream.foreachBatch(latest_sink(path, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

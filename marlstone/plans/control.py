"""Quota, audit and run state as tables, and catalog checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marlstone.operators.rank import first_per_key, merge_on_keys
from marlstone.sources.landing import path_exists
from marlstone.sources.schemas import LAYERS


def quota_usage(requests: DataFrame, source: str = "source", at: str = "requested_at") -> DataFrame:
    """Calls by source and month."""
    month = F.date_format(at, "yyyy-MM")
    return requests.where(F.col(at).isNotNull()).groupBy(F.col(source).alias("source"), month.alias("quota_period")).agg(F.count("*").alias("used"))


def quota_status(usage: DataFrame, limits: DataFrame) -> DataFrame:
    """Calls left by source and month; sources without a limit have none to exceed."""
    rows = usage.join(limits.select("source", "quota_limit"), "source", "left")
    left = F.col("quota_limit") - F.col("used")
    return rows.select("source", "quota_period", "used", "quota_limit", left.alias("remaining"), F.coalesce(left <= 0, F.lit(False)).alias("exceeded"))


def add_usage(usage: DataFrame, new: DataFrame) -> DataFrame:
    """Counters after more calls."""
    return merge_on_keys(usage, new, ["source", "quota_period"], {"used": lambda o, n: o + n})


def request_log(events: DataFrame) -> DataFrame:
    """The last state of each logged request from an append-only log of starts, ends and cache hits."""
    return first_per_key(events, ["request_id"], [F.desc("logged_at"), F.when(F.col("state") == "finished", 0).otherwise(1)])


def find_request(log: DataFrame, source: str, request_hash: str) -> DataFrame:
    """The latest finished request of a hash."""
    rows = log.where((F.col("source") == source) & (F.col("request_hash") == request_hash) & (F.col("state") == "finished"))
    return rows.orderBy(F.desc("logged_at"), "request_id").limit(1)


def run_states(events: DataFrame) -> DataFrame:
    """Status, start, end and duration of each run's stages from their events."""
    ends = F.col("status").isin("completed", "failed", "partial")
    return events.groupBy("run_id", "pipeline_name", "stage_name").agg(
        F.max_by("status", "logged_at").alias("status"),
        F.min("logged_at").alias("started_at"),
        F.max(F.when(ends, F.col("logged_at"))).alias("finished_at"),
        ((F.unix_millis(F.max(F.when(ends, F.col("logged_at")))) - F.unix_millis(F.min("logged_at")))).alias("duration_ms"),
    )


def upsert_checkpoint(checkpoints: DataFrame, new: DataFrame) -> DataFrame:
    """Checkpoint values by source, job and key, the new one winning."""
    return merge_on_keys(checkpoints, new, ["source", "job_name", "checkpoint_key"], {})


def schema_problems(spark: SparkSession, root: str) -> list[str]:
    """Declared tables that are not there, or lack declared columns."""
    problems = []
    for layer, tables in LAYERS.items():
        for name, schema in tables.items():
            path = f"{root}/{layer}/{name}"
            if not path_exists(spark, path):
                problems.append(f"missing table {layer}.{name}")
                continue
            absent = set(schema.fieldNames()) - set(spark.read.parquet(path).columns)
            problems += [f"missing column {layer}.{name}.{c}" for c in sorted(absent)]
    return problems


def expected_table_count() -> int:
    return sum(map(len, LAYERS.values()))


def existing_tables(spark: SparkSession, root: str) -> list[str]:
    """Declared tables that are there."""
    return [f"{layer}.{name}" for layer, tables in LAYERS.items() for name in tables if path_exists(spark, f"{root}/{layer}/{name}")]


def readiness(spark: SparkSession, root: str, required: list[str], optional: list[str]) -> DataFrame:
    """(path, status): ok, error for a missing required path, warning for an optional one."""
    rows = [(p, "ok" if path_exists(spark, f"{root}/{p}") else kind) for ps, kind in ((required, "error"), (optional, "warning")) for p in ps]
    return spark.createDataFrame(rows, "path string, status string")

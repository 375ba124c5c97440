"""Quota, audit, run state and streaming counts over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.plans import control
from marlstone.plans.catalog import build_catalog
from marlstone.plans.demo import base, staging
from marlstone.streaming.ingest import windowed_usage

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_USAGE = "SELECT event_type AS source, strftime(ts, '%Y-%m') AS quota_period, count(*) AS used FROM events GROUP BY ALL"


def _usage(spark, sf_dir):
    return control.quota_usage(base(spark, sf_dir, "events"), "event_type", "ts")


@_query(_USAGE)
def l01_quota_usage(spark, sf_dir):
    return _usage(spark, sf_dir)


@_query(f"SELECT *, quota_limit - used AS remaining, coalesce(quota_limit - used <= 0, false) AS exceeded FROM (SELECT u.*, CASE source WHEN 'click' THEN 100::BIGINT WHEN 'view' THEN 1000000000 END AS quota_limit FROM ({_USAGE}) u)")
def l01_quota_status(spark, sf_dir):
    limits = spark.createDataFrame([("click", 100), ("view", 1_000_000_000)], "source string, quota_limit long")
    return control.quota_status(_usage(spark, sf_dir), limits)


@_query(f"SELECT source, quota_period, used * 2 AS used FROM ({_USAGE})")
def l01_add_usage(spark, sf_dir):
    return control.add_usage(_usage(spark, sf_dir), _usage(spark, sf_dir))


@_query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS used FROM events GROUP BY ALL")
def l01_windowed_usage(spark, sf_dir):
    """The streaming count run as a batch."""
    out = windowed_usage(base(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "used")


@_query("""SELECT user_id AS request_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END) = 1""")
def l05_request_log(spark, sf_dir):
    e = base(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), "event_id", F.col("ts").alias("logged_at"), F.when(F.col("event_type") == "purchase", "finished").otherwise("started").alias("state"))
    return control.request_log(e).select("request_id", "event_id")


@_query("""SELECT user_id AS run_id, arg_max(s, ts) AS status, min(ts) AS started_at, max(ts) FILTER (WHERE s = 'completed') AS finished_at FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN 'completed' ELSE 'running' END AS s FROM events) GROUP BY user_id""")
def l06_run_states(spark, sf_dir):
    e = base(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.lit("p").alias("pipeline_name"), F.lit("s").alias("stage_name"), F.when(F.col("event_type") == "purchase", "completed").otherwise("running").alias("status"), F.col("ts").cast("timestamp").alias("logged_at"))
    out = control.run_states(e)
    return out.select("run_id", "status", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("started_at", "finished_at")])


@_query("SELECT n_name AS source, 'job' AS job_name, 'k' AS checkpoint_key, CASE WHEN n_nationkey % 2 = 0 THEN 'new' ELSE 'old' END AS checkpoint_value FROM nation")
def l07_checkpoints(spark, sf_dir):
    n = base(spark, sf_dir, "nation")
    row = lambda value: [F.col("n_name").alias("source"), F.lit("job").alias("job_name"), F.lit("k").alias("checkpoint_key"), F.lit(value).alias("checkpoint_value")]
    return control.upsert_checkpoint(n.select(*row("old")), n.where("n_nationkey % 2 = 0").select(*row("new")))


@_query()
def k09_catalog_build(spark, sf_dir):
    """Canonical entities of a build over the demo staging tables with all tables that they come from (rows only: ids are hashes)."""
    built = build_catalog(spark, staging(spark, sf_dir))
    return built.canonical["entities"].join(built.canonical["sources"].groupBy("canonical_id").agg(F.count("*").alias("sources")), "canonical_id")

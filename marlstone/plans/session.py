"""Session helpers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])
#: Arrow batches between the JVM and Python workers: (setting, Spark's default, ours).
#: Rows are whole texts here, so that a batch of the default size is tens of megabytes on either side.
BATCHES = (
    ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"),
    ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8388608b"),
)


def workers_see_package(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver found it.

    On a cluster without a shared installation ship the package instead
    (``--py-files``); the setting is harmless then.  Arrow batches are made
    smaller unless the session has set their size itself.
    """
    for key, default, ours in BATCHES:
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark

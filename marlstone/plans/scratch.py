"""Scratch tables that cut lineage and outlive lost executors.

Tables are Parquet under ``spark.checkpoint.dir`` (a folder that the driver and
all executors share).  Where a session whose executors are threads of the driver
sets none, as in tests, a folder under the system's temporary directory is used;
on a cluster the setting is required.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/marlstone"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder on whatever file system the path names."""
    try:
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already; scratch is disposable
        pass


class Scratch:
    """A folder of intermediate tables for one operator call.

    ``table`` writes a DataFrame and returns a reader of the written files.
    ``drop`` removes tables that no returned DataFrame reads any more; whatever
    is left goes when the driver exits.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/marlstone-{label}-{uuid.uuid4().hex}"
        atexit.register(delete_path, spark, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            delete_path(self.spark, self.path(name))

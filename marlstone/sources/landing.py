"""Readers: raw landing tables, staging and matching tables, files."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from marlstone.operators.rank import first_per_key
from marlstone.sources.schemas import LAYERS, RAW


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on any Hadoop file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_table(
    spark: SparkSession, root: str, layer: str, name: str, *, source: str | None = None, order: list[str] | None = None, limit: int | None = None
) -> DataFrame:
    """A table of a layer with its declared schema, empty if it is not there.

    ``source`` is a pushed-down predicate (and prunes partitions where the table
    is laid out by source).  Rows are ordered only when a limit is asked for.
    """
    schema, path = LAYERS[layer][name], f"{root}/{layer}/{name}"
    df = spark.read.schema(schema).parquet(path) if path_exists(spark, path) else empty(spark, schema)
    if source is not None:
        df = df.where(F.col("source") == source)
    if limit is not None:
        df = df.orderBy(*(order or df.columns[:2])).limit(limit)
    return df


def usable_raw(raw: DataFrame) -> DataFrame:
    """Rows that are no errors: without status, or with one below 400."""
    return raw.where("http_status is null or http_status < 400")


def latest_raw(raw: DataFrame, *keys: str) -> DataFrame:
    """The last loaded usable row of each key whose payload is a JSON object."""
    rows = usable_raw(raw).where(F.col("response_json").rlike(r"^\s*\{"))
    return first_per_key(rows, list(keys), [F.desc_nulls_last("loaded_at"), F.desc_nulls_last("id")])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = RAW, *, partitions: int | None = None) -> DataFrame:
    """JSON lines, gzipped or not; blank lines are skipped.

    Gzip files do not split: ``partitions`` spreads their rows after reading.
    """
    df = spark.read.schema(schema).json(path)
    return df.repartition(partitions) if partitions else df


def read_csv(spark: SparkSession, path: str, *, limit: int | None = None) -> DataFrame:
    """A CSV report with header, all columns as text; a missing file is an empty table."""
    if not path_exists(spark, path):
        return empty(spark, T.StructType([]))
    df = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return df if limit is None else df.limit(limit)


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    """A JSON document as one row; None for a missing file."""
    if not path_exists(spark, path):
        return None
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def reviewed_labels(reviews: DataFrame, limit: int | None = None) -> DataFrame:
    """A10: (pair_id, manual_label) of reviewed pairs."""
    rows = reviews.where("review_status = 'reviewed' and review_label is not null").select("pair_id", F.col("review_label").cast("int").alias("manual_label"))
    return rows if limit is None else rows.orderBy("pair_id").limit(limit)


def scan(df: DataFrame, *, where: Column | None = None, order: list[Column | str] | None = None, limit: int | None = None) -> DataFrame:
    """Filtered rows; ordered and cut when a limit is given."""
    rows = df if where is None else df.where(where)
    return rows if limit is None else rows.orderBy(*(order or df.columns[:1])).limit(limit)


def arrow_store(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a Hadoop path and the path in it; an Arrow or OS error where it has none."""
    scheme, colon, rest = uri.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/") if colon else uri
    authority, _, path = rest.removeprefix("//").partition("/")
    store, base = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return store, f"{base.rstrip('/')}/{path}"

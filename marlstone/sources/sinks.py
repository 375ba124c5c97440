"""Writers: partition replacement, exports with declared schemas, packs and manifests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from marlstone.functions.scoring import clamp_limit
from marlstone.operators.rank import first_per_key
from marlstone.sources.landing import arrow_store, path_exists


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def replace_partition(df: DataFrame, path: str, column: str, keys: list[str] | None = None) -> None:
    """Overwrite only the partitions (sources, algorithms) that ``df`` has rows of.

    With ``keys`` the rows have to be unique on them.
    """
    if keys and not duplicate_keys(df, keys).isEmpty():
        raise ValueError(f"rows repeat the key {', '.join(keys)}")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def merge_raw(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Landing rows with the last delivery of each key; redelivery changes nothing."""
    rows = old.unionByName(new.select(*old.columns))
    return first_per_key(rows, keys, [F.desc_nulls_last("loaded_at"), F.desc_nulls_last("id")])


def export_value(column: Column, kind: T.DataType, wanted: T.DataType) -> Column:
    """A value in its export type: dates as ISO text, decimals as double, nested values as JSON with keys in order."""
    if isinstance(wanted, T.StringType):
        if isinstance(kind, T.MapType):
            return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(column))))
        if isinstance(kind, T.StructType | T.ArrayType):
            return F.to_json(column)
        if isinstance(kind, T.DateType):
            return F.date_format(column, "yyyy-MM-dd")
        if isinstance(kind, T.TimestampType):
            return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        return column.cast("string")
    return column.try_cast(wanted) if isinstance(kind, T.StringType) else column.cast(wanted)


def conformed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The declared columns in their types; absent ones are null."""
    kinds = {f.name: f.dataType for f in df.schema}
    cols = [
        export_value(F.col(f.name), kinds[f.name], f.dataType).alias(f.name) if f.name in kinds else F.lit(None).cast(f.dataType).alias(f.name) for f in schema
    ]
    return df.select(*cols)


def write_dataset(df: DataFrame, path: str, schema: T.StructType | None = None) -> None:
    """Parquet with a declared schema, or with nested columns as JSON text without one."""
    if schema is None:
        fields = [T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.MapType | T.StructType | T.ArrayType) else f.dataType) for f in df.schema]
        schema = T.StructType(fields)
    conformed(df, schema).write.mode("overwrite").parquet(path)


@dataclass(frozen=True)
class Dataset:
    """One named export."""

    name: str
    df: DataFrame
    schema: T.StructType | None = None
    required: bool = False


def export_datasets(datasets: list[Dataset], root: str) -> dict[str, int]:
    """Write all datasets and return their rows; a required one that is empty is an error."""
    missing = [d.name for d in datasets if d.required and d.df.isEmpty()]
    if missing:
        raise ValueError(f"required datasets are empty: {', '.join(missing)}")
    counts = {}
    for d in datasets:
        write_dataset(d.df, f"{root}/{d.name}.parquet", d.schema)
        counts[d.name] = d.df.sparkSession.read.parquet(f"{root}/{d.name}.parquet").count()
    return counts


def write_jsonl(df: DataFrame, path: str) -> None:
    """Gzipped JSON lines with columns in name order."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("compression", "gzip").json(path)


#: Most rows of a report, which is one file.
REPORT_ROWS = 1_000_000


def _one_file(df: DataFrame) -> DataFrame:
    """A report's rows in one partition; ValueError for tables that are no reports."""
    if df.limit(REPORT_ROWS + 1).count() > REPORT_ROWS:
        raise ValueError(f"a report has at most {REPORT_ROWS} rows; write larger tables as Parquet or JSON lines")
    return df.coalesce(1)


def write_csv_report(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """A CSV report with header in one file: given columns, or all in name order."""
    _one_file(df.select(*(columns or sorted(df.columns)))).write.mode("overwrite").option("header", True).csv(path)


def write_quality_csv(df: DataFrame, path: str) -> None:
    """A CSV report that says ``status=empty`` when it has no row."""
    rows = df.sparkSession.createDataFrame([("empty",)], "status string") if df.isEmpty() else df
    _one_file(rows).write.mode("overwrite").option("header", True).csv(path)


def write_json_report(df: DataFrame, path: str) -> None:
    """Rows as JSON lines in one file."""
    _one_file(df).write.mode("overwrite").json(path)


#: Bytes of a file that a checksum reads at a time.
CHUNK = 1 << 20


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths -> SHA-256 of the files, read as streams."""
    for batch in batches:
        out = []
        for uri in batch.column(0).to_pylist():
            store, path = arrow_store(uri)
            digest = hashlib.sha256()
            with store.open_input_stream(path) as stream:
                while chunk := stream.read(CHUNK):
                    digest.update(chunk)
            out.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "sha256"])


def file_checksums(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, sha256, bytes) of the files under a folder, paths relative to it.

    Files are read as streams where Arrow opens their store; elsewhere as whole
    files by Spark, which takes files of less than 2 GB.  Spark lists no empty files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/"
    inner = F.regexp_replace("path", "^[a-z]+:(//[^/]*)?(?=/)", "")
    inner = F.regexp_replace(inner, "^/+", "/")
    try:
        arrow_store(spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration()).getUri().toString() + "/")
        summed = files.select("path", "length").mapInArrow(_digests, "path string, length long, sha256 string")
    except (pa.ArrowInvalid, OSError, NotImplementedError):
        summed = files.select("path", "length", F.sha2("content", 256).alias("sha256"))
    return summed.select(F.substring(inner, len(base) + 1, 1_000_000).alias("path"), "sha256", F.col("length").alias("bytes"))


def verify_checksums(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """Manifest entries whose file is missing or differs: (path, problem); empty when all is well."""
    actual = file_checksums(spark, root).select("path", F.col("sha256").alias("found"))
    joined = manifest.select("path", "sha256").join(actual, "path", "left")
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "checksum mismatch")
    return joined.withColumn("problem", problem).where("problem is not null").select("path", "problem")


# Sources of a pack, and the steps that it reports.
REQUIRED_SOURCES, OPTIONAL_SOURCES = ("rawg", "wikidata"), ("steam", "wikipedia", "igdb")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, source, row_count) of tables, by source where they have one."""
    out = None
    for name, df in tables.items():
        source = F.col("source") if "source" in df.columns else F.lit(None).cast("string")
        part = df.groupBy(source.alias("source")).agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "source", "row_count")
        out = part if out is None else out.unionByName(part)
    return out


def pack_manifest(counts: DataFrame, *, warnings: list[str] | None = None) -> dict:
    """Manifest of a pack from its counts: rows, active and missing sources, run status.

    The run is completed when every required source has rows and nothing warned,
    failed without any row, partial otherwise.
    """
    rows = counts.groupBy("table_name").agg(F.sum("row_count").alias("n")).collect()  # one row a table
    by_source = {r.source: r.n for r in counts.where("source is not null").groupBy("source").agg(F.sum("row_count").alias("n")).collect()}
    active = sorted(s for s, n in by_source.items() if n)
    optional_missing = sorted(s for s in OPTIONAL_SOURCES if not by_source.get(s))
    absent = sorted(s for s in REQUIRED_SOURCES if not by_source.get(s))
    total = sum(r.n for r in rows)
    status = "failed" if not total else "completed" if not absent and not warnings else "partial"
    return {
        "row_counts": {r.table_name: r.n for r in sorted(rows)},
        "active_sources": active,
        "checked_sources": sorted({*REQUIRED_SOURCES, *OPTIONAL_SOURCES}),
        "missing_required_sources": absent,
        "missing_optional_sources": optional_missing,
        "warnings": list(warnings or []),
        "run_status": status,
    }


def dataset_manifest(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """(dataset, path, row_count) of exported datasets; missing ones count 0."""
    rows = []
    for name in names:
        path = f"{root}/{name}.parquet"
        rows.append((name, path, spark.read.parquet(path).count() if path_exists(spark, path) else 0))
    return spark.createDataFrame(rows, "dataset string, path string, row_count long")


def _escape(text: object) -> str:
    return str(text).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def bar_chart_svg(df: DataFrame, label: str, values: list[str], *, title: str = "", limit: int = 50, width: int = 720, row_height: int = 28) -> str:
    """Horizontal bars (one or several a row) scaled to the greatest value; at most 250 rows."""
    rows = df.select(label, *values).limit(clamp_limit(limit, default=50, maximum=250)).collect()
    top = max((float(r[v] or 0) for r in rows for v in values), default=0.0)
    height = row_height * max(1, len(rows)) + 48
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">', f'<text x="8" y="24">{_escape(title)}</text>']
    band = (row_height - 6) / max(1, len(values))
    for i, r in enumerate(rows):
        y = 40 + i * row_height
        out.append(f'<text x="8" y="{y + row_height / 2:.1f}">{_escape(r[label])}</text>')
        for j, v in enumerate(values):
            length = (width - 320) * float(r[v] or 0) / top if top else 0
            out.append(f'<rect x="220" y="{y + j * band:.1f}" width="{length:.1f}" height="{band:.1f}" class="bar{j}"/>')
            out.append(f'<text x="{228 + length:.1f}" y="{y + (j + 0.8) * band:.1f}">{_escape(r[v])}</text>')
    return "\n".join([*out, "</svg>"])

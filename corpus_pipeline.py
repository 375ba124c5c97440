"""The corpus pipeline: five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; the driver
writes it as Parquet and hands it to the next stage.  Every stage but the last
returns the columns of ``documents``; what a stage decides is in the rows and
texts that it returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marlstone.llm.decontaminate import clean_documents
from marlstone.llm.mixing import mixed_documents
from marlstone.llm.neardup import near_duplicates
from marlstone.llm.quality import accepted_documents
from marlstone.llm.substring import repeated_substrings
from marlstone.plans.scratch import Scratch
from marlstone.plans.session import workers_see_package

#: Near copies go at a similarity of 0.8; 48 bands of 5 miss such a pair with probability (1 - 0.8**5)**48 < 1e-8.
SIMILARITY, BANDS, ROWS = 80, 48, 5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the quality classifier accepts."""
    workers_see_package(spark)
    return accepted_documents(docs, _table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    workers_see_package(spark)
    gone = near_duplicates(docs, threshold=SIMILARITY, bands=BANDS, rows=ROWS).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that stand earlier already; a changed text is its kept words joined by a space."""
    workers_see_package(spark)
    changed = repeated_substrings(docs, with_text=True).where("n_removed > 0").select("doc_id", "kept_text").dropDuplicates(["doc_id"])
    joined = docs.join(changed, "doc_id", "left")
    text = F.coalesce("kept_text", "text")
    return joined.withColumn("text", text).withColumn(
        "n_chars", F.when(F.col("kept_text").isNull(), F.col("n_chars")).otherwise(F.char_length("kept_text").cast("long"))
    ).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents without a window of the benchmark."""
    workers_see_package(spark)
    return clean_documents(docs, _table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents by their sources' rates: the documents' columns and a copy number."""
    workers_see_package(spark)
    return mixed_documents(docs)


STAGES = [
    ("quality_classifier", quality),
    ("minhash_neardup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mixing),
]

#: The first stage is a fitted model, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, with each stage's result written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs

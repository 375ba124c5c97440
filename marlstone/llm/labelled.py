"""Bounded, held-out-aware samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marlstone.plans.scratch import Scratch

#: Most labelled rows that a model is fitted on (a documented bound).
FIT_ROWS = 20_000


def held_out(doc_id: str | Column) -> Column:
    """True where crc32 of the id as text leaves 1 modulo 3: never learned from."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def usable_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label): labels that may be learned from: not held out, 0 or 1, and agreeing for their id."""
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
        .where(~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other")
        .select("doc_id", "label")
    )


def fit_sample(documents: DataFrame, labels: DataFrame, label: str, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text, label): up to ``rows`` labelled documents that may be learned from.

    The sample is the smallest hashes of the id, so it is the same for any
    partitioning.
    """
    usable = usable_labels(labels, label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # At most ``rows`` rows of 12 bytes, by the limit above; the texts are read once and kept.
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return Scratch(documents.sparkSession, f"fit-{label}").table(docs.join(F.broadcast(usable), "doc_id"), "sample")

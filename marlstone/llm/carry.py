"""Carry all columns of a table through an Arrow function without name clashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def packed(documents: DataFrame) -> DataFrame:
    """(doc_id, text, rest): the two columns that operators read, and a struct of all others."""
    others = [F.col(f"`{c}`") for c in documents.columns if c not in ("doc_id", "text")]
    rest = F.struct(*others) if others else F.struct(F.lit(True).alias("none"))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", rest.alias("rest"))


def packed_schema(pack: DataFrame, *fields: T.StructField) -> T.StructType:
    return T.StructType([*pack.schema.fields, *fields])


def original_columns(documents: DataFrame) -> list[Column]:
    """Expressions over a pack that give the columns of ``documents`` in their order and types."""
    kinds = dict(documents.dtypes)
    return [
        F.col(c).cast(kinds[c]).alias(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in documents.columns
    ]


def unpacked(pack: DataFrame, documents: DataFrame) -> DataFrame:
    return pack.select(*original_columns(documents))

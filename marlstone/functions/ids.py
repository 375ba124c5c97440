"""Stable ids computed inside the JVM."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, functions as F

from marlstone.functions.text import Text, as_column

# Fixed value: namespace of canonical entity ids.
CANONICAL_NAMESPACE = uuid.UUID("ab9b6711-7362-56f1-8b3f-b3d3f5d4d12d")
CANONICAL_PREFIX = "canonical_v0:"


def uuid5(namespace: uuid.UUID, name: Text) -> Column:
    """Name-based UUID (version 5) of a string column."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(as_column(name), "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 1, F.lit(1))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def canonical_id(keys: Text) -> Column:
    """Id of an array of ``source:id`` keys in order."""
    return uuid5(CANONICAL_NAMESPACE, F.concat(F.lit(CANONICAL_PREFIX), F.array_join(as_column(keys), "|")))

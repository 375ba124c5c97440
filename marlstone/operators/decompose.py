"""Truncated singular value decomposition of sparse TF-IDF rows, by distributed subspace iteration.

Rows and right singular vectors are tables of dense vectors of ``l`` numbers
(rank wanted and a few more): a product is an equi-join on terms or documents and
a weighted vector sum, combined map-side.  The driver sees ``l`` by ``l`` Gram
matrices alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F

from marlstone.functions.similarity import component_count, cosine, distinct_texts, text_weights, word_ngrams
from marlstone.plans.scratch import Scratch

#: Rank of the title space, vectors beyond it that steady the iteration, and rounds.
RANK, OVERSAMPLES, ROUNDS = 64, 10, 6


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, width)


def _grams(width: int):
    """Partial Gram matrices of a column of vectors, one row an entry and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _vectors(batch.column(0), width)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["entry", "value"])

    return run


def gram(vectors: DataFrame, column: str, width: int) -> np.ndarray:
    """Sum of the outer products of a column of vectors (``width`` squared numbers on the driver)."""
    parts = vectors.select(column).mapInArrow(_grams(width), "entry long, value double")
    rows = parts.groupBy("entry").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(width * width)
    out[rows["entry"].to_numpy()] = rows["value"].to_numpy()
    return out.reshape(width, width)


def _turned(matrix: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column(1), matrix.shape[0]) @ matrix
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * matrix.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], batch.schema.names)

    return run


def turned(vectors: DataFrame, matrix: np.ndarray) -> DataFrame:
    """(key, vector) rows with each vector times a small matrix."""
    return vectors.mapInArrow(_turned(matrix), vectors.schema)


def _summed(weights: DataFrame, vectors: DataFrame, on: str, to: str) -> DataFrame:
    """(to, v): the weighted sums of the vectors that weights lead to."""
    joined = weights.join(vectors, on).select(to, array_to_vector("v").alias("v"), "w")
    return joined.groupBy(to).agg(vector_to_array(Summarizer.sum(F.col("v"), F.col("w"))).alias("v"))


def _whitener(g: np.ndarray) -> np.ndarray:
    """Matrix that turns vectors of a Gram matrix into orthonormal ones, greatest first; directions without length go."""
    values, vectors = np.linalg.eigh(g)
    kept = values > max(values.max(initial=0.0), 1e-300) * 1e-12
    return (vectors[:, kept] / np.sqrt(values[kept]))[:, ::-1]


def right_space(weights: DataFrame, rank: int, scratch: Scratch, *, oversamples: int = OVERSAMPLES, rounds: int = ROUNDS) -> DataFrame:
    """(term, v) orthonormal right singular vectors of the ``rank`` greatest values of a matrix of (doc, term, w) entries.

    Entries are not negative.  Starting vectors are drawn by the terms' hashes, so
    reruns agree.
    """
    width = rank + oversamples
    signs = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.xxhash64("term", k).cast("double") / F.lit(2.0**63))
    space = scratch.table(weights.select("term").distinct().select("term", signs.alias("v")), "space-0")
    for k in range(1, rounds + 1):
        left = scratch.table(_summed(weights, space, "term", "doc"), f"left-{k}")
        right = scratch.table(_summed(weights, left, "doc", "term"), f"right-{k}")
        basis = _whitener(gram(right, "v", width))
        space = scratch.table(turned(right, basis), f"space-{k}")
        scratch.drop(f"left-{k}", f"right-{k}", f"space-{k - 1}")
        width = basis.shape[1]
    # Of the space found, the directions in which the matrix is greatest.
    left = scratch.table(_summed(weights, space, "term", "doc"), "left")
    values, vectors = np.linalg.eigh(gram(left, "v", width))
    return turned(space, vectors[:, ::-1][:, :rank])


def title_svd_cosine(pairs: DataFrame, left: str, right: str, *, rank: int = RANK, key: str = "pair_id") -> DataFrame | None:
    """(key, cosine) of two texts' places in the truncated space of their word TF-IDF rows; None if its rank would be 0.

    The corpus is all left and right texts together.  A side without terms
    gives 0.
    """
    scratch = Scratch(pairs.sparkSession, "svd")
    both, same = distinct_texts(pairs, left, right)
    both = scratch.table(both, "texts")
    weights = text_weights(both, word_ngrams)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("t")))
    weights = scratch.table(weights.select(F.col("t").alias("doc"), "times", "term", (F.col("w") / norm).alias("w")), "weights")
    k = component_count(2 * pairs.count(), weights.select("term").distinct().count(), rank)
    if not k:
        return None
    # A text that occurs n times is n equal rows: one of the root of n times the length spans the same space.
    repeated = weights.select("doc", "term", (F.col("w") * F.sqrt("times")).alias("w"))
    places = _summed(weights.select("doc", "term", "w"), right_space(repeated, k, scratch), "term", "doc")
    side = lambda s: places.select(F.col("doc").alias(f"__{s}"), F.col("v").alias(s))
    scored = both.join(side("l"), "__l").join(side("r"), "__r").select("__l", "__r", cosine("l", "r").alias("cosine"))
    return pairs.select(key, left, right).join(scored, same, "left").select(key, F.coalesce("cosine", F.lit(0.0)).alias("cosine"))

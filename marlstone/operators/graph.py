"""Connected components by alternating large-star and small-star contraction.

Every round is two aggregations and two joins over the edge table; nothing is
collected but an edge count and checksum.  Hub vertices are harmless: the
aggregations combine map-side and the joins are skew-splittable.  Callers may
let a table of few edges be joined up in one task instead, which gives the same
components without the rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from marlstone.plans.scratch import Scratch

MAX_ROUNDS = 60
#: Edges of two short keys that one task may hold (about 100 MB in Python).
FEW_EDGES = 200_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))


def _lowest(edges: DataFrame) -> DataFrame:
    """(n, low): the smallest of each node and its neighbours, combined map-side."""
    return _both_ways(edges).groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))


def _large_star(edges: DataFrame, low: DataFrame) -> DataFrame:
    return (
        _both_ways(edges)
        .join(low, "n")
        .where(F.col("m") > F.col("n"))
        .select(F.col("m").alias("u"), F.col("low").alias("v"))
        .where("u <> v")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("low"))
    hang = edges.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v")
    return hang.unionByName(low.select("u", F.col("low").alias("v"))).distinct()


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges of a task -> (node, component), the component being its smallest node."""
    up: dict = {}

    def key(value):
        return tuple(map(key, value.values())) if isinstance(value, dict) else value

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    original, kind = {}, None
    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            original[a := key(u)], original[b := key(v)] = u, v
            a, b = sorted((root(up.setdefault(a, a)), root(up.setdefault(b, b))))
            up[b] = a
    nodes = list(up)
    if nodes:
        columns = [[original[n] for n in nodes], [original[root(n)] for n in nodes]]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c in columns], ["node", "component"])


def connected_components(edges: DataFrame, scratch: Scratch, label: str = "cc", *, few: int = 0) -> DataFrame:
    """(u, v) edges of any orderable key type -> (node, component).

    ``component`` is the smallest node reachable.  Self loops and repeated
    edges are harmless; edges with a null end are ignored; nodes without edges
    are not in the result (callers give them their own id).  An empty edge
    table gives an empty result.  Up to ``few`` edges are joined up in one task.
    """
    u, v = edges.columns[:2]
    edges = (
        edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
        .where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    current, seen = scratch.table(edges, f"{label}-0"), None
    if few and current.count() <= few:
        kind = T.StructType([T.StructField(c, current.schema["u"].dataType) for c in ("node", "component")])
        return current.coalesce(1).mapInArrow(_joined_up, kind)
    for k in range(1, MAX_ROUNDS + 1):
        # Written first, so that the join below has two plain shuffles and a hub's rows can be split.
        low = scratch.table(_lowest(current), f"{label}-low-{k}")
        following = scratch.table(_small_star(_large_star(current, low)), f"{label}-{k}")
        scratch.drop(f"{label}-{k - 1}", f"{label}-low-{k}")
        state = tuple(
            following.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.max("u")).first()
        )
        current = following
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()

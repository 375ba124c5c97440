"""MinHash near-duplicate groups: fast similarity sketches, banding, exact check.

1. One pass over the texts gives each document's set of five-word shingles (as
   64-bit hashes), a digest of the set, and a fast similarity sketch: in round
   ``i`` every element is thrown into a hashed bin with value ``(i, hash)``; the
   first round that reaches a bin fills it and rounds go on until none is empty
   (from round ``t`` on, round ``t + j`` throws everything into bin ``j``, which
   bounds the number of rounds).  Bands of coordinates become bucket keys.
2. Documents with equal sets form a class; only one row of its smallest id goes
   on, under a row number, and only numbers are aggregated from here on.
3. Bucket mates are joined to the bucket's smallest id; components of this
   (unchecked) graph are the units in which pairs are verified, so that a set
   travels once.  Units over ``unit_rows`` rows or ``unit_shingles`` shingles
   are verified bucket by bucket instead, and buckets over that as pairs of
   blocks, so that no task holds more than two blocks whatever a group's size.
4. Links (100 * intersection >= threshold * union on the full sets) are found
   inside a unit without emitting pairs: a unit returns a spanning forest of
   its links.  Components of those links are the groups.

With 40 bands of 6 rows a pair at the threshold of 0.85 is missed with
probability (1 - 0.85**6)**40 < 1e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from marlstone.llm.words import list_of, mix, spaced, utf8_rows, window_hashes, word_hashes
from marlstone.operators.graph import connected_components
from marlstone.plans.scratch import Scratch

SHINGLE = 5
BANDS, ROWS = 40, 6
THRESHOLD = 85
#: Most rows and shingles of a unit, and of one block of a larger one.
UNIT_ROWS = 1024
UNIT_SHINGLES = 1_000_000
#: Candidate documents (an id, a row number and a digest each) are broadcast up to this many.
BROADCAST_IDS = 200_000
#: Documents signed between two output batches, and rows compared at once inside a unit.
SIGN_ROWS, STRIPE = 250, 256


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes; the whole sequence when it is shorter."""
    words = spaced(text.lower() if text else None)
    if not words:
        return np.empty(0, np.uint64)
    hashes = window_hashes(word_hashes(words), min(size, len(words)))
    # A short sequence is no shingle of other words: its length goes into its hash.
    return np.unique(hashes if len(words) >= size else mix(hashes + np.uint64(len(words))))


def _seed(i: int) -> np.uint64:
    return np.uint64((i * 0xD1B54A32D192ED03 + 0x2545F4914F6CDD1D) % 2**64)


def sketch(elements: np.ndarray, size: int) -> np.ndarray:
    """Fast similarity sketch of ``size`` coordinates of a non-empty set."""
    out = np.zeros(size, np.uint64)
    filled = np.zeros(size, bool)
    low, width = np.uint64(0xFFFFFFFF), np.uint64(32)
    with np.errstate(over="ignore"):
        for i in range(2 * size):
            if i < size:
                v = mix(elements + _seed(i))
                key = np.sort((((v >> width) * np.uint64(size)) & ~low) | (v & low))
                bins = (key >> width).astype(np.int64)
                head = np.concatenate([[True], bins[1:] != bins[:-1]])
                bins, key = bins[head], key[head]
                fresh = ~filled[bins]
                bins = bins[fresh]
                out[bins] = (key[fresh] & low) | np.uint64(i << 32)
                filled[bins] = True
            elif not filled[i - size]:
                out[i - size] = (mix(elements + _seed(i)).min() & low) | np.uint64(i << 32)
                filled[i - size] = True
            if filled.all():
                break
    return out


def band_keys(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    grid = coordinates.reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for k in range(rows):
            key = mix(key + grid[:, k])
    return key.view(np.int64)


def set_digest(elements: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(elements.tobytes())


def _signatures(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SIGN_ROWS):
                batch = whole.slice(start, SIGN_ROWS)
                counts, digests, keys = [], [], []
                for text in utf8_rows(batch.column(1)):
                    elements = shingle_set(text)
                    counts.append(len(elements))
                    digests.append(set_digest(elements))
                    keys.append(band_keys(sketch(elements, bands * rows), bands, rows) if len(elements) else np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), list_of(keys, pa.int64())],
                    ["doc_id", "n_shingles", "digest", "bands"],
                )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, digest, text) -> (row, shingles) of texts that have the digest, once a task for each row number."""
    done: set[int] = set()
    for whole in batches:
        for start in range(0, whole.num_rows, SIGN_ROWS):
            batch = whole.slice(start, SIGN_ROWS)
            rows, sets = [], []
            for row, digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8_rows(batch.column(2))):
                if row in done:
                    continue
                elements = shingle_set(text)
                if set_digest(elements) == digest:
                    done.add(row)
                    rows.append(row)
                    sets.append(elements.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), list_of(sets, pa.int64())], ["row", "shingles"])


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    common = np.intersect1d(a, b, assume_unique=True).size
    return 100 * common >= percent * (len(a) + len(b) - common)


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


class _Buckets:
    """Which rows share a value in some column of ``bands``."""

    def __init__(self, bands: np.ndarray):
        order = np.argsort(bands, axis=0, kind="stable")
        self.members = []  # of each column: rows by value, and each row's range among them
        for c in range(bands.shape[1]):
            value = bands[order[:, c], c]
            head = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1], [True]]))
            of = np.repeat(np.arange(len(head) - 1), np.diff(head))
            place = np.empty(len(bands), np.int64)
            place[order[:, c]] = of
            self.members.append((order[:, c], head[place], head[place + 1]))

    def mates(self, i: int, out: np.ndarray) -> None:
        """Mark the rows that share a value with row ``i``."""
        for rows, low, high in self.members:
            out[rows[low[i] : high[i]]] = True


def _shared_columns(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """(owner, column, number of columns) of the shingles that more than one set holds, by column."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    head = np.concatenate([[True], flat[1:] != flat[:-1]])
    place = np.cumsum(head) - 1
    several = np.bincount(place)[place] > 1
    place, owner = place[several], owner[several]
    if not len(place):
        return owner, place, 0
    column = np.cumsum(np.concatenate([[0], (place[1:] != place[:-1]).astype(np.int64)]))
    return owner, column, int(column[-1]) + 1


def _common_counts(start: int, stop: int, m: int, owner: np.ndarray, column: np.ndarray, edges: np.ndarray, width: int) -> np.ndarray:
    """Intersection sizes of rows ``start`` to ``stop`` with all rows, by products of 0/1 column blocks."""
    total = np.zeros((stop - start, m), np.float32)
    for k in range(len(edges) - 1):
        a, b = edges[k], edges[k + 1]
        rows = owner[a:b]
        if a == b or not ((rows >= start) & (rows < stop)).any():
            continue
        block = np.zeros((m, width), np.float32)
        block[rows, column[a:b] - k * width] = 1
        total += block[start:stop] @ block.T
    return total


def unit_links(ids: np.ndarray, bands: np.ndarray | None, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the links inside one unit, found in stripes of rows.

    With ``bands`` only pairs that share a bucket are looked at (the others are
    below the threshold but for the stated chance); without, all pairs are.
    Rows go by size, so that a row's possible partners are a slice.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    ids, sets = ids[order], [sets[i] for i in order]
    buckets = _Buckets(bands[order]) if bands is not None else None
    n, width = len(ids), 2048
    forest, links = _Forest(n), []
    size = np.array([len(s) for s in sets], np.int64)
    reach = np.searchsorted(size, 100 * size // percent, side="right")
    owner, column, columns = _shared_columns(sets) if n > 24 else (None, None, 0)
    edges = np.searchsorted(column, np.arange(0, columns + width, width)) if n > 24 else None
    for start in range(0, n, STRIPE):
        stop = min(n, start + STRIPE)
        wanted = np.zeros((stop - start, n), bool)
        for i in range(start, stop):
            if buckets is None:
                wanted[i - start, i + 1 : reach[i]] = True
            else:
                buckets.mates(i, wanted[i - start])
                wanted[i - start, : i + 1] = False
                wanted[i - start, reach[i] :] = False
        # A product costs about rows * n * columns / 2e10 s, a single pair about 3e-5 s.
        product = n > 24 and (stop - start) * n * columns / 2e10 < 3e-5 * np.count_nonzero(wanted)
        if product:
            common = _common_counts(start, stop, n, owner, column, edges, width)
            wanted &= 100 * common >= percent * (size[start:stop, None] + size[None, :] - common)
        for i in range(start, stop):
            for j in np.flatnonzero(wanted[i - start]).tolist():
                if forest.root(i) != forest.root(j) and (product or _linked(sets[i], sets[j], percent)):
                    forest.join(i, j)
                    links.append((int(ids[i]), int(ids[j])))
    return links


def _verify(percent: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table["row"].to_numpy()
        column = table["shingles"].chunk(0)
        ends = column.offsets.to_numpy()
        flat = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
        sets = [flat[ends[i] : ends[i + 1]] for i in range(len(ids))]
        whole = bool(table["by_band"][0].as_py())
        bands = None
        if whole:
            keys = table["bands"].chunk(0)
            bands = keys.values.to_numpy(zero_copy_only=False)[keys.offsets[0].as_py() :].reshape(len(ids), -1)
        links = unit_links(ids, bands, sets, percent)
        return pa.table(
            {"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())}
        )

    return run


def _units(scratch: Scratch, members: DataFrame, sizes: DataFrame, counts: DataFrame, unit_rows: int, unit_shingles: int) -> DataFrame:
    """(unit, row, by_band): where each candidate's set has to go.

    ``sizes`` has rows and shingles of each bucket, ``counts`` the shingles of
    each class.
    """
    stars = members.join(sizes, "key").where("row <> low").select("row", "low")
    clusters = connected_components(stars, scratch, "coarse").withColumnRenamed("node", "row")
    clusters = scratch.table(clusters, "clusters")
    weighed = clusters.join(counts, "row").groupBy("component").agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("shingles"))
    big = weighed.where((F.col("rows") > unit_rows) | (F.col("shingles") > unit_shingles))
    # As a written table it is small enough to be broadcast, or at least a plain shuffle beside the clusters'.
    big = scratch.table(big.select("component"), "big")
    small = clusters.join(big, "component", "left_anti").select(
        F.struct(F.lit(0).alias("kind"), F.col("component").alias("of"), F.lit(0).alias("i"), F.lit(0).alias("j")).alias("unit"),
        "row",
        F.lit(True).alias("by_band"),
    )
    rest = clusters.join(big, "component", "left_semi").select("row")
    blocks = F.ceil(F.greatest(F.col("rows") / unit_rows, F.col("shingles") / unit_shingles)).cast("int")
    mine = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    by_bucket = (
        members.join(rest, "row", "left_semi")
        .join(sizes.select("key", "rows", "shingles"), "key")
        .withColumn("blocks", blocks)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            F.struct(
                F.lit(1).alias("kind"), F.col("key").alias("of"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")
            ).alias("unit"),
            "row",
            F.lit(False).alias("by_band"),
        )
    )
    return small.unionByName(by_bucket)


def near_duplicates(
    documents: DataFrame,
    *,
    threshold: int = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
    unit_rows: int = UNIT_ROWS,
    unit_shingles: int = UNIT_SHINGLES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row.

    Words are maximal runs without white space, A-Z lower-cased; the set holds
    the distinct five-word shingles, or the whole sequence if there are fewer
    words.  Documents are linked at a Jaccard similarity of ``threshold`` per
    cent or more, by an exact check on the full sets.

    Null, empty or blank text: n_shingles 0, linked with nothing, kept.  Equal
    sets (repeated rows, copies): one class, the smallest id is kept.  Rows that
    repeat an id with other texts are documents of their own under one id, which
    all are kept if that id is their group's smallest.  A null id forms no link
    and keeps component null and kept true.  Other columns of the input,
    whatever their names, are ignored.  Empty input: empty result.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "neardup")
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = docs.mapInArrow(_signatures(bands, rows), "doc_id long, n_shingles long, digest binary, bands array<long>")
    signed = scratch.table(signed.withColumn("row", F.monotonically_increasing_id()), "signed")  # numbers are fixed by the write
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    first = usable.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"), F.min_by("row", "doc_id").alias("row"))
    classes = scratch.table(first, "classes")
    reps = scratch.table(usable.select("row", "n_shingles", "bands").join(classes.select("row"), "row", "left_semi"), "reps")
    keys = reps.select("row", "n_shingles", F.explode("bands").alias("key"))
    sizes = scratch.table(
        keys.groupBy("key")
        .agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("shingles"), F.min("row").alias("low"))
        .where("rows > 1"), "sizes"
    )
    members = scratch.table(keys.drop("n_shingles").join(sizes.select("key"), "key", "left_semi"), "members")
    units = scratch.table(_units(scratch, members, sizes, classes.select("row", "n_shingles"), unit_rows, unit_shingles), "units")

    candidates = units.select("row").distinct()
    wanted = scratch.table(classes.join(candidates, "row", "left_semi").select("doc_id", "row", "digest"), "wanted")
    near = F.broadcast if wanted.count() <= BROADCAST_IDS else (lambda side: side)
    sets = docs.join(near(wanted), "doc_id").select("row", "digest", "text").mapInArrow(_sets, "row long, shingles array<long>")
    load = units.join(sets, "row").join(reps.select("row", "bands").join(near(wanted.select("row")), "row", "left_semi"), "row")
    links = load.groupBy("unit").applyInArrow(_verify(threshold), "a long, b long")
    groups = connected_components(scratch.table(links, "links"), scratch, "groups")

    grouped = groups.withColumnRenamed("node", "row").join(classes.select("row", "doc_id"), "row")
    lowest = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    label = classes.join(grouped.join(lowest, "component").select("row", "component_id"), "row", "left").select(
        "digest", F.coalesce("component_id", "doc_id").alias("component_id")
    )
    result = (
        signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest"))
        .join(label, "digest", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
    result = scratch.table(result, "result")
    scratch.drop("signed", "classes", "reps", "sizes", "members", "units", "wanted", "clusters", "big", "links")
    return result

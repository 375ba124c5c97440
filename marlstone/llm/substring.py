"""Substring dedup: repeated word windows, found level by level at doubling lengths.

Runs of ``base`` words are counted first; only where they repeat are runs of
twice the length looked at, and so on up to the window, until no candidates
survive.

* Whole copies first: documents with equal word sequences form a class; all but
  the smallest id are removed in whole, which their windows ask for anyway, and
  go no further.
* First level: of the runs in a window the one with the smallest hash (leftmost
  on ties) is the same in each occurrence.  Counting only those chosen runs
  loses no repeated window and keeps the shuffle small; a window goes on when
  its chosen run repeats.
* Doubled lengths: a window has two parts, one reaching from its start and one
  to its end, that overlap and hold a chosen run each.  It goes on when the runs
  of both parts repeat, counted over the windows that the level before left.
* At the window's own length the earliest document of each window is aggregated
  (combined map-side, so that a passage in a third of all documents is one row
  a task) and joined back to mark the later occurrences.

Runs are counted by a 64-bit hash, where a clash only costs a candidate more;
windows are the same when two 64-bit hashes, independent of each other over the
words' hashes, are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marlstone.llm.words import list_of, mix, spaced, utf8_rows, window_hashes, word_hashes
from marlstone.plans.scratch import Scratch

WINDOW = 20
BASE = 5
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
#: Rows to an Arrow batch of windows.
BATCH_ROWS = 200_000


def chosen_runs(runs: np.ndarray, span: int) -> np.ndarray:
    """For each window of ``span`` consecutive run hashes, the index of the smallest."""
    n = len(runs) - span + 1
    if n <= 0:
        return np.empty(0, np.int64)
    value, place, width = runs.copy(), np.arange(len(runs)), 1
    while width < span:  # minimum over doubling spans
        step = min(width, span - width)
        left, right = value[:-step], value[step:]
        take = right < left
        place = np.where(take, place[step:], place[:-step])
        value = np.where(take, right, left)
        width += step
    return place


def _first_level(window: int, base: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shas, hashes = [], [], []
            for text in utf8_rows(batch.column(1)):
                words = spaced(text)
                counts.append(len(words))
                shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
                runs = window_hashes(word_hashes(words), base)
                hashes.append(runs[np.unique(chosen_runs(runs, window - base + 1))].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(shas), list_of(hashes, pa.int64())], ["doc_id", "n_words", "sha", "runs"]
            )

    return run


def _candidates(codes: np.ndarray, places: np.ndarray, length: int, base: int, window: int) -> np.ndarray:
    """Mask of the windows whose chosen runs of ``length`` words repeat.

    ``places`` are positions of repeating runs; of the base length, numbers of
    chosen runs in their order.
    """
    runs = window_hashes(codes, length)
    if length == base:
        at = chosen_runs(runs, window - base + 1)
        return np.isin(at, np.unique(at)[places])
    part = (window - length) // 2
    repeats = np.isin(chosen_runs(runs, part + 1), places)
    n = len(codes) - window + 1
    return repeats[:n] & repeats[part : part + n]


def _next_level(window: int, base: int, length: int):
    """Texts with their repeating runs of half the length -> chosen runs of the candidates' parts, with their positions."""
    part = (window - length) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, places = [], []
            for text, alive in zip(utf8_rows(batch.column(1)), batch.column(2)):
                codes = word_hashes(spaced(text))
                starts = np.flatnonzero(_candidates(codes, alive.values.to_numpy(), length // 2, base, window))
                runs = window_hashes(codes, length)
                at = chosen_runs(runs, part + 1)
                at = np.unique(np.concatenate([at[starts], at[starts + part]]))
                hashes.append(runs[at].view(np.int64))
                places.append(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), list_of(hashes, pa.int64()), list_of(places, pa.int32())], ["doc_id", "runs", "places"])

    return run


def _doubled(hashes: np.ndarray, window: int, odd: int) -> np.ndarray:
    """Window hashes from word hashes: by doubling while the length is even, then by a chain."""
    step = np.uint64(odd)
    lengths = [window]
    while lengths[-1] % 2 == 0:
        lengths.append(lengths[-1] // 2)
    with np.errstate(over="ignore"):
        n = len(hashes) - lengths[-1] + 1
        out = mix(hashes[:n] ^ step)
        for k in range(1, lengths[-1]):
            out = mix(out * step + hashes[k : k + n])
        for length in lengths[-2::-1]:
            out = mix(out[: -length // 2] * step + out[length // 2 :])
    return out.view(np.int64)


#: Odd multipliers of the two window hashes.
FIRST, SECOND = 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F


def _last_level(window: int, base: int, length: int):
    """Texts with their repeating runs of half the window -> one row for each window that may repeat.

    Within a document only the first occurrence of a window is hashed out;
    later ones come as rows without a hash, since they are later anyway.
    """

    def emit(parts: list) -> pa.RecordBatch:
        ids, starts, first, second, later = (np.concatenate(x) for x in zip(*parts))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array(starts, pa.int32()),
                pa.array(first, pa.int64(), mask=later),
                pa.array(second, pa.int64(), mask=later),
            ],
            ["doc_id", "start", "h", "g"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for doc, text, alive in zip(ids, utf8_rows(batch.column(1)), batch.column(2)):
                codes = word_hashes(spaced(text))
                starts = np.flatnonzero(_candidates(codes, alive.values.to_numpy(), length, base, window))
                if not len(starts):
                    continue
                first, second = _doubled(codes, window, FIRST)[starts], _doubled(codes, window, SECOND)[starts]
                order = np.lexsort((starts, second, first))
                same = (first[order][1:] == first[order][:-1]) & (second[order][1:] == second[order][:-1])
                later = np.zeros(len(starts), bool)
                later[order[1:][same]] = True
                parts.append((np.full(len(starts), doc), starts.astype(np.int32), first, second, later))
                size += len(starts)
                if size >= BATCH_ROWS:
                    yield emit(parts)
                    parts, size = [], 0
        if parts:
            yield emit(parts)

    return run


def covered(n_words: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Mask of the words that some window from ``starts`` covers."""
    step = np.zeros(n_words + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + window, -1)
    return np.cumsum(step[:-1]) > 0


def _apply(window: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas, kept_texts = [], [], []
            for text, starts in zip(utf8_rows(batch.column(1)), batch.column(2)):
                words = spaced(text)
                gone = covered(len(words), starts.values.to_numpy(), window)
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                removed.append(int(gone.sum()))
                shas.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept.decode() if texts else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(kept_texts, pa.string())],
                ["doc_id", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


def _repeating(runs: DataFrame, scratch: Scratch, length: int) -> DataFrame:
    """(doc_id, places) of the (doc_id, place, run) rows whose run is in more than one row."""
    again = scratch.table(runs.groupBy("run").agg(F.count("*").alias("n")).where("n > 1").select("run"), f"again-{length}")
    alive = runs.join(again, "run", "left_semi").groupBy("doc_id").agg(F.collect_set("place").alias("places"))
    alive = scratch.table(alive, f"alive-{length}")
    scratch.drop(f"again-{length}")
    return alive


def repeated_substrings(
    documents: DataFrame,
    *,
    window: int = WINDOW,
    base: int = BASE,
    with_text: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]), one row per document.

    Words are maximal runs without white space, unchanged.  A word goes when a
    window of ``window`` words that covers it starts earlier as well (in a
    smaller doc_id, or earlier in the same document); windows are judged on the
    input.  ``with_text`` adds the kept words joined by a space, null for
    documents that lose nothing (their text stays as it is).

    Null, empty or blank text: no words, nothing removed, the digest of the
    empty string.  doc_id is a key: rows that repeat an id with the same text
    count once and get equal rows; rows that repeat an id with other texts are
    not supported.  Rows with a null id lose nothing and never count as an
    earlier occurrence.  Other columns are ignored.  Empty input:
    empty result.  ``window`` must be ``base`` times a power of two from 2 on.
    """
    if window % base or window == base or (window // base) & (window // base - 1):
        raise ValueError("window must be base times a power of two")
    spark = documents.sparkSession
    scratch = Scratch(spark, "substring")
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    level = scratch.table(docs.mapInArrow(_first_level(window, base), "doc_id long, n_words long, sha string, runs array<long>"), "level")
    long_enough = level.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    classes = long_enough.groupBy("sha").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = scratch.table(classes, "classes")
    single = long_enough.join(classes.select("sha", F.col("rep").alias("doc_id")), ["sha", "doc_id"], "left_semi")
    length, runs = base, single.select("doc_id", F.posexplode("runs").alias("place", "run"))
    alive = _repeating(runs, scratch, length)
    while 2 * length < window and not alive.isEmpty():
        length *= 2
        found = docs.join(alive, "doc_id").mapInArrow(_next_level(window, base, length), "doc_id long, runs array<long>, places array<int>")
        found = scratch.table(found, f"runs-{length}").select("doc_id", F.explode(F.arrays_zip("runs", "places")).alias("x"))
        alive = _repeating(found.select("doc_id", F.col("x.runs").alias("run"), F.col("x.places").alias("place")), scratch, length)
        scratch.drop(f"runs-{length}", f"alive-{length // 2}")

    windows = docs.join(alive, "doc_id").mapInArrow(_last_level(window, base, length), "doc_id long, start int, h long, g long")
    windows = scratch.table(windows, "windows")
    first = windows.where("h is not null").groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    first = scratch.table(first.where("first < last").select("h", "g", "first"), "first")
    later = windows.where("h is not null").join(first, ["h", "g"]).where("doc_id > first").select("doc_id", "start")
    later = later.unionByName(windows.where("h is null").select("doc_id", "start"))
    later = scratch.table(later.groupBy("doc_id").agg(F.collect_set("start").alias("starts")), "later")

    changed = docs.join(later, "doc_id").mapInArrow(
        _apply(window, with_text), "doc_id long, n_removed long, kept_sha256 string, kept_text string"
    )
    copies = (
        long_enough.join(classes.where("copies > 1"), "sha")
        .where("doc_id <> rep")
        .select("doc_id", F.col("n_words").alias("n_removed"), F.lit(EMPTY_SHA).alias("kept_sha256"), F.lit("").alias("kept_text"))
    )
    decided = changed.unionByName(copies).dropDuplicates(["doc_id"])
    result = level.join(decided, "doc_id", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        *(["kept_text"] if with_text else []),
    )
    result = scratch.table(result, "result")
    scratch.drop("level", "classes", f"alive-{length}", "windows", "first", "later")
    return result


def _all_windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, held = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), utf8_rows(batch.column(1))):
                hashes = window_hashes(word_hashes(spaced(text)), size)
                parts.append((np.full(len(hashes), doc), np.arange(len(hashes), dtype=np.int32), hashes.view(np.int64)))
                held += len(hashes)
                if held >= BATCH_ROWS:
                    yield _window_rows(parts)
                    parts, held = [], 0
            if held:
                yield _window_rows(parts)

    return run


def _window_rows(parts: list) -> pa.RecordBatch:
    ids, starts, hashes = (np.concatenate(x) for x in zip(*parts))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(hashes, pa.int64())], ["doc_id", "start", "h"])


def repeat_levels(documents: DataFrame, *, base: int = BASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, length, n_windows): repeated windows of each document at base, 2 * base, 4 * base ... words.

    Plain level-wise doubling, for finding how long repeats are: a window of
    twice the length is looked at when both halves repeat, until no candidate
    survives.  Windows of one document that repeat inside it count as well.
    Null, empty and short texts have no windows; rows with a null id are left
    out; doc_id is a key.  An empty table gives an empty result.
    """
    scratch = Scratch(documents.sparkSession, "levels")
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")

    def repeating(windows: DataFrame, name: str) -> DataFrame:
        again = windows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
        return scratch.table(windows.join(again, "h", "left_semi").select("doc_id", "start", "h"), name)

    length = base
    level = repeating(docs.mapInArrow(_all_windows(base), "doc_id long, start int, h long"), f"level-{length}")
    counted = None
    while True:
        counts = level.groupBy("doc_id").agg(F.lit(length).alias("length"), F.count("*").alias("n_windows"))
        counts = scratch.table(counts, f"counts-{length}")
        counted = counts if counted is None else counted.unionByName(counts)
        if level.isEmpty():
            return counted
        second = level.select("doc_id", (F.col("start") - length).alias("start"), F.col("h").alias("second"))
        longer = level.join(second, ["doc_id", "start"]).select("doc_id", "start", F.xxhash64("h", "second").alias("h"))
        following = repeating(longer, f"level-{2 * length}")
        scratch.drop(f"level-{length}")
        level, length = following, 2 * length

"""Quality scores by Bradley-Terry ranking.

Every text becomes a vector of rates (letters, symbols, repetition, lines).  A
linear score is learned from preference pairs (every document labelled 1
against every one labelled 0) by logistic loss on the difference of their
vectors; the threshold is the quantile of the training scores at the share of
documents labelled 0, and the reported score is a logistic curve through 0.5
there.

The fit takes all labelled rows that are not held out and all their pairs, by
sums that executors make in passes over a table of the rows' features; scores
are computed on executors over whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from marlstone.llm.carry import packed, packed_schema, unpacked
from marlstone.llm.labelled import held_out, usable_labels
from marlstone.llm.words import utf8_rows
from marlstone.plans.scratch import Scratch

#: Weight of all comparisons together against the penalty, if there are more.
PAIRS = 60_000
#: Width of the bins of scores by which rows meet: a chance between two bins is off by less than 0.0001.
BIN = 1 / 16
#: Most bins; they are wider where scores lie further apart than that.
MAX_BINS = 8192
#: Most labels that are broadcast.
BROADCAST_LABELS = 1_000_000
SYMBOLS = b"!?*#%$&|<>@/_=+~^{}[]()\\\"'.,;:-"
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LOWER = np.zeros(256, bool)
_LOWER[0x61:0x7B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_HIGH = np.zeros(256, bool)
_HIGH[0x80:] = True
_MARK = np.zeros(256, bool)
_MARK[list(SYMBOLS)] = True
N_FEATURES = 24 + len(SYMBOLS)


def features(text: bytes | None) -> np.ndarray:
    """Dense features of a whole text; zeros for a text without words."""
    out = np.zeros(N_FEATURES)
    words = text.split() if text else []
    if not words:
        return out
    raw = np.frombuffer(text, np.uint8)
    count = np.bincount(raw, minlength=256)
    n, k = len(raw), len(words)
    lengths = np.fromiter(map(len, words), np.int64, k)
    last = np.fromiter((w[-1] for w in words), np.uint8, k)
    first = np.fromiter((w[0] for w in words), np.uint8, k)
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:]))) if k > 1 else 1
    same = sum(map(bytes.__eq__, words, words[1:])) if k > 1 else 0
    lines = [x for x in text.split(b"\n") if x]
    upper, lower = count[_UPPER].sum(), count[_LOWER].sum()
    out[0] = math.log1p(k)
    out[1] = lengths.mean()
    out[2] = lengths.std()
    out[3] = min(lengths.max(), 200) / 50
    out[4] = upper / n
    out[5] = lower / n
    out[6] = upper / max(1, upper + lower)
    out[7] = count[_DIGIT].sum() / n
    out[8] = count[_HIGH].sum() / n
    out[9] = count[_MARK].sum() / n
    out[10] = distinct / k
    out[11] = distinct / math.sqrt(k)
    out[12] = same / k
    out[13] = pairs / max(1, k - 1)
    out[14] = _MARK[last].mean()
    out[15] = _UPPER[first].mean()
    out[16] = (lengths == 1).mean()
    out[17] = math.log1p(k / max(1, len(lines)))
    out[18] = len(set(lines)) / max(1, len(lines))
    out[19] = math.log1p(len(lines))
    out[20] = (_MARK[last] & (lengths > 3)).mean()
    out[21] = count[32] / n
    out[22] = count[10] / n
    two = raw[1:] == raw[:-1]
    out[23] = (two & _MARK[raw[1:]]).sum() / n
    out[24:] = np.sqrt(count[list(SYMBOLS)] / n)
    return out


@dataclass
class Ranker:
    """Linear Bradley-Terry score over standardised, clipped features."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    threshold: float
    slope: float

    def _prepared(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([z, np.minimum(np.abs(z), 3)], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        s = self._prepared(x) @ self.weight
        return 1 / (1 + np.exp(-np.clip(self.slope * (s - self.threshold), -500, 500)))


#: (entries, values) of a block of rows (features, labels), to be summed by entry.
Part = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
#: Sums of a part over all rows: the entries in order, and their sums.
Total = Callable[[Part], tuple[np.ndarray, np.ndarray]]
BLOCK = 2048


def _summed(entries: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not entries:
        return np.empty(0, np.int64), np.empty(0)
    found, place = np.unique(np.concatenate(entries), return_inverse=True)
    return found, np.bincount(place, np.concatenate(values), len(found))


def _blocks(x: np.ndarray, label: np.ndarray, part: Part, so_far: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    for a in range(0, len(x), BLOCK):
        so_far = [_summed(*map(list, zip(*so_far, part(x[a : a + BLOCK], label[a : a + BLOCK]))))]
    return so_far


def _dense(total: Total, size: int, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sums of vectors of ``size`` numbers."""
    out = np.zeros(size)
    entries, values = total(lambda x, y: (np.arange(size), part(x, y)))
    out[entries] = values
    return out


def _binned(z: np.ndarray, label: np.ndarray, weight: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Each row counted, with its features, at the two bins beside its score, by nearness and label."""
    place = z @ weight / width
    low = np.floor(place).astype(np.int64)
    bins = np.concatenate([2 * low + label, 2 * low + 2 + label])
    near = np.concatenate([1 - (place - low), place - low])
    order = np.argsort(bins, kind="stable")
    found, first = np.unique(bins[order], return_index=True)
    rows = np.column_stack([near, np.concatenate([z, z]) * near[:, None]])
    sums = np.add.reduceat(rows[order], first)
    return (found[:, None] * sums.shape[1] + np.arange(sums.shape[1])).ravel(), sums.ravel()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _weights(total: Total, prepared, size: int, scale: float, penalty: float, rounds: int = 60) -> np.ndarray:
    """Newton's method for the penalised logistic loss of all comparisons of a row labelled 1 with one labelled 0.

    The comparisons are not listed: a row meets the other label's rows by the bins of their scores.
    A step that does not lower the loss is halved.
    """
    w, best, step = np.zeros(size), np.inf, np.zeros(size)
    for _ in range(rounds):
        width = max(BIN, 12 * np.abs(w).sum() / MAX_BINS)  # features are at most 6
        entries, values = total(lambda x, y, w=w, width=width: _binned(prepared(x), y, w, width))
        sums, bins = values.reshape(-1, size + 1), entries.reshape(-1, size + 1)[:, 0] // (size + 1)
        (bad, good), (low, high) = [sums[bins % 2 == k] for k in (0, 1)], [bins[bins % 2 == k] // 2 * width for k in (0, 1)]
        apart = low[None, :] - high[:, None]
        loss = penalty / 2 * (w @ w) + scale * (good[:, 0] @ np.logaddexp(0, apart) @ bad[:, 0])
        if loss > best + 1e-6 * abs(best):
            step = step / 2
            w = w + step
            continue
        best = loss
        wrong = _sigmoid(apart)  # chance of the wrong order, good by bad bins
        spread = wrong * (1 - wrong)
        gradient = penalty * w - scale * ((wrong @ bad[:, 0]) @ good[:, 1:] - (good[:, 0] @ wrong) @ bad[:, 1:])

        def squares(x: np.ndarray, y: np.ndarray, w=w, low=low, high=high, bad=bad[:, 0], good=good[:, 0]) -> np.ndarray:
            z = prepared(x)
            s, out = z @ w, np.empty(len(z))
            for k, centres, counts in ((1, low, bad), (0, high, good)):
                p = _sigmoid(centres[None, :] - s[y == k][:, None])
                out[y == k] = (p * (1 - p)) @ counts
            return ((z * out[:, None]).T @ z).ravel()

        cross = good[:, 1:].T @ spread @ bad[:, 1:]
        hessian = penalty * np.eye(size) + scale * (_dense(total, size * size, squares).reshape(size, size) - cross - cross.T)
        step = np.linalg.solve(hessian, gradient)
        step /= max(1.0, np.abs(step).max())
        w = w - step
        if np.abs(step).max() < 1e-5:
            break
    return w


def _ordered(total: Total, score, ranks: tuple[int, ...]) -> list[float]:
    """The scores of the given places (from 0) in order, found by their bits, 16 in a pass."""
    top = np.uint64(1 << 63)

    def keys(x: np.ndarray) -> np.ndarray:  # whole numbers in the order of the scores
        bits = (score(x) + 0.0).view(np.uint64)
        return np.where(bits & top, ~bits, bits | top)

    found, left = [0] * len(ranks), list(ranks)
    for shift in (48, 32, 16, 0):

        def part(x: np.ndarray, _: np.ndarray, shift=shift, found=tuple(found)) -> tuple[np.ndarray, np.ndarray]:
            key = keys(x)
            digit = ((key >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.int64)
            before = key >> np.uint64(shift + 16) if shift < 48 else np.zeros(len(key), np.uint64)
            chosen = [digit[before == np.uint64(f)] + (k << 16) for k, f in enumerate(found)]
            entries = np.concatenate(chosen)
            return entries, np.ones(len(entries))

        entries, counts = total(part)
        for k in range(len(ranks)):
            mine = entries >> 16 == k
            upto = np.cumsum(counts[mine])
            at = int(np.searchsorted(upto, left[k], side="right"))
            left[k] -= int(upto[at - 1]) if at else 0
            found[k] = (found[k] << 16) | int(entries[mine][at] & 0xFFFF)
    bits = np.array(found, np.uint64)
    return np.where(bits & top, bits ^ top, ~bits).view(np.float64).tolist()


def _fitted(total: Total, n_features: int, pairs: int = PAIRS, penalty: float = 3.0) -> Ranker:
    n, n_good, *mean = _dense(total, 2 + n_features, lambda x, y: np.concatenate([[len(y), y.sum()], x.sum(0)]))
    n, n_good, mean = int(n), int(n_good), np.array(mean) / max(n, 1)
    scale = np.sqrt(_dense(total, n_features, lambda x, _: ((x - mean) ** 2).sum(0)) / n) if n else np.ones(n_features)
    ranker = Ranker(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(2 * n_features), 0.0, 1.0)
    n_bad = n - n_good
    if not n_good or not n_bad:  # nothing to rank: all score 0.5, or the only label
        ranker.threshold = 0.0 if not n else (-30.0 if n_good else 30.0)
        return ranker
    prepared = ranker._prepared
    ranker.weight = _weights(total, prepared, 2 * n_features, min(1.0, pairs / (n_good * n_bad)), penalty)
    score = lambda x, w=ranker.weight: prepared(x) @ w
    # The quantile at the share of zeros, halfway between its neighbours.
    cut = min(max(n_bad, 1), n - 1)
    threshold = sum(_ordered(total, score, (cut - 1, cut))) / 2
    spread = max(float(_dense(total, 1, lambda x, _: np.abs(score(x) - threshold).sum(keepdims=True))[0]) / n, 1e-6)
    slope = 0.0
    for _ in range(30):

        def terms(x: np.ndarray, y: np.ndarray, slope=slope) -> np.ndarray:
            c = (score(x) - threshold) / spread
            p = _sigmoid(np.clip(c * slope, -30, 30))
            return np.array([((p - y) * c).sum(), (p * (1 - p) * c * c).sum()])

        first, second = _dense(total, 2, terms)
        step = (first + slope) / (second + 1.0)
        slope -= step
        if abs(step) < 1e-6:
            break
    ranker.threshold, ranker.slope = float(threshold), float(max(slope, 0.05) / spread)
    return ranker


def fit_ranker(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, penalty: float = 3.0) -> Ranker:
    """Learn from all rows of features with labels 0 and 1; more than ``pairs`` comparisons weigh as so many together."""
    label = np.asarray(label, np.int64)
    return _fitted(lambda part: _summed(*map(list, zip(*_blocks(x, label, part, [])))) if len(x) else _summed([], []), x.shape[1], pairs, penalty)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [features(t) for t in utf8_rows(batch.column(1))]
        flat = pa.array(np.concatenate(values) if values else np.empty(0), pa.float64())
        offsets = pa.array(np.arange(len(values) + 1, dtype=np.int32) * N_FEATURES)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "x"])


def _parts(part: Part):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
            so_far = _blocks(x, batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), part, so_far)
        for entries, values in so_far:
            yield pa.RecordBatch.from_arrays([pa.array(entries), pa.array(values)], ["entry", "value"])

    return run


def train_quality(documents: DataFrame, labels: DataFrame, label: str = "quality") -> Ranker:
    """Fit on all labelled documents that are not held out; the driver sees sums alone."""
    scratch = Scratch(documents.sparkSession, "quality")
    usable = scratch.table(usable_labels(labels, label), "labels")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(~held_out("doc_id"))
    kind = "doc_id long, x array<double>"
    if usable.count() <= BROADCAST_LABELS:
        rows = docs.join(F.broadcast(usable.select("doc_id")), "doc_id", "left_semi").mapInArrow(_featured, kind).join(F.broadcast(usable), "doc_id")
    else:  # features are moved instead of texts
        rows = docs.mapInArrow(_featured, kind).join(usable, "doc_id")
    rows = scratch.table(rows.distinct().sortWithinPartitions("doc_id"), "rows").select("x", "label")
    rows = rows.coalesce(max(documents.sparkSession.sparkContext.defaultParallelism, 1))  # sums are a task's: as many as run at once

    def total(part: Part) -> tuple[np.ndarray, np.ndarray]:
        sums = rows.mapInArrow(_parts(part), "entry long, value double").groupBy("entry").agg(
            F.aggregate(F.array_sort(F.collect_list("value")), F.lit(0.0), lambda a, b: a + b).alias("value")  # one value a task
        ).toArrow().sort_by("entry")
        return sums["entry"].to_numpy(), sums["value"].to_numpy()

    ranker = _fitted(total, N_FEATURES)
    scratch.drop("labels", "rows")
    return ranker


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = model.value
        for batch in batches:
            x = np.array([features(t) for t in utf8_rows(batch.column(1))]).reshape(-1, N_FEATURES)
            scores = pa.array(ranker.scores(x), pa.float64())
            if batch.num_columns == 2:
                yield pa.RecordBatch.from_arrays([batch.column(0), scores], ["doc_id", "score"])
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, "score"])

    return run


def accepted_documents(documents: DataFrame, labels: DataFrame, *, threshold: float = 0.5, label: str = "quality") -> DataFrame:
    """The rows of ``documents`` that score at least ``threshold``, with all their columns."""
    model = documents.sparkSession.sparkContext.broadcast(train_quality(documents, labels, label))
    pack = packed(documents)
    scored = pack.mapInArrow(_scored(model), packed_schema(pack, T.StructField("score", T.DoubleType())))
    return unpacked(scored.where(F.col("score") >= threshold), documents)


def score_quality(documents: DataFrame, labels: DataFrame, *, threshold: float = 0.5, label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row.

    The score uses the text alone.  Null, empty and blank texts have the zero
    vector and its score; repeated rows score alike; a null id is not held out.
    With no usable labels, or one class only, everything scores 0.5 or lies on
    that class's side.  Other columns are ignored.
    """
    model = documents.sparkSession.sparkContext.broadcast(train_quality(documents, labels, label))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = docs.mapInArrow(_scored(model), "doc_id long, score double")
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )

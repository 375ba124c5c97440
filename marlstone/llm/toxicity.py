"""Toxicity scores: boosted trees over dense features, with isotonic calibration.

Features are densities of abusive words (a small fixed list and a list learned
from the training rows), how near they stand to a second person, capitals,
punctuation and obfuscation (digits or symbols inside words, words spelled out
letter by letter).  Words are compared after undoing such disguises.

The word list and trees are fitted on at most ``FIT_ROWS`` labelled rows.  Scores
are calibrated on the margins of four folds, each of whose word list and trees
come from the other three.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marlstone.llm.boosting import Boosted, fit_boosted, isotonic
from marlstone.llm.labelled import FIT_ROWS, fit_sample, held_out
from marlstone.llm.words import list_of, utf8_rows
from marlstone.plans.scratch import Scratch

# Common insults, and words for the person addressed.
INSULTS = frozenset(
    b"""asshole bastard bitch crap creep cretin damn dickhead disgusting dumb dumbass fool freak garbage
    hate hateful idiot idiotic idiots imbecile kill loser losers lowlife moron morons pathetic pig rubbish scum
    scumbag shit shut stupid sucker trash ugly vermin vile worthless""".split()
)
SECOND_PERSON = frozenset(
    b"""you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos
    usted ustedes tus vosotros""".split()
)
LEARNED_WORDS = 400
FOLDS = 4
_LEET = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ013457@$", b"abcdefghijklmnopqrstuvwxyzoieastas")
_DROPPED = b"!\"#%&'()*+,-./:;<=>?[\\]^_`{|}~"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(_DROPPED + b"@$0123456789")] = True
_MARK = np.zeros(256, bool)
_MARK[list(_DROPPED + b"@$")] = True
N_FEATURES = 19


def plain_words(text: bytes | None) -> list[bytes]:
    """Words after lower-casing A-Z, undoing digit-for-letter spellings and dropping symbols."""
    return text.translate(_LEET, _DROPPED).split() if text else []


def spelled_out(words: list[bytes], lengths: np.ndarray) -> list[tuple[int, bytes]]:
    """(place, word) of runs of four or more single letters."""
    single = np.concatenate([[0], (lengths == 1).astype(np.int8), [0]])
    starts, ends = np.flatnonzero(np.diff(single) == 1), np.flatnonzero(np.diff(single) == -1)
    return [(a, b"".join(words[a:b])) for a, b in zip(starts.tolist(), ends.tolist()) if b - a >= 4]


def features(text: bytes | None, learned: dict[bytes, float]) -> np.ndarray:
    """Dense features of a whole text; zeros for a text without words."""
    out = np.zeros(N_FEATURES)
    words = plain_words(text)
    k = len(words)
    if not k:
        return out
    raw = np.frombuffer(text, np.uint8)
    count = np.bincount(raw, minlength=256)
    n = len(raw)
    lengths = np.fromiter(map(len, words), np.int64, k)
    fixed = [i for i, w in enumerate(words) if w in INSULTS]
    weighted = [(i, learned[w]) for i, w in enumerate(words) if w in learned]
    joined = [(i, w) for i, w in spelled_out(words, lengths) if w in INSULTS or w in learned]
    places = np.array(sorted({*fixed, *(i for i, _ in weighted), *(i for i, _ in joined)}), np.int64)
    person = np.array([i for i, w in enumerate(words) if w in SECOND_PERSON], np.int64)
    near = 0
    if len(places) and len(person):
        at = np.searchsorted(person, places)
        gap = np.minimum(np.abs(person[np.minimum(at, len(person) - 1)] - places), np.abs(person[np.maximum(at - 1, 0)] - places))
        near = int((gap <= 5).sum())
    # A symbol with a letter on both sides, outside plain punctuation at word ends.
    letter = ~_SYMBOL[raw] & (raw > 32)
    inside = int((_SYMBOL[raw[1:-1]] & letter[:-2] & letter[2:]).sum()) if n > 2 else 0
    crowd = int((np.searchsorted(places, places + 50) - np.arange(len(places))).max()) if len(places) else 0
    weight = sum(v for _, v in weighted)
    out[0] = len(fixed) / k
    out[1] = math.log1p(len(fixed))
    out[2] = len(weighted) / k
    out[3] = math.log1p(len(weighted))
    out[4] = weight / k
    out[5] = weight
    out[6] = max((v for _, v in weighted), default=0.0)
    out[7] = len({words[i] for i in fixed} | {words[i] for i, _ in weighted})
    out[8] = crowd
    out[9] = near
    out[10] = len(person) / k
    out[11] = count[0x41:0x5B].sum() / max(1, count[0x41:0x5B].sum() + count[0x61:0x7B].sum())
    out[12] = count[0x21] / n
    out[13] = count[0x3F] / n
    out[14] = count[_MARK].sum() / n
    out[15] = inside / k
    out[16] = len(joined)
    out[17] = math.log1p(k)
    out[18] = len(places) * 100.0 / (k + 20)
    return out


@dataclass
class ToxicModel:
    learned: dict[bytes, float]
    trees: Boosted
    knots: np.ndarray
    values: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return 1 / (1 + np.exp(-self.trees.margins(x)))
        return np.interp(self.trees.margins(x), self.knots, self.values)


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, labels = [], []
        for text, label in zip(utf8_rows(batch.column(1)), batch.column(2).to_pylist()):
            own = {w for w in plain_words(text) if 2 < len(w) <= 40}
            words += own
            labels += [label] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(labels, pa.int32())], ["word", "label"])


def learned_words(sample: DataFrame, limit: int = LEARNED_WORDS) -> list[dict[bytes, float]]:
    """Words whose odds to stand in toxic documents are high, with their log odds: of each fold's other rows, and of all.

    ``sample`` is (doc_id, text, label, fold).  Item ``f`` leaves fold ``f`` out,
    the last one leaves out none.
    """
    sizes = {(r.fold, r.label): r["count"] for r in sample.groupBy("fold", "label").count().collect()}  # eight rows
    words = sample.select("doc_id", "text", (F.col("label") + 2 * F.col("fold")).alias("label")).mapInArrow(_distinct_words, "word binary, label int")
    counts = [F.count_if(F.col("label") == k).alias(f"n{k}") for k in range(2 * FOLDS)]
    seen = words.groupBy("word").agg(*counts)
    seen = Scratch(sample.sparkSession, "toxic-words").table(seen.where(" + ".join(f"n{2 * f + 1}" for f in range(FOLDS)) + " >= 3"), "seen")
    lists = []
    for left_out in [*range(FOLDS), None]:
        used = [f for f in range(FOLDS) if f != left_out]
        clean, toxic = (sum(sizes.get((f, label), 0) for f in used) for label in (0, 1))
        if not toxic or not clean:
            lists.append({})
            continue
        c, t = (sum((F.col(f"n{2 * f + label}") for f in used), F.lit(0)) for label in (0, 1))
        odds = F.log(((F.col("t") + 0.5) / (toxic + 1)) / ((F.col("c") + 0.5) / (clean + 1)))
        rows = seen.select("word", t.alias("t"), c.alias("c")).where("t >= 3").withColumn("odds", odds).where("odds > 1.6")
        rows = rows.orderBy(F.desc(F.col("odds") * F.sqrt("t")), "word").limit(limit).collect()
        lists.append({bytes(r.word): float(r.odds) for r in rows})
    return lists


def _featured(lists: list[dict[bytes, float]]):
    """Rows with their features under all words and under those learned without their fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], []]
            for text, fold in zip(utf8_rows(batch.column(1)), batch.column(3).to_pylist()):
                made = [features(text, words) for words in lists]
                cols[0].append(made[-1])
                cols[1].append(made[fold])
                cols[2].append(np.concatenate(made[:-1]))
            vectors = [list_of(c, pa.float64()) for c in cols]
            yield pa.RecordBatch.from_arrays([batch.column(0), *vectors, batch.column(2), batch.column(3)], ["doc_id", "x", "own", "others", "label", "fold"])

    return run


def fit_toxic(x: np.ndarray, own: np.ndarray, others: np.ndarray, y: np.ndarray, fold: np.ndarray, learned: dict[bytes, float]) -> ToxicModel:
    """Trees on all rows; calibration on margins of folds whose words and trees did not see the row.

    ``x`` has the rows' features under all learned words, ``own`` those under the
    words learned without the row's fold, and ``others[:, f]`` those under the
    words learned without fold ``f``.
    """
    trees = fit_boosted(x, y)
    if len(y) < 40 or y.min() == y.max():
        return ToxicModel(learned, trees, np.empty(0), np.empty(0))
    margins = np.empty(len(y))
    for f in range(FOLDS):
        mine = fold == f
        margins[mine] = fit_boosted(others[~mine, f], y[~mine]).margins(own[mine])
    knots, values = isotonic(margins, y)
    return ToxicModel(learned, trees, knots, values)


def train_toxicity(documents: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS) -> ToxicModel:
    """Fit on at most ``rows`` labelled documents that are not held out."""
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")
    sample = fit_sample(documents, labels, label, rows).select("doc_id", "text", "label", fold)
    lists = learned_words(sample)
    kind = "doc_id long, x array<double>, own array<double>, others array<double>, label int, fold int"
    found = sample.mapInArrow(_featured(lists), kind).toArrow()  # at most ``rows`` rows of 6 * N_FEATURES numbers
    ids = found["doc_id"].to_numpy()
    x, own, others = (found[c].combine_chunks().flatten().to_numpy().reshape(len(ids), n, N_FEATURES) for c, n in (("x", 1), ("own", 1), ("others", FOLDS)))
    y, fold = found["label"].to_numpy().astype(float), found["fold"].to_numpy()
    order = np.lexsort((*x[:, 0].T, ids))  # repeated ids too in a fixed order
    return fit_toxic(x[order, 0], own[order, 0], others[order], y[order], fold[order], lists[-1])


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic = model.value
        for batch in batches:
            x = np.array([features(t, toxic.learned) for t in utf8_rows(batch.column(1))]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(toxic.scores(x), pa.float64())], ["doc_id", "score"])

    return run


def score_toxicity(documents: DataFrame, labels: DataFrame, *, threshold: float = 0.7, label: str = "toxic", rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row.

    The score uses the text alone.  Null, empty and blank texts have the zero
    vector and its score; repeated rows score alike; a null id is not held out.
    With no usable labels or one class only, scores are the base rate.  Other
    columns are ignored.
    """
    model = documents.sparkSession.sparkContext.broadcast(train_toxicity(documents, labels, label, rows))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = docs.mapInArrow(_scored(model), "doc_id long, score double")
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )

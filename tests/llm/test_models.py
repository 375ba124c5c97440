"""Quality and toxicity classifiers, their parts and held-out accuracy."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import boosting, labelled, quality, toxicity


def prose(draw, n):
    return " ".join(draw.choice(["the", "river", "stone", "under", "light", "carries", "green", "of", "and", "morning"]) + ("." if draw.random() < 0.1 else "") for _ in range(n))


def labelled_documents(spark, n=400):
    draw = random.Random(4)
    data, labels = [], []
    for i in range(n):
        text, good, toxic = prose(draw, draw.randrange(20, 80)), i % 5 != 0, i % 4 == 1
        if toxic:
            words = text.split()
            for _ in range(3):
                words.insert(draw.randrange(len(words)), draw.choice(["blorf", "idiot", "bl0rf", "B-L-O-R-F"]))
            text = " ".join(words)
        if not good:
            text = " ".join(w.upper() + "!!" for w in text.split())
        data.append((i, text, "en", "s", 0, "x"))
        labels.append((i, int(good), int(toxic)))
    data += [(n, None, "en", "s", 0, "x"), (n + 1, "", "en", "s", 0, "x"), (None, "text", "en", "s", 0, "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, label long, score string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("score", "label"), [(quality.score_quality, "quality"), (toxicity.score_toxicity, "toxic")])
def test_held_out_accuracy(spark, score, label):
    docs, labels = labelled_documents(spark)
    got = {r.doc_id: r for r in score(docs, labels).collect()}
    truth = {r.doc_id: r[label] for r in labels.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in truth)
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == docs.count()
    assert got[400].score == got[401].score and got[None].held_out is False


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_few_labels_and_empty_tables(spark, score):
    docs, labels = labelled_documents(spark, 12)
    for few in (labels.limit(0), labels.where("quality = 1 and toxic = 0"), labels.withColumns({"quality": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})):
        assert all(0 <= r.score <= 1 for r in score(docs, few).collect())
    assert score(docs.limit(0), labels).count() == 0


def test_labels_of_held_out_rows_are_never_read(spark):
    docs, labels = labelled_documents(spark, 60)
    flipped = labels.withColumn("quality", F.when(labelled.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    first = {r.doc_id: r.score for r in quality.score_quality(docs, labels).collect()}
    assert {r.doc_id: r.score for r in quality.score_quality(docs, flipped).collect()} == first


def test_disputed_labels_are_left_out(spark):
    docs, _ = labelled_documents(spark, 6)
    labels = spark.createDataFrame([(0, 1), (0, 0), (2, 1), (2, 1), (3, 7), (None, 1)], "doc_id long, quality int")
    assert {r.doc_id for r in labelled.fit_sample(docs, labels, "quality").collect()} <= {2}


def test_accepted_documents_keep_their_columns(spark):
    docs, labels = labelled_documents(spark, 100)
    kept = quality.accepted_documents(docs, labels)
    assert kept.columns == docs.columns and dict(kept.dtypes) == dict(docs.dtypes) and 0 < kept.count() < docs.count()


def test_words_of_a_fold_come_from_the_other_folds(spark):
    fold_words = {0: "alphox", 1: "betox"}
    data = [(i, f"{fold_words.get(i % 4, 'plain')} everywhere text {'gammox' if toxic else ''}", int(toxic), i % 4) for i in range(160) for toxic in [i % 8 < 4]]
    data = [(i, t if y else t.replace("alphox", "clean").replace("betox", "clean"), y, f) for i, t, y, f in data]
    lists = toxicity.learned_words(spark.createDataFrame(data, "doc_id long, text string, label int, fold int"))
    assert len(lists) == toxicity.FOLDS + 1 and all(b"gammox" in words for words in lists)
    assert [b"alphox" in words for words in lists] == [False, True, True, True, True]
    assert [b"betox" in words for words in lists] == [True, False, True, True, True]


def test_isotonic_is_the_least_squares_fit():
    draw = np.random.default_rng(0)
    x, y = draw.random(200).round(2), (draw.random(200) < 0.4).astype(float)
    knots, values = boosting.isotonic(x, y)
    assert (np.diff(values) >= 0).all() and (np.diff(knots) >= 0).all()
    fitted = np.interp(x, knots, values)
    order = np.argsort(x)
    # Least squares over non-decreasing sequences, by the max-min formula on distinct values.
    u = np.unique(x)
    s, n = np.array([y[x == v].sum() for v in u]), np.array([(x == v).sum() for v in u])
    best = [max(min(s[i:j].sum() / n[i:j].sum() for j in range(k + 1, len(u) + 1)) for i in range(k + 1)) for k in range(len(u))]
    assert np.allclose([fitted[order][np.searchsorted(x[order], v)] for v in u], best)


def test_boosting_learns_an_interaction():
    draw = np.random.default_rng(1)
    x = draw.random((800, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    model = boosting.fit_boosted(x[:600], y[:600])
    assert np.mean((model.margins(x[600:]) > 0) == y[600:]) > 0.95
    assert np.allclose(boosting.fit_boosted(x[:20], np.ones(20)).margins(x[:3]), np.log(0.999 / 0.001))


def test_toxic_words_are_seen_through_disguise():
    assert toxicity.plain_words(b"1d10t St*pid! @sshole") == [b"idiot", b"stpid", b"asshole"]
    words = toxicity.plain_words(b"you i d i o t")
    assert toxicity.spelled_out(words, np.array([len(w) for w in words])) == [(1, b"idiot")]
    near = toxicity.features(b"you idiot", {})
    far = toxicity.features(b"you " + b"word " * 30 + b"idiot", {})
    assert near[9] == 1 and far[9] == 0 and near[0] == 0.5
    assert not toxicity.features(None, {}).any() and not quality.features(b" \n").any()


def test_ranker_threshold_is_a_quantile():
    draw = np.random.default_rng(3)
    label = (draw.random(300) < 0.8).astype(int)
    x = draw.normal(size=(300, quality.N_FEATURES)) + label[:, None] * 0.3
    ranker = quality.fit_ranker(x, label)
    assert abs((ranker.scores(x) < 0.5).mean() - (label == 0).mean()) < 0.01
    assert (ranker.scores(x).argsort() == (ranker._prepared(x) @ ranker.weight).argsort()).mean() > 0.99


def test_ranker_is_fitted_on_all_comparisons():
    draw = np.random.default_rng(4)
    label = (draw.random(500) < 0.7).astype(int)
    x = draw.normal(size=(500, quality.N_FEATURES)) + label[:, None] * 0.2
    ranker = quality.fit_ranker(x, label)
    z = ranker._prepared(x)
    s, good, bad = z @ ranker.weight, label == 1, label == 0
    wrong = 1 / (1 + np.exp(s[good][:, None] - s[bad][None, :]))
    gradient = 3.0 * ranker.weight - min(1.0, quality.PAIRS / wrong.size) * (wrong.sum(1) @ z[good] - wrong.sum(0) @ z[bad])
    assert np.abs(gradient).max() < 0.3  # of sums of thousands
    order = np.sort(s)
    assert ranker.threshold == (order[bad.sum() - 1] + order[bad.sum()]) / 2


@pytest.mark.parametrize("most", [quality.BROADCAST_LABELS, 10])
def test_quality_learns_from_every_labelled_row(spark, monkeypatch, most):
    monkeypatch.setattr(quality, "BROADCAST_LABELS", most)
    n = 32_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, F.repeat(F.lit("Ab! "), F.col("id").cast("int") % 9)).otherwise("word text").alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 4 != 0).cast("int").alias("quality"))
    taken = [r for r in docs.where(~labelled.held_out("doc_id")).collect()]
    x = np.array([quality.features(r.text.encode()) for r in taken])
    assert len(x) > labelled.FIT_ROWS
    expected = quality.fit_ranker(x, np.array([r.doc_id % 4 != 0 for r in taken]).astype(int))
    got = quality.train_quality(docs, labels)
    assert np.allclose(got.mean, expected.mean) and np.allclose(got.weight, expected.weight, atol=1e-4) and abs(got.threshold - expected.threshold) < 1e-4

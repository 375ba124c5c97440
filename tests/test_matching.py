"""Records, blocking, features, rules, labels, metrics and the model."""

import difflib
import random

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from marlstone.functions import similarity
from marlstone.functions.scoring import rule_probability
from marlstone.operators import blocking, decompose, features, metrics, model, training
from marlstone.operators.records import build_records
from marlstone.sources.schemas import STAGING


def table(spark, name, data):
    fields = STAGING[name].fieldNames()
    return spark.createDataFrame([tuple(d.get(f) for f in fields) for d in data], STAGING[name])


def entity(source, source_id, name, year=None, slug=None):
    return {"source": source, "source_id": source_id, "name": name, "name_normalized": name.lower() or None, "release_year": year, "slug": slug}


def sample(spark, **more):
    entities = more.pop("entities", None) or [entity("rawg", "1", "Grand Theft Auto V", 2013, "gta-v"), entity("wikidata", "Q1", "Grand Theft Auto V", 2013, "Q1")]
    tables = {k: table(spark, k, v) for k, v in more.items()}
    return build_records(table(spark, "entities", entities), **tables)


def key(source, source_id, **more):
    return {"source": source, "source_id": source_id, **more}


def test_records_gather_attributes(spark):
    r = sample(
        spark,
        aliases=[key("rawg", "1", alias="GTA 5!", language="en"), key("rawg", "1", alias="ГТА"), key("rawg", "9", alias="lost")],
        external_ids=[key("wikidata", "Q1", external_source="rawg", external_id="1"), key("wikidata", "Q1", external_source="rawg", external_id="0")],
        genres=[key("rawg", "1", value="Action"), key("rawg", "1", value="action")],
        urls=[key("wikidata", "Q1", url_type="enwiki", url="u")],
        descriptions=[key("rawg", "1", language="en", description_text="x"), key("wikidata", "Q1", language="ru", description_text="")],
    )
    got = {x.source: x for x in r.collect()}
    assert got["rawg"].aliases == ["gta 5"] and got["rawg"].genres == ["action"] and got["rawg"].external_ids == {"rawg": "gta-v"}
    assert got["wikidata"].external_ids == {"rawg": "1", "wikidata": "Q1"} and got["wikidata"].evidence_sources == ["rawg", "wikidata", "wikipedia"]
    assert got["rawg"].has_description and not got["wikidata"].has_description and got["rawg"].first_token == "grand"
    assert got["rawg"].comparison_names == ["grand theft auto v", "gta 5"]


def test_blocking_rules(spark):
    by_name = blocking.candidate_pairs(sample(spark), rule="same_normalized_name").collect()
    assert [(p.source_id_b, p.confidence) for p in by_name] == [("Q1", 0.8)]
    alias = sample(
        spark, entities=[entity("rawg", "1", "One"), entity("wikidata", "Q2", "Two")], aliases=[key("rawg", "1", alias="Same"), key("wikidata", "Q2", alias="same")]
    )
    assert [(p.candidate_source, p.confidence) for p in blocking.candidate_pairs(alias).collect()] == [("shared_alias", 0.7)]
    near = sample(spark, entities=[entity("rawg", "1", "game one", 2000), entity("wikidata", "Q2", "game onee", 2000), entity("wikidata", "Q3", "game zzzzzzzzzzz", 2000)])
    got = blocking.candidate_pairs(near).collect()
    assert [(p.source_id_b, p.candidate_source, p.confidence) for p in got] == [("Q2", "same_release_year_and_similar_name", round(difflib.SequenceMatcher(None, "game one", "game onee").ratio(), 6))]


def test_first_rule_wins_and_slug_beats_id(spark):
    ids = [key("wikidata", "Q1", external_source="rawg", external_id="gta-v"), key("wikidata", "Q5", external_source="rawg", external_id="7")]
    entities = [entity("rawg", "1", "Grand Theft Auto V", 2013, "gta-v"), entity("rawg", "7", "Other", 2000, "x"), entity("rawg", "8", "Third", 2000, "7"), entity("wikidata", "Q1", "Grand Theft Auto V", 2013), entity("wikidata", "Q5", "Fifth", 1990)]
    r = sample(spark, entities=entities, external_ids=ids)
    assert rows(blocking.external_id_matches(r), "source_id_a", "source_id_b") == [("1", "Q1"), ("8", "Q5")]
    pairs = blocking.candidate_pairs(r)
    assert rows(pairs, "source_id_a", "source_id_b", "candidate_source", "label_value") == [("1", "Q1", "external_id_positive", "1"), ("8", "Q5", "external_id_positive", "1")]
    assert blocking.candidate_pairs(r, limit=1).count() == 1
    summary = {(x.metric, x.key): x.value for x in blocking.pair_summary(pairs).collect()}
    assert summary[("candidate_pair_count", "")] == 2 and summary[("positive_weak_label_count", "")] == 2


def test_pair_features(spark):
    r = sample(
        spark,
        platforms=[key("rawg", "1", value="PC"), key("rawg", "1", value="PS4"), key("wikidata", "Q1", value="pc")],
        external_ids=[key("wikidata", "Q1", external_source="rawg", external_id="1")],
        descriptions=[key("rawg", "1", language="en", description_text="x")],
        urls=[key("wikidata", "Q1", url_type="ruwiki", url="u")],
    )
    pairs = blocking.candidate_pairs(r)
    f = features.pair_features(pairs, r).first()
    assert (f.name_similarity, f.alias_similarity, f.release_year_diff, f.external_id_exact_match, f.platform_jaccard) == (1.0, 1.0, 0, True, 0.5)
    assert f.description_language_match is None and f.source_count_signal == 3 and not f.description_available_flag
    assert set(f.reasons) == {"developer_overlap", "publisher_overlap", "genre_jaccard", "tag_jaccard", "description_language_match"}
    counts = {(x.metric, x.key): x.value for x in features.feature_summary(features.pair_features(pairs, r)).collect()}
    assert counts[("missing_feature_reason_count", "tag_jaccard")] == 1 and counts[("external_id_exact_match_count", "")] == 1


def test_alias_similarity_is_the_best_ratio(spark):
    entities = [entity("rawg", "1", "a"), entity("wikidata", "Q1", "b")]
    r = sample(spark, entities=entities, aliases=[key("rawg", "1", alias="first name"), key("rawg", "1", alias="zzz"), key("wikidata", "Q1", alias="first named"), key("wikidata", "Q1", alias="qq")])
    pairs = spark.createDataFrame([("p", "rawg", "1", "wikidata", "Q1"), ("gone", "rawg", "2", "wikidata", "Q1")], "pair_id string, source_a string, source_id_a string, source_b string, source_id_b string")
    got = features.pair_features(pairs, r).collect()
    assert [(x.pair_id, x.alias_similarity) for x in got] == [("p", round(difflib.SequenceMatcher(None, "first name", "first named").ratio(), 6))]


FEATURES = "name_similarity double, alias_similarity double, release_year_diff bigint, external_id_exact_match boolean, developer_overlap double, platform_jaccard double"


def test_rule_probability(spark):
    data = [(0.2, None, 6, True, None, None), (0.98, None, 1, False, None, None), (0.5, 0.98, None, False, None, None), (0.2, None, 6, False, None, None), (None, None, 2, False, None, None), (0.8, 0.5, 0, None, 0.5, 0.5), (0.9, 0.9, 5, False, 1.0, None)]
    got = [tuple(x.r) for x in spark.createDataFrame(data, FEATURES).select(rule_probability().alias("r")).collect()]
    assert [p for p, _ in got] == [0.99, 0.97, 0.96, 0.05, 0.05, 0.835, 0.64]
    assert got[5][1] == ["name_similarity", "alias_similarity", "same_release_year", "developer_overlap", "platform_overlap"]


def frame(spark, *changes):
    blank = dict.fromkeys(features.FEATURES)
    pairs, rows_ = [], []
    for i, change in enumerate(changes, 1):
        pair = {"pair_id": f"pair-{i}", "source_a": "rawg", "source_id_a": str(i), "source_b": "wikidata", "source_id_b": f"Q{i}", "candidate_source": "shared_alias", "label_source": None, "label_value": None}
        pairs.append(tuple({**pair, **{k: v for k, v in change.items() if k in pair}}.values()))
        given = {**blank, "external_id_exact_match": False, "description_available_flag": False, "platform_jaccard": 0.1, **{k: v for k, v in change.items() if k in blank}}
        rows_.append((f"pair-{i}", *given.values()))
    kinds = {"release_year_diff": "bigint", "source_count_signal": "bigint", "external_id_exact_match": "boolean", "description_available_flag": "boolean", "description_language_match": "boolean"}
    p = spark.createDataFrame(pairs, "pair_id string, source_a string, source_id_a string, source_b string, source_id_b string, candidate_source string, label_source string, label_value string")
    f = spark.createDataFrame(rows_, "pair_id string, " + ", ".join(f"{c} {kinds.get(c, 'double')}" for c in features.FEATURES))
    return p, f


def test_training_labels(spark):
    p, f = frame(
        spark,
        {"label_value": "1", "name_similarity": 0.95},
        {"name_similarity": 0.2, "release_year_diff": 5, "source_count_signal": 2},
        {"name_similarity": 0.95, "release_year_diff": 12},
        {"name_similarity": 0.3, "release_year_diff": 2},
        {"name_similarity": 0.8},
        {"label_source": "external_id"},
    )
    got = {r.pair_id: (r.label, r.training_label_source, r.synthetic_negative_rule) for r in training.training_frame(p, f).collect()}
    assert got == {
        "pair-1": (1, "weak_positive", None), "pair-2": (0, "synthetic_negative", "different_external_ids"),
        "pair-3": (0, "synthetic_negative", "same_or_similar_name_different_release_year"), "pair-4": (0, "synthetic_negative", "low_name_similarity_different_year"),
        "pair-6": (1, "weak_positive", None),
    }
    capped = training.training_frame(p, f, ratio=1)
    assert rows(capped.where("label = 0"), "pair_id") == [("pair-2",), ("pair-3",)]
    manual = spark.createDataFrame([("pair-1", 0), ("pair-5", 1)], "pair_id string, manual_label int")
    got = {r.pair_id: (r.label, r.training_label_source) for r in training.training_frame(p, f, reviews=manual).collect()}
    assert got["pair-1"] == (0, "manual_review") and got["pair-5"] == (1, "manual_review")


def test_unusable_names_are_dropped(spark):
    df = spark.createDataFrame([(n,) for n in ("Q123", "12", "ab", " Halo ", None, "Q12x")], "n string")
    assert [r[0] for r in df.select(training.usable_name("n")).collect()] == [False, False, False, True, False, True]


def test_metrics_by_hand(spark):
    data = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.3), (1, 0.3), (0, 0.1), (None, 0.5)]
    df = spark.createDataFrame(data, "label int, same_game_probability double")
    m = metrics.binary_metrics(df).first()
    assert (m.true_positive, m.false_positive, m.true_negative, m.false_negative) == (2, 1, 2, 1)
    pairs = [(a, b) for a in (0.9, 0.8, 0.3) for b in (0.8, 0.3, 0.1)]
    assert m.roc_auc == round(sum((a > b) + (a == b) / 2 for a, b in pairs) / 9, 6)
    assert m.pr_auc == round((1 * 1 + 1 * 2 / 3 + 1 * 3 / 5) / 3, 6)
    assert m.brier_score == round((0.01 + 0.64 + 0.04 + 0.09 + 0.49 + 0.01) / 6, 6)


def test_metrics_of_one_class_and_none(spark):
    schema = "label int, same_game_probability double, decision string"
    single = metrics.er_metrics(spark.createDataFrame([(1, 0.9, "auto_merge"), (1, 0.1, "no_merge")], schema)).first()
    assert single.roc_auc is None and single.pr_auc is None and single.warning == "single-class labeled predictions" and single.auto_merge_rate == 0.5
    none = metrics.er_metrics(spark.createDataFrame([], schema)).first()
    assert none.row_count == 0 and none.warning == "no labeled predictions available" and none.auto_merge_rate == 0.0
    by_value = metrics.labelled(spark.createDataFrame([("1",), (None,), ("0",), ("x",)], "label_value string"))
    assert [r.label for r in by_value.collect()] == [1, None, 0, None]


def test_tenths_and_calibration(spark):
    df = spark.createDataFrame([(0.05, 0), (0.55, 1), (1.0, 1)], "x double, label int")
    assert rows(metrics.similarity_histogram(df, "x")) == [("0.0-0.1", 1), ("0.5-0.6", 1), ("1.0", 1)]
    bins = {r.bin: (r.row_count, r.positive_rate) for r in metrics.calibration_bins(df, "x").collect()}
    assert len(bins) == 10 and bins["0.9-1.0"] == (1, 1.0) and bins["0.1-0.2"] == (0, None)


def test_model_learns_and_skips_empty_features(spark):
    changes = [{"name_similarity": 0.9 if i % 2 else 0.1, "release_year_diff": i % 3, "label_value": "1" if i % 2 else None} for i in range(60)]
    p, f = frame(spark, *changes)
    data = p.join(f, "pair_id").withColumn("label", F.coalesce(F.col("label_value").cast("int"), F.lit(0)))
    fitted = model.fit_model(data)
    assert "tag_jaccard" not in fitted.features and fitted.coefficients["name_similarity"] > 1
    out = model.predict(f, fitted)
    scored = {r.pair_id: r.same_game_probability for r in out.collect()}
    assert scored["pair-2"] > 0.5 > scored["pair-1"]
    assert out.first().top_factors[0].feature == "name_similarity"
    alone = model.fit_model(data.where("label = 1"))
    assert model.score(f, alone).first().same_game_probability == 1.0
    assert model.grouped_holdout(data.where("label = 1").withColumn("training_label_source", F.lit("weak_positive"))).first().status == "skipped"


def test_title_space_matches_numpy(spark):
    draw = random.Random(2)
    words = ["dark", "light", "ring", "lord", "war", "star", "craft", "sun", "moon", "king", "age", "of", "the", "two"]
    names = [(f"p{i}", " ".join(draw.choices(words, k=draw.randrange(1, 5))), " ".join(draw.choices(words, k=draw.randrange(1, 5)))) for i in range(60)] + [("none", None, "dark"), ("odd", "!!", "??")]
    pairs = spark.createDataFrame(names, "pair_id string, a string, b string")
    entries = similarity.tfidf_weights(pairs, "a", "b", similarity.word_ngrams).collect()
    docs, terms = sorted({(r.pair_id, r.side) for r in entries}), sorted({r.term for r in entries})
    x = np.zeros((len(docs), len(terms)))
    for r in entries:
        x[docs.index((r.pair_id, r.side)), terms.index(r.term)] = r.w
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rank = 12
    place = x @ np.linalg.svd(x)[2][:rank].T
    got = {r.pair_id: r.cosine for r in decompose.title_svd_cosine(pairs, "a", "b", rank=rank).collect()}
    for pair, *_ in names:
        ends = [(pair, s) for s in "lr"]
        if all(e in docs for e in ends):
            a, b = (place[docs.index(e)] for e in ends)
            assert abs(got[pair] - a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) < 0.02, pair
        else:
            assert got[pair] == 0.0
    assert decompose.title_svd_cosine(pairs.limit(0), "a", "b") is None
    assert decompose.title_svd_cosine(spark.createDataFrame([("p", "one", "one")], "pair_id string, a string, b string"), "a", "b") is None


def test_names_that_cannot_be_near_do_not_meet(spark):
    draw = random.Random(7)
    word = lambda: "the" + "".join(draw.choice(" abc") for _ in range(draw.randrange(0, 14)))
    names = [(s, f"{s[0]}{i}", word()) for s in ("rawg", "wikidata") for i in range(60)]
    rows_ = [(s, i, n, n, 2000, "the", {}, []) for s, i, n in names]
    records = spark.createDataFrame(rows_, "source string, source_id string, name string, name_normalized string, release_year int, first_token string, external_ids map<string,string>, comparison_names array<string>")
    got = {(r.source_id_a, r.source_id_b): r.confidence for r in blocking.candidate_pairs(records, rule="same_release_year_and_similar_name").collect()}
    ratio = lambda a, b: round(difflib.SequenceMatcher(None, a, b).ratio(), 6)
    expected = {(i, j): ratio(a, b) for s, i, a in names for t, j, b in names if (s, t) == ("rawg", "wikidata") and ratio(a, b) >= 0.75}
    assert got == expected and len(expected) > 100


def test_joined_pairs_are_the_first_rules_pairs(spark):
    draw = random.Random(5)
    names = ["ring", "bolt", "gear", "", "дом"]
    entities = [entity(s, f"{s[0]}{i}", draw.choice(names)) for s in ("rawg", "wikidata") for i in range(25)]
    aliases = [key(e["source"], e["source_id"], alias=draw.choice(["ring", "alpha", "beta", "gamma"])) for e in entities for _ in range(3)]
    ids = [key("wikidata", f"w{i}", external_source="rawg", external_id=f"r{draw.randrange(30)}") for i in range(0, 25, 2)]
    r = sample(spark, entities=entities, aliases=aliases, external_ids=ids)
    every = [x for rule in ("external_id_positive", "same_normalized_name", "shared_alias") for x in rows(blocking.candidate_pairs(r, rule=rule), "pair_id", "source_id_a", "source_id_b", "candidate_source")]
    expected = {}
    for pair in every:
        expected.setdefault(pair[0], pair)
    joined = blocking.joined_pairs(r)
    assert rows(joined, "pair_id", "source_id_a", "source_id_b", "candidate_source") == sorted(expected.values(), key=repr)
    assert {p[3] for p in expected.values()} == {"external_id_positive", "same_normalized_name", "shared_alias"} and len(every) > len(expected)
    shown = [f for f in features.FEATURES if not f.endswith("_similarity")]
    full = features.pair_features(joined.select("pair_id", *blocking.PAIR), r)
    assert rows(features.native_features(joined), "pair_id", *shown, "reasons") == rows(full, "pair_id", *shown, "reasons")
    lacks = {x.pair_id: {c for c in ("name_similarity", "alias_similarity") if x[c] is None} for x in full.collect()}
    assert {x.pair_id: set(x.reasons) & {"name_similarity", "alias_similarity"} for x in full.collect()} == lacks and any(lacks.values())


def test_terms_are_made_once_for_each_text(spark):
    pairs = spark.range(400).selectExpr("cast(id as string) pair_id", "concat('name ', id % 2) a", "if(id % 5 = 0, null, concat('name ', id % 3)) b")
    weights = similarity.text_weights(similarity.distinct_texts(pairs, "a", "b")[0], similarity.word_ngrams)
    assert weights.select("t").distinct().count() == 3
    plain = {(r.pair_id, r.side, r.term): r.w for r in similarity.tfidf_weights(pairs, "a", "b", similarity.word_ngrams).collect()}
    given = {(r.t, r.term): r.w for r in weights.collect()}
    texts = {(r.pair_id, s): t for r in pairs.collect() for s, t in (("l", r.a), ("r", r.b))}
    assert plain and all(abs(w - given[texts[p, s], term]) < 1e-12 for (p, s, term), w in plain.items())
    plan = similarity.tfidf_pair_cosine(pairs, "a", "b", similarity.word_ngrams)
    assert plan.count() == 400 and plan.where("cosine = 0").count() == 80

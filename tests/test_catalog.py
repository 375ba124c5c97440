"""Recommendations, ratings, quality, search, explanations and service."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from marlstone.operators import catalog, explain, quality, ratings, recommend, review, search


def features(spark, **entities):
    data = [(k, k.upper(), f, w) for k, fs in entities.items() for f, w in fs.items()]
    return spark.createDataFrame(data, "id string, name string, feature string, weight double")


def test_recommendations_of_equal_entities(spark):
    f = features(spark, a={"genre:x": 3.0}, b={"genre:x": 3.0}, c={"genre:y": 3.0})
    got = rows(recommend.recommendations(f, top_k=1, min_score=0.2), "canonical_id", "recommended_id", "rank", "score")
    assert got == [("a", "b", 1, 1.0), ("b", "a", 1, 1.0)]
    hybrid = recommend.recommendations(f, algorithm="hybrid_content_rating_v1").first()
    assert hybrid.algorithm == "hybrid_content_rating_v1" and hybrid.hybrid_note.startswith("Uses content similarity")


def test_crowded_features_score_but_make_no_candidates(spark):
    f = features(spark, a={"t:all": 1.0, "g:1": 3.0}, b={"t:all": 1.0, "g:1": 3.0}, c={"t:all": 1.0})
    got = recommend.recommendations(f, max_block=2, min_score=0.0).where("canonical_id = 'a'").collect()
    assert [(r.recommended_id, r.score, r.shared_features) for r in got] == [("b", 1.0, ["g:1", "t:all"])]
    assert recommend.recommendations(f.limit(0)).count() == 0


def test_bayesian_ratings(spark):
    assert spark.range(1).select(ratings.normalized_rating(F.lit(4.5), F.lit(5)), ratings.normalized_rating(F.lit(110), F.lit(100)), ratings.normalized_rating(F.lit(-10), F.lit(100))).first()[:] == (90.0, 100.0, 0.0)
    assert spark.range(1).select(ratings.bayesian_average(F.lit(100.0), F.lit(1), F.lit(70.0), 50)).first()[0] == pytest.approx((100 + 3500) / 51)
    data = [("1", "Game One", 2000, "rawg_rating", 4.0, "5", 100), ("1", "Game One", 2000, "igdb_rating", 90.0, "100", 100), ("2", "Game Two", 2001, "rawg_rating", 3.0, "5", 10), ("2", "Game Two", 2001, "rawg_rating", 3.0, "5", None)]
    df = spark.createDataFrame(data, "canonical_id string, canonical_name string, release_year int, rating_type string, rating_value double, rating_scale string, rating_count int")
    first = ratings.ranked_ratings(ratings.bayesian_ratings(df)).collect()
    assert [(r.canonical_name, r.vote_count) for r in first] == [("Game One", 200), ("Game Two", 10)]
    assert first[0].naive_weighted_rating == 85.0 and first[0].rating_types == "igdb_rating, rawg_rating" and first[0].rating_source_count == 2
    assert ratings.bayesian_ratings(df.limit(0)).count() == 0


def test_multi_seed_collects_all_seeds(spark):
    recs = spark.createDataFrame([("a", "x", 0.5), ("b", "x", 0.7), ("a", "b", 0.9)], "canonical_id string, recommended_id string, score double")
    seeds = spark.createDataFrame([("a",), ("b",)], "canonical_id string")
    assert [tuple(r) for r in recommend.merge_seeds(recs, seeds).collect()] == [("x", 0.7, ["a", "b"], 2)]


RECORD = "source string, source_id string, name string, name_normalized string, release_year int, developers array<string>"


def test_anomalies(spark):
    recs = spark.createDataFrame([("rawg", "1", "Foo Edition", "foo", 1960, []), ("rawg", "2", "Foo", "foo", 2000, []), ("igdb", "3", "Bar", None, None, [])], RECORD)
    rated = spark.createDataFrame([("rawg", "1", 4.5, None), ("rawg", "2", 4.5, 4), ("rawg", "2", None, 1)], "source string, source_id string, rating_value double, rating_count int")
    told = spark.createDataFrame([("rawg", "1", " "), ("rawg", "2", "short"), ("rawg", "3", "x" * 50), ("rawg", "4", None)], "source string, source_id string, description_text string")
    pairs = spark.createDataFrame([("wikidata_rawg_external_id",)] * 2, "label_source string")
    got = rows(quality.anomalies(recs, rated, told, pairs), "anomaly_type", "source_id", "detail")
    assert got == sorted([
        ("missing_required_fields", "3", "missing normalized title"), ("suspicious_release_year", "1", "1960"), ("possible_dlc_or_edition_by_title", "1", "Foo Edition"),
        ("duplicate_normalized_names", "1,2", "foo"), ("high_rating_low_votes", "1", "value=4.5, count=0"), ("empty_descriptions", "1", "empty"), ("empty_descriptions", "4", "empty"),
        ("very_short_descriptions", "2", "short"), ("canonical_risk_clusters", "2", "multiple deterministic pairs require canonical review"),
    ], key=repr)
    assert quality.anomalies(recs.limit(0), rated.limit(0), told.limit(0), pairs.limit(0)).count() == 0


def test_validation_and_counts(spark):
    some, none = spark.range(1), spark.range(0)
    assert quality.validate_tables({"a": some, "b": none, "c": None}, {"d": none}) == (["b is empty", "c is missing"], ["d is empty"])
    assert quality.validate_tables({"a": some}, {"d": None}, strict=True) == (["d is missing"], [])


def test_search_queries(spark):
    df = spark.createDataFrame([("Portal 2", "portal-2", ["Portal 2", "Portal Two"]), ("  ", None, None)], "name string, slug string, aliases array<string>")
    got = [[tuple(q) for q in r.q] for r in df.select(search.search_queries("name", "slug", "aliases").alias("q")).collect()]
    assert got == [[("Portal 2", "source_name"), ("Portal Two", "wikidata_alias")], []]


def test_search_candidates_keep_the_least_rank(spark):
    envelope = '{"anchor":{"source":"rawg","source_game_id":"1","release_year":2000},"query":{"text":"t","strategy":"%s","rank":%d},"candidate":{"id":7,"name":"N","first_release_date":946684800}}'
    raw = spark.createDataFrame([(1, "h", envelope % ("source_name", 2)), (2, "h", envelope % ("wikidata_alias", 1)), (3, "h", envelope % ("x", 0)), (4, "h", "{}"), (5, "h", "broken"), (6, "h", None)], "seq int, request_hash string, response_json string")
    got = search.search_candidates(raw).collect()
    assert [(r.search_rank, r.query_strategy, r.igdb_id, r.confidence, r.metadata.candidate_release_year) for r in got] == [(1, "wikidata_alias", "7", 0.99, 2000)]


def test_explanations_and_grounding(spark):
    row = spark.createDataFrame([("p", "A", "rawg", "1", "B", "igdb", "2", "auto_merge", 0.97, "reviewed", True, 0.5, None, None, None, None, None, None, None, False)],
        "pair_id string, name_a string, source_a string, source_id_a string, name_b string, source_b string, source_id_b string, model_decision string, same_game_probability double, review_status string, "
        "review_label boolean, name_similarity double, alias_similarity double, release_year_diff bigint, developer_overlap double, publisher_overlap double, platform_jaccard double, genre_jaccard double, tag_jaccard double, external_id_exact_match boolean")  # fmt: skip
    e = explain.match_explanations(row).first()
    assert e.case_type == "reviewed_positive" and e.subject == "A <> B"
    assert e.grounded_explanation_ru == (
        "Пара `A (rawg:1)` и `B (igdb:2)`: модель считает пару сильным кандидатом на объединение (97.0%). Основание: сходство названий: 50.0%; сходство alias: нет данных; "
        "разница годов выпуска: нет данных; ручная разметка: положительная. Важно: объяснение основано только на рассчитанных признаках, прогнозе модели и ручной разметке, если она есть."
    )
    df = spark.createDataFrame([("text about Halo", ["seed_game=Halo"]), ("nothing here", ["seed_game=Halo"]), ("invented_fact Halo", ["x=Halo"]), ("any", ["a=b"])], "t string, k array<string>")
    assert [r[0] for r in df.select(explain.is_grounded("t", "k")).collect()] == [True, False, False, True]
    spoken = explain.render("t", "k", mode="llm", provider="mock")
    assert df.select(spoken.text).first()[0].startswith("text about Halo Дополнительная")
    assert explain.render("t", "k", mode="llm").provider == "none" and explain.render("t", "k").provider == "template"


def test_catalog_pages_and_names(spark):
    e = spark.createDataFrame([("1", "Halo", 2001), ("2", "Halo 2", 2004), ("3", "100% Orange", 2010)], "canonical_id string, canonical_name string, release_year int")
    links = spark.createDataFrame([("1", "rawg", "a"), ("1", "igdb", "b")], "canonical_id string, source string, source_id string")
    page = catalog.list_entities(e, links, search="halo", limit=1, offset=1).collect()
    assert [(r.canonical_name, r.total_count, r.source_count, r.genres) for r in page] == [("Halo 2", 2, 0, [])]
    assert catalog.list_entities(e, links, search="%").count() == 1  # nothing is a wildcard
    assert [r.canonical_id for r in catalog.find_by_names(e, ["halo", " ", "zzz", "HALO 2"]).collect()] == ["1", "2"]


REVIEW = "pair_id string, review_label boolean, review_status string, selection_strategy string, priority_score double, reviewer string, review_notes string, reviewed_at timestamp"


def test_review_updates(spark):
    r = spark.createDataFrame([("p", None, "pending", None, 0.1, None, "old", None), ("q", None, "pending", None, 0.1, None, None, None)], REVIEW)
    now = F.lit("2026-01-01").cast("timestamp")
    done = review.update_review(r, "p", now=now, label=True, reviewer="me").where("pair_id = 'p'").first()
    assert done.review_label and done.review_status == "reviewed" and done.review_notes == "old" and done.reviewed_at is not None and done.priority_score == 0.1
    back = review.update_review(review.update_review(r, "p", now=now, label=True), "p", now=now, status="pending", confidence=0.9).where("pair_id = 'p'").first()
    assert back.review_label is None and back.reviewed_at is None and back.priority_score == 0.9
    for bad in ({"status": "reviewed"}, {"status": "odd", "label": True}):
        with pytest.raises(ValueError):
            review.update_review(r, "p", now=now, **bad)
    broken = spark.createDataFrame([("x", None, "reviewed", None, None, None, None, None), ("y", None, "odd", None, None, None, None, None)], REVIEW)
    assert review.invalid_reviews(r.unionByName(broken)).count() == 2

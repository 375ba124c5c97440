"""Review queues, selections and explanations over the demo review view."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions.scoring import STRATEGIES, model_edge, reviewed_negative, reviewed_positive, trusted_edge
from marlstone.operators import explain, review, strategies
from marlstone.plans.demo import base, table, tables, with_tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_V = with_tables("view")
_POS, _NEG = "coalesce(review_status = 'reviewed' AND review_label, false)", "coalesce(review_status = 'reviewed' AND NOT review_label, false)"
_TRUST = f"({_POS} OR coalesce(candidate_source = 'external_id' AND label_value = '1' AND NOT {_NEG} AND coalesce(name_similarity, 0) >= 0.9 AND (release_year_diff IS NULL OR release_year_diff <= 2), false))"
_SAFE = f"coalesce(same_game_probability >= 0.9 AND NOT {_NEG} AND coalesce(name_similarity, 0) >= 0.9 AND (release_year_diff IS NULL OR release_year_diff <= 2), false)"


def view(spark, sf_dir):
    return table(spark, sf_dir, "view")


@_query(f"{_V} SELECT pair_id, {_POS} AS positive, {_NEG} AS negative, {_TRUST} AS trusted, same_game_probability >= 0.9 AS model_090, {_SAFE} AS hybrid_safe FROM view")
def c05_edge_predicates(spark, sf_dir):
    by = {s.name: s for s in STRATEGIES}
    return view(spark, sf_dir).select(
        "pair_id", reviewed_positive().alias("positive"), reviewed_negative().alias("negative"), trusted_edge().alias("trusted"),
        model_edge(by["model_auto_090"]).alias("model_090"), model_edge(by["hybrid_safe_090"]).alias("hybrid_safe"),
    )


@_query(f"""{_V}, e AS (SELECT source_a, source_id_a, source_b, source_id_b, bool_or({_TRUST}) AS t, bool_or({_SAFE}) AS m FROM view GROUP BY ALL)
SELECT concat_ws(' <-> ', least(source_a, source_b), greatest(source_a, source_b)) AS source_pair, CASE WHEN t AND m THEN 'trusted_and_model' WHEN t THEN 'trusted' ELSE 'model' END AS edge_origin, count(*) AS edge_count, 'hybrid_safe_090' AS strategy FROM e WHERE t OR m GROUP BY ALL""")
def e12_bridges(spark, sf_dir):
    return strategies.bridge_counts(strategies.strategy_edges(view(spark, sf_dir), STRATEGIES[-1]), STRATEGIES[-1].name)


_STATUS = "CASE review_status WHEN 'pending' THEN 0 WHEN 'unsure' THEN 1 WHEN 'skipped' THEN 2 ELSE 3 END"


@_query(f"""{_V} SELECT pair_id, row_number() OVER (ORDER BY {_STATUS}, priority_score DESC NULLS FIRST, name_similarity ASC NULLS LAST, igdb_search_rank DESC NULLS LAST, pair_id) AS place FROM view WHERE candidate_source = 'igdb_search'""")
def g02_search_queue(spark, sf_dir):
    rows = review.search_queue(view(spark, sf_dir)).select("pair_id", review.status_order().alias("s"), "priority_score", "name_similarity", "igdb_search_rank")
    return rows.selectExpr("pair_id", "row_number() over (order by s, priority_score desc nulls first, name_similarity asc nulls last, igdb_search_rank desc nulls last, pair_id) as place").withColumn("place", F.col("place").cast("bigint"))


@_query(f"""{_V} SELECT pair_id, review_status, name_a IS NULL OR trim(name_a) = '' OR regexp_full_match(trim(name_a), 'Q?[0-9]+') OR name_b IS NULL OR trim(name_b) = '' OR regexp_full_match(trim(name_b), 'Q?[0-9]+') AS invalid_display_name_flag
FROM view WHERE review_status = 'pending' ORDER BY {_STATUS}, priority_score DESC NULLS LAST, name_similarity ASC NULLS LAST, pair_id LIMIT 200""")
def c03_review_export(spark, sf_dir):
    return review.review_export(view(spark, sf_dir), status="pending", limit=200).select("pair_id", "review_status", "invalid_display_name_flag")


@_query(f"""{_V} SELECT pair_id, model_decision AS decision, same_game_probability FROM view ORDER BY CASE WHEN model_decision = 'manual_review' THEN 0 ELSE 1 END, abs(same_game_probability - 0.825), same_game_probability, source_a, source_id_a, source_b, source_id_b LIMIT 300""")
def g01_prioritised_queue(spark, sf_dir):
    rows = view(spark, sf_dir).withColumnRenamed("model_decision", "decision")
    keyed = review.prioritised_queue(rows.withColumn("explanation_reasons", F.col("pair_id"))).limit(300)
    return keyed.select(F.col("explanation_reasons").alias("pair_id"), "decision", "same_game_probability")


@_query(f"""{_V} SELECT pair_id, priority_score FROM view WHERE review_status = 'reviewed' AND model_decision = 'auto_merge' ORDER BY priority_score DESC NULLS LAST, same_game_probability DESC NULLS LAST, pair_id LIMIT 50""")
def g05_review_matches(spark, sf_dir):
    return review.review_matches(view(spark, sf_dir), status="reviewed", decision="auto_merge").select("pair_id", "priority_score")


def _selection_sql(s: review.Selection) -> str:
    order = ", ".join(f"{o} NULLS LAST" for o in s.order)
    return f"SELECT * FROM (SELECT pair_id, '{s.name}' AS selection_strategy, round(({s.priority})::DOUBLE, 6) AS priority_score FROM view WHERE (review_status IS NULL OR review_status = 'pending') AND review_label IS NULL AND ({s.where}) ORDER BY {order}, pair_id LIMIT 100)"


@_query(f"{_V} " + " UNION ALL ".join(map(_selection_sql, review.SELECTIONS)))
def c21_review_selections(spark, sf_dir):
    v = view(spark, sf_dir)
    out = review.select_for_review(v, review.SELECTIONS[0])
    for s in review.SELECTIONS[1:]:
        out = out.unionByName(review.select_for_review(v, s))
    return out


@_query(f"""{_V} SELECT pair_id, CASE WHEN same_game_probability BETWEEN 0.45 AND 0.55 THEN 'high_uncertainty' WHEN same_game_probability >= 0.9 THEN 'high_risk_model_positive' ELSE 'manual_review_priority' END AS active_learning_bucket
FROM view WHERE (review_status IS NULL OR review_status IN ('pending', 'unsure', 'skipped')) AND (same_game_probability BETWEEN 0.45 AND 0.55 OR same_game_probability >= 0.7)
ORDER BY CASE WHEN same_game_probability BETWEEN 0.45 AND 0.55 THEN 0 WHEN same_game_probability >= 0.9 THEN 1 ELSE 2 END, abs(same_game_probability - 0.5), same_game_probability DESC, pair_id LIMIT 250""")
def c20_active_learning(spark, sf_dir):
    return review.active_learning(view(spark, sf_dir)).select("pair_id", "active_learning_bucket")


@_query(f"""{_V} SELECT pair_id, same_game_probability FROM view WHERE {_NEG} AND same_game_probability >= 0.7 ORDER BY same_game_probability DESC, lower(name_a), lower(name_b), pair_id LIMIT 100""")
def c10_likely_wrong_negatives(spark, sf_dir):
    return strategies.likely_wrong_negatives(view(spark, sf_dir)).select("pair_id", "same_game_probability")


@_query(f"{_V} SELECT pair_id, same_game_probability FROM view WHERE same_game_probability >= 0.95")
def c11_merge_candidates(spark, sf_dir):
    return strategies.model_merge_candidates(view(spark, sf_dir)).select("pair_id", "same_game_probability")


@_query(f"""{_V} SELECT * FROM (SELECT 'reviewed_negative_high_model_score' AS case_type, pair_id FROM view WHERE review_status = 'reviewed' AND NOT review_label AND (coalesce(same_game_probability, 0) >= 0.7 OR model_decision = 'auto_merge')
  ORDER BY coalesce(same_game_probability, 0) DESC, lower(name_a), lower(name_b), pair_id LIMIT 100)
UNION ALL SELECT * FROM (SELECT 'unreviewed_likely_positive', pair_id FROM view WHERE coalesce(review_status <> 'reviewed', true) AND name_similarity >= 0.9 AND igdb_search_rank = 1 AND igdb_search_confidence >= 0.85 AND (release_year_diff IS NULL OR release_year_diff <= 1)
  ORDER BY name_similarity DESC, igdb_search_confidence DESC, lower(name_a), pair_id LIMIT 100)""")
def c09_review_cases(spark, sf_dir):
    v = view(spark, sf_dir)
    return review.risky_negatives(v).select("case_type", "pair_id").unionByName(review.likely_positives(v).select("case_type", "pair_id"))


@_query(f"""{_V} SELECT * FROM (SELECT 'successful_merge' AS case_type, name_a AS item_a, name_b AS item_b, same_game_probability AS score FROM view WHERE review_status = 'reviewed' AND review_label ORDER BY same_game_probability DESC, pair_id LIMIT 3)
UNION ALL SELECT * FROM (SELECT 'rejected_risky_match', name_a, name_b, same_game_probability FROM view WHERE review_status = 'reviewed' AND NOT review_label ORDER BY same_game_probability DESC, pair_id LIMIT 3)
UNION ALL SELECT * FROM (SELECT 'active_learning_candidate', name_a, name_b, same_game_probability FROM view WHERE review_status IS NULL OR review_status IN ('pending', 'unsure', 'skipped') ORDER BY abs(coalesce(same_game_probability, 0.5) - 0.5), same_game_probability DESC, pair_id LIMIT 3)""")
def h02_demo_cases(spark, sf_dir):
    return review.demo_cases(view(spark, sf_dir))


@_query(f"""{_V} SELECT coalesce(review_status, 'missing') AS review_status, count(*) AS row_count, count(*) FILTER (WHERE review_label) AS reviewed_positive_count, count(*) FILTER (WHERE NOT review_label) AS reviewed_negative_count,
count(*) FILTER (WHERE review_label IS NULL) AS unlabeled_count, round(count(*) FILTER (WHERE review_label)::DOUBLE / nullif(count(review_label), 0), 6) AS reviewed_precision FROM view GROUP BY 1""")
def e08_label_summary(spark, sf_dir):
    return review.label_summary(view(spark, sf_dir))


_RB = "CASE WHEN igdb_search_rank IS NULL THEN 'unknown' WHEN igdb_search_rank <= 1 THEN '1' WHEN igdb_search_rank <= 3 THEN '2-3' WHEN igdb_search_rank <= 5 THEN '4-5' ELSE '6+' END"


@_query(f"""{_V} SELECT 'igdb_rank_bucket' AS bucket_name, {_RB} AS bucket_value, count(*) FILTER (WHERE review_label) AS reviewed_positive_count, count(*) FILTER (WHERE NOT review_label) AS reviewed_negative_count, count(*) AS reviewed_pair_count,
round(count(*) FILTER (WHERE review_label)::DOUBLE / count(*), 6) AS reviewed_precision FROM view WHERE candidate_source = 'igdb_search' AND review_status = 'reviewed' AND review_label IS NOT NULL GROUP BY ALL""")
def e08_bucket_precision(spark, sf_dir):
    return review.bucket_precision(review.bucketed_reviews(view(spark, sf_dir)), "igdb_rank_bucket")


@_query(f"""{_V} SELECT 'selection_strategy' AS dimension, coalesce(selection_strategy, 'missing') AS key, count(*) AS row_count FROM view GROUP BY 2
UNION ALL SELECT 'candidate_source', candidate_source, count(*) FROM view GROUP BY 2 UNION ALL SELECT 'model_decision', model_decision, count(*) FROM view GROUP BY 2""")
def e03_review_counts(spark, sf_dir):
    return review.count_by(view(spark, sf_dir), "selection_strategy", "candidate_source", "model_decision")


@_query(with_tables("view", "entities") + """, p AS (SELECT * FROM view WHERE source_id_a IN (SELECT source_id FROM entities WHERE source = 'rawg')),
j AS (SELECT p.*, a.name AS na, b.name AS nb FROM p JOIN entities a ON a.source = p.source_a AND a.source_id = p.source_id_a JOIN entities b ON b.source = p.source_b AND b.source_id = p.source_id_b)
SELECT pair_id, na AS entity_a, nb AS entity_b, unnest(list_filter([CASE WHEN label_value = '1' THEN 'deterministic_positive' END, CASE WHEN candidate_source = 'same_normalized_name' AND release_year_diff <> 0 THEN 'same_title_different_year' END,
  CASE WHEN candidate_source = 'same_release_year_and_similar_name' THEN 'similar_title' END, CASE WHEN candidate_source = 'shared_alias' THEN 'alias_overlap' END,
  CASE WHEN coalesce(developer_overlap, 1) = 0 OR coalesce(publisher_overlap, 1) = 0 THEN 'potential_conflict' END], lambda x: x IS NOT NULL)) AS review_category FROM j""")
def j08_review_categories(spark, sf_dir):
    v = view(spark, sf_dir)
    pairs = v.select("pair_id", "source_a", "source_id_a", "source_b", "source_id_b", "candidate_source", "label_source", "label_value")
    rows = v.select("pair_id", "release_year_diff", "developer_overlap", "publisher_overlap")
    out = review.review_categories(pairs, rows, table(spark, sf_dir, "entities"))
    return out.select("pair_id", F.col("name_a").alias("entity_a"), F.col("name_b").alias("entity_b"), "review_category")


@_query(f"""{_V}, one AS (SELECT pair_id FROM view WHERE review_status = 'pending' ORDER BY pair_id LIMIT 1)
SELECT pair_id, CASE WHEN pair_id = (SELECT pair_id FROM one) THEN false ELSE review_label END AS review_label, CASE WHEN pair_id = (SELECT pair_id FROM one) THEN 'reviewed' ELSE review_status END AS review_status,
review_notes, CASE WHEN pair_id = (SELECT pair_id FROM one) THEN 0.25::DOUBLE ELSE priority_score END AS priority_score, CASE WHEN pair_id = (SELECT pair_id FROM one) THEN 'me' END AS reviewer FROM view""")
def b20_review_update(spark, sf_dir):
    v = view(spark, sf_dir)
    one = v.where("review_status = 'pending'").agg(F.min("pair_id")).first()[0]
    rows = v.select("pair_id", "review_label", "review_status", "review_notes", "priority_score", F.lit(None).cast("string").alias("reviewer"), F.lit(None).cast("timestamp").alias("reviewed_at"))
    return review.update_review(rows, one, now=F.current_timestamp(), label=False, reviewer="me", confidence=0.25).drop("reviewed_at")


# --- explanations ----------------------------------------------------------------------------------

_CASE = "CASE WHEN review_status = 'reviewed' AND review_label THEN 'reviewed_positive' WHEN review_status = 'reviewed' AND NOT review_label THEN 'reviewed_negative' WHEN model_decision = 'auto_merge' THEN 'model_auto_merge' WHEN same_game_probability BETWEEN 0.45 AND 0.55 THEN 'high_uncertainty' WHEN model_decision = 'manual_review' THEN 'model_manual_review' ELSE 'other' END"
_LEAD = "CASE WHEN review_status = 'reviewed' AND review_label THEN 0 WHEN review_status = 'reviewed' AND NOT review_label THEN 1 WHEN model_decision = 'auto_merge' THEN 2 WHEN model_decision = 'manual_review' THEN 3 ELSE 4 END"
_ORDER = f"{_LEAD}, abs(coalesce(same_game_probability, 0.5) - 0.5), same_game_probability DESC NULLS LAST, pair_id"
_MATCHES = f"""{_V}, m AS (SELECT *, {_CASE} AS explanation_case_type FROM view WHERE same_game_probability IS NOT NULL AND NOT regexp_full_match(name_a, 'Q[0-9]+') AND NOT regexp_full_match(name_b, 'Q[0-9]+') ORDER BY {_ORDER} LIMIT 20000),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY explanation_case_type ORDER BY {_ORDER}) AS n FROM m) WHERE n <= 6
  ORDER BY list_position(['reviewed_positive', 'reviewed_negative', 'model_auto_merge', 'model_manual_review', 'high_uncertainty', 'other'], explanation_case_type), n LIMIT 30)"""


@_query(f"{_MATCHES} SELECT pair_id, explanation_case_type FROM b")
def f06_balanced_matches(spark, sf_dir):
    return explain.balanced_matches(explain.explainable(view(spark, sf_dir), 30), 30).select("pair_id", "explanation_case_type")


def _pct(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'нет данных' ELSE printf('%.1f%%', {c} * 100) END"


_POINTS = f"""array_to_string(list_filter(['сходство названий: ' || {_pct('name_similarity')}, 'сходство alias: ' || {_pct('alias_similarity')}, 'разница годов выпуска: ' || coalesce(release_year_diff::VARCHAR, 'нет данных'),
  'пересечение разработчиков: ' || CASE WHEN developer_overlap IS NOT NULL THEN {_pct('developer_overlap')} END, 'пересечение издателей: ' || CASE WHEN publisher_overlap IS NOT NULL THEN {_pct('publisher_overlap')} END,
  'пересечение платформ: ' || CASE WHEN platform_jaccard IS NOT NULL THEN {_pct('platform_jaccard')} END, 'пересечение жанров: ' || CASE WHEN genre_jaccard IS NOT NULL THEN {_pct('genre_jaccard')} END,
  'пересечение тегов: ' || CASE WHEN tag_jaccard IS NOT NULL THEN {_pct('tag_jaccard')} END, CASE WHEN external_id_exact_match THEN 'есть точное совпадение внешнего ID' END,
  CASE WHEN review_status = 'reviewed' THEN CASE WHEN review_label THEN 'ручная разметка: положительная' ELSE 'ручная разметка: отрицательная' END END], lambda x: x IS NOT NULL)[1:7], '; ')"""


@_query(f"""{_MATCHES} SELECT pair_id, explanation_case_type AS case_type, name_a || ' <> ' || name_b AS subject, 'Пара `' || name_a || ' (' || source_a || ':' || source_id_a || ')` и `' || name_b || ' (' || source_b || ':' || source_id_b || ')`: ' ||
CASE model_decision WHEN 'auto_merge' THEN 'модель считает пару сильным кандидатом на объединение (' WHEN 'manual_review' THEN 'модель отправляет пару на ручную проверку (' ELSE 'модель считает пару кандидатом на отказ от объединения (' END || {_pct('same_game_probability')} || ').' ||
' Основание: ' || {_POINTS} || '. Важно: объяснение основано только на рассчитанных признаках, прогнозе модели и ручной разметке, если она есть.' AS grounded_explanation_ru FROM b""")
def i32_match_explanations(spark, sf_dir):
    rows = explain.balanced_matches(explain.explainable(view(spark, sf_dir), 30), 30)
    return explain.match_explanations(rows).select("pair_id", "case_type", "subject", "grounded_explanation_ru")


@_query("""SELECT p_partkey, CASE lower(p_type) WHEN 'small' THEN 'жанр' WHEN 'large' THEN 'десятилетие' ELSE 'other' END || ': ' || lower(p_name) AS readable, 'seed_game=' || p_name || ';rank=' || p_size::VARCHAR AS facts FROM part""")
def i34_facts_and_labels(spark, sf_dir):
    p = base(spark, sf_dir, "part")
    kind = F.when(F.lower("p_type") == "small", "genre").when(F.lower("p_type") == "large", "decade").otherwise("other")
    rows = p.withColumns({"f": F.concat_ws(":", kind, F.lower("p_name")), "nothing": F.lit("")})
    return rows.select("p_partkey", explain.readable_feature("f").alias("readable"), F.array_join(explain.facts(seed_game="p_name", recommended_game="nothing", rank="p_size"), ";").alias("facts"))


@_query("""SELECT p_partkey, NOT contains(lower(p_name), 'unknown_source') AND (length(w) = 0 OR len(list_filter(string_split(w, ' '), lambda t: length(t) >= 4 AND contains(lower(p_name), lower(t)))) > 0 OR len(list_filter(string_split(w, ' '), lambda t: length(t) >= 4)) = 0) AS grounded
FROM (SELECT *, 'name ' || CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type END AS w FROM part)""")
def i33_grounded(spark, sf_dir):
    fact = F.concat(F.lit("name="), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.col("p_type")))
    return base(spark, sf_dir, "part").withColumn("k", F.array(fact)).select("p_partkey", explain.is_grounded("p_name", "k").alias("grounded"))


_CARDS = with_tables("canonical", "links", "descriptions")


@_query(f"""{_CARDS} SELECT c.canonical_id, canonical_name, release_year, count(DISTINCT l.source) AS source_count, string_agg(DISTINCT l.source, ', ' ORDER BY l.source) AS sources, count(DISTINCT d.source_id) FILTER (WHERE d.description_text IS NOT NULL) AS description_source_count
FROM canonical c JOIN links l ON l.canonical_id = c.canonical_id LEFT JOIN descriptions d ON d.source = l.source AND d.source_id = l.source_id WHERE NOT regexp_full_match(canonical_name, 'Q[0-9]+')
GROUP BY ALL ORDER BY source_count DESC, description_source_count DESC, canonical_name, c.canonical_id LIMIT 50""")
def e25_fact_cards(spark, sf_dir):
    t = tables(spark, sf_dir, "canonical", "links", "descriptions")
    return explain.fact_cards(t["canonical"], t["links"], t["descriptions"])


@_query(with_tables("view", "entities", "urls") + """, u AS (SELECT source_id, url FROM urls WHERE source = 'rawg' AND url_type IN ('rawg', 'website', 'background_image') QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY CASE WHEN url_type = 'rawg' THEN 0 ELSE 1 END, url_type, url) = 1)
SELECT v.pair_id, a.name AS name_a, a.release_year AS release_year_a, b.name AS name_b, CASE WHEN a.slug IS NOT NULL THEN 'https://rawg.io/games/' || a.slug ELSE u.url END AS rawg_url, v.igdb_search_rank,
v.name_similarity, 'v2' AS model_version, v.same_game_probability, v.model_decision, v.review_status, v.review_label, v.priority_score
FROM view v LEFT JOIN entities a ON a.source = v.source_a AND a.source_id = v.source_id_a LEFT JOIN entities b ON b.source = v.source_b AND b.source_id = v.source_id_b LEFT JOIN u ON u.source_id = v.source_id_a""")
def d03_review_view(spark, sf_dir):
    """The review view from its seven tables: two predictions a pair, the later one counts."""
    v = view(spark, sf_dir)
    t = tables(spark, sf_dir, "entities", "urls")
    pairs = v.select("pair_id", "source_a", "source_id_a", "source_b", "source_id_b", "candidate_source", "label_source", "label_value", F.lit(0.5).alias("confidence"))
    features = v.select("pair_id", "name_similarity", "alias_similarity", "release_year_diff", "external_id_exact_match", F.lit(None).cast("map<string,string>").alias("reasons"), F.lit("{}").alias("features_json"))
    scored = v.select("pair_id", F.lit("m").alias("model_name"), F.explode(F.array(F.lit("v1"), F.lit("v2"))).alias("model_version"), "same_game_probability", F.col("model_decision").alias("decision"))
    late = F.col("model_version") == "v2"
    predictions = scored.withColumns({"predicted_at": F.timestamp_seconds(F.when(late, 2).otherwise(1)), "same_game_probability": F.when(late, F.col("same_game_probability")).otherwise(0.0)})
    searches = v.where("igdb_search_rank is not null").groupBy(F.col("source_a").alias("source_name"), F.col("source_id_a").alias("source_game_id"), F.col("source_id_b").alias("igdb_id"), "pair_id").agg(
        F.min("igdb_search_rank").alias("search_rank"), F.lit("q").alias("query_text"), F.lit("s").alias("query_strategy"), F.lit(0.5).alias("confidence")
    )
    # Search evidence is keyed by the two entities: here every pair has its own candidate id.
    own = v.select("pair_id", F.col("pair_id").alias("mark"), "source_id_b")
    pairs = pairs.join(own.select("pair_id", "mark"), "pair_id").withColumns({"keep": F.col("source_id_b"), "source_id_b": F.col("mark")}).drop("mark")
    searches = searches.withColumn("igdb_id", F.col("pair_id")).drop("pair_id")
    named = t["entities"].join(v.select(F.col("source_b").alias("source"), F.col("source_id_b").alias("source_id"), "pair_id").distinct(), ["source", "source_id"]).withColumn("source_id", F.col("pair_id")).drop("pair_id")
    reviews = v.select("pair_id", "review_label", "review_status", "selection_strategy", "priority_score", F.lit("r").alias("reviewer"), "review_notes", F.lit(None).cast("timestamp").alias("reviewed_at"))
    out = review.review_view(pairs, features, predictions, t["entities"].where("source = 'rawg'").unionByName(named), searches, t["urls"], reviews)
    return out.select("pair_id", "name_a", "release_year_a", "name_b", "rawg_url", "igdb_search_rank", "name_similarity", "model_version", "same_game_probability", "model_decision", "review_status", "review_label", "priority_score")


@_query(f"""{_V} SELECT pair_id, {_CASE} AS case_type FROM view WHERE same_game_probability IS NOT NULL AND NOT regexp_full_match(name_a, 'Q[0-9]+') AND NOT regexp_full_match(name_b, 'Q[0-9]+') ORDER BY {_ORDER} LIMIT 20000""")
def g06_explainable_matches(spark, sf_dir):
    return explain.explainable(view(spark, sf_dir), 10).select("pair_id", explain.case_type().alias("case_type"))

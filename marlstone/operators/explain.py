"""Explanations from computed facts only; the texts are Russian as their readers are."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from marlstone.functions.text import Text, as_column, percent_text
from marlstone.operators.rank import first_per_key

# Order of case types, and labels of feature types.
CASES = ("reviewed_positive", "reviewed_negative", "model_auto_merge", "model_manual_review", "high_uncertainty", "other")
FEATURE_LABELS = {"genre": "жанр", "tag": "тег", "platform": "платформа", "developer": "разработчик", "publisher": "издатель", "decade": "десятилетие"}
FORBIDDEN = ("unknown_source", "invented_fact", "неизвестный источник")


def case_type() -> Column:
    """kind of a match: review first, then decision and uncertainty."""
    reviewed = F.col("review_status") == "reviewed"
    p = F.col("same_game_probability")
    return (
        F.when(reviewed & F.col("review_label"), CASES[0])
        .when(reviewed & ~F.col("review_label"), CASES[1])
        .when(F.col("model_decision") == "auto_merge", CASES[2])
        .when(p.between(0.45, 0.55), CASES[4])
        .when(F.col("model_decision") == "manual_review", CASES[3])
        .otherwise(CASES[5])
    )


def match_order() -> list[Column]:
    """Reviewed first, then by decision, distance from .5, probability and id."""
    reviewed = F.col("review_status") == "reviewed"
    lead = (
        F.when(reviewed & F.col("review_label"), 0).when(reviewed & ~F.col("review_label"), 1)
        .when(F.col("model_decision") == "auto_merge", 2).when(F.col("model_decision") == "manual_review", 3).otherwise(4)
    )
    return [lead, F.abs(F.coalesce("same_game_probability", F.lit(0.5)) - 0.5), F.desc_nulls_last("same_game_probability"), F.col("pair_id")]


def explainable(view: DataFrame, limit: int) -> DataFrame:
    """Scored pairs of named entities, the first max(500 * limit, 20000) in match order."""
    plain = lambda c: F.col(c).isNotNull() & ~F.col(c).rlike("^Q[0-9]+$")
    rows = view.where(F.col("same_game_probability").isNotNull() & plain("name_a") & plain("name_b"))
    return rows.orderBy(*match_order()).limit(max(limit * 500, 20_000))


def balanced_matches(rows: DataFrame, limit: int) -> DataFrame:
    """up to ``limit`` matches, an equal share of each case type in its order, at least one each."""
    share = max(1, limit // (len(CASES) - 1))
    kept = rows.withColumn("explanation_case_type", case_type())
    place = F.lit(len(CASES))
    for k, c in reversed(list(enumerate(CASES))):
        place = F.when(F.col("explanation_case_type") == c, k).otherwise(place)
    ranked = kept.withColumn("__n", F.row_number().over(Window.partitionBy("explanation_case_type").orderBy(*match_order()))).where(F.col("__n") <= share)
    return ranked.orderBy(place, "__n").limit(limit).drop("__n")


def readable_feature(feature: Text) -> Column:
    """``genre:action`` as ``жанр: action``; text without a colon stays."""
    f = as_column(feature)
    kind, value = F.substring_index(f, ":", 1), F.regexp_replace(f, "^[^:]*:", "")
    labels = F.create_map(*[x for kv in FEATURE_LABELS.items() for x in map(F.lit, kv)])
    return F.when(F.contains(f, F.lit(":")), F.concat(F.coalesce(F.try_element_at(labels, kind), kind), F.lit(": "), value)).otherwise(f)


def decision_text() -> Column:
    """What the model says of a pair."""
    p = percent_text("same_game_probability")
    d = F.col("model_decision")
    return (
        F.when(d == "auto_merge", F.concat(F.lit("модель считает пару сильным кандидатом на объединение ("), p, F.lit(").")))
        .when(d == "manual_review", F.concat(F.lit("модель отправляет пару на ручную проверку ("), p, F.lit(").")))
        .when(d == "no_merge", F.concat(F.lit("модель считает пару кандидатом на отказ от объединения ("), p, F.lit(").")))
        .otherwise(F.concat(F.lit("решение модели не задано, вероятность совпадения "), p, F.lit(".")))
    )


def match_points() -> Column:
    """Evidence points of a pair, in order."""
    said = lambda label, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{label}: "), percent_text(c)))
    points = F.array(
        F.concat(F.lit("сходство названий: "), percent_text("name_similarity")),
        F.concat(F.lit("сходство alias: "), percent_text("alias_similarity")),
        F.concat(F.lit("разница годов выпуска: "), F.coalesce(F.col("release_year_diff").cast("string"), F.lit("нет данных"))),
        said("пересечение разработчиков", "developer_overlap"),
        said("пересечение издателей", "publisher_overlap"),
        said("пересечение платформ", "platform_jaccard"),
        said("пересечение жанров", "genre_jaccard"),
        said("пересечение тегов", "tag_jaccard"),
        F.when(F.col("external_id_exact_match"), F.lit("есть точное совпадение внешнего ID")),
        F.when(
            F.col("review_status") == "reviewed",
            F.when(F.col("review_label"), "ручная разметка: положительная").otherwise("ручная разметка: отрицательная"),
        ),
    )
    return F.filter(points, lambda x: x.isNotNull())


def match_explanations(rows: DataFrame) -> DataFrame:
    """I32: explanation rows of matches; at most seven points each."""
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    side = lambda s: F.concat(none(f"name_{s}"), F.lit(" ("), none(f"source_{s}"), F.lit(":"), none(f"source_id_{s}"), F.lit(")"))
    text = F.concat(
        F.lit("Пара `"), side("a"), F.lit("` и `"), side("b"), F.lit("`: "), decision_text(), F.lit(" Основание: "),
        F.array_join(F.slice(match_points(), 1, 7), "; "),
        F.lit(". Важно: объяснение основано только на рассчитанных признаках, прогнозе модели и ручной разметке, если она есть."),
    )
    kind = F.col("explanation_case_type") if "explanation_case_type" in rows.columns else case_type()
    return rows.select(
        F.lit("match").alias("explanation_type"), kind.alias("case_type"), "pair_id",
        F.concat(none("name_a"), F.lit(" <> "), none("name_b")).alias("subject"),
        "model_decision", "same_game_probability", "review_status", "review_label", text.alias("grounded_explanation_ru"),
    )


def recommendation_points() -> Column:
    """Evidence points of a recommendation: six shared features, years, score."""
    shared = F.transform(F.slice("shared_features", 1, 6), lambda f: F.concat(F.lit("общий признак `"), readable_feature(f), F.lit("`")))
    years = F.when(
        F.col("seed_release_year").isNotNull() & F.col("recommended_release_year").isNotNull(),
        F.concat(F.lit("годы выпуска: "), F.col("seed_release_year").cast("string"), F.lit(" и "), F.col("recommended_release_year").cast("string")),
    )
    return F.filter(F.concat(shared, F.array(years, F.concat(F.lit("content score: "), percent_text("score")))), lambda x: x.isNotNull())


def recommendation_explanations(rows: DataFrame) -> DataFrame:
    """I32: explanation rows of named recommendations."""
    text = F.concat(
        F.lit("Для игры `"), F.coalesce("seed_game", F.lit("unknown seed")), F.lit("` рекомендация `"),
        F.coalesce("recommended_game", F.lit("unknown recommendation")), F.lit("` объясняется совпадением контента. Основание: "),
        F.array_join(recommendation_points(), "; "),
        F.lit(". Это content-based объяснение без user interactions и без LLM-решений."),
    )
    return rows.select(F.lit("recommendation").alias("explanation_type"), "seed_game", "recommended_game", "rank", "score", "algorithm", text.alias("grounded_explanation_ru"))


def recommendation_text() -> Column:
    """I32: the served text of one recommendation."""
    features = F.array_join(F.slice("shared_features", 1, 8), "; ")
    basis = F.when(features != "", F.concat(F.lit("Основание: общие признаки: "), features, F.lit("."))).otherwise(F.lit("Основание: рассчитанные content-based признаки рекомендации."))
    return F.concat(
        F.lit("Для игры `"), "seed_game", F.lit("` рекомендация `"), "recommended_game", F.lit("` построена по content-based similarity. "), basis,
        F.lit(" Итоговый score: "), percent_text("score"),
        F.lit(". Это объяснение использует только canonical facts и заранее рассчитанные recommendation factors."),
    )


def facts(**columns: str) -> Column:
    """``key=value`` of the columns that are neither null nor blank."""
    said = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{k}="), F.col(c).cast("string"))) for k, c in columns.items()]
    return F.filter(F.array(*said), lambda x: x.isNotNull())


def recommendation_facts() -> Column:
    return facts(seed_game="seed_game", recommended_game="recommended_game", content_score="score", rank="rank")


def match_facts() -> Column:
    return facts(subject="subject", same_game_probability="same_game_probability", model_decision="model_decision", review_label="review_label")


def is_grounded(output: Text, known: Text) -> Column:
    """No forbidden marker, and one fact word of four letters or more stands in the text."""
    low = F.lower(as_column(output))
    bad = F.lit(False)
    for marker in FORBIDDEN:
        bad = bad | F.contains(low, F.lit(marker))
    words = F.flatten(F.transform(as_column(known), lambda f: F.split(F.regexp_replace(f, "[=:]", " "), r"(?U)\s+")))
    words = F.filter(F.transform(words, F.lower), lambda w: F.length(w) >= 4)
    return ~bad & ((F.size(words) == 0) | F.exists(words, lambda w: F.contains(low, w)))


@dataclass(frozen=True)
class Rendering:
    text: Column
    provider: str
    warning: Column


def render(template: Text, known: Text, *, mode: str = "template", provider: str = "none") -> Rendering:
    """The template, or the mock rendering of it when that is asked for and grounded."""
    text = as_column(template)
    if mode != "llm":
        return Rendering(text, "template", F.lit(None).cast("string"))
    if provider == "none":
        return Rendering(text, "none", F.lit("LLM rendering is disabled; returned template grounded explanation."))
    if provider != "mock":
        return Rendering(text, provider, F.lit("External LLM rendering is not configured in this local demo; returned template grounded explanation."))
    told = F.when(F.size(as_column(known)) > 0, F.array_join(F.slice(as_column(known), 1, 6), "; ")).otherwise(F.lit("нет дополнительных фактов"))
    spoken = F.concat(text, F.lit(" Дополнительная LLM-формулировка основана только на фактах: "), told, F.lit("."))
    good = is_grounded(spoken, known)
    warning = F.when(~good, F.lit("LLM rendering failed groundedness verification; returned template explanation."))
    return Rendering(F.when(good, spoken).otherwise(text), "mock", warning)


def fact_cards(entities: DataFrame, links: DataFrame, descriptions: DataFrame, limit: int = 50) -> DataFrame:
    """Sources of named entities, and how many of them have a description."""
    told = descriptions.where("description_text is not null").select("source", "source_id").distinct().withColumn("told", F.lit(True))
    rows = entities.where(~F.col("canonical_name").rlike("^Q[0-9]+$")).join(links, "canonical_id").join(told, ["source", "source_id"], "left")
    cards = rows.groupBy("canonical_id", "canonical_name", "release_year").agg(
        F.count_distinct("source").alias("source_count"),
        F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("sources"),
        F.count_distinct(F.when(F.col("told"), F.col("source_id"))).alias("description_source_count"),
    )
    return cards.orderBy(F.desc("source_count"), F.desc("description_source_count"), "canonical_name", "canonical_id").limit(limit)


def latest_explanation(explanations: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One explanation for each key."""
    return first_per_key(explanations, keys, order)

"""Labelled training rows from pairs, features, context and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marlstone.functions.scoring import decision, rule_probability
from marlstone.functions.text import Text, as_column
from marlstone.operators.features import FEATURES
from marlstone.operators.rank import cap_rows, first_per_key
from marlstone.plans.scratch import Scratch

# Label rules.
POSITIVE_LABEL_SOURCES = ("external_id", "wikidata_rawg_external_id")
MAX_NEGATIVE_RATIO = 3
MIN_FEATURES = 3


def usable_name(name: Text) -> Column:
    """At least three characters, neither a hub id nor a number."""
    text = F.trim(as_column(name))
    return F.coalesce((F.length(text) > 2) & ~text.rlike("^Q[0-9]+$") & ~text.rlike("^[0-9]+$"), F.lit(False))


def with_context(frame: DataFrame, entities: DataFrame) -> DataFrame:
    """Names and years of both sides, joined only when they are not there yet."""
    for side in ("a", "b"):
        if f"name_{side}" not in frame.columns:
            context = entities.select(
                F.col("source").alias(f"source_{side}"),
                F.col("source_id").alias(f"source_id_{side}"),
                F.col("name").alias(f"name_{side}"),
                F.col("release_year").alias(f"release_year_{side}"),
            )
            frame = frame.join(context, [f"source_{side}", f"source_id_{side}"], "left")
    return frame


def training_frame(
    pairs: DataFrame,
    features: DataFrame,
    entities: DataFrame | None = None,
    reviews: DataFrame | None = None,
    *,
    ratio: int = MAX_NEGATIVE_RATIO,
) -> DataFrame:
    """Rows labelled by review, else weak positive, else synthetic negative.

    ``reviews`` has (pair_id, manual_label).  Negatives are capped at ``ratio``
    times the positives in order of pair_id; without positives, or with a cap
    of 0, all stay.  Rows need three non-null features.
    """
    rows = pairs.join(features, "pair_id")
    if entities is not None:
        rows = with_context(rows, entities).where(usable_name("name_a") & usable_name("name_b"))
    if reviews is not None:
        manual = first_per_key(reviews.select("pair_id", "manual_label"), ["pair_id"], ["manual_label"])
        rows = rows.join(manual, "pair_id", "left")
    else:
        rows = rows.withColumn("manual_label", F.lit(None).cast("int"))
    exact = F.coalesce("external_id_exact_match", F.lit(False))
    positive = F.coalesce(F.col("label_value") == "1", F.lit(False)) | F.coalesce(F.col("label_source").isin(*POSITIVE_LABEL_SOURCES), F.lit(False)) | exact
    name, years, signal = F.coalesce("name_similarity", F.lit(0.0)), F.coalesce("release_year_diff", F.lit(0)), F.coalesce("source_count_signal", F.lit(0))
    rule = (
        F.when((name >= 0.9) & (years >= 10) & ~exact, F.lit("same_or_similar_name_different_release_year"))
        .when(~exact & (signal >= 2) & (name <= 0.6) & (years >= 2), F.lit("different_external_ids"))
        .when((name < 0.35) & (years >= 2), F.lit("low_name_similarity_different_year"))
    )
    rows = rows.withColumn("given", F.when(F.col("manual_label").isNotNull(), F.col("manual_label")).when(positive, 1))
    rows = rows.withColumn("synthetic_negative_rule", F.when(F.col("given").isNull(), rule))
    rows = rows.withColumns(
        {
            "label": F.when(F.col("synthetic_negative_rule").isNotNull(), 0).otherwise(F.col("given")),
            "training_label_source": F.when(F.col("synthetic_negative_rule").isNotNull(), F.lit("synthetic_negative"))
            .when(F.col("manual_label").isNotNull(), F.lit("manual_review"))
            .when(F.col("given").isNotNull(), F.lit("weak_positive")),
        }
    ).drop("given")
    # Written once: the count and both parts below read it.
    rows = Scratch(pairs.sparkSession, "training").table(rows.where("label in (0, 1)"), "rows")
    positives, negatives = rows.where("label = 1"), rows.where("label = 0")
    cap = ratio * positives.count()
    rows = positives.unionByName(cap_rows(negatives, ["pair_id"], cap or None))  # H03
    available = sum((F.col(c).isNotNull().cast("int") for c in FEATURES), F.lit(0))
    return rows.withColumn("available_feature_count", available).where(F.col("available_feature_count") >= MIN_FEATURES)


def training_stats(frame: DataFrame) -> DataFrame:
    """(metric, key, value) of a training frame: rows, rates, labels and label sources."""
    one = frame.agg(
        F.count("*").cast("double").alias("row_count"),
        F.round(F.avg(F.col("label").cast("double")), 6).alias("positive_rate"),
        F.min("available_feature_count").cast("double").alias("min_available_features"),
        F.round(F.avg("available_feature_count"), 6).alias("avg_available_features"),
        F.max("available_feature_count").cast("double").alias("max_available_features"),
    )
    wide = one.select(F.explode(F.create_map(*[x for c in one.columns for x in (F.lit(c), F.col(c))])).alias("metric", "value")).select(
        "metric", F.lit("").alias("key"), "value"
    )
    counts = lambda name, col: frame.groupBy(F.col(col).cast("string").alias("key")).agg(F.count("*").cast("double").alias("value")).select(F.lit(name).alias("metric"), "key", "value")
    return wide.unionByName(counts("label_count", "label")).unionByName(counts("label_source_count", "training_label_source"))


def rule_predictions(frame: DataFrame) -> DataFrame:
    """Rule probability, decision and reasons of feature rows."""
    scored = frame.withColumn("__rule", rule_probability())
    return scored.select(
        *frame.columns,
        F.lit("rule_baseline").alias("model_name"),
        F.lit("v1").alias("model_version"),
        F.col("__rule.probability").alias("same_game_probability"),
        decision("__rule.probability").alias("decision"),
        F.col("__rule.reasons").alias("explanation_reasons"),
    )

"""The review view, queues, selection strategies and updates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from marlstone.functions.scoring import confidence_bucket, rank_bucket, safe_ratio
from marlstone.operators.rank import first_per_key
from marlstone.operators.training import with_context


def latest_predictions(predictions: DataFrame) -> DataFrame:
    """the latest prediction of each pair; equal times by model and version."""
    return first_per_key(predictions, ["pair_id"], [F.desc("predicted_at"), F.desc("model_name"), F.desc("model_version")])


def best_urls(urls: DataFrame, source: str, preferred: str, others: tuple[str, ...], name: str) -> DataFrame:
    """one URL for each entity of a source, the preferred type first."""
    rows = urls.where((F.col("source") == source) & F.col("url_type").isin(preferred, *others))
    best = first_per_key(rows, ["source", "source_id"], [F.when(F.col("url_type") == preferred, 0).otherwise(1), "url_type", "url"])
    return best.select("source", "source_id", F.col("url").alias(name))


def review_view(
    pairs: DataFrame,
    features: DataFrame,
    predictions: DataFrame,
    entities: DataFrame,
    searches: DataFrame,
    urls: DataFrame,
    reviews: DataFrame,
) -> DataFrame:
    """Every pair with features, latest prediction, both sides, search evidence, URLs and review."""
    rows = pairs.withColumnRenamed("confidence", "candidate_confidence").join(features.drop("reasons", "features_json"), "pair_id")
    latest = latest_predictions(predictions).select("pair_id", "model_name", "model_version", "same_game_probability", F.col("decision").alias("model_decision"))
    rows = rows.join(latest, "pair_id", "left")
    for s in ("a", "b"):
        side = entities.select(
            F.col("source").alias(f"source_{s}"), F.col("source_id").alias(f"source_id_{s}"), F.col("name").alias(f"name_{s}"),
            F.col("release_year").alias(f"release_year_{s}"), F.col("slug").alias(f"slug_{s}"),
        )
        rows = rows.join(side, [f"source_{s}", f"source_id_{s}"], "left")
    search = searches.select(
        F.col("source_name").alias("source_a"), F.col("source_game_id").alias("source_id_a"), F.col("igdb_id").alias("source_id_b"),
        F.col("search_rank").alias("igdb_search_rank"), F.col("query_text").alias("igdb_query_text"),
        F.col("query_strategy").alias("igdb_query_strategy"), F.col("confidence").alias("igdb_search_confidence"),
    )
    rows = rows.join(search, ["source_a", "source_id_a", "source_id_b"], "left")
    left = best_urls(urls, "rawg", "rawg", ("website", "background_image"), "found_a").withColumnsRenamed({"source": "source_a", "source_id": "source_id_a"})
    right = best_urls(urls, "igdb", "igdb", ("website",), "found_b").withColumnsRenamed({"source": "source_b", "source_id": "source_id_b"})
    rows = rows.join(left, ["source_a", "source_id_a"], "left").join(right, ["source_b", "source_id_b"], "left")
    own = lambda s, source, base, found: F.when((F.col(f"source_{s}") == source) & F.col(f"slug_{s}").isNotNull(), F.concat(F.lit(base), f"slug_{s}")).otherwise(F.col(found))
    rows = rows.withColumns(
        {"rawg_url": own("a", "rawg", "https://rawg.io/games/", "found_a"), "igdb_url": own("b", "igdb", "https://www.igdb.com/games/", "found_b")}
    ).drop("found_a", "found_b")
    return rows.join(
        reviews.select("pair_id", "review_label", "review_status", "selection_strategy", "priority_score", "reviewer", "review_notes", "reviewed_at"), "pair_id", "left"
    )


def status_order() -> Column:
    s = F.col("review_status")
    return F.when(s == "pending", 0).when(s == "unsure", 1).when(s == "skipped", 2).otherwise(3)


def search_queue(view: DataFrame) -> DataFrame:
    """Pairs of the search lane in the order of work."""
    return view.where("candidate_source = 'igdb_search'").orderBy(
        status_order(), F.desc_nulls_first("priority_score"), F.asc_nulls_last("name_similarity"), F.desc_nulls_last("igdb_search_rank"), "pair_id"
    )


def bucketed_reviews(view: DataFrame) -> DataFrame:
    """Search-lane pairs with rank and confidence buckets."""
    rows = view.where("candidate_source = 'igdb_search'")
    return rows.withColumns(
        {"igdb_rank_bucket": rank_bucket("igdb_search_rank"), "igdb_confidence_bucket": confidence_bucket("igdb_search_confidence")}
    )


def review_export(view: DataFrame, *, status: str | None = None, limit: int | None = None) -> DataFrame:
    """Queue rows of a status, with a flag for names that are hub ids or numbers."""
    rows = view if status in (None, "all") else view.where(F.col("review_status") == status)
    odd = lambda c: F.col(c).isNull() | F.trim(c).rlike("^(Q[0-9]+|[0-9]+)$") | (F.trim(c) == "")
    rows = rows.withColumn("invalid_display_name_flag", odd("name_a") | odd("name_b")).orderBy(
        status_order(), F.desc_nulls_last("priority_score"), F.asc_nulls_last("name_similarity"), "pair_id"
    )
    return rows.limit(limit) if limit is not None else rows


def prioritised_queue(predictions: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Manual-review decisions first, then by distance from the middle of the review band."""
    frame = with_context(predictions, entities) if entities is not None else predictions
    ordered = frame.orderBy(
        F.when(F.col("decision") == "manual_review", 0).otherwise(1), F.abs(F.col("same_game_probability") - 0.825), "same_game_probability",
        "source_a", "source_id_a", "source_b", "source_id_b",
    )
    wanted = ["source_a", "source_id_a", "name_a", "release_year_a", "source_b", "source_id_b", "name_b", "release_year_b",
              "same_game_probability", "decision", "explanation_reasons", "candidate_source", "label_source"]
    return ordered.select(*[c for c in wanted if c in ordered.columns])


@dataclass(frozen=True)
class Selection:
    """A way to pick pairs for review: SQL predicate, priority and order."""

    name: str
    where: str
    priority: str
    order: tuple[str, ...]


_NAME, _RANK, _CONF = "coalesce(name_similarity, 0)", "coalesce(igdb_search_rank, 1)", "coalesce(igdb_search_confidence, 0)"
_LANE = "candidate_source = 'igdb_search'"
# The seven selection strategies.
SELECTIONS = (
    Selection(
        "igdb_suspicious_auto_merge",
        f"{_LANE} and model_decision = 'auto_merge' and ({_NAME} < 0.75 or {_RANK} > 1 or {_CONF} < 0.85)",
        f"(1 - {_NAME}) + 0.1 * {_RANK} + (1 - {_CONF})",
        ("name_similarity asc", "igdb_search_rank desc", "igdb_search_confidence asc"),
    ),
    Selection("igdb_low_similarity", f"{_LANE} and {_NAME} < 0.70", f"1 - {_NAME}", ("name_similarity asc", "igdb_search_rank desc")),
    Selection("igdb_rank_2_3", f"{_LANE} and {_RANK} >= 2", f"0.25 * {_RANK} + (1 - {_NAME})", ("igdb_search_rank desc", "name_similarity asc")),
    Selection(
        "igdb_borderline",
        f"{_LANE} and {_NAME} >= 0.70 and {_NAME} < 0.90",
        f"1 - abs({_NAME} - 0.80)",
        (f"abs({_NAME} - 0.80) asc", "igdb_search_rank desc"),
    ),
    Selection(
        "igdb_likely_positive",
        f"{_LANE} and {_NAME} >= 0.90 and coalesce(release_year_diff, 99) <= 1 and {_RANK} = 1 and {_CONF} >= 0.85",
        f"{_NAME} + {_CONF}",
        ("name_similarity desc", "igdb_search_confidence desc"),
    ),
    Selection(
        "external_id_positive_control",
        "candidate_source in ('external_id', 'external_id_positive') and label_value = '1'",
        f"{_NAME} + coalesce(same_game_probability, 0)",
        ("name_similarity asc", "same_game_probability asc"),
    ),
    Selection(
        "same_name_year_negative_control",
        "candidate_source = 'same_normalized_name' and coalesce(release_year_diff, 0) >= 10",
        "coalesce(release_year_diff, 0)",
        ("release_year_diff desc", "name_similarity desc"),
    ),
)


def select_for_review(view: DataFrame, selection: Selection, limit: int = 100) -> DataFrame:
    """The pairs that a selection proposes among those without a label."""
    open_rows = view.where("(review_status is null or review_status = 'pending') and review_label is null").where(selection.where)
    order = [F.expr(o.rsplit(" ", 1)[0]) for o in selection.order]
    order = [o.asc_nulls_last() if text.endswith("asc") else o.desc_nulls_last() for o, text in zip(order, selection.order)]
    return (
        open_rows.withColumns({"selection_strategy": F.lit(selection.name), "priority_score": F.round(F.expr(f"cast({selection.priority} as double)"), 6)})
        .orderBy(*order, "pair_id")
        .limit(limit)
        .select("pair_id", "selection_strategy", "priority_score")
    )


def seed_reviews(view: DataFrame, reviews: DataFrame, strategy: str = "all", limit: int = 100) -> DataFrame:
    """New pending reviews, the first strategy of a pair winning; reviewed pairs stay out."""
    chosen = [s for s in SELECTIONS if strategy in ("all", s.name)]
    if not chosen:
        raise ValueError(f"no selection strategy {strategy}")
    parts = [select_for_review(view, s, limit).withColumn("__k", F.lit(k)) for k, s in enumerate(chosen)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    fresh = first_per_key(rows, ["pair_id"], ["__k"]).drop("__k").join(reviews.select("pair_id"), "pair_id", "left_anti")
    return fresh.withColumn("review_status", F.lit("pending"))


STATUSES = ("pending", "reviewed", "skipped", "unsure")


def update_review(
    reviews: DataFrame,
    pair: str,
    *,
    now: Column,
    label: bool | None = None,
    status: str = "reviewed",
    notes: str | None = None,
    reviewer: str | None = None,
    confidence: float | None = None,
) -> DataFrame:
    """The review table after one update.

    A reviewed row needs a label and gets the time; other statuses lose it.
    Null notes and reviewer keep the old ones; the confidence goes into the
    priority.
    """
    if status not in STATUSES:
        raise ValueError(f"unknown review status {status}")
    if status == "reviewed" and label is None:
        raise ValueError("a reviewed pair needs a label")
    hit = F.col("pair_id") == pair
    new = {
        "review_label": F.lit(label).cast("boolean"),
        "review_status": F.lit(status),
        "review_notes": F.coalesce(F.lit(notes).cast("string"), F.col("review_notes")),
        "reviewer": F.coalesce(F.lit(reviewer).cast("string"), F.col("reviewer")),
        "priority_score": F.coalesce(F.lit(confidence).cast("double"), F.col("priority_score")),
        "reviewed_at": now if status == "reviewed" else F.lit(None).cast("timestamp"),
    }
    return reviews.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()})


def invalid_reviews(reviews: DataFrame) -> DataFrame:
    """Rows that break the table's rules: unknown status, or reviewed without label or time."""
    known = F.coalesce(F.col("review_status").isin(*STATUSES), F.lit(False))
    complete = (F.col("review_status") != "reviewed") | (F.col("review_label").isNotNull() & F.col("reviewed_at").isNotNull())
    return reviews.where(~(known & F.coalesce(complete, F.lit(False))))


def review_matches(view: DataFrame, *, status: str = "all", decision: str = "all", limit: int = 50) -> DataFrame:
    """Pairs by status and decision ('all' for any), the most pressing first."""
    rows = view
    if status != "all":
        rows = rows.where(F.col("review_status") == status)
    if decision != "all":
        rows = rows.where(F.col("model_decision") == decision)
    return rows.orderBy(F.desc_nulls_last("priority_score"), F.desc_nulls_last("same_game_probability"), "pair_id").limit(limit)


def review_categories(pairs: DataFrame, features: DataFrame, entities: DataFrame) -> DataFrame:
    """One row for each pair and reason to review it."""
    rows = pairs.join(features, "pair_id", "left")
    for s in ("a", "b"):
        side = entities.select(
            F.col("source").alias(f"source_{s}"), F.col("source_id").alias(f"source_id_{s}"), F.col("name").alias(f"name_{s}"), F.col("release_year").alias(f"release_year_{s}")
        )
        rows = rows.join(side, [f"source_{s}", f"source_id_{s}"])
    rule = F.col("candidate_source")
    apart = (F.coalesce("developer_overlap", F.lit(1.0)) == 0) | (F.coalesce("publisher_overlap", F.lit(1.0)) == 0)
    reasons = F.array(
        F.when(F.col("label_value") == "1", F.lit("deterministic_positive")),
        F.when((rule == "same_normalized_name") & (F.col("release_year_diff") != 0), F.lit("same_title_different_year")),
        F.when(rule == "same_release_year_and_similar_name", F.lit("similar_title")),
        F.when(rule == "shared_alias", F.lit("alias_overlap")),
        F.when(apart, F.lit("potential_conflict")),
    )
    return rows.withColumn("review_category", F.explode(F.filter(reasons, lambda x: x.isNotNull()))).dropDuplicates(["pair_id", "review_category"])


def count_by(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows by each of the columns in turn: (dimension, key, row_count)."""
    out = None
    for c in columns:
        part = rows.groupBy(F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias("key")).agg(F.count("*").alias("row_count")).select(F.lit(c).alias("dimension"), "key", "row_count")
        out = part if out is None else out.unionByName(part)
    return out


def label_summary(rows: DataFrame) -> DataFrame:
    """Labels by review status, with the precision among labelled rows."""
    positive, negative = F.count_if("review_label"), F.count_if(~F.col("review_label"))
    return rows.groupBy(F.coalesce("review_status", F.lit("missing")).alias("review_status")).agg(
        F.count("*").alias("row_count"),
        positive.alias("reviewed_positive_count"),
        negative.alias("reviewed_negative_count"),
        F.count_if(F.col("review_label").isNull()).alias("unlabeled_count"),
        safe_ratio(positive, positive + negative).alias("reviewed_precision"),
    )


def bucket_precision(rows: DataFrame, bucket: str) -> DataFrame:
    """Precision of reviewed pairs by bucket."""
    positive, negative = F.count_if("review_label"), F.count_if(~F.col("review_label"))
    reviewed = rows.where("review_status = 'reviewed' and review_label is not null")
    return reviewed.groupBy(F.col(bucket).alias("bucket_value")).agg(
        positive.alias("reviewed_positive_count"),
        negative.alias("reviewed_negative_count"),
        (positive + negative).alias("reviewed_pair_count"),
        safe_ratio(positive, positive + negative).alias("reviewed_precision"),
    ).select(F.lit(bucket).alias("bucket_name"), "*")


def risky_negatives(rows: DataFrame, limit: int = 100) -> DataFrame:
    """Reviewed negatives that the model would merge or puts at .70 or more."""
    kept = rows.where("review_status = 'reviewed' and not review_label").where(
        (F.coalesce("same_game_probability", F.lit(0.0)) >= 0.70) | (F.col("model_decision") == "auto_merge")
    )
    ordered = kept.orderBy(F.desc(F.coalesce("same_game_probability", F.lit(0.0))), F.lower("name_a"), F.lower("name_b"), "pair_id").limit(limit)
    return ordered.select(F.lit("reviewed_negative_high_model_score").alias("case_type"), "*")


def likely_positives(rows: DataFrame, limit: int = 100) -> DataFrame:
    """Pairs without review whose name, rank, confidence and year all speak for a match."""
    year = F.col("release_year_diff").isNull() | (F.col("release_year_diff") <= 1)
    kept = rows.where(F.coalesce(F.col("review_status") != "reviewed", F.lit(True))).where(
        (F.col("name_similarity") >= 0.90) & (F.col("igdb_search_rank") == 1) & (F.col("igdb_search_confidence") >= 0.85) & year
    )
    ordered = kept.orderBy(F.desc("name_similarity"), F.desc("igdb_search_confidence"), F.lower("name_a"), "pair_id").limit(limit)
    return ordered.select(F.lit("unreviewed_likely_positive").alias("case_type"), "*")


def active_learning(view: DataFrame, limit: int = 250) -> DataFrame:
    """C20: open pairs worth a review: uncertain ones first, then sure ones, then the review band."""
    p = F.col("same_game_probability")
    bucket = (
        F.when(p.between(0.45, 0.55), "high_uncertainty").when(p >= 0.90, "high_risk_model_positive").when(p >= 0.70, "manual_review_priority").otherwise("low_priority")
    )
    rows = view.where("review_status is null or review_status in ('pending', 'unsure', 'skipped')").withColumn("active_learning_bucket", bucket)
    order = F.when(F.col("active_learning_bucket") == "high_uncertainty", 0).when(F.col("active_learning_bucket") == "high_risk_model_positive", 1).otherwise(2)
    return rows.where("active_learning_bucket <> 'low_priority'").orderBy(order, F.abs(F.coalesce(p, F.lit(0.5)) - 0.5), F.desc_nulls_last("same_game_probability"), "pair_id").limit(limit)


def demo_cases(view: DataFrame, per_case: int = 3) -> DataFrame:
    """The first few reviewed positives, reviewed negatives and open pairs, each in its own order."""
    p = F.col("same_game_probability")
    sure = [F.desc_nulls_last("same_game_probability"), "pair_id"]
    parts = [
        ("successful_merge", view.where("review_status = 'reviewed' and review_label"), sure),
        ("rejected_risky_match", view.where("review_status = 'reviewed' and not review_label"), sure),
        ("active_learning_candidate", view.where("review_status is null or review_status in ('pending', 'unsure', 'skipped')"), [F.abs(F.coalesce(p, F.lit(0.5)) - 0.5), *sure]),
    ]
    out = None
    for name, rows, order in parts:
        part = rows.orderBy(*order).limit(per_case).select(F.lit(name).alias("case_type"), F.col("name_a").alias("item_a"), F.col("name_b").alias("item_b"), p.alias("score"))
        out = part if out is None else out.unionByName(part)
    return out.orderBy("case_type", F.desc_nulls_last("score"), "item_a", "item_b")

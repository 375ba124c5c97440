"""Rules, thresholds and buckets of entity matching as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from marlstone.functions.text import Text, as_column

# Decision thresholds.
AUTO_MERGE, REVIEW_MIN, REVIEW_MAX = 0.95, 0.70, 0.95


@dataclass(frozen=True)
class Policy:
    """Thresholds of a decision; a gap between review_max and auto_merge is ``no_merge``."""

    auto_merge: float = AUTO_MERGE
    review_min: float = REVIEW_MIN
    review_max: float = REVIEW_MAX


def decision(probability: Text, policy: Policy = Policy()) -> Column:
    """auto_merge, manual_review or no_merge."""
    p = as_column(probability)
    return (
        F.when(p >= policy.auto_merge, F.lit("auto_merge"))
        .when((p >= policy.review_min) & (p < policy.review_max), F.lit("manual_review"))
        .otherwise(F.lit("no_merge"))
    )


def rank_bucket(rank: Text) -> Column:
    """Search rank 1, 2-3, 4-5, 6+ or unknown."""
    r = as_column(rank)
    return (
        F.when(r.isNull(), F.lit("unknown"))
        .when(r <= 1, F.lit("1"))
        .when(r <= 3, F.lit("2-3"))
        .when(r <= 5, F.lit("4-5"))
        .otherwise(F.lit("6+"))
    )


def confidence_bucket(confidence: Text) -> Column:
    """Confidence from .95, from .85, from .70, below, or unknown."""
    c = as_column(confidence)
    return (
        F.when(c.isNull(), F.lit("unknown"))
        .when(c >= 0.95, F.lit("0.95-1.00"))
        .when(c >= 0.85, F.lit("0.85-0.95"))
        .when(c >= 0.70, F.lit("0.70-0.85"))
        .otherwise(F.lit("<0.70"))
    )


def safe_ratio(numerator: Text, denominator: Text, digits: int = 6) -> Column:
    """Ratio to six digits, null unless the denominator is positive."""
    d = as_column(denominator)
    return F.when(d > 0, F.round(as_column(numerator) / d, digits))


def rule_probability() -> Column:
    """I26 over columns of a feature row: struct(probability, reasons).

    The first of the four sure rules wins; otherwise the score adds up and is
    clamped to [0, 0.94].  Missing similarities count as 0.
    """
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    name, alias, dev, plat = map(zero, ("name_similarity", "alias_similarity", "developer_overlap", "platform_jaccard"))
    diff = F.col("release_year_diff")
    exact = F.coalesce(F.col("external_id_exact_match"), F.lit(False))
    near_year = diff.isNull() | (diff <= 1)
    very_name, very_alias = (name >= 0.97) & near_year, (alias >= 0.97) & near_year
    apart = (name < 0.35) & F.coalesce(diff >= 2, F.lit(False))
    same, far = F.coalesce(diff == 0, F.lit(False)), F.coalesce(diff >= 5, F.lit(False))
    part = lambda cond, points: F.when(cond, F.lit(points)).otherwise(F.lit(0.0))
    score = F.lit(0.15) + name * 0.45 + alias * 0.15 + part(same, 0.15) + part(far, -0.1) + part(dev >= 0.5, 0.05) + part(plat >= 0.5, 0.05)
    added = F.filter(
        F.array(
            F.when(name != 0, F.lit("name_similarity")),
            F.when(alias != 0, F.lit("alias_similarity")),
            F.when(same, F.lit("same_release_year")).when(far, F.lit("release_year_conflict")),
            F.when(dev >= 0.5, F.lit("developer_overlap")),
            F.when(plat >= 0.5, F.lit("platform_overlap")),
        ),
        lambda x: x.isNotNull(),
    )
    listed = lambda *xs: F.array(*map(F.lit, xs))
    return F.struct(
        F.when(exact, 0.99).when(very_name, 0.97).when(very_alias, 0.96).when(apart, 0.05)
        .otherwise(F.greatest(F.lit(0.0), F.least(F.round(score, 6), F.lit(0.94)))).alias("probability"),
        F.when(exact, listed("external_id_exact_match"))
        .when(very_name, listed("very_high_name_similarity", "compatible_release_year"))
        .when(very_alias, listed("high_alias_similarity", "compatible_release_year"))
        .when(apart, listed("low_name_similarity", "different_release_year"))
        .otherwise(added).alias("reasons"),
    )


def search_confidence(rank: Text, strategy: Text, anchor_year: Text, candidate_year: Text) -> Column:
    """Base .85, less .1 a rank (at most .4), bonus for alias queries and near years, in [.1, .99]."""
    r = as_column(rank)
    gap = F.abs(as_column(anchor_year) - as_column(candidate_year))
    value = (
        F.lit(0.85)
        - F.least(F.greatest(r - 1, F.lit(0)) * 0.1, F.lit(0.4))
        + F.when(as_column(strategy) == "wikidata_alias", 0.1).otherwise(0.0)
        + F.when(gap == 0, 0.1).when(gap <= 1, 0.05).otherwise(0.0)
    )
    return F.round(F.greatest(F.lit(0.1), F.least(value, F.lit(0.99))), 4)


def reviewed_positive() -> Column:
    """Reviewed and labelled true; null is false."""
    return F.coalesce((F.col("review_status") == "reviewed") & F.col("review_label"), F.lit(False))


def reviewed_negative() -> Column:
    """Reviewed and labelled false; null is false."""
    return F.coalesce((F.col("review_status") == "reviewed") & ~F.col("review_label"), F.lit(False))


def trusted_edge() -> Column:
    """Reviewed positives, and guarded external-id matches that no review denies."""
    year = F.col("release_year_diff").isNull() | (F.col("release_year_diff") <= 2)
    guarded = (
        (F.col("candidate_source") == "external_id")
        & (F.col("label_value") == "1")
        & ~reviewed_negative()
        & (F.coalesce(F.col("name_similarity"), F.lit(0.0)) >= 0.90)
        & year
    )
    return reviewed_positive() | F.coalesce(guarded, F.lit(False))


@dataclass(frozen=True)
class Strategy:
    """A way to pick merge edges: ``trusted``, ``model_only`` or ``hybrid``."""

    name: str
    mode: str
    threshold: float | None = None
    min_name: float | None = None
    max_years: int | None = None
    block_negatives: bool = False


# The six compared strategies.
STRATEGIES = (
    Strategy("canonical_v1_trusted", "trusted"),
    Strategy("model_auto_095", "model_only", 0.95),
    Strategy("model_auto_090", "model_only", 0.90),
    Strategy("model_auto_070_research", "model_only", 0.70),
    Strategy("hybrid_conservative_095", "hybrid", 0.95, block_negatives=True),
    Strategy("hybrid_safe_090", "hybrid", 0.90, 0.90, 2, True),
)


def model_edge(strategy: Strategy) -> Column:
    """Probability over the threshold, within the strategy's guards."""
    if strategy.threshold is None:
        return F.lit(False)
    edge = F.col("same_game_probability") >= strategy.threshold
    if strategy.block_negatives:
        edge = edge & ~reviewed_negative()
    if strategy.min_name is not None:
        edge = edge & (F.coalesce(F.col("name_similarity"), F.lit(0.0)) >= strategy.min_name)
    if strategy.max_years is not None:
        edge = edge & (F.col("release_year_diff").isNull() | (F.col("release_year_diff") <= strategy.max_years))
    return F.coalesce(edge, F.lit(False))


def clamp_limit(limit: int, *, default: int, maximum: int) -> int:
    """The default for limits that are not positive, else at most the maximum."""
    return default if limit <= 0 else min(limit, maximum)


def number(value: Text, digits: int | None = None) -> Column:
    """Text or number as double, null if it is none; rounded if asked."""
    out = as_column(value).cast("string").try_cast("double")
    return F.round(out, digits) if digits is not None else out


def whole_number(value: Text) -> Column:
    """Text or number as bigint, null if it is none."""
    return as_column(value).cast("string").try_cast("bigint")

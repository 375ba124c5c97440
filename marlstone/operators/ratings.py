"""Vote-adjusted ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marlstone.functions.text import Text, as_column

PRIOR_VOTES = 50.0
# Rating types that carry votes.
RATING_TYPES = ("rawg_rating", "igdb_rating", "igdb_aggregated_rating", "igdb_total_rating")


def normalized_rating(value: Text, scale: Text) -> Column:
    """Rating on 0-100, clamped."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), as_column(value).cast("double") / as_column(scale).cast("double") * 100))


def bayesian_average(rating: Text, votes: Text, mean: Text, prior: float = PRIOR_VOTES) -> Column:
    """Rating shrunk towards the mean by ``prior`` votes; the mean when there are none."""
    v = as_column(votes)
    total = v + F.lit(float(prior))
    return F.when(total > 0, (as_column(rating) * v + as_column(mean) * F.lit(float(prior))) / total).otherwise(as_column(mean))


def rating_inputs(ratings: DataFrame, links: DataFrame, entities: DataFrame, types: tuple[str, ...] | None = RATING_TYPES) -> DataFrame:
    """Usable ratings of linked entities: known type, numeric scale, positive value, scale and votes."""
    ratings = ratings if types is None else ratings.where(F.col("rating_type").isin(*types))
    numeric = F.col("rating_scale").rlike(r"^[0-9]+(\.[0-9]+)?$")
    usable = ratings.where(numeric & (F.col("rating_scale").try_cast("double") > 0) & (F.col("rating_value") > 0) & (F.col("rating_count") > 0))
    return usable.join(links.select("canonical_id", "source", "source_id"), ["source", "source_id"]).join(
        entities.select("canonical_id", "canonical_name", "release_year"), "canonical_id"
    )


def bayesian_ratings(inputs: DataFrame, prior: float = PRIOR_VOTES) -> DataFrame:
    """One row an entity: naive and shrunken rating, votes, rows and types.

    The mean is weighted by votes over all usable rows.  Sums run in decimals,
    so that the result does not depend on the order of rows.
    """
    votes = F.col("rating_count").cast("decimal(20,0)")
    points = (normalized_rating("rating_value", "rating_scale").cast("decimal(18,10)") * votes).cast("decimal(38,10)")
    rows = inputs.where("rating_count > 0").withColumns({"__votes": votes, "__points": points})
    per = rows.groupBy("canonical_id").agg(
        F.min("canonical_name").alias("canonical_name"),
        F.min("release_year").alias("release_year"),
        F.sum("__points").alias("points"),
        F.sum("__votes").alias("votes"),
        F.count("*").alias("rating_source_count"),
        F.array_join(F.array_sort(F.collect_set("rating_type")), ", ").alias("rating_types"),
    )
    mean = rows.agg((F.sum("__points").cast("double") / F.sum("__votes").cast("double")).alias("global_mean"))
    scored = per.crossJoin(F.broadcast(mean))  # one row
    naive = F.col("points").cast("double") / F.col("votes").cast("double")
    scored = scored.withColumn("naive", naive).withColumn("bayes", bayesian_average("naive", F.col("votes").cast("double"), "global_mean", prior))
    return scored.select(
        "canonical_id",
        "canonical_name",
        "release_year",
        F.round("naive", 6).alias("naive_weighted_rating"),
        F.round("bayes", 6).alias("bayesian_rating"),
        F.col("votes").cast("bigint").alias("vote_count"),
        "rating_source_count",
        "rating_types",
        F.round(F.col("bayes") - F.col("naive"), 6).alias("shrinkage_delta"),
    )


def rating_summary(inputs: DataFrame, prior: float = PRIOR_VOTES) -> DataFrame:
    """Input rows, entities, weighted mean and votes of a rating run."""
    rows = inputs.where("rating_count > 0")
    weighted = (normalized_rating("rating_value", "rating_scale").cast("decimal(18,10)") * F.col("rating_count").cast("decimal(20,0)")).cast("decimal(38,10)")
    return rows.agg(
        F.count("*").alias("rating_input_count"),
        F.count_distinct("canonical_id").alias("canonical_game_count"),
        F.round(F.sum(weighted).cast("double") / F.sum("rating_count"), 6).alias("global_weighted_mean"),
        F.lit(float(prior)).alias("prior_votes"),
        F.coalesce(F.sum("rating_count"), F.lit(0)).cast("bigint").alias("total_vote_count"),
    )


def ranked_ratings(ratings: DataFrame) -> DataFrame:
    return ratings.orderBy(F.desc("bayesian_rating"), F.desc("vote_count"), F.lower("canonical_name"), "canonical_id")


def low_vote_shifts(ratings: DataFrame, limit: int = 25) -> DataFrame:
    """C14: entities of under 50 votes whose rating moved by more than a point."""
    kept = ratings.where("vote_count < 50 and abs(shrinkage_delta) > 1.0")
    return kept.orderBy(F.desc(F.abs("shrinkage_delta")), "vote_count", F.lower("canonical_name"), "canonical_id").limit(limit)


def chart_rows(ratings: DataFrame, limit: int = 20) -> DataFrame:
    """C14: the best-rated entities for a chart."""
    return ranked_ratings(ratings).limit(limit).select("canonical_name", "bayesian_rating", "vote_count")


def source_summary(ratings: DataFrame) -> DataFrame:
    """Rating rows by source, type and scale: all, with votes, value range."""
    return ratings.groupBy("source", "rating_type", "rating_scale").agg(
        F.count("*").alias("row_count"),
        F.count_if(F.col("rating_count") > 0).alias("with_vote_count"),
        F.min("rating_value").alias("min_rating"),
        F.max("rating_value").alias("max_rating"),
        F.max("rating_count").alias("max_vote_count"),
    )

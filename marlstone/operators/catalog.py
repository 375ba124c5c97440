"""The catalog as it is served: pages, details, names, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marlstone.functions.scoring import clamp_limit
from marlstone.operators.rank import first_per_key, page_with_total

DESCRIPTION_ORDER = ("wikipedia", "rawg", "steam", "igdb")


def attribute_arrays(links: DataFrame, table: DataFrame, value: str, name: str) -> DataFrame:
    """(canonical_id, name): sorted distinct values of an entity's sources."""
    joined = links.select("canonical_id", "source", "source_id").join(table, ["source", "source_id"])
    return joined.where(F.col(value).isNotNull()).groupBy("canonical_id").agg(F.array_sort(F.collect_set(value)).alias(name))


def contains_text(column: str, needle: str | None) -> Column:
    """Case-insensitive containment of plain text; no needle matches all (T39: nothing is a wildcard)."""
    return F.lit(True) if not needle or not needle.strip() else F.contains(F.lower(column), F.lower(F.lit(needle.strip())))


def list_entities(
    entities: DataFrame,
    links: DataFrame,
    *,
    genres: DataFrame | None = None,
    platforms: DataFrame | None = None,
    search: str | None = None,
    limit: int = 20,
    offset: int = 0,
) -> DataFrame:
    """One page by name with the total of matches, sources, genres and platforms.

    The page is cut first; its arrays are then gathered for those rows only.
    """
    found = entities.where(contains_text("canonical_name", search))
    page = page_with_total(found, ["canonical_name", "canonical_id"], limit=clamp_limit(limit, default=20, maximum=100), offset=max(0, offset))
    own = links.join(F.broadcast(page.select("canonical_id")), "canonical_id", "left_semi")  # at most 100 rows
    out = page.join(own.groupBy("canonical_id").agg(F.count("*").alias("source_count")), "canonical_id", "left")
    for name, table in (("genres", genres), ("platforms", platforms)):
        arrays = attribute_arrays(own, table, "value", name) if table is not None else None
        out = out.join(arrays, "canonical_id", "left") if arrays is not None else out.withColumn(name, F.lit(None).cast("array<string>"))
        out = out.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out.withColumn("source_count", F.coalesce("source_count", F.lit(0))).orderBy("canonical_name", "canonical_id")


def entity_details(
    entities: DataFrame,
    links: DataFrame,
    staged: DataFrame,
    *,
    descriptions: DataFrame,
    genres: DataFrame,
    platforms: DataFrame,
    companies: DataFrame,
    ratings: DataFrame,
    entity: str | None = None,
) -> DataFrame:
    """Details of one entity (or of all): first date, best description, arrays, ratings, sources."""
    picked = entities if entity is None else entities.where(F.col("canonical_id") == entity)
    own = links if entity is None else links.where(F.col("canonical_id") == entity)
    joined = lambda table: own.select("canonical_id", "source", "source_id", "linkage_confidence").join(table, ["source", "source_id"])
    dates = joined(staged.select("source", "source_id", "release_date")).groupBy("canonical_id").agg(F.min("release_date").alias("release_date"))
    order = F.lit(len(DESCRIPTION_ORDER))
    for k, s in reversed(list(enumerate(DESCRIPTION_ORDER))):
        order = F.when(F.col("source") == s, k).otherwise(order)
    texts = joined(descriptions.select("source", "source_id", "description_text").where("description_text is not null"))
    best = first_per_key(texts, ["canonical_id"], [order, F.desc(F.length("description_text")), "description_text"]).select("canonical_id", F.col("description_text").alias("description"))
    rated = joined(ratings.select("source", "source_id", "rating_type", "rating_value")).groupBy("canonical_id", "rating_type").agg(F.max("rating_value").alias("rating_value"))
    rated = rated.groupBy("canonical_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rating_type", "rating_value")))).alias("ratings"))
    named = own.join(staged.select("source", "source_id", F.col("name").alias("source_name")), ["source", "source_id"], "left")
    sources = named.groupBy("canonical_id").agg(F.array_sort(F.collect_list(F.struct("source", "source_id", "source_name", "linkage_confidence"))).alias("sources"))
    out = picked.join(dates, "canonical_id", "left").join(best, "canonical_id", "left")
    arrays = {
        "genres": attribute_arrays(own, genres, "value", "genres"),
        "platforms": attribute_arrays(own, platforms, "value", "platforms"),
        "developers": attribute_arrays(own, companies.where("company_role = 'developer'"), "company_name", "developers"),
        "publishers": attribute_arrays(own, companies.where("company_role = 'publisher'"), "company_name", "publishers"),
    }
    for name, table in arrays.items():
        out = out.join(table, "canonical_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out.join(rated, "canonical_id", "left").join(sources, "canonical_id", "left")


def find_by_names(entities: DataFrame, names: list[str]) -> DataFrame:
    """The best entity for each name: exact first, then shortest, then by name.

    The names are a short list of the caller, joined as one small table.
    """
    spark = entities.sparkSession
    asked = spark.createDataFrame([(i, n.strip()) for i, n in enumerate(names) if n and n.strip()], "position int, asked string")
    hit = F.contains(F.lower("canonical_name"), F.lower("asked"))
    rows = entities.join(F.broadcast(asked), hit)  # bounded by the caller's list
    exact = F.when(F.lower("canonical_name") == F.lower("asked"), 0).otherwise(1)
    return first_per_key(rows, ["position"], [exact, F.length("canonical_name"), "canonical_name", "canonical_id"]).orderBy("position")


def catalog_stats(staged: DataFrame, entities: DataFrame, links: DataFrame, recommendations: DataFrame, aliases: DataFrame) -> DataFrame:
    """(metric, key, value): sizes of the catalog, with staged entities by source."""
    one = lambda name, df, value=F.count("*"): df.agg(value.alias("value")).select(F.lit(name).alias("metric"), F.lit("").alias("key"), F.col("value").cast("bigint").alias("value"))
    russian = aliases.where("language = 'ru'")
    parts = [
        one("source_games", staged),
        one("source_count", staged, F.count_distinct("source")),
        one("canonical_games", entities),
        one("canonical_game_sources", links),
        one("recommendations_count", recommendations),
        one("games_with_ru_name", russian, F.count_distinct("canonical_id")),
        staged.groupBy(F.col("source").alias("key")).agg(F.count("*").alias("value")).select(F.lit("source_games_by_source").alias("metric"), "key", "value"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def model_stats(pairs: DataFrame, reviews: DataFrame, predictions: DataFrame) -> DataFrame:
    """(metric, key, value): pairs, labels and decisions."""
    counted = reviews.agg(
        F.count_if(F.col("review_status") == "reviewed").alias("labeled_pairs"),
        F.count_if((F.col("review_status") == "reviewed") & F.col("review_label")).alias("manual_positive_labels"),
        F.count_if((F.col("review_status") == "reviewed") & ~F.col("review_label")).alias("manual_negative_labels"),
    )
    wide = counted.select(F.explode(F.create_map(*[x for c in counted.columns for x in (F.lit(c), F.col(c))])).alias("metric", "value")).select("metric", F.lit("").alias("key"), "value")
    whole = pairs.agg(F.count("*").alias("value")).select(F.lit("candidate_pairs").alias("metric"), F.lit("").alias("key"), "value")
    by = predictions.groupBy(F.col("decision").alias("key")).agg(F.count("*").alias("value")).select(F.lit("model_decisions").alias("metric"), "key", "value")
    return wide.unionByName(whole).unionByName(by)


def stats_as_map(stats: DataFrame, metric: str) -> DataFrame:
    """One row with a map of a metric's keys to values."""
    rows = stats.where(F.col("metric") == metric)
    return rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("counts"))


def artifact_stats(rows: DataFrame, key: str, value: str = "row_count") -> DataFrame:
    """(key, value) of a saved report table; numbers that do not parse count as 0."""
    number = F.coalesce(F.col(value).cast("string").try_cast("bigint"), F.lit(0))
    return rows.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(F.sum(number).alias("value"))

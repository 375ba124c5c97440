"""Content recommendations: weighted features, blocked candidates, weighted Jaccard, top k."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marlstone.functions.similarity import weighted_jaccard
from marlstone.functions.text import decade_key, feature_key
from marlstone.operators.rank import top_per_key

# Weights of feature types; any other type weighs 1.
WEIGHTS = {"genre": 3.0, "developer": 2.0, "publisher": 1.5, "tag": 1.0, "platform": 0.5, "decade": 0.25}
TOP_K, MAX_BLOCK, MAX_CANDIDATES, MIN_SCORE, TOP_FEATURES = 10, 500, 250, 0.12, 8


def entity_features(
    entities: DataFrame,
    links: DataFrame,
    *,
    genres: DataFrame | None = None,
    tags: DataFrame | None = None,
    platforms: DataFrame | None = None,
    companies: DataFrame | None = None,
    limit: int | None = None,
    weights: dict[str, float] = WEIGHTS,
) -> DataFrame:
    """(id, name, feature, weight) of canonical entities from their sources' attributes.

    ``entities`` has (canonical_id, canonical_name, release_year), ``links``
    (canonical_id, source, source_id), attribute tables (source, source_id,
    value).  Equal keys count once; entities without features have no row.
    """
    picked = entities if limit is None else entities.orderBy("canonical_name", "canonical_id").limit(limit)
    picked = picked.select(F.col("canonical_id").alias("id"), F.col("canonical_name").alias("name"), "release_year")
    parts = [
        table.select("source", "source_id", F.lit(kind).alias("kind"), "value")
        for kind, table in (("genre", genres), ("tag", tags), ("platform", platforms))
        if table is not None
    ]
    if companies is not None:
        roles = companies.where(F.col("company_role").isin("developer", "publisher"))
        parts.append(roles.select("source", "source_id", F.col("company_role").alias("kind"), F.col("company_name").alias("value")))
    rows = picked.select("id", "name", F.lit("decade").alias("kind"), decade_key("release_year").alias("feature")).where("feature is not null")
    if parts:
        values = parts[0]
        for part in parts[1:]:
            values = values.unionByName(part)
        linked = links.select(F.col("canonical_id").alias("id"), "source", "source_id").join(values, ["source", "source_id"])
        keyed = linked.select("id", "kind", feature_key("kind", "value").alias("feature")).where("feature is not null")
        rows = rows.unionByName(keyed.join(picked.select("id", "name"), "id").select("id", "name", "kind", "feature"))
    weight = F.lit(1.0)
    for kind, w in weights.items():
        weight = F.when(F.col("kind") == kind, F.lit(float(w))).otherwise(weight)
    return rows.groupBy("id", "feature").agg(F.first("name").alias("name"), F.max(weight).alias("weight")).select("id", "name", "feature", "weight")


def candidates(features: DataFrame, *, max_block: int = MAX_BLOCK, max_candidates: int = MAX_CANDIDATES) -> DataFrame:
    """(id, other, overlap): entities that share a feature of 2 to ``max_block`` entities.

    The guard bounds every block, so the self-join emits at most ``max_block``
    rows for each usable feature row.  An entity keeps its ``max_candidates``
    candidates of greatest shared weight, ties by id.
    """
    usable = features.groupBy("feature").agg(F.count("*").alias("n")).where(F.col("n").between(2, max_block)).select("feature")
    rows = features.select("id", "feature", "weight").join(usable, "feature")
    pairs = rows.alias("a").join(rows.select(F.col("id").alias("other"), "feature").alias("b"), "feature").where("id <> other")
    overlap = pairs.groupBy("id", "other").agg(F.sum("weight").alias("overlap"))
    return top_per_key(overlap, ["id"], [F.desc("overlap"), "other"], max_candidates, "__n").drop("__n")


def recommendations(
    features: DataFrame,
    *,
    top_k: int = TOP_K,
    max_block: int = MAX_BLOCK,
    max_candidates: int = MAX_CANDIDATES,
    min_score: float = MIN_SCORE,
    algorithm: str = "content_jaccard_v1",
) -> DataFrame:
    """ranked recommendations; all features score, only usable ones make candidates.

    Ranks follow the unrounded score, then name and id; features shared are
    listed by weight, then name.  ``hybrid_content_rating_v1`` gives the same
    rows with a note.
    """
    maps = features.groupBy("id").agg(
        F.first("name").alias("name"), F.map_from_entries(F.collect_list(F.struct("feature", "weight"))).alias("weights"), F.count("*").cast("int").alias("n")
    )
    left = maps.select("id", F.col("weights").alias("w"), F.col("n").alias("source_feature_count"))
    right = maps.select(F.col("id").alias("other"), F.col("name").alias("other_name"), F.col("weights").alias("v"), F.col("n").alias("candidate_feature_count"))
    scored = candidates(features, max_block=max_block, max_candidates=max_candidates).join(left, "id").join(right, "other")
    scored = scored.withColumn("raw", weighted_jaccard("w", "v")).where(F.col("raw") >= min_score)
    best = top_per_key(scored, ["id"], [F.desc("raw"), F.lower("other_name"), "other"], top_k)
    shared = F.map_filter(F.map_zip_with("w", "v", lambda k, a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))), lambda k, x: x.isNotNull())
    ordered = F.array_sort(F.transform(F.map_entries(shared), lambda e: F.struct((-e["value"]).alias("w"), e["key"].alias("k"))))
    note = "Uses content similarity as a safe fallback baseline; Bayesian rating prior can be added when rating artifacts are joined."
    return best.select(
        F.col("id").alias("canonical_id"),
        F.col("other").alias("recommended_id"),
        "rank",
        F.round("raw", 6).alias("score"),
        F.lit(algorithm).alias("algorithm"),
        F.slice(F.transform(ordered, lambda e: e["k"]), 1, TOP_FEATURES).alias("shared_features"),
        "source_feature_count",
        "candidate_feature_count",
        F.lit(note if algorithm == "hybrid_content_rating_v1" else None).cast("string").alias("hybrid_note"),
    )


def named_recommendations(recs: DataFrame, entities: DataFrame) -> DataFrame:
    """Recommendations with names and years of both ends."""
    side = lambda key, prefix: entities.select(F.col("canonical_id").alias(key), F.col("canonical_name").alias(f"{prefix}_game"), F.col("release_year").alias(f"{prefix}_release_year"))
    return recs.join(side("canonical_id", "seed"), "canonical_id").join(side("recommended_id", "recommended"), "recommended_id")


def similar(recs: DataFrame, entities: DataFrame, entity: str, *, limit: int = 10, algorithm: str = "content_jaccard_v1") -> DataFrame:
    """The recommendations of one entity in rank order."""
    rows = recs.where((F.col("canonical_id") == entity) & (F.col("algorithm") == algorithm))
    return named_recommendations(rows, entities).orderBy("rank").limit(limit)


def strong_examples(recs: DataFrame, entities: DataFrame, *, min_shared: int = 3, limit: int = 5) -> DataFrame:
    """The best recommendations with several shared features between named entities."""
    rows = named_recommendations(recs.where(F.size("shared_features") >= min_shared), entities)
    plain = rows.where(~F.col("seed_game").rlike("^Q[0-9]+$") & ~F.col("recommended_game").rlike("^Q[0-9]+$"))
    return plain.orderBy(F.desc("score"), "seed_game", "recommended_game", "recommended_id").limit(limit)


def merge_seeds(recs: DataFrame, seeds: DataFrame, *, limit: int = 10) -> DataFrame:
    """Candidates of several liked entities: greatest score, all their seeds, liked ones left out."""
    liked = seeds.select("canonical_id").distinct()
    rows = recs.join(liked, "canonical_id", "left_semi").join(liked.withColumnRenamed("canonical_id", "recommended_id"), "recommended_id", "left_anti")
    return (
        rows.groupBy("recommended_id")
        .agg(F.max("score").alias("score"), F.array_sort(F.collect_set("canonical_id")).alias("seeds"), F.count_distinct("canonical_id").alias("seed_count"))
        .orderBy(F.desc("score"), "recommended_id")
        .limit(limit)
    )


def score_histogram(recs: DataFrame) -> DataFrame:
    """Recommendations by tenths of the score."""
    low = F.least(F.floor(F.col("score") * 10 + 1e-9), F.lit(9))
    bucket = F.format_string("%.1f-%.1f", low / 10, (low + 1) / 10)
    return recs.groupBy(bucket.alias("score_bucket")).agg(F.count("*").alias("row_count"))


def recommendation_stats(recs: DataFrame) -> DataFrame:
    """Counts and score range."""
    return recs.agg(
        F.count("*").alias("recommendation_count"),
        F.count_distinct("canonical_id").alias("seed_count"),
        F.round(F.min("score"), 6).alias("min_score"),
        F.round(F.avg("score"), 6).alias("avg_score"),
        F.round(F.max("score"), 6).alias("max_score"),
    )


def block_sizes(features: DataFrame) -> DataFrame:
    """Entities to a feature, for tuning the block guard."""
    return features.groupBy("feature").agg(F.count("*").alias("block_size"))

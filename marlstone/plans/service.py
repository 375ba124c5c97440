"""The service surface: one method for each route, DataFrames in place of payloads."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from marlstone.functions.scoring import clamp_limit
from marlstone.operators import catalog, explain, recommend, review, strategies
from marlstone.plans import control

VERSION = "0.1.0"


@dataclass
class CatalogService:
    """Routes over the tables of a catalog; nothing is computed before a route is called.

    ``staging`` and ``canonical`` are dicts of tables by name; ``view`` is the
    review view.
    """

    spark: SparkSession
    staging: dict[str, DataFrame]
    canonical: dict[str, DataFrame]
    pairs: DataFrame
    view: DataFrame
    reviews: DataFrame
    predictions: DataFrame
    recommendations: DataFrame
    root: str = ""
    write_key: str | None = None

    def health(self) -> dict:
        return {"status": "ok"}

    def health_store(self) -> dict:
        """Whether tables can be read."""
        try:
            self.canonical["entities"].limit(1).collect()
        except Exception as problem:  # reported, as this route is for that
            return {"status": "error", "detail": str(problem)[:200]}
        return {"status": "ok"}

    def health_sources(self) -> DataFrame:
        return self.staging["entities"].groupBy("source").agg(F.count("*").alias("entity_count")).orderBy("source")

    def version(self) -> dict:
        return {"version": VERSION, "spark": self.spark.version}

    def games(self, *, search: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
        return catalog.list_entities(
            self.canonical["entities"], self.canonical["sources"], genres=self.staging["genres"], platforms=self.staging["platforms"],
            search=search, limit=limit, offset=offset,
        )

    def game(self, entity: str) -> DataFrame:
        s = self.staging
        return catalog.entity_details(
            self.canonical["entities"], self.canonical["sources"], s["entities"], descriptions=s["descriptions"], genres=s["genres"],
            platforms=s["platforms"], companies=s["companies"], ratings=s["ratings"], entity=entity,
        )

    def similar(self, entity: str, *, limit: int = 10, algorithm: str = "content_jaccard_v1") -> DataFrame:
        return recommend.similar(self.recommendations, self.canonical["entities"], entity, limit=clamp_limit(limit, default=10, maximum=50), algorithm=algorithm)

    def recommend(self, liked: list[str], *, limit: int = 10, algorithm: str = "content_jaccard_v1") -> DataFrame:
        """POST /recommend: names are matched first, then their recommendations are merged."""
        seeds = catalog.find_by_names(self.canonical["entities"], liked).select("canonical_id")
        recs = self.recommendations.where(F.col("algorithm") == algorithm)
        merged = recommend.merge_seeds(recs, seeds, limit=clamp_limit(limit, default=10, maximum=50))
        names = self.canonical["entities"].select(F.col("canonical_id").alias("recommended_id"), "canonical_name", "release_year")
        return merged.join(names, "recommended_id").orderBy(F.desc("score"), "recommended_id")

    def review_matches(self, *, status: str = "all", decision: str = "all", limit: int = 50) -> DataFrame:
        return review.review_matches(self.view, status=status, decision=decision, limit=clamp_limit(limit, default=50, maximum=200))

    def update_review(self, pair: str, *, key: str | None = None, label: str | bool | None = None, **changes: object) -> DataFrame:
        """PATCH /matches/review/{pair}: the review table after the update."""
        if self.write_key is not None and key != self.write_key:
            raise PermissionError("a valid write key is needed")
        if self.reviews.where(F.col("pair_id") == pair).isEmpty():
            raise LookupError(f"no review of {pair}")
        self.reviews = review.update_review(self.reviews, pair, now=F.current_timestamp(), label=review_label(label), **changes)
        return self.reviews

    def stats_catalog(self) -> DataFrame:
        return catalog.catalog_stats(self.staging["entities"], self.canonical["entities"], self.canonical["sources"], self.recommendations, self.canonical["aliases"])

    def stats_ml(self) -> DataFrame:
        return catalog.model_stats(self.pairs, self.reviews, self.predictions)

    def stats_readiness(self, required: list[str], optional: list[str]) -> DataFrame:
        return control.readiness(self.spark, self.root, required, optional)

    def stats_graph(self) -> DataFrame:
        members = self.canonical["sources"].select(F.col("canonical_id").alias("component"), "source", "source_id")
        return strategies.size_distribution(members, "canonical")

    def explain_recommendation(self, *, entity: str | None = None, recommended: str | None = None, limit: int = 10) -> DataFrame:
        rows = self.recommendations
        if entity is not None:
            rows = rows.where(F.col("canonical_id") == entity)
        if recommended is not None:
            rows = rows.where(F.col("recommended_id") == recommended)
        named = recommend.named_recommendations(rows, self.canonical["entities"]).orderBy(F.desc("score"), "seed_game", "rank").limit(limit)
        return named.withColumns({"explanation_ru": explain.recommendation_text(), "facts": explain.recommendation_facts()})

    def explain_match(self, *, pair: str | None = None, limit: int = 10, mode: str = "template", provider: str = "none") -> DataFrame:
        rows = self.view if pair is None else self.view.where(F.col("pair_id") == pair)
        told = explain.match_explanations(explain.explainable(rows, limit).limit(limit)).withColumn("facts", explain.match_facts())
        spoken = explain.render("grounded_explanation_ru", "facts", mode=mode, provider=provider)
        return told.withColumns({"rendered_ru": spoken.text, "provider": F.lit(spoken.provider), "warning": spoken.warning})


def review_label(value: str | bool | None) -> bool | None:
    """A label as it is sent: booleans, or words for them; other words are an error."""
    if value is None or isinstance(value, bool):
        return value
    word = value.strip().lower()
    if word in ("positive", "true", "1", "match", "same"):
        return True
    if word in ("negative", "false", "0", "no_match", "different"):
        return False
    if word in ("", "none", "unsure", "skip", "skipped"):
        return None
    raise ValueError(f"unknown label {re.sub(r'[^a-z0-9_]', '', word)}")

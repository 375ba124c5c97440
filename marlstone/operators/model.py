"""The weighted logistic pair model: fit, score, ablate, hold out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from marlstone.functions.scoring import decision
from marlstone.functions.similarity import padded_char_ngrams, tfidf_pair_cosine, word_ngrams
from marlstone.operators.decompose import title_svd_cosine
from marlstone.operators.features import FEATURES
from marlstone.operators.metrics import binary_metrics
from marlstone.plans.scratch import Scratch

# Label weights, and feature groups for ablations.
LABEL_WEIGHTS = {"manual_review": 1.0, "weak_positive": 0.2, "synthetic_negative": 0.5}
RESEARCH_WEIGHTS = {"manual_review": 1.0, "weak_positive": 0.05, "synthetic_negative": 0.5}
FEATURE_GROUPS = {
    "name": ("name_similarity", "alias_similarity"),
    "year": ("release_year_diff",),
    "external_id": ("external_id_exact_match",),
    "companies": ("developer_overlap", "publisher_overlap"),
    "taxonomy": ("platform_jaccard", "genre_jaccard", "tag_jaccard"),
    "description": ("description_available_flag", "description_language_match"),
    "source_signal": ("source_count_signal",),
}
FEATURE_SETS = {
    "name_similarity_only": ("name_similarity",),
    "char_tfidf_only": ("char_tfidf_cosine",),
    "word_tfidf_only": ("word_tfidf_cosine",),
    "svd_title_only": ("title_svd_cosine",),
    "vector_stack": ("char_tfidf_cosine", "word_tfidf_cosine", "title_svd_cosine"),
    "combined_name_vector_year": ("name_similarity", "char_tfidf_cosine", "word_tfidf_cosine", "title_svd_cosine", "release_year_abs_diff", "same_release_year"),
}
TEST_SHARE, SEED = 0.4, 42


def held_out(key: Column, label: Column, share: float = TEST_SHARE, seed: int = SEED) -> Column:
    """Whether a row belongs to the test part: a hash of its key, seeded, within its label."""
    return F.pmod(F.xxhash64(key.cast("string"), label.cast("string"), F.lit(seed)), F.lit(10_000)) < int(share * 10_000)


def group_held_out(key: Column, share: float = TEST_SHARE, seed: int = SEED) -> Column:
    """Whether a whole group belongs to the test part."""
    return F.pmod(F.xxhash64(key.cast("string"), F.lit(seed)), F.lit(10_000)) < int(share * 10_000)


def label_weights(weights: dict[str, float], column: str = "training_label_source") -> Column:
    """Weight of a row by its label source, 1 for any other."""
    out = F.lit(1.0)
    for name, w in weights.items():
        out = F.when(F.col(column) == name, F.lit(float(w))).otherwise(out)
    return out


@dataclass
class PairModel:
    """Medians, coefficients and intercept; features that are null in every training row are left out."""

    features: tuple[str, ...]
    medians: dict[str, float]
    fitted: LogisticRegressionModel | None
    constant: float = 0.5

    @property
    def coefficients(self) -> dict[str, float]:
        values = self.fitted.coefficients.toArray().tolist() if self.fitted else [0.0] * len(self.features)
        return dict(zip(self.features, values))


def _numeric(frame: DataFrame, features: tuple[str, ...], medians: dict[str, float]) -> DataFrame:
    filled = {f"__{f}": F.coalesce(F.col(f).cast("double"), F.lit(medians[f])) for f in features}
    return VectorAssembler(inputCols=list(filled), outputCol="__x").transform(frame.withColumns(filled)).drop(*filled)


def fit_model(train: DataFrame, features: tuple[str, ...] = FEATURES, weights: dict[str, float] = LABEL_WEIGHTS, *, iterations: int = 200) -> PairModel:
    """Exact-median imputation and L2 logistic regression with balanced classes and row weights.

    The penalty is that of C = 1: ``1 / sum of weights`` in Spark's scaling,
    with a free intercept and unstandardised features.
    """
    source = "training_label_source" in train.columns
    medians = train.agg(*[F.percentile(F.col(f).cast("double"), 0.5).alias(f) for f in features]).first().asDict()
    kept = tuple(f for f in features if medians[f] is not None)
    classes = {r.label: r["count"] for r in train.groupBy("label").count().collect()}  # two rows
    total = sum(classes.values())
    if len(classes) < 2 or not kept:
        return PairModel(kept, medians, None, float(next(iter(classes), 0.5)))
    balance = F.lit(1.0)
    for label, n in classes.items():
        balance = F.when(F.col("label") == label, F.lit(total / (len(classes) * n))).otherwise(balance)
    rows = train.withColumn("__w", (label_weights(weights) if source else F.lit(1.0)) * balance)
    weight = rows.agg(F.sum("__w")).first()[0]
    rows = _numeric(rows, kept, medians).select(F.col("label").cast("double").alias("label"), "__w", "__x")
    fitted = LogisticRegression(
        featuresCol="__x", labelCol="label", weightCol="__w", regParam=1.0 / weight, elasticNetParam=0.0, standardization=False, maxIter=iterations, tol=1e-9
    ).fit(rows)
    return PairModel(kept, medians, fitted)


def score(frame: DataFrame, model: PairModel, name: str = "same_game_probability") -> DataFrame:
    """``frame`` with the model's probability."""
    if model.fitted is None:
        return frame.withColumn(name, F.lit(model.constant))
    out = model.fitted.transform(_numeric(frame, model.features, model.medians))
    return out.withColumn(name, F.get(vector_to_array("probability"), F.lit(1))).drop("__x", "rawPrediction", "probability", "prediction")


def predict(frame: DataFrame, model: PairModel, *, model_name: str = "logistic_regression", version: str = "v1") -> DataFrame:
    """Probability, decision and the three features of greatest absolute contribution."""
    parts = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                (F.coalesce(F.col(f).cast("double"), F.lit(model.medians[f])) * F.lit(c)).alias("contribution"),
            )
            for f, c in model.coefficients.items()
        ]
    )
    ordered = F.array_sort(F.transform(parts, lambda p: F.struct((-F.abs(p["contribution"])).alias("k"), p["feature"].alias("feature"), F.round(p["contribution"], 6).alias("contribution"))))
    top = F.transform(F.slice(ordered, 1, 3), lambda p: F.struct(p["feature"], p["contribution"]))
    out = score(frame, model).withColumn("same_game_probability", F.round("same_game_probability", 6))
    return out.withColumns(
        {"model_name": F.lit(model_name), "model_version": F.lit(version), "decision": decision("same_game_probability"), "top_factors": top}
    )


def train_and_evaluate(frame: DataFrame, features: tuple[str, ...] = FEATURES, weights: dict[str, float] = LABEL_WEIGHTS) -> tuple[PairModel, DataFrame]:
    """(model, scored test rows) of a split by pair and label."""
    split = frame.withColumn("__test", held_out(F.col("pair_id"), F.col("label")))
    model = fit_model(split.where("not __test"), features, weights)
    return model, score(split.where("__test").drop("__test"), model)


def ablation(frame: DataFrame, weights: dict[str, float] = RESEARCH_WEIGHTS) -> DataFrame:
    """Test metrics with all features and without each group."""
    frame = Scratch(frame.sparkSession, "ablation").table(frame.select("pair_id", "label", "training_label_source", *FEATURES), "frame")
    out = None
    for name, excluded in [("all_features", ()), *((f"without_{g}", fs) for g, fs in FEATURE_GROUPS.items())]:
        kept = tuple(f for f in FEATURES if f not in excluded)
        _, tested = train_and_evaluate(frame, kept, weights)
        row = binary_metrics(tested).select(
            F.lit(name).alias("scenario"), F.lit(len(kept)).alias("feature_count"), F.lit(", ".join(sorted(excluded))).alias("excluded_features"), "precision", "recall", "f1", "roc_auc", "pr_auc"
        )
        out = row if out is None else out.unionByName(row)
    return out


def grouped_holdout(frame: DataFrame, weights: dict[str, float] = RESEARCH_WEIGHTS) -> DataFrame:
    """Test metrics with whole left entities held out; ``skipped`` when a part has one class."""
    frame = Scratch(frame.sparkSession, "holdout").table(frame, "frame")
    key = F.coalesce(F.concat_ws(":", "source_a", "source_id_a"), F.col("pair_id"))
    split = frame.withColumns({"__group": key, "__test": group_held_out(key)})
    sizes = split.groupBy("__test").agg(F.count("*").alias("rows"), F.count_distinct("__group").alias("groups"), F.count_distinct("label").alias("classes"))
    parts = {r["__test"]: r for r in sizes.collect()}  # two rows
    spark = frame.sparkSession
    if len(parts) < 2 or any(r.classes < 2 for r in parts.values()):
        return spark.createDataFrame([("skipped", "single-class train or test partition")], "status string, warning string")
    model = fit_model(split.where("not __test"), FEATURES, weights)
    metrics = binary_metrics(score(split.where("__test"), model))
    return metrics.select(
        F.lit("ok").alias("status"), F.lit(parts[False].rows).alias("train_row_count"), F.lit(parts[True].rows).alias("test_row_count"),
        F.lit(parts[False].groups).alias("train_group_count"), F.lit(parts[True].groups).alias("test_group_count"), "precision", "recall", "f1", "roc_auc", "pr_auc",
    )


def title_vectors(pairs: DataFrame, left: str = "name_a", right: str = "name_b") -> DataFrame:
    """Pairs with character, word and truncated-space TF-IDF cosines of their names, and year features.

    Names too few for a truncated space have their word cosine in its place.
    """
    char = tfidf_pair_cosine(pairs, left, right, padded_char_ngrams).select("pair_id", F.round("cosine", 6).alias("char_tfidf_cosine"))
    word = tfidf_pair_cosine(pairs, left, right, word_ngrams).select("pair_id", F.round("cosine", 6).alias("word_tfidf_cosine"))
    space = title_svd_cosine(pairs, left, right)
    rows = pairs.join(char, "pair_id").join(word, "pair_id")
    if space is None:
        rows = rows.withColumn("title_svd_cosine", F.col("word_tfidf_cosine"))
    else:
        rows = rows.join(space.select("pair_id", F.round("cosine", 6).alias("title_svd_cosine")), "pair_id")
    return rows.withColumns(
        {
            "release_year_abs_diff": F.abs("release_year_diff").cast("double"),
            "same_release_year": F.when(F.col("release_year_diff").isNotNull(), (F.col("release_year_diff") == 0).cast("int")),
        }
    )


def title_model_comparison(rows: DataFrame, label: str = "manual_label") -> DataFrame:
    """Test metrics of the title feature sets."""
    frame = Scratch(rows.sparkSession, "titles").table(rows.withColumn("label", F.col(label).cast("int")), "frame")
    out = None
    for name, features in FEATURE_SETS.items():
        _, tested = train_and_evaluate(frame, features, {})
        row = binary_metrics(tested).select(F.lit(name).alias("feature_set"), "precision", "recall", "f1", "roc_auc", "pr_auc", "brier_score")
        out = row if out is None else out.unionByName(row)
    return out


def usable_review_pairs(view: DataFrame) -> DataFrame:
    """Reviewed pairs whose names are neither hub ids nor numbers."""
    plain = lambda c: F.col(c).isNotNull() & (F.trim(c) != "") & ~F.col(c).rlike("^Q[0-9]+$") & ~F.col(c).rlike("^[0-9]+$")
    rows = view.where("review_status = 'reviewed' and review_label is not null").where(plain("name_a") & plain("name_b"))
    return rows.withColumn("manual_label", F.col("review_label").cast("int"))

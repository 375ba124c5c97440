"""Classifier metrics as aggregates: confusion, ROC and PR areas, Brier, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def labelled(frame: DataFrame) -> DataFrame:
    """``frame`` with a label; without one it is read from label_value ('1' or '0')."""
    if "label" in frame.columns:
        return frame
    if "label_value" not in frame.columns:
        return frame.withColumn("label", F.lit(None).cast("int"))
    return frame.withColumn("label", F.when(F.col("label_value") == "1", 1).when(F.col("label_value") == "0", 0))


def _by_score(frame: DataFrame, score: str, label: str) -> DataFrame:
    """Positives and negatives at each distinct score: as many rows as scores differ."""
    rows = frame.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    return rows.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.sum(F.col(label).cast("bigint")).alias("p"), F.sum(1 - F.col(label).cast("bigint")).alias("n")
    )


def ranking_areas(frame: DataFrame, score: str = "same_game_probability", label: str = "label") -> DataFrame:
    """(roc_auc, pr_auc): rank-sum area with ties averaged, and step-sum average precision.

    Null when only one class is there.  Scores are summed per distinct value
    first; the cumulative sums then run over two levels of buckets, so that no
    task orders all rows.
    """
    counts = _by_score(frame, score, label).withColumn("b", F.floor(F.col("s") * 4096))
    total = counts.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    per_bucket = counts.groupBy("b").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"))
    above = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)  # at most 4097 buckets for scores in [0, 1]
    per_bucket = per_bucket.select("b", F.coalesce(F.sum("bp").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("b").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    run = counts.join(per_bucket, "b").withColumns({"tp": F.col("p0") + F.sum("p").over(inside), "fp": F.col("n0") + F.sum("n").over(inside)})
    run = run.crossJoin(F.broadcast(total))  # one row
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    # A positive at this score beats every negative below it and half of those beside it.
    beaten = F.col("all_n") - F.col("fp") + F.col("n") / 2
    return run.agg(
        F.round(F.try_divide(F.sum(F.col("p") * beaten), F.first("all_p") * F.first("all_n")), 6).alias("roc_auc"),
        F.round(F.when(F.first("all_n") > 0, F.try_divide(F.sum(F.col("p") * precision), F.first("all_p"))), 6).alias("pr_auc"),
    )


def binary_metrics(
    frame: DataFrame, score: str = "same_game_probability", label: str = "label", threshold: float = 0.5, *, areas: bool = True
) -> DataFrame:
    """One row: confusion counts, precision, recall, F1 (0 where undefined), Brier score and areas."""
    rows = frame.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    yes, hit = F.col(label) == 1, F.col(score) >= threshold
    one = rows.agg(
        F.count("*").alias("row_count"),
        F.count_if(yes).alias("positive_label_count"),
        F.count_if(~yes).alias("negative_label_count"),
        F.count_if(yes & hit).alias("true_positive"),
        F.count_if(~yes & hit).alias("false_positive"),
        F.count_if(~yes & ~hit).alias("true_negative"),
        F.count_if(yes & ~hit).alias("false_negative"),
        F.round(F.avg((F.col(score) - F.col(label)) * (F.col(score) - F.col(label))), 6).alias("brier_score"),
    )
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    tp, fp, fn = F.col("true_positive"), F.col("false_positive"), F.col("false_negative")
    one = one.withColumns(
        {"precision": zero(F.try_divide(tp, tp + fp)), "recall": zero(F.try_divide(tp, tp + fn)), "f1": zero(F.try_divide(tp * 2, tp * 2 + fp + fn))}
    )
    single = (F.col("positive_label_count") == 0) | (F.col("negative_label_count") == 0)
    one = one.withColumn("warning", F.when(F.col("row_count") == 0, "no labeled predictions available").when(single, "single-class labeled predictions"))
    if areas:
        one = one.crossJoin(F.broadcast(ranking_areas(rows, score, label)))  # one row
        one = one.withColumns({c: F.when(~single, F.col(c)) for c in ("roc_auc", "pr_auc")})
    return one


def decision_rates(frame: DataFrame) -> DataFrame:
    """Shares of the three decisions over all rows."""
    share = lambda d: F.round(F.coalesce(F.try_divide(F.count_if(F.col("decision") == d), F.count("*")), F.lit(0.0)), 6)
    return frame.agg(*[share(d).alias(f"{d}_rate") for d in ("auto_merge", "manual_review", "no_merge")])


def er_metrics(predictions: DataFrame) -> DataFrame:
    """Metrics and decision rates of labelled predictions, in one row."""
    frame = labelled(predictions)
    return binary_metrics(frame).crossJoin(F.broadcast(decision_rates(frame)))  # one row each


def metrics_by(frame: DataFrame, column: str, score: str = "same_game_probability", label: str = "label", threshold: float = 0.5) -> DataFrame:
    """Confusion figures by a column's values, such as the label source."""
    yes, hit = F.col(label) == 1, F.col(score) >= threshold
    tp, fp, fn = F.count_if(yes & hit), F.count_if(~yes & hit), F.count_if(yes & ~hit)
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return frame.where(F.col(label).isNotNull()).groupBy(column).agg(
        F.count("*").alias("row_count"),
        F.count_if(yes).alias("positive_label_count"),
        F.count_if(~yes).alias("negative_label_count"),
        zero(F.try_divide(tp, tp + fp)).alias("precision"),
        zero(F.try_divide(tp, tp + fn)).alias("recall"),
        zero(F.try_divide(tp * 2, tp * 2 + fp + fn)).alias("f1"),
    )


def calibration_bins(frame: DataFrame, score: str = "same_game_probability", label: str = "label", bins: int = 10) -> DataFrame:
    """Equal-width bins of the score, the last one closed: rows, mean score, positive rate."""
    spark = frame.sparkSession
    every = spark.range(bins).select(F.col("id").cast("int").alias("k"))
    rows = frame.where(F.col(label).isNotNull() & F.col(score).between(0, 1))
    got = rows.groupBy(F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int").alias("k")).agg(
        F.count("*").alias("n"), F.round(F.avg(score), 6).alias("avg_probability"), F.round(F.avg(F.col(label).cast("double")), 6).alias("positive_rate")
    )
    name = F.format_string("%.1f-%.1f", F.col("k") / bins, (F.col("k") + 1) / bins)
    return every.join(got, "k", "left").select(name.alias("bin"), F.coalesce("n", F.lit(0)).alias("row_count"), "avg_probability", "positive_rate")


def score_distribution(frame: DataFrame, score: str = "same_game_probability", label: str = "label") -> DataFrame:
    """Least, tenth, middle, ninetieth and greatest score by label, interpolated."""
    q = F.percentile(score, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    rows = frame.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("int").alias("label"))
    got = rows.agg(F.count(score).alias("row_count"), F.min(score).alias("lo"), q.alias("q"), F.max(score).alias("hi"))
    return got.select("label", "row_count", F.round("lo", 6).alias("min"), *[F.round(F.get("q", F.lit(i)), 6).alias(n) for i, n in enumerate(("p10", "median", "p90"))], F.round("hi", 6).alias("max"))


def tenths(value: Column) -> Column:
    """Bucket text of a value in [0, 1): ``0.1-0.2``; ``1.0`` from one on."""
    low = F.floor(value * 10)
    return F.when(value >= 1, F.lit("1.0")).otherwise(F.format_string("%.1f-%.1f", low / 10, (low + 1) / 10))


def similarity_histogram(frame: DataFrame, column: str) -> DataFrame:
    """Rows by tenth of a similarity."""
    return frame.where(F.col(column).isNotNull()).groupBy(tenths(F.col(column)).alias("bucket")).agg(F.count("*").alias("pair_count"))


def error_cases(frame: DataFrame, score: str, label: str = "manual_label", limit: int = 50) -> DataFrame:
    """Reviewed negatives with high scores and reviewed positives with low ones."""
    high = frame.where((F.col(label) == 0) & (F.col(score) >= 0.70)).orderBy(F.desc(score), "pair_id").limit(limit)
    low = frame.where((F.col(label) == 1) & (F.col(score) < 0.50)).orderBy(score, "pair_id").limit(limit)
    return high.select(F.lit("reviewed_negative_high_embedding_probability").alias("case_type"), "*").unionByName(
        low.select(F.lit("reviewed_positive_low_embedding_probability").alias("case_type"), "*")
    )


def threshold_sweep(frame: DataFrame, score: str, label: str, thresholds: tuple[float, ...]) -> DataFrame:
    """Confusion figures at several thresholds in one pass."""
    out = frame.where(F.col(label).isNotNull()).withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    yes, hit = F.col(label) == 1, F.col(score) >= F.col("threshold")
    tp, fp, fn = F.count_if(yes & hit), F.count_if(~yes & hit), F.count_if(yes & ~hit)
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return out.groupBy("threshold").agg(
        zero(F.try_divide(tp, tp + fp)).alias("precision"), zero(F.try_divide(tp, tp + fn)).alias("recall"), zero(F.try_divide(tp * 2, tp * 2 + fp + fn)).alias("f1"), F.count_if(hit).alias("positive_predictions")
    )

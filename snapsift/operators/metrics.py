"""Ranking metrics of scores against 0/1 labels, per (dataset, algorithm, ...).

Input rows are ``(by columns, score, y)``. Scores are grouped by value before anything is
ranked, and running counts of large groups are spread over tasks.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.running import WINDOW_ROWS, running_totals
from ..functions.runtime import settle, store
from ..functions.skew import skew_lookup, small_side
from .ensemble import is_finite

BY = ["dataset", "algorithm"]
ALPHA = 0.05

# What an unusable score column is reported as.
ONE_CLASS = "no meaningful labels"
ALL_INFINITE = "all infinity predictions"
ALL_MISSING = "missing predictions"


def score_profile(scores: DataFrame, by: list[str] = BY) -> DataFrame:
    """One row per group: counts, finite range, repair mean and error."""
    s = F.col("score")
    finite = is_finite(s)
    infinite = s.isNotNull() & ~F.isnan(s) & ~finite
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    grouped = scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("long")).alias("n_pos"),
        F.min(F.when(finite, s)).alias("lo"), F.max(F.when(finite, s)).alias("hi"),
        F.sum(F.when(finite, s)).alias("_sum"), count(finite).alias("_fin"),
        count(infinite & (s > 0)).alias("_up"), count(infinite & (s < 0)).alias("_down"),
    )
    mean = (F.col("_sum") + F.col("_up") * F.col("hi") + F.col("_down") * F.col("lo")) / (
        F.col("_fin") + F.col("_up") + F.col("_down")
    )
    error = (
        F.when((F.col("n_pos") == 0) | (F.col("n_pos") == F.col("n")), ONE_CLASS)
        .when(F.col("_up") + F.col("_down") == F.col("n"), ALL_INFINITE)
        .when(F.col("_fin") == 0, ALL_MISSING)
    )
    return grouped.select(
        *by, "n", "n_pos", "lo", "hi", F.when(F.col("_fin") > 0, mean).alias("mean"), error.alias("error")
    )


def clean_scores(scores: DataFrame, by: list[str] = BY, profile: DataFrame | None = None) -> DataFrame:
    """Infinite scores to the finite extremes, missing ones to the mean; adds ``error``."""
    profile = profile if profile is not None else settle(score_profile(scores, by))
    total = profile.agg(F.sum("n")).first()[0] or 0
    side = profile.select(*by, F.col("n").alias("_w"), "lo", "hi", "mean", "error")
    s = F.col("score")
    repaired = (
        F.when(s.isNull() | F.isnan(s), F.col("mean"))
        .when(is_finite(s), s).when(s > 0, F.col("hi")).otherwise(F.col("lo"))
    )
    return skew_lookup(scores, side, by, "_w", total).withColumn("score", repaired).drop("lo", "hi", "mean")


def ranking_sums(
    cleaned: DataFrame, profile: DataFrame, by: list[str], largest: int, window_rows: int = WINDOW_ROWS
) -> DataFrame:
    """AUROC and average precision of each group; ``profile`` is settled."""
    counts = cleaned.groupBy(*by, "score").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("long")).alias("pos")
    )
    running = running_totals(counts, by, "score", {"cn": "n", "cp": "pos"}, largest, window_rows)
    totals = profile.select(*by, F.col("n").alias("all_n"), F.col("n_pos").alias("all_pos"))
    joined = running.join(small_side(totals), by)
    below = (F.col("cn") - F.col("n")) - (F.col("cp") - F.col("pos"))
    wins = F.col("pos") * (below + (F.col("n") - F.col("pos")) / 2)
    hits = F.col("all_pos") - F.col("cp") + F.col("pos")
    seen = F.col("all_n") - F.col("cn") + F.col("n")
    pairs = F.first("all_pos") * (F.first("all_n") - F.first("all_pos"))
    return joined.groupBy(*by).agg(
        F.try_divide(F.sum(wins), pairs.cast("double")).alias("auroc"),
        F.try_divide(F.sum(F.col("pos") * (hits / seen)), F.first("all_pos").cast("double")).alias("aupr"),
    )


def ci_bounds(auroc: Column, n_pos: Column, n_neg: Column, alpha: float = ALPHA) -> tuple[Column, Column]:
    """Hanley–McNeil normal interval, clipped to [0, 1]."""
    z = NormalDist().inv_cdf(1 - alpha / 2)
    q1 = auroc / (2 - auroc)
    q2 = 2 * auroc * auroc / (1 + auroc)
    variance = (
        auroc * (1 - auroc) + (n_pos - 1) * (q1 - auroc * auroc) + (n_neg - 1) * (q2 - auroc * auroc)
    ) / (n_pos * n_neg)
    half = z * F.sqrt(F.greatest(variance, F.lit(0.0)))
    return F.greatest(auroc - half, F.lit(0.0)), F.least(auroc + half, F.lit(1.0))


def auroc(scores: DataFrame, by: list[str] = BY, **limits) -> DataFrame:
    return _metrics(scores, by, **limits).select(*by, "auroc")


def average_precision(scores: DataFrame, by: list[str] = BY, **limits) -> DataFrame:
    return _metrics(scores, by, **limits).select(*by, "aupr")


def auroc_ci(scores: DataFrame, alpha: float = ALPHA, by: list[str] = BY, **limits) -> DataFrame:
    lower, upper = ci_bounds(F.col("auroc"), F.col("n_pos"), F.col("n") - F.col("n_pos"), alpha)
    return _metrics(scores, by, **limits).select(
        *by, "auroc", lower.alias("auroc_lower"), upper.alias("auroc_upper")
    )


def auroc_ci_corrected(scores: DataFrame, algorithms: int, by: list[str] = BY, **limits) -> DataFrame:
    """Interval at alpha over the number of compared algorithms (Bonferroni)."""
    return auroc_ci(scores, ALPHA / algorithms, by, **limits)


def anomaly_profile(records: DataFrame) -> DataFrame:
    """Size, width and label share of each dataset of records."""
    return records.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.max(F.size("features")).cast("long").alias("num_columns"),
        F.sum(F.col("y").cast("long")).alias("num_anomalies"),
        F.avg(F.col("y").cast("double")).alias("anomaly_proportion"),
    )


def _metrics(scores: DataFrame, by: list[str], window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Profile of each group joined to its metrics; groups with an error have none."""
    profile = settle(score_profile(scores, by))
    largest = profile.agg(F.max("n")).first()[0] or 0
    cleaned = clean_scores(scores, by, profile).filter(F.col("error").isNull())
    return profile.join(ranking_sums(cleaned, profile, by, largest, window_rows), by, "left")


def evaluate_scores(
    scores: DataFrame, records: DataFrame, algorithms: int, by: list[str] = ("dataset", "algorithm", "params")
) -> DataFrame:
    """Comparison rows: one per dataset, algorithm and parameters.

    ``scores`` and ``records`` meet on (dataset, rec_id), which is unique in ``records``. They meet once:
    the labelled scores are stored, because they are read for their profile and for their ranking.
    """
    by = list(by)
    labelled = store(scores.join(records.select("dataset", "rec_id", "y"), ["dataset", "rec_id"]).select(*by, "score", "y"))
    metrics = _metrics(labelled, by)
    lower, upper = ci_bounds(F.col("auroc"), F.col("n_pos"), F.col("n") - F.col("n_pos"))
    low_c, up_c = ci_bounds(F.col("auroc"), F.col("n_pos"), F.col("n") - F.col("n_pos"), ALPHA / algorithms)
    rows = metrics.select(
        *by, "auroc", lower.alias("auroc_lower"), upper.alias("auroc_upper"),
        low_c.alias("auroc_lower_corrected"), up_c.alias("auroc_upper_corrected"), "aupr", "error",
    )
    return anomaly_profile(records).join(rows, "dataset")

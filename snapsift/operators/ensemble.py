"""Score transforms and ensembles over ``(dataset, rec_id, algorithm, score)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import settle
from ..functions.skew import skew_lookup, small_side

BY = ["dataset", "algorithm"]


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def score_bounds(scores: DataFrame) -> DataFrame:
    """Rows and finite range of each (dataset, algorithm); one row each."""
    finite = F.when(is_finite(F.col("score")), F.col("score"))
    return scores.groupBy(*BY).agg(
        F.count(F.lit(1)).alias("n"), F.min(finite).alias("lo"), F.max(finite).alias("hi")
    )


def _with_bounds(scores: DataFrame) -> DataFrame:
    bounds = settle(score_bounds(scores))
    total = bounds.agg(F.sum("n")).first()[0] or 0
    return skew_lookup(scores, bounds.withColumnRenamed("n", "_w"), BY, "_w", total)


def _clipped() -> Column:
    s = F.col("score")
    kept = F.when(F.isnan(s), s).otherwise(F.greatest(F.least(s, F.col("hi")), F.col("lo")))
    return F.when(F.col("lo").isNull(), F.lit(0.0)).otherwise(kept)


def prune_inf(scores: DataFrame) -> DataFrame:
    """Clip to the finite range of the (dataset, algorithm); without one, zero."""
    return _with_bounds(scores).withColumn("score", _clipped()).drop("lo", "hi")


def minmax_scores(scores: DataFrame) -> DataFrame:
    """Pruned scores rescaled to [0, 1]; constant scores become zero."""
    clipped = _clipped()
    width = F.col("hi") - F.col("lo")
    scaled = F.when(F.isnan(clipped), clipped).otherwise(
        F.coalesce(F.try_divide(clipped - F.col("lo"), width), F.lit(0.0))
    )
    return _with_bounds(scores).withColumn("score", scaled).drop("lo", "hi")


def mean_scores(scores: DataFrame) -> DataFrame:
    """Mean over algorithms per record, missing scores skipped."""
    return scores.groupBy("dataset", "rec_id").agg(
        F.avg(F.nanvl("score", F.lit(None).cast("double"))).alias("score")
    )


def naive_ensemble(scores: DataFrame) -> DataFrame:
    return mean_scores(prune_inf(scores))


def probabilistic_ensemble(scores: DataFrame) -> DataFrame:
    return mean_scores(minmax_scores(scores))


def topk_ensemble(scores: DataFrame, chosen: DataFrame) -> DataFrame:
    """Mean rescaled score of the settings in ``chosen`` (dataset, algorithm)."""
    return probabilistic_ensemble(scores.join(small_side(chosen.select(*BY)), BY, "left_semi"))


def selected_model_scores(scores: DataFrame, best: DataFrame) -> DataFrame:
    """Scores of the one setting chosen for each dataset."""
    return scores.join(small_side(best.select(*BY)), BY, "left_semi").select("dataset", "rec_id", "score")

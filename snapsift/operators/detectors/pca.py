"""Principal-component outlier score (Shyu et al. 2003)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ...functions.models import feature_stats, fold_arrays, score_with_models
from ...functions.runtime import settle

SMALLEST_VARIANCE = 1e-9


def standardise(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """z-scores of the features that vary."""
    varies = sd > 0
    return (x[:, varies] - mean[varies]) / sd[varies]


def correlations(records: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Per-dataset statistics with the flat correlation matrix of varying features.

    Standardising before summing products keeps the sums accurate; each part of a
    dataset contributes one d x d partial.
    """
    stats = stats if stats is not None else feature_stats(records)

    def products(x, model):
        z = standardise(x, model["mean"], model["sd"])
        return z.T @ z / model["n"]

    totals = fold_arrays(records, stats, products)
    return settle(stats.join(totals.withColumnRenamed("total", "corr"), "dataset", "left"))


def whitening(corr: np.ndarray, d: int) -> np.ndarray:
    """Matrix whose product with z-scores has the score as squared row length."""
    values, vectors = np.linalg.eigh(np.asarray(corr, dtype=float).reshape(d, d))
    kept = values > SMALLEST_VARIANCE
    return vectors[:, kept] / np.sqrt(values[kept])


def fit_pca(records: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Model row per dataset; the d x d eigen step runs in one task per dataset."""
    models = correlations(records, stats)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        d = int((np.asarray(row["sd"]) > 0).sum())
        axes = whitening(row["corr"], d).ravel() if d else np.empty(0)
        return pd.DataFrame({
            "dataset": [row["dataset"]], "n": [row["n"]], "mean": [row["mean"]], "sd": [row["sd"]], "axes": [axes],
        })

    schema = "dataset string, n long, mean array<double>, sd array<double>, axes array<double>"
    return settle(models.groupBy("dataset").applyInPandas(solve, schema))


def score_pca(records: DataFrame, **limits) -> DataFrame:
    """Sum of squared component scores over their variances, all components."""

    def score(x, model):
        z = standardise(x, model["mean"], model["sd"])
        if not z.shape[1] or not len(model["axes"]):
            return np.zeros(len(x))
        return ((z @ model["axes"].reshape(z.shape[1], -1)) ** 2).sum(axis=1)

    return score_with_models(records, fit_pca(records), score, **limits)

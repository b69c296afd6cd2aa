"""Histogram-based outlier score (Goldstein & Dengel 2012)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.models import feature_stats, fold_arrays, score_settings
from ...functions.runtime import settle


def bin_of(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, n_bins: int) -> np.ndarray:
    """Equal-width bin of each value; a feature without width has bin 0."""
    width = (hi - lo) / n_bins
    safe = np.where(width > 0, width, 1.0)
    return np.clip(np.floor((x - lo) / safe), 0, n_bins - 1).astype(np.int64)


def bin_counts(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, n_bins: int) -> np.ndarray:
    """Counts as a flat (feature, bin) array."""
    d = x.shape[1]
    flat = bin_of(x, lo, hi, n_bins) + np.arange(d) * n_bins
    return np.bincount(flat.ravel(), minlength=d * n_bins).astype(np.float64)


def fit_histograms(records: DataFrame, bins: list[int], stats: DataFrame | None = None) -> DataFrame:
    """Model row per dataset with all histograms of ``bins`` one after the other.

    One pass for the ranges, one for the counts; parts of a dataset are counted in place
    and only counts are shuffled.
    """
    stats = stats if stats is not None else feature_stats(records)

    def counts(x, model):
        return np.concatenate([bin_counts(x, model["lo"], model["hi"], b) for b in bins])

    totals = fold_arrays(records, stats, counts)
    return settle(stats.join(totals.withColumnRenamed("total", "counts"), "dataset"))


def setting_name(n_bins: int, alpha: float) -> str:
    return f"HBOS(alpha={alpha}, n_bins={n_bins})"


def score_hbos_settings(records: DataFrame, settings: list[tuple[int, float]], **limits) -> DataFrame:
    """Scores of many ``(n_bins, alpha)`` from one fit."""
    bins = sorted({b for b, _ in settings})
    models = fit_histograms(records, bins)

    def score(x, model):
        lo, hi, n, d = model["lo"], model["hi"], model["n"], x.shape[1]
        flat, density, start = {}, {}, 0
        for b in bins:
            counts = model["counts"][start : start + d * b].reshape(d, b)
            width = ((hi - lo) / b)[:, None]
            density[b] = np.where(width > 0, counts / (n * np.where(width > 0, width, 1.0)), np.nan).ravel()
            flat[b] = bin_of(x, lo, hi, b) + np.arange(d) * b
            start += d * b
        out = np.empty((len(x), len(settings)))
        for i, (b, alpha) in enumerate(settings):
            # a feature without width adds nothing
            terms = np.nan_to_num(-np.log2(density[b] + alpha), nan=0.0)
            out[:, i] = terms[flat[b]].sum(axis=1)
        return out

    return score_settings(records, models, score, [setting_name(*s) for s in settings], **limits)


def score_hbos(records: DataFrame, n_bins: int = 10, alpha: float = 0.1, **limits) -> DataFrame:
    return score_hbos_settings(records, [(n_bins, alpha)], **limits).select("dataset", "rec_id", "score")

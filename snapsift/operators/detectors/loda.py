"""Lightweight on-line detector of anomalies (Pevny 2016), batch form."""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.models import dataset_sizes, fold_arrays, gather, map_with_models, score_settings
from ...functions.runtime import settle
from .hbos import bin_counts, bin_of


def _uniform(cut: int, pos: int, use: str) -> float:
    """Number in (0, 1) from the first 32 bits of md5("cut:pos:use")."""
    head = hashlib.md5(f"{cut}:{pos}:{use}".encode()).hexdigest()[:8]
    return (int(head, 16) + 0.5) / 2**32


@lru_cache(maxsize=64)
def projections(d: int, n_cuts: int) -> np.ndarray:
    """``d x n_cuts`` sparse weights: each cut uses ceil(sqrt d) features, normal weights."""
    used = math.ceil(math.sqrt(d))
    out = np.zeros((d, n_cuts))
    for cut in range(n_cuts):
        order = sorted(range(d), key=lambda p: (_uniform(cut, p, "pick"), p))
        for p in order[:used]:
            radius = math.sqrt(-2 * math.log(_uniform(cut, p, "r")))
            out[p, cut] = radius * math.cos(2 * math.pi * _uniform(cut, p, "a"))
    return out


def fit_loda(records: DataFrame, bins: list[int], n_cuts: int) -> DataFrame:
    """Model row per dataset: range of every cut and all histograms of ``bins``."""
    sizes = settle(dataset_sizes(records))

    def ranges(part, x, model):
        z = x @ projections(x.shape[1], n_cuts)
        return pd.DataFrame({"dataset": [part["dataset"].iloc[0]], "lo": [z.min(axis=0)], "hi": [z.max(axis=0)]})

    parts = map_with_models(records, sizes, ranges, "dataset string, lo array<double>, hi array<double>")
    zipped = parts.select("dataset", F.posexplode(F.arrays_zip("lo", "hi")).alias("pos", "r"))
    limits = gather(
        zipped.groupBy("dataset", "pos").agg(F.min("r.lo").alias("lo"), F.max("r.hi").alias("hi")),
        {"lo": "lo", "hi": "hi"},
    )
    ranged = settle(sizes.join(limits, "dataset"))

    def counts(x, model):
        z = x @ projections(x.shape[1], n_cuts)
        return np.concatenate([bin_counts(z, model["lo"], model["hi"], b) for b in bins])

    totals = fold_arrays(records, ranged, counts)
    return settle(ranged.join(totals.withColumnRenamed("total", "counts"), "dataset"))


def setting_name(n_bins: int, n_cuts: int) -> str:
    return f"LODA(n_bins={n_bins}, n_random_cuts={n_cuts})"


def score_loda_settings(records: DataFrame, settings: list[tuple[int, int]], **limits) -> DataFrame:
    """Scores of many ``(n_bins, n_random_cuts)``; fewer cuts are a prefix of more."""
    bins, most = sorted({b for b, _ in settings}), max(c for _, c in settings)
    models = fit_loda(records, bins, most)

    def score(x, model):
        z = x @ projections(x.shape[1], most)
        running, start = {}, 0
        for b in bins:
            share = model["counts"][start : start + most * b] / model["n"]
            flat = bin_of(z, model["lo"], model["hi"], b) + np.arange(most) * b
            with np.errstate(divide="ignore"):
                running[b] = np.cumsum(-np.log(share)[flat], axis=1)
            start += most * b
        return np.column_stack([running[b][:, c - 1] / c for b, c in settings])

    return score_settings(records, models, score, [setting_name(*s) for s in settings], **limits)


def score_loda(records: DataFrame, n_bins: int = 10, n_random_cuts: int = 100, **limits) -> DataFrame:
    scores = score_loda_settings(records, [(n_bins, n_random_cuts)], **limits)
    return scores.select("dataset", "rec_id", "score")

"""Score many detectors or settings at once over shared intermediate results."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hbos, iforest, loda, neighbors, ocsvm
from .ecod import score_ecod
from .pca import score_pca

#: Name -> function(records, **params) -> (dataset, rec_id, score). Extend it to add a detector.
DETECTORS = {
    "ECOD": score_ecod,
    "IForest": iforest.score_iforest,
    "KNN": neighbors.score_knn,
    "LOF": neighbors.score_lof,
    "PCA": score_pca,
    "HBOS": hbos.score_hbos,
    "LODA": loda.score_loda,
    "ABOD": neighbors.score_abod,
    "COF": neighbors.score_cof,
    "OCSVM": ocsvm.score_ocsvm,
}

# The compared line-up, all with default parameters.
DEFAULT_GRID = {name: {} for name in ("ECOD", "IForest", "KNN", "LOF", "PCA", "HBOS")}

# Parameter lists of the candidate pool (302 settings).
POOL = {
    "LODA": {"n_bins": [5, 10, 15, 20, 25, 30], "n_random_cuts": [10, 20, 30, 40, 50, 75, 100, 150, 200]},
    "ABOD": {"n_neighbors": [3, 5, 10, 15, 20, 25, 50, 60, 75, 80, 90, 100]},
    "IForest": {
        "n_estimators": [10, 20, 30, 40, 50, 75, 100, 150, 200],
        "max_features": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
    },
    "KNN": {
        "method": ["largest", "mean", "median"],
        "n_neighbors": [1, 5, 10, 15, 20, 25, 50, 60, 70, 80, 90, 100],
    },
    "LOF": {
        "metric": ["manhattan", "euclidean", "minkowski"],
        "n_neighbors": [1, 5, 10, 15, 20, 25, 50, 60, 70, 80, 90, 100],
    },
    "HBOS": {"n_bins": [5, 10, 20, 30, 40, 50, 75, 100], "alpha": [0.1, 0.2, 0.3, 0.4, 0.5]},
    "OCSVM": {
        "kernel": ["linear", "poly", "rbf", "sigmoid"],
        "nu": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
    },
    "COF": {"n_neighbors": [3, 5, 10, 15, 20, 25, 50]},
}


def combinations(grid: dict[str, list]) -> list[dict]:
    """All combinations of the parameter lists; no lists give one default setting."""
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def settings_of(name: str, pool: dict) -> list[dict]:
    return combinations(pool[name]) if name in pool else []


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def score_candidate_pool(records: DataFrame, pool: dict = POOL, **limits) -> DataFrame:
    """``(dataset, rec_id, algorithm, score)`` for every setting of the pool.

    One histogram pass serves all HBOS settings, one forest per feature share all forest
    sizes, one neighbour graph at the largest k all KNN, ABOD, COF and euclidean LOF
    settings, a second one manhattan LOF.
    """
    parts = []
    got = {name: settings_of(name, pool) for name in POOL}
    if got["LODA"]:
        parts.append(loda.score_loda_settings(records, [(s["n_bins"], s["n_random_cuts"]) for s in got["LODA"]], **limits))
    if got["IForest"]:
        parts.append(iforest.score_iforest_settings(
            records, [(s["n_estimators"], s["max_features"]) for s in got["IForest"]], **limits))
    if got["HBOS"]:
        parts.append(hbos.score_hbos_settings(records, [(s["n_bins"], s["alpha"]) for s in got["HBOS"]], **limits))
    if got["OCSVM"]:
        parts.append(ocsvm.score_ocsvm_settings(records, [(s["nu"], s["kernel"]) for s in got["OCSVM"]], **limits))
    plain = [s["n_neighbors"] for n in ("KNN", "ABOD", "COF") for s in got[n]]
    plain += [s["n_neighbors"] for s in got["LOF"] if s["metric"] != "manhattan"]
    if plain:
        graph = neighbors.knn_points(records, max(plain))
        if got["KNN"]:
            chosen = [(s["n_neighbors"], s["method"]) for s in got["KNN"]]
            parts.append(neighbors.explode_scores(
                neighbors.knn_scores(graph, chosen), graph, [neighbors.knn_setting(*s) for s in chosen]))
        for name, fn, label in (
            ("ABOD", neighbors.abod_scores, neighbors.abod_setting),
            ("COF", neighbors.cof_scores, neighbors.cof_setting),
        ):
            ks = [s["n_neighbors"] for s in got[name]]
            if ks:
                parts.append(neighbors.explode_scores(fn(graph, ks), graph, [label(k) for k in ks]))
        parts += _lof_parts(graph, [s for s in got["LOF"] if s["metric"] != "manhattan"])
    far = [s for s in got["LOF"] if s["metric"] == "manhattan"]
    if far:
        graph = neighbors.knn_points(records, max(s["n_neighbors"] for s in far), "manhattan")
        parts += _lof_parts(graph, far)
    return _union(parts)


def _lof_parts(graph, settings: list[dict]) -> list[DataFrame]:
    """Settings with the same k share one computation, whatever their metric is called."""
    if not settings:
        return []
    ks = sorted({s["n_neighbors"] for s in settings})
    scored = neighbors.to_records(neighbors.lof_scores(graph, ks), graph, ["scores"])
    named = [
        F.struct(
            F.lit(neighbors.lof_setting(s["n_neighbors"], s["metric"])).alias("algorithm"),
            F.get("scores", F.lit(ks.index(s["n_neighbors"]))).alias("score"),
        )
        for s in settings
    ]
    return [scored.select("dataset", "rec_id", F.inline(F.array(*named)))]


def params_text(params: dict) -> str:
    return ", ".join(f"{k}={params[k]}" for k in sorted(params))


def score_all(records: DataFrame, grid: dict[str, dict[str, list]] = DEFAULT_GRID) -> DataFrame:
    """``(dataset, rec_id, algorithm, params, score)`` of every combination in the grid.

    KNN and LOF settings with the same distance read one neighbour graph.
    """
    graph = None
    lists = {n: combinations(g) for n, g in grid.items()}
    ks = [s.get("k", 5) for s in lists.get("KNN", [])]
    ks += [s.get("k", 20) for s in lists.get("LOF", []) if s.get("metric") != "manhattan"]
    if ks:
        graph = neighbors.knn_points(records, max(ks))
    parts = []
    for name, settings in lists.items():
        for params in settings:
            shared = {}
            if name in ("KNN", "LOF") and params.get("metric") != "manhattan":
                shared = {"graph": graph}
            scored = DETECTORS[name](records, **params, **shared)
            parts.append(scored.select(
                "dataset", "rec_id", F.lit(name).alias("algorithm"),
                F.lit(params_text(params)).alias("params"), "score",
            ))
    return _union(parts)

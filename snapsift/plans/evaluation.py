"""Evaluation runs: detectors against labels, selection strategies against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import settle
from ..functions.skew import small_side
from ..operators import ensemble, metrics, selector
from ..operators.detectors import pool
from ..operators.rank_selector import fit_rank_selector
from .study import union_all


def evaluate_detectors(records: DataFrame, grid: dict = pool.DEFAULT_GRID) -> DataFrame:
    """Comparison rows of every setting of the grid on every dataset."""
    settings = sum(len(pool.combinations(g)) for g in grid.values())
    scores = settle(pool.score_all(records, grid))
    return metrics.evaluate_scores(scores, records, settings)


def score_with_selector(
    records: DataFrame, selectors: list, scores: DataFrame | None = None,
    metafeatures: DataFrame | None = None, k: int = 1, grid: dict = pool.DEFAULT_GRID,
) -> DataFrame:
    """Scores of the chosen setting(s), for all datasets in one batch.

    The choice comes first: without given ``scores``, each detector runs only on the datasets
    that chose it. Meta-features are computed when they are not given.
    """
    if metafeatures is None:
        metafeatures = selector.meta_features(records)
    chosen = settle(selector.top_models(selector.predict_performance(selectors, metafeatures), k))
    if scores is None:
        scores = score_chosen(records, chosen, grid)
    if k == 1:
        return ensemble.selected_model_scores(scores, chosen)
    return ensemble.topk_ensemble(scores, chosen)


def score_chosen(records: DataFrame, chosen: DataFrame, grid: dict = pool.DEFAULT_GRID) -> DataFrame:
    """``(dataset, rec_id, algorithm, score)`` of the chosen (dataset, algorithm) pairs."""
    names = [r[0] for r in chosen.select("algorithm").distinct().orderBy("algorithm").collect()]  # algorithms of the grid
    parts = []
    for name in names:
        datasets = small_side(settle(chosen.filter(F.col("algorithm") == name).select("dataset").distinct()))
        own = settle(records.join(datasets, "dataset", "left_semi"))
        parts.append(pool.score_all(own, {name: grid[name]}).drop("params"))
    if not parts:
        return records.sparkSession.createDataFrame([], "dataset string, rec_id long, algorithm string, score double")
    return union_all(parts)


def evaluate_selection(
    records: DataFrame, training: tuple[DataFrame, DataFrame], pretrained: list | None = None,
    k: int = 3, grid: dict = pool.DEFAULT_GRID, metafeatures: DataFrame | None = None, retrained: list | None = None,
) -> DataFrame:
    """Compare the best single detector, two selectors, two ensembles and a top-k ensemble.

    ``training`` is (meta-features, comparisons) of other trials, from which a selector is fitted unless
    ``retrained`` ones are given. ``pretrained`` are selectors fitted elsewhere; without them that
    line-up entry is left out. ``metafeatures`` of the records are computed when not given.
    """
    scores = settle(pool.score_all(records, grid).drop("params"))
    names = list(grid)
    retrained = retrained or [fit_rank_selector(*training, names)]
    cells = settle(selector.meta_features(records) if metafeatures is None else metafeatures)
    lines = {"IForest": scores.filter(F.col("algorithm") == "IForest").select("dataset", "rec_id", "score")}
    if pretrained:
        lines["Selector(pretrained)"] = score_with_selector(records, pretrained, scores, cells)
    lines["Selector(retrained)"] = score_with_selector(records, retrained, scores, cells)
    lines["NaiveEnsemble"] = ensemble.naive_ensemble(scores)
    lines["ProbabilisticEnsemble"] = ensemble.probabilistic_ensemble(scores)
    lines[f"SelectorTopK(retrained, k={k})"] = score_with_selector(records, retrained, scores, cells, k)
    tagged = union_all([
        df.select("dataset", "rec_id", "score", F.lit(name).alias("algorithm"), F.lit("").alias("params"))
        for name, df in lines.items()
    ])
    return metrics.evaluate_scores(settle(tagged), records, len(lines))

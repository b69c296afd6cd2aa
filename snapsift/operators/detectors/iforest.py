"""Isolation forest (Liu et al. 2008)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ...functions.models import dataset_sizes, score_settings
from ...functions.runtime import settle, spread
from ...functions.skew import skew_lookup

SAMPLE_ROWS = 256
EULER = 0.5772156649015329
_GRID = 1 << 30


def path_adjustment(m: np.ndarray | float) -> np.ndarray:
    """Mean path length c(m) of an unsuccessful search among m records."""
    m = np.asarray(m, dtype=float)
    harmonic = np.log(np.maximum(m - 1, 1)) + EULER
    return np.where(m > 2, 2 * harmonic - 2 * (m - 1) / np.maximum(m, 1), np.where(m == 2, 1.0, 0.0))


def tree_samples(records: DataFrame, sizes: DataFrame, total: int, n_trees: int, seed: int) -> DataFrame:
    """``(dataset, tree, rec_id, features)``: a seeded sample of up to 256 records per tree.

    A record enters a tree's draw when its hash is below a rate that leaves a little more
    than the sample, and the smallest hashes win: what is sorted does not grow with the
    dataset.
    """
    located = skew_lookup(
        records.select("dataset", "rec_id", "features"),
        sizes.select("dataset", F.col("n").alias("_n"), F.col("n").alias("_w")),
        ["dataset"], "_w", total, "inner",
    )
    wanted = SAMPLE_ROWS + 8 * math.sqrt(SAMPLE_ROWS)
    rate = F.least(F.lit(1.0), F.lit(wanted) / F.col("_n"))

    def draw(*of):
        return F.pmod(F.xxhash64(F.col("rec_id"), *of, F.lit(seed)), F.lit(_GRID)) / F.lit(float(_GRID))

    # one hash tells whether a record may enter any tree; only those are tried tree by tree,
    # at a rate that gives each record the same chance in each tree
    some = F.least(F.lit(1.0), rate * n_trees)
    trees = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: draw(t) < rate / some)
    drawn = located.filter(draw(F.lit(-1)) < some).select("dataset", "rec_id", "features", F.explode(trees).alias("tree"))
    order = W.partitionBy("dataset", "tree").orderBy(F.xxhash64("rec_id", "tree", F.lit(seed)), "rec_id")
    return (
        drawn.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= SAMPLE_ROWS).drop("_r")
    )


def grow_tree(x: np.ndarray, features: np.ndarray, rng: np.random.Generator):
    """Nodes as arrays: feature (-1 for a leaf), threshold, left child, path length."""
    depth_limit = math.ceil(math.log2(max(len(x), 2)))
    feature, threshold, left, length = [-1], [0.0], [0], [0.0]
    work = [(0, np.arange(len(x)), 0)]
    while work:
        node, rows, depth = work.pop()
        part = x[rows][:, features]
        spread = part.max(axis=0) - part.min(axis=0) if len(rows) else np.zeros(len(features))
        usable = np.flatnonzero(spread > 0)
        if depth >= depth_limit or len(rows) <= 1 or not len(usable):
            length[node] = depth + float(path_adjustment(len(rows)))
            continue
        pick = rng.choice(usable)
        column = part[:, pick]
        cut = rng.uniform(column.min(), column.max())
        feature[node], threshold[node], left[node] = int(features[pick]), float(cut), len(feature)
        for side, chosen in enumerate((column <= cut, column > cut)):
            feature.append(-1), threshold.append(0.0), left.append(0), length.append(0.0)
            work.append((left[node] + side, rows[chosen], depth + 1))
    return np.array(feature, float), np.array(threshold), np.array(left, float), np.array(length)


def fit_forest(
    records: DataFrame, n_trees: int, max_features: list[float], seed: int
) -> DataFrame:
    """One model row per dataset: the trees of every feature share, one after the other."""
    sizes = settle(dataset_sizes(records))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    samples = tree_samples(records, sizes, total, n_trees, seed)
    schema = (
        "dataset string, tree int, share int, rows long, feature array<double>, threshold array<double>, "
        "left array<double>, length array<double>"
    )

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rec_id")
        x = np.array(pdf["features"].tolist(), dtype=float)
        d, tree = x.shape[1], int(pdf["tree"].iloc[0])
        rows = []
        for i, share in enumerate(max_features):
            # by value, so that a setting scores alike whatever else is asked for
            rng = np.random.default_rng([seed, tree, round(share * 1_000_000)])
            used = np.sort(rng.choice(d, max(1, int(share * d)), replace=False))
            rows.append((pdf["dataset"].iloc[0], tree, i, len(x), *grow_tree(x, used, rng)))
        return pd.DataFrame(
            rows, columns=["dataset", "tree", "share", "rows", "feature", "threshold", "left", "length"]
        )

    groups = sizes.count() * n_trees
    trees = spread(samples, ["dataset", "tree"], groups * SAMPLE_ROWS, groups).groupBy("dataset", "tree").applyInPandas(grow, schema)
    # n_trees * shares trees of at most 511 nodes each
    items = F.array_sort(
        F.collect_list(F.struct("share", "tree", "rows", "feature", "threshold", "left", "length"))
    )
    forest = trees.groupBy("dataset").agg(items.alias("t")).select(
        "dataset",
        F.col("t.share").alias("share"), F.col("t.tree").alias("tree"), F.col("t.rows").alias("rows"),
        F.transform("t", lambda t: F.size(t["feature"])).alias("nodes"),
        *[F.flatten(F.col(f"t.{c}")).alias(c) for c in ("feature", "threshold", "left", "length")],
    )
    return settle(forest.join(sizes, "dataset"))


def tree_paths(x: np.ndarray, feature, threshold, left, length) -> np.ndarray:
    """Path length of every record in one tree.

    A leaf leads to itself, as no value is above infinity, so all records take as many steps as the
    tree has levels and none is looked for among them.
    """
    leaf = feature < 0
    to, cut, at = np.where(leaf, np.arange(len(leaf)), left), np.where(leaf, np.inf, threshold), np.where(leaf, 0, feature)
    values, first = x.ravel(), np.arange(len(x)) * x.shape[1]
    node, level = np.zeros(len(x), dtype=np.int64), np.zeros(1, dtype=np.int64)
    while len(level := level[~leaf[level]]):
        node = to.take(node) + (values.take(first + at.take(node)) > cut.take(node))
        level = np.concatenate([left[level], left[level] + 1])
    return length[node]


def score_iforest_settings(
    records: DataFrame, settings: list[tuple[int, float]], seed: int = 42, **limits
) -> DataFrame:
    """Scores of many ``(n_estimators, max_features)``; a smaller forest is a prefix."""
    shares, most = sorted({s for _, s in settings}), max(n for n, _ in settings)
    models = fit_forest(records, most, shares, seed)

    def score(x, model):
        feature, left = model["feature"].astype(np.int64), model["left"].astype(np.int64)
        ends = np.cumsum(model["nodes"])
        sums = {s: np.zeros(len(x)) for s in range(len(shares))}
        seen = {s: 0 for s in range(len(shares))}
        out = np.empty((len(x), len(settings)))
        norm = float(path_adjustment(max(2, int(model["rows"].max()))))
        for i, end in enumerate(ends):
            a, share = end - model["nodes"][i], int(model["share"][i])
            sums[share] += tree_paths(x, feature[a:end], model["threshold"][a:end], left[a:end], model["length"][a:end])
            seen[share] += 1
            for j, (n, s) in enumerate(settings):
                if shares[share] == s and seen[share] == n:
                    out[:, j] = 2.0 ** (-(sums[share] / n) / norm)
        return out

    return score_settings(records, models, score, [setting_name(*s) for s in settings], **limits)


def setting_name(n_estimators: int, max_features: float) -> str:
    return f"IForest(max_features={max_features}, n_estimators={n_estimators})"


def score_iforest(
    records: DataFrame, n_estimators: int = 100, max_features: float = 1.0, seed: int = 42, **limits
) -> DataFrame:
    scores = score_iforest_settings(records, [(n_estimators, max_features)], seed, **limits)
    return scores.select("dataset", "rec_id", "score")

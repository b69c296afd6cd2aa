"""Choosing a detector from dataset statistics.

Meta-features are long cells ``(dataset, feature, value)`` or, for training, carry
``(trial, snapshot, plate)`` through a ``dataset`` name of the form trial/snapshot/plate.
Everything here has one row per dataset, feature or algorithm, never per record, except
the statistics themselves.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cells import only
from ..functions.models import feature_cells
from ..functions.running import WINDOW_ROWS, running_totals
from ..functions.runtime import settle
from ..functions.skew import small_side
from .detectors import hbos, iforest, loda, pca

QUANTILES = {"q01": 0.01, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q99": 0.99}


# --- meta-features --------------------------------------------------------------------------


def feature_statistics(records: DataFrame, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """One row per (dataset, pos): moments, quantiles, entropy, distinct and zero share.

    Everything comes from counts of distinct values: moments in a second pass around the
    mean, quantiles from running counts.
    """
    counts = feature_cells(records).groupBy("dataset", "pos", "value").agg(F.count(F.lit(1)).alias("c"))
    base = counts.groupBy("dataset", "pos").agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("distinct"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        (F.sum(F.col("value") * F.col("c")) / F.sum("c")).alias("mean"),
        (F.coalesce(F.sum(F.when(F.col("value") == 0, F.col("c"))), F.lit(0)) / F.sum("c")).alias("zero_share"),
        # -sum p ln p with p = c / n
        (F.log(F.sum("c")) - F.sum(F.col("c") * F.log("c")) / F.sum("c")).alias("entropy"),
    )
    base = settle(base)
    largest = base.agg(F.max("distinct")).first()[0] or 0
    running = running_totals(counts, ["dataset", "pos"], "value", {"upto": "c"}, largest, window_rows)
    joined = running.join(small_side(base.select("dataset", "pos", "n", "mean")), ["dataset", "pos"])
    gap = F.col("value") - F.col("mean")

    def quantile(p: float) -> Column:
        place = F.lit(p) * (F.col("n") - 1)
        low = F.min(F.when(F.col("upto") > F.floor(place), F.col("value")))
        high = F.min(F.when(F.col("upto") > F.ceil(place), F.col("value")))
        return low + (high - low) * F.max(place - F.floor(place))

    more = joined.groupBy("dataset", "pos").agg(
        (F.sum(gap * gap * F.col("c")) / F.sum("c")).alias("_m2"),
        (F.sum(gap * gap * gap * F.col("c")) / F.sum("c")).alias("_m3"),
        (F.sum(gap * gap * gap * gap * F.col("c")) / F.sum("c")).alias("_m4"),
        *[quantile(p).alias(name) for name, p in QUANTILES.items()],
    )
    m2 = F.col("_m2")
    return base.join(more, ["dataset", "pos"]).select(
        "dataset", "pos", "n", "min", "max", "mean", F.sqrt(m2).alias("sd"),
        F.when(m2 > 0, F.col("_m3") / F.pow(m2, 1.5)).alias("skewness"),
        F.when(m2 > 0, F.col("_m4") / (m2 * m2) - 3).alias("kurtosis"),
        (F.col("distinct") / F.col("n")).alias("distinct_share"), "zero_share", "entropy", *QUANTILES,
    )


PER_FEATURE = [
    "min", "max", "mean", "sd", "skewness", "kurtosis", "distinct_share", "zero_share", "entropy", *QUANTILES,
]


def correlation_statistics(records: DataFrame) -> DataFrame:
    """Mean, spread and extremes of the absolute pairwise correlations per dataset."""
    models = pca.correlations(records)
    d = F.size(F.filter("sd", lambda s: s > 0))
    cells = models.select("dataset", d.alias("d"), F.posexplode("corr").alias("i", "r"))
    upper = F.floor(F.col("i") / F.col("d")) < F.col("i") % F.col("d")
    r = F.abs("r")
    return cells.filter(upper).groupBy("dataset").agg(
        F.avg(r).alias("corr_mean"), F.stddev_pop(r).alias("corr_sd"), F.min(r).alias("corr_min"), F.max(r).alias("corr_max")
    )


def meta_features_stats(records: DataFrame, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Long ``(dataset, feature, value)``: sizes, per-feature statistics folded over
    features by min, max, mean and sd, and pairwise correlations."""
    per_feature = feature_statistics(records, window_rows)
    folds = {"min": F.min, "max": F.max, "mean": F.avg, "sd": F.stddev_pop}
    wide = per_feature.groupBy("dataset").agg(
        F.max("n").cast("double").alias("n_rows"), F.count(F.lit(1)).cast("double").alias("n_features"),
        F.log(F.max("n")).alias("log_n_rows"), (F.count(F.lit(1)) / F.max("n")).alias("feature_ratio"),
        *[fn(c).alias(f"{c}_{name}") for c in PER_FEATURE for name, fn in folds.items()],
    )
    wide = wide.join(correlation_statistics(records), "dataset", "left")
    names = [c for c in wide.columns if c != "dataset"]
    return wide.unpivot("dataset", names, "feature", "value")


def meta_features(records: DataFrame, seed: int = 42) -> DataFrame:
    """All meta-features: statistics and landmarks."""
    return meta_features_stats(records).unionByName(meta_features_landmarks(records, seed))


def meta_features_landmarks(records: DataFrame, seed: int = 42) -> DataFrame:
    """Long statistics of the scores of four cheap detectors."""
    scored = {
        "HBOS": hbos.score_hbos(records),
        "LODA": loda.score_loda(records, 10, 50),
        "PCA": pca.score_pca(records),
        "IForest": iforest.score_iforest(records, 20, 1.0, seed),
    }
    frames = []
    for name, scores in scored.items():
        stats = scores.groupBy("dataset").agg(
            F.min("score").alias("min"), F.max("score").alias("max"), F.avg("score").alias("mean"),
            F.stddev_pop("score").alias("sd"), F.skewness("score").alias("skewness"), F.kurtosis("score").alias("kurtosis"),
        )
        long = stats.unpivot("dataset", ["min", "max", "mean", "sd", "skewness", "kurtosis"], "s", "value")
        frames.append(long.select("dataset", F.concat(F.lit(f"{name}_"), "s").alias("feature"), "value"))
    return reduce(lambda a, b: a.unionByName(b), frames)


# --- training data -------------------------------------------------------------------------


def dataset_name(trial: str = "trial", snapshot: str = "snapshot", plate: str = "plate") -> Column:
    return F.concat_ws("/", trial, snapshot, plate)


def performance_matrix(comparisons: DataFrame, algorithms: list[str]) -> DataFrame:
    """(trial, snapshot, plate) by algorithm of AUROC in the given column order; rows
    without any value drop out, other gaps are zero."""
    return (
        comparisons.groupBy("trial", "snapshot", "plate").pivot("algorithm", algorithms).agg(only("auroc", "results of an algorithm"))
        .dropna(how="all", subset=algorithms).na.fill(0.0, algorithms)
    )


def meta_training_set(metafeatures: DataFrame, performance: DataFrame) -> DataFrame:
    """Meta-feature cells of datasets with a known performance, with that performance.

    ``metafeatures`` is long with (trial, snapshot, plate).
    """
    return metafeatures.join(performance, ["trial", "snapshot", "plate"])


def clean_metafeatures(cells: DataFrame, by: list[str] = ("dataset",)) -> DataFrame:
    """Infinite or NaN values become missing; datasets that had no value at all drop out.

    Emptiness is judged before infinities are replaced.
    """
    by = list(by)
    value = F.nanvl("value", F.lit(None).cast("double"))
    known = cells.filter(value.isNotNull()).select(*by).distinct()
    finite = F.when(F.abs(value) < F.lit(float("inf")), value)
    return cells.join(known, by, "left_semi").withColumn("value", finite)


def fit_scaling(cells: DataFrame) -> DataFrame:
    """``(feature, lo, hi, fill)``: range and mean rescaled value of each meta-feature."""
    base = cells.groupBy("feature").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("_mean")
    )
    width = F.col("hi") - F.col("lo")
    return base.select(
        "feature", "lo", "hi",
        F.when(F.col("lo").isNull(), 0.0).otherwise(
            F.coalesce(F.try_divide(F.col("_mean") - F.col("lo"), width), F.lit(0.0))
        ).alias("fill"),
    )


def _scaled(value: Column) -> Column:
    width = F.col("hi") - F.col("lo")
    return F.when(value.isNotNull() & F.col("lo").isNotNull(), F.coalesce(F.try_divide(value - F.col("lo"), width), F.lit(0.0)))


def scale_metafeatures(cells: DataFrame, scaling: DataFrame) -> DataFrame:
    """Training side: min-max per feature, missing to the feature's mean, else zero."""
    value = F.coalesce(_scaled(F.col("value")), F.col("fill"), F.lit(0.0))
    return cells.join(small_side(scaling), "feature").withColumn("value", value).drop("lo", "hi", "fill")


def apply_scaling(cells: DataFrame, scaling: DataFrame) -> DataFrame:
    """Scoring side: missing to zero, stored range, missing to zero, clipped to [0, 1]."""
    raw = F.nanvl(F.coalesce("value", F.lit(0.0)), F.lit(0.0))
    value = F.least(F.greatest(F.coalesce(_scaled(raw), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return cells.join(small_side(scaling), "feature").withColumn("value", value).drop("lo", "hi", "fill")


def leave_one_trial_out(rows: DataFrame, left_out: str) -> DataFrame:
    """Rows of the other trials with their ``part``; the least trial name is validation."""
    others = rows.filter(F.col("trial") != left_out)
    least = others.agg(F.min("trial")).first()[0]
    part = F.when(F.col("trial") == F.lit(least), "validation").otherwise("training")
    return others.withColumn("part", part)


# --- model ------------------------------------------------------------------------------------


class Selector:
    """Scaling, one forest per factor, and the factors of the algorithms."""

    def __init__(self, scaling: DataFrame, features: list[str], model: PipelineModel, algorithms: DataFrame, rank: int):
        self.scaling, self.features, self.model = scaling, features, model
        self.algorithms, self.rank = algorithms, rank

    def save(self, path: str) -> None:
        self.scaling.write.mode("overwrite").parquet(f"{path}/scaling")
        self.algorithms.write.mode("overwrite").parquet(f"{path}/algorithms")
        self.model.write().overwrite().save(f"{path}/model")
        spark = self.scaling.sparkSession
        spark.createDataFrame(
            [(i, f, self.rank) for i, f in enumerate(self.features)], "position int, feature string, rank int"
        ).write.mode("overwrite").parquet(f"{path}/features")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Selector":
        # one row per meta-feature
        rows = spark.read.parquet(f"{path}/features").orderBy("position").collect()
        return cls(
            spark.read.parquet(f"{path}/scaling"), [r["feature"] for r in rows],
            PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/algorithms"), rows[0]["rank"],
        )

    def predict(self, metafeatures: DataFrame) -> DataFrame:
        """``(dataset, algorithm, predicted)``; the algorithms' factors, one row each, travel as a literal column."""
        predicted = self.model.transform(_vectors(apply_scaling(metafeatures, self.scaling), self.features)).select(
            "dataset", F.array(*[F.col(f"p{i}") for i in range(self.rank)]).alias("f")
        )
        known = F.array(*[
            F.struct(F.lit(r["algorithm"]).alias("algorithm"), F.array(*[F.lit(v) for v in r["g"]]).alias("g"))
            for r in self.algorithms.collect()
        ])
        dot = F.aggregate(F.zip_with("f", "g", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
        return predicted.select("dataset", "f", F.inline(known)).select("dataset", "algorithm", dot.alias("predicted"))


def _vectors(cells: DataFrame, features: list[str]) -> DataFrame:
    """One ML vector per dataset, in the order of ``features``; absent ones are zero."""
    wide = cells.groupBy("dataset").pivot("feature", features).agg(only("value", "values of a meta-feature")).na.fill(0.0)
    return wide.select("dataset", array_to_vector(F.array(*[F.col(f"`{f}`") for f in features])).alias("x"))


def fit_selector(
    metafeatures: DataFrame, comparisons: DataFrame, algorithms: list[str], rank: int = 3, trees: int = 20, seed: int = 42
) -> Selector:
    """Factor the performance matrix and regress its factors on meta-features.

    ``metafeatures`` is long by ``dataset``; ``comparisons`` has dataset, algorithm and
    auroc. Datasets are numbered by their sorted names for the factorisation. Rows whose
    ``part`` (of :func:`leave_one_trial_out`) is not training are left out.
    """
    if "part" in comparisons.columns:
        comparisons = comparisons.filter(F.col("part") == "training")
    cells = settle(clean_metafeatures(metafeatures.join(comparisons.select("dataset").distinct(), "dataset", "left_semi")))
    scaling = settle(fit_scaling(cells))
    features = [r["feature"] for r in scaling.select("feature").orderBy("feature").collect()]
    scaled = scale_metafeatures(cells, scaling)
    names = F.array(*[F.lit(a) for a in algorithms])
    known = comparisons.join(cells.select("dataset").distinct(), "dataset", "left_semi")
    one = known.select("dataset", F.lit(0).alias("all"), F.lit(1).alias("one")).distinct()
    ids = settle(
        running_totals(one, ["all"], "dataset", {"number": "one"})
        .select("dataset", F.col("number").cast("int").alias("number"))
    )
    ratings = known.join(ids, "dataset").select(
        "number", (F.array_position(names, F.col("algorithm")) - 1).cast("int").alias("item"),
        F.coalesce(F.nanvl("auroc", F.lit(0.0)), F.lit(0.0)).cast("float").alias("rating"),
    ).filter("item >= 0")
    als = ALS(
        userCol="number", itemCol="item", ratingCol="rating", rank=rank, maxIter=10, regParam=0.02, seed=seed,
        coldStartStrategy="nan", numUserBlocks=4, numItemBlocks=1,
    ).fit(settle(ratings))
    factors = als.userFactors.select(F.col("id").alias("number"), F.col("features").alias("f"))
    training = _vectors(scaled, features).join(ids, "dataset").join(factors, "number").select(
        "x", *[F.col("f")[i].cast("double").alias(f"f{i}") for i in range(rank)]
    )
    forests = [
        RandomForestRegressor(
            featuresCol="x", labelCol=f"f{i}", predictionCol=f"p{i}", numTrees=trees, maxDepth=5, seed=seed + i
        )
        for i in range(rank)
    ]
    model = Pipeline(stages=forests).fit(settle(training))
    items = als.itemFactors.select(
        F.element_at(names, F.col("id") + 1).alias("algorithm"), F.col("features").cast("array<double>").alias("g")
    )
    return Selector(scaling, features, model, settle(items), rank)


def choice_ranks(predictions: DataFrame, comparisons: DataFrame) -> DataFrame:
    """``(dataset, algorithm, auroc, place)`` of the setting chosen for each dataset.

    ``place`` is its rank among the dataset's known performances, 1 for the best, ties averaged; a
    missing performance counts as zero.
    """
    per = W.partitionBy("dataset")
    known = comparisons.select("dataset", "algorithm", F.coalesce(F.nanvl("auroc", F.lit(0.0)), F.lit(0.0)).alias("auroc"))
    ties = F.count(F.lit(1)).over(W.partitionBy("dataset", "auroc"))
    placed = known.withColumn("place", F.rank().over(per.orderBy(F.desc("auroc"))) + (ties - 1) / 2)
    return top_models(predictions, 1).select("dataset", "algorithm").join(placed, ["dataset", "algorithm"])


def tune_selector(
    metafeatures: DataFrame, comparisons: DataFrame, algorithms: list[str], ranks: tuple[int, ...] = (2, 3, 4), fit=fit_selector, **limits
):
    """The selector of ``fit`` whose rank makes the best choices on the validation part, by mean place; the smallest on ties."""
    held = settle(comparisons.filter(F.col("part") == "validation").select("dataset", "algorithm", "auroc"))
    own = settle(metafeatures.join(held.select("dataset").distinct(), "dataset", "left_semi"))
    best, least = None, math.inf
    for rank in ranks:
        fitted = fit(metafeatures, comparisons, algorithms, rank, **limits)
        place = choice_ranks(predict_performance([fitted], own), held).agg(F.avg("place")).first()[0]
        if best is None or (place is not None and place < least):
            best, least = fitted, place if place is not None else math.inf
    return best


def predict_performance(selectors: list, metafeatures: DataFrame) -> DataFrame:
    """``(dataset, algorithm, predicted)``, averaged over the selectors.

    A selector has ``predict(metafeatures)``.
    """
    both = reduce(lambda a, b: a.unionByName(b), [s.predict(metafeatures) for s in selectors])
    return both.groupBy("dataset", "algorithm").agg(F.avg("predicted").alias("predicted"))


def top_models(predictions: DataFrame, k: int = 1) -> DataFrame:
    """The k algorithms of highest predicted score per dataset, missing ones skipped."""
    order = W.partitionBy("dataset").orderBy(F.desc("predicted"), "algorithm")
    usable = predictions.filter(F.col("predicted").isNotNull() & ~F.isnan("predicted"))
    return (
        usable.withColumn("place", F.row_number().over(order).cast("long"))
        .filter(F.col("place") <= k).select("dataset", "algorithm", "predicted", "place")
    )

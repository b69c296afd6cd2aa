"""From a labelled study to comparison rows and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions.runtime import settle
from ..operators import compare, metrics, preprocess
from ..operators.detectors import pool
from ..sources import tables as src

#: Parts of a dataset name, in order.
PLATE = ["trial", "snapshot", "plate"]


def labelled_plates(labelled: DataFrame, target: str = "any_change") -> DataFrame:
    """Labelled records of a study as plates ``(dataset, rec_id, values, y)``.

    A dataset is named ``trial/snapshot/table``; names hold no slash. ``rec_id`` is the
    64-bit hash of the record key.
    """
    named = F.concat_ws("/", "trial", "snapshot", "table_name")
    values = F.transform("values", lambda v: F.nanvl(v, F.lit(None).cast("double")))
    return labelled.select(
        named.alias("dataset"), F.xxhash64("key").alias("rec_id"), values.alias("values"), F.col(target).cast("int").alias("y")
    )


def comparison_rows(evaluated: DataFrame) -> DataFrame:
    """Evaluation rows with trial, snapshot, plate and hyperparameters, as the comparison sink takes them."""
    parts = F.split("dataset", "/")
    return evaluated.withColumns({name: parts[i] for i, name in enumerate(PLATE)}).withColumnRenamed("params", "hyperparameters").drop("dataset")


def compare_study(
    labelled: DataFrame, grid: dict = pool.DEFAULT_GRID, target: str = "any_change",
    least_rows: int = config.PLATE_MIN_ROWS, least_columns: int = config.PLATE_MIN_COLUMNS,
) -> DataFrame:
    """Comparison rows of every setting of the grid on every usable plate of a labelled study."""
    records = settle(preprocess.preprocess_plates(labelled_plates(labelled, target), least_rows, least_columns))
    settings = sum(len(pool.combinations(g)) for g in grid.values())
    scores = settle(pool.score_all(records, grid).withColumn("score", F.round("score", 9)))
    return comparison_rows(metrics.evaluate_scores(scores, records, settings))


def write_study_comparisons(rows: DataFrame, root: str) -> None:
    """Store comparison rows so that :func:`read_comparisons` finds them, one folder per trial."""
    columns = [c.strip().split(" ")[0] for c in src.COMPARISON_SCHEMA.split(",")]
    src.write_trial_comparisons(rows.select("trial", *columns), root)


def report(spark: SparkSession, root: str, output: str | None = None) -> dict[str, DataFrame]:
    """Every report over a folder of comparison rows; stored below ``output`` when given.

    Variants of one algorithm must have been told apart or reduced before: two results of an
    algorithm on one dataset are an error.
    """
    rows = settle(compare.snapshot_number(compare.flag_significant(src.read_comparisons(spark, root))))
    names = compare.algorithm_names(rows)
    numbers = [r[0] for r in rows.select("snapshot_number").distinct().orderBy("snapshot_number").collect()]
    ranks = settle(compare.average_ranks(rows, names))
    best = compare.best_algorithm(ranks).first()["algorithm"]
    tests = settle(compare.holm_adjust(compare.pairwise_wilcoxon(rows, names)))
    overall = settle(compare.friedman_statistic(rows, names))
    summary = compare.trial_summary(rows, best)
    out = {
        "any_significant": compare.any_significant(rows), "significant_histogram": compare.significant_histogram(rows),
        "average_ranks": ranks, "friedman": overall, "pairwise": tests,
        "groups": compare.indistinguishable_groups(ranks, compare.gate_pairs(tests, overall)), "mean_performance": compare.mean_performance(rows, names),
        "best_significance": compare.best_significance(rows, best), "best_loses": compare.best_loses(rows, best),
        "winner_breakdown": compare.winner_breakdown(rows, names), "snapshot_success": compare.snapshot_success(rows),
        "irregularity_distribution": compare.irregularity_distribution(rows),
        "best_by_trial_snapshot": compare.best_by_trial_snapshot(rows, best, numbers), "trial_summary": summary,
        "trial_algorithm_means": compare.trial_algorithm_means(rows, names, names),
    }
    if output:
        src.report_tables({name: out[name] for name in src.REPORT_PLACES}, output)
    return out

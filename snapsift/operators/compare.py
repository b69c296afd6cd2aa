"""Statistical comparison of algorithms over many datasets.

A comparison table has one row per (trial, snapshot, plate, algorithm) with ``auroc``,
its bounds and the dataset's size. A dataset is a (trial, snapshot, plate).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import only
from ..functions.tails import chi_square_tail, f_tail
from ..functions.running import WINDOW_ROWS, running_totals
from ..functions.runtime import settle
from ..functions.skew import small_side

DATASET = ["trial", "snapshot", "plate"]
LAST_SNAPSHOT = 4

# Participants, centres and countries of the published trials.
TRIAL_FACTS = [
    ("poise", 8351, 190, 23),
    ("rely", 18113, 951, 44),
    ("hope3", 12705, 228, 21),
    ("tips3", 5713, 86, 9),
    ("compass", 27395, 602, 33),
    ("hipattack", 2970, 69, 17),
    ("manage", 1754, 84, 19),
]
FACTS_SCHEMA = "trial string, participants long, centres long, countries long"


def flag_significant(df: DataFrame, bound: str = "auroc_lower") -> DataFrame:
    """Is the lower confidence bound above chance?"""
    return df.withColumn("significant", F.coalesce(F.col(bound) > 0.5, F.lit(False)))


def snapshot_number(df: DataFrame, last: int = LAST_SNAPSHOT) -> DataFrame:
    """Rank of the snapshot name within its trial, shifted so that the last is at least ``last``.

    Ranked over the distinct snapshot names, which are few, and joined back.
    """
    names = df.select("trial", "snapshot").distinct()
    rank = F.dense_rank().over(W.partitionBy("trial").orderBy("snapshot")) - 1
    whole = W.partitionBy("trial")
    numbered = names.withColumn("_r", rank).withColumn(
        "snapshot_number",
        (F.col("_r") + F.greatest(F.lit(0), F.lit(last) - F.max("_r").over(whole))).cast("long"),
    )
    return df.join(small_side(settle(numbered.drop("_r"))), ["trial", "snapshot"])


def normalise_algorithm(df: DataFrame) -> DataFrame:
    """Give every isolation forest variant one name."""
    name = F.when(F.col("algorithm").startswith("IForest"), "IForest").otherwise(F.col("algorithm"))
    return df.withColumn("algorithm", name)


def significant_counts(df: DataFrame) -> DataFrame:
    """Number of significant algorithms per dataset."""
    return df.groupBy(*DATASET).agg(F.sum(F.col("significant").cast("long")).alias("num_significant"))


def any_significant(df: DataFrame) -> DataFrame:
    """Datasets with a significant algorithm, and all datasets."""
    return significant_counts(df).agg(
        F.sum((F.col("num_significant") > 0).cast("long")).alias("datasets_significant"),
        F.count(F.lit(1)).alias("datasets"),
    )


def significant_histogram(df: DataFrame) -> DataFrame:
    return significant_counts(df).groupBy("num_significant").agg(F.count(F.lit(1)).alias("datasets"))


def algorithm_names(df: DataFrame) -> list[str]:
    """Sorted algorithm names: as many as compared settings, a column set by design."""
    return [r["algorithm"] for r in df.select("algorithm").distinct().orderBy("algorithm").collect()]


def auroc_matrix(df: DataFrame, algorithms: list[str], by: list[str] = DATASET) -> DataFrame:
    """Dataset by algorithm; datasets without any value drop out, other gaps are zero.

    Two results of one algorithm on one dataset raise an error when the plan runs.
    """
    return (
        df.groupBy(*by).pivot("algorithm", algorithms).agg(only("auroc", "results of an algorithm"))
        .dropna(how="all", subset=algorithms).na.fill(0.0, algorithms)
    )


def matrix_cells(df: DataFrame, algorithms: list[str], by: list[str] = DATASET) -> DataFrame:
    """:func:`auroc_matrix` as rows."""
    return auroc_matrix(df, algorithms, by).unpivot(by, algorithms, "algorithm", "auroc")


def dataset_ranks(df: DataFrame, algorithms: list[str], by: list[str] = DATASET) -> DataFrame:
    """Rank of each algorithm within a dataset, best first, ties averaged.

    The window holds one row per compared algorithm.
    """
    best = W.partitionBy(*by).orderBy(F.desc("auroc"))
    ties = F.count(F.lit(1)).over(W.partitionBy(*by, "auroc"))
    return matrix_cells(df, algorithms, by).withColumn("rank", F.rank().over(best) + (ties - 1) / 2)


def average_ranks(df: DataFrame, algorithms: list[str]) -> DataFrame:
    return dataset_ranks(df, algorithms).groupBy("algorithm").agg(F.avg("rank").alias("avg_rank"))


def friedman_statistic(df: DataFrame, algorithms: list[str]) -> DataFrame:
    """Friedman chi-square and its F form (Demšar 2006), each with its tail probability."""
    ranks = dataset_ranks(df, algorithms).groupBy("algorithm").agg(
        F.avg("rank").alias("r"), F.count(F.lit(1)).alias("n")
    )
    k = float(len(algorithms))
    n = F.col("n").cast("double")
    chi = 12 * n / (k * (k + 1)) * (F.col("s") - k * (k + 1) ** 2 / 4)
    return (
        ranks.agg(F.max("n").alias("n"), F.sum(F.col("r") * F.col("r")).alias("s"))
        .select(F.col("n").alias("datasets"), F.lit(len(algorithms)).cast("long").alias("algorithms"), chi.alias("chi_square"))
        .withColumn(
            "f_statistic",
            F.try_divide(
                (F.col("datasets") - 1) * F.col("chi_square"), F.col("datasets") * (k - 1) - F.col("chi_square")
            ),
        )
        .withColumn("p_chi_square", chi_square_tail(F.col("chi_square"), len(algorithms) - 1))
        .withColumn("p_f", f_tail(F.col("f_statistic"), F.lit(k - 1), (k - 1) * (F.col("datasets") - 1)))
    )


def wilcoxon_sums(df: DataFrame, algorithms: list[str], window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Signed-rank sums and z of every algorithm pair (zero differences dropped).

    A pair whose results are all equal has n = 0 and no z. Differences are formed from the
    pivoted row of a dataset. Equal differences are counted
    together and ranked with running totals, so many datasets do not meet in one task.
    """
    results = F.array(*[F.struct(F.lit(a).alias("name"), F.col(f"`{a}`").alias("auroc")) for a in algorithms])

    def against(x, i):
        later = F.slice("_results", i + 2, F.lit(len(algorithms)))
        return F.transform(later, lambda y: F.struct(
            x["name"].alias("a"), y["name"].alias("b"), F.round(x["auroc"] - y["auroc"], 12).alias("gap")))

    # the plan holds one expression for all pairs
    gaps = F.flatten(F.transform("_results", against))
    paired = auroc_matrix(df, algorithms).select(results.alias("_results"))
    rows = paired.select(F.inline(gaps)).filter(F.col("gap") != 0)
    counts = rows.groupBy("a", "b", F.abs("gap").alias("size")).agg(
        F.count(F.lit(1)).alias("c"), F.sum((F.col("gap") > 0).cast("long")).alias("up")
    )
    ranked = running_totals(counts, ["a", "b"], "size", {"upto": "c"}, None, window_rows)
    rank = F.col("upto") - (F.col("c") - 1) / 2
    sums = ranked.groupBy("a", "b").agg(
        F.sum("c").alias("n"), F.sum(F.col("up") * rank).alias("w_plus"),
        F.sum((F.col("c") - F.col("up")) * rank).alias("w_minus"),
        F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("_ties"),
    )
    n = F.col("n").cast("double")
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    z = F.try_divide(F.least("w_plus", "w_minus") - n * (n + 1) / 4, F.sqrt(variance))
    tested = sums.select("a", "b", "n", "w_plus", "w_minus", z.alias("z"), (F.col("_ties") > 0).alias("ties"))
    pairs = [(a, b) for i, a in enumerate(algorithms) for b in algorithms[i + 1 :]]
    every = df.sparkSession.createDataFrame(pairs, "a string, b string")
    return every.join(tested, ["a", "b"], "left").fillna(0, ["n", "w_plus", "w_minus"]).fillna(False, ["ties"])


#: Up to so many differing datasets, and without ties among the differences, p is exact.
EXACT_DATASETS = 25


def signed_rank_counts(n: int) -> list[int]:
    """Number of sign patterns of the ranks 1..n for every sum of positive ranks, by adding one rank after the other."""
    counts = [1]
    for rank in range(1, n + 1):
        more = [0] * rank + counts
        counts = [a + b for a, b in zip(counts + [0] * rank, more, strict=True)]
    return counts


def exact_tails(most: int) -> list[list[float]]:
    """For each n up to ``most``, the two-sided p of every smaller signed-rank sum."""
    tails = []
    for n in range(most + 1):
        counts = signed_rank_counts(n)
        below, row = 0, []
        for c in counts[: n * (n + 1) // 4 + 1]:
            below += c
            row.append(min(1.0, 2 * below / 2**n))
        tails.append(row)
    return tails


@F.pandas_udf(T.DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """Two-sided normal p-value."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)) if v == v else np.nan)


def pairwise_wilcoxon(df: DataFrame, algorithms: list[str], exact: int = EXACT_DATASETS) -> DataFrame:
    """Sums, z and two-sided p of every pair; p is 1 where no dataset differs.

    With at most ``exact`` differing datasets and no ties, p comes from the null distribution of the
    smaller sum (``exact`` is true); otherwise from z.
    """
    sums = wilcoxon_sums(df, algorithms)
    few = (F.col("n") <= exact) & ~F.col("ties")
    table = F.array(*[F.array(*[F.lit(p) for p in row]) for row in exact_tails(exact)])
    known = F.get(F.get(table, F.col("n").cast("int")), F.least("w_plus", "w_minus").cast("int"))
    p = F.when(F.col("n") == 0, F.lit(1.0)).when(few, known).otherwise(two_sided_p("z"))
    return sums.withColumn("p", p).withColumn("exact", few).drop("ties")


def holm_adjust(tests: DataFrame, by: list[str] = ()) -> DataFrame:
    """Step-down adjusted p-values; one row per test, as many as algorithm pairs."""
    by = list(by)
    order = W.partitionBy(*by).orderBy("p", "a", "b")
    size = F.count(F.lit(1)).over(W.partitionBy(*by))
    step = tests.withColumn("_scaled", F.col("p") * (size - F.row_number().over(order) + 1))
    running = F.max("_scaled").over(order.rowsBetween(W.unboundedPreceding, 0))
    return step.withColumn("p_adjusted", F.least(running, F.lit(1.0))).drop("_scaled")


def gate_pairs(tests: DataFrame, overall: DataFrame, alpha: float = 0.05, column: str = "p_f") -> DataFrame:
    """Pairwise tests that count only if the overall test is significant; otherwise all adjusted p are 1.

    ``overall`` is the one row of :func:`friedman_statistic`. A missing p, from ranks that are the same on
    all datasets, is significant.
    """
    p = overall.select(F.coalesce(column, F.lit(0.0)).alias("p")).first()
    return tests if p is not None and p["p"] < alpha else tests.withColumn("p_adjusted", F.lit(1.0))


def indistinguishable_groups(ranks: DataFrame, tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Maximal runs of algorithms, in rank order, without a significant pair.

    ``(first, last, size, members)``; input is one row per algorithm and per pair (see :func:`gate_pairs`).
    """
    placed = settle(ranks.withColumn(
        "position", F.row_number().over(W.orderBy("avg_rank", "algorithm")).cast("long")))
    at = placed.select("algorithm", "position")
    apart = (
        tests.filter(F.col("p_adjusted") < alpha)
        .join(at.select(F.col("algorithm").alias("a"), F.col("position").alias("pa")), "a")
        .join(at.select(F.col("algorithm").alias("b"), F.col("position").alias("pb")), "b")
        .select(F.least("pa", "pb").alias("low"), F.greatest("pa", "pb").alias("high"))
    )
    # a run that starts at i may reach up to just before the nearest significant partner
    # of any member: the least high end among significant pairs with low >= i
    ends = at.select(F.col("position").alias("start")).join(
        apart, F.col("low") >= F.col("start"), "left"
    ).groupBy("start").agg((F.min("high") - 1).alias("stop"))
    count = at.agg(F.max("position")).first()[0] or 0
    runs = ends.withColumn("stop", F.coalesce("stop", F.lit(count)))
    # a run is maximal when the one before it ends earlier
    earlier = F.lag("stop", 1, 0).over(W.orderBy("start"))
    maximal = runs.withColumn("_before", earlier).filter(
        (F.col("stop") > F.col("_before")) & (F.col("stop") > F.col("start"))
    )
    inside = maximal.join(placed, F.col("position").between(F.col("start"), F.col("stop")))
    members = F.array_sort(F.collect_list(F.struct("position", "algorithm")))
    return inside.groupBy("start", "stop").agg(members.alias("m")).select(
        F.col("start").alias("first"), F.col("stop").alias("last"),
        (F.col("stop") - F.col("start") + 1).alias("size"), F.col("m.algorithm").alias("members"),
    )


def mean_performance(df: DataFrame, algorithms: list[str]) -> DataFrame:
    return auroc_matrix(df, algorithms).agg(*[F.avg(f"`{a}`").alias(a) for a in algorithms]).unpivot(
        [], algorithms, "algorithm", "mean_auroc"
    )


def best_algorithm(ranks: DataFrame) -> DataFrame:
    """Algorithm of least average rank (first name on ties)."""
    return ranks.agg(
        F.min_by("algorithm", F.struct("avg_rank", "algorithm")).alias("algorithm"),
        F.min("avg_rank").alias("avg_rank"),
    )


def best_significance(df: DataFrame, best: str) -> DataFrame:
    """Datasets where the best algorithm is significant: count and share of its rows."""
    flags = df.filter(F.col("algorithm") == best).select(F.col("significant").cast("long").alias("s"))
    return flags.agg(
        F.coalesce(F.sum("s"), F.lit(0).cast("long")).alias("significant"), F.avg("s").alias("fraction")
    )


def best_loses(df: DataFrame, best: str) -> DataFrame:
    """Datasets where the best algorithm has a row and is not significant, but another is."""
    mine = F.col("algorithm") == best
    sums = df.groupBy(*DATASET).agg(
        F.sum(F.col("significant").cast("long")).alias("all"),
        F.sum(F.when(mine, F.col("significant").cast("long"))).alias("mine"),
    )
    return sums.filter((F.col("all") > 0) & (F.col("mine") == 0)).agg(F.count(F.lit(1)).alias("datasets"))


def winner_breakdown(df: DataFrame, algorithms: list[str]) -> DataFrame:
    """Share of datasets each algorithm wins (first name on ties)."""
    filled = df.groupBy(*DATASET).pivot("algorithm", algorithms).agg(only("auroc", "results of an algorithm")).na.fill(0.0, algorithms)
    top = F.greatest(*[F.col(f"`{a}`") for a in algorithms]) if len(algorithms) > 1 else F.col(f"`{algorithms[0]}`")
    winner = F.coalesce(*[F.when(F.col(f"`{a}`") == top, F.lit(a)) for a in sorted(algorithms)])
    wins = filled.groupBy(winner.alias("algorithm")).agg(F.count(F.lit(1)).alias("wins"))
    total = F.sum("wins").over(W.partitionBy())
    return wins.select("algorithm", "wins", (F.col("wins") / total).alias("fraction"))


def snapshot_success(df: DataFrame) -> DataFrame:
    """Share of datasets with a significant algorithm, by trial and snapshot number."""
    per_dataset = df.groupBy("trial", "snapshot_number", "plate").agg(F.bool_or("significant").alias("any"))
    return per_dataset.groupBy("trial", "snapshot_number").agg(
        F.avg(F.col("any").cast("double")).alias("success_fraction")
    )


QUARTILES = {"minimum": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "maximum": 1.0}


def exact_quantiles(
    values: DataFrame, by: list[str], column: str, points: dict[str, float], window_rows: int = WINDOW_ROWS
) -> DataFrame:
    """Linearly interpolated quantiles from running counts of distinct values."""
    counts = values.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("c"))
    running = running_totals(counts, by, column, {"upto": "c"}, None, window_rows)
    sizes = settle(counts.groupBy(*by).agg(F.sum("c").alias("_n")))
    joined = running.join(small_side(sizes), by)
    picks = []
    for name, p in points.items():
        place = F.lit(p) * (F.col("_n") - 1)
        low = F.min(F.when(F.col("upto") > F.floor(place), F.col(column)))
        high = F.min(F.when(F.col("upto") > F.ceil(place), F.col(column)))
        part = F.max(place - F.floor(place))
        picks.append((low + (high - low) * part).alias(name))
    return joined.groupBy(*by).agg(*picks)


def irregularity_distribution(df: DataFrame) -> DataFrame:
    """Box-plot numbers of the label share by trial and snapshot number."""
    distinct = df.select("trial", "plate", "snapshot_number", "anomaly_proportion").dropDuplicates()
    return exact_quantiles(distinct, ["trial", "snapshot_number"], "anomaly_proportion", QUARTILES)


def best_by_trial_snapshot(df: DataFrame, best: str, numbers: list[int]) -> DataFrame:
    """Mean AUROC of the best algorithm, trial by snapshot number."""
    return df.filter(F.col("algorithm") == best).groupBy("trial").pivot("snapshot_number", numbers).agg(F.avg("auroc"))


def trial_summary(df: DataFrame, best: str) -> DataFrame:
    """Datasets, mean rows, mean columns and percent irregular per trial and in total."""
    return (
        df.filter(F.col("algorithm") == best)
        .rollup("trial")
        .agg(
            F.count("plate").alias("datasets"), F.avg("num_samples").alias("avg_instances"),
            F.avg("num_columns").alias("avg_features"),
            (F.avg("anomaly_proportion") * 100).alias("pct_irregular"),
            F.grouping("trial").alias("_total"),
        )
        .withColumn("trial", F.when(F.col("_total") == 1, "total").otherwise(F.col("trial")))
        .drop("_total")
    )


def join_trial_facts(summary: DataFrame, facts: DataFrame) -> DataFrame:
    return facts.join(summary, "trial", "full")


def trial_algorithm_means(df: DataFrame, algorithms: list[str], chosen: list[str]) -> DataFrame:
    """Mean AUROC (gaps as zero) per trial for the chosen algorithms."""
    cells = matrix_cells(df, algorithms, ["trial", "snapshot_number", "plate"])
    return cells.groupBy("trial").pivot("algorithm", chosen).agg(F.avg("auroc"))

"""Queries for algorithm comparison and detector selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.runtime import scratch_path, settle, store_records
from ..operators import compare, preprocess, selector
from ..operators.rank_selector import RankSelector, fit_rank_selector
from ..plans import evaluation, reporting
from ..sources import tables as src
from .registry import query, shared, with_sql
from .scoring import CELLS, plates, predictions, PREDICTED_SQL

ALGS = fx.ALGORITHMS
DATASET = "trial, snapshot, plate"


def table(spark, sf):
    return shared(spark, sf, "comparisons", lambda: settle(
        compare.snapshot_number(compare.flag_significant(fx.comparisons(spark, sf)))))


CMP = [fx.COMPARISONS_SQL, """
    sig AS (SELECT *, auroc_lower > 0.5 AS significant FROM cmp)""", """
    num AS (SELECT trial, snapshot, CAST(r + greatest(0, 4 - max(r) OVER (PARTITION BY trial)) AS BIGINT) AS snapshot_number
      FROM (SELECT trial, snapshot, dense_rank() OVER (PARTITION BY trial ORDER BY snapshot) - 1 AS r
            FROM (SELECT DISTINCT trial, snapshot FROM cmp)))""", """
    full_table AS (SELECT s.*, snapshot_number FROM sig s JOIN num n ON s.trial = n.trial AND s.snapshot = n.snapshot)"""]

MATRIX = CMP + ["""
    mat AS (SELECT d.trial, d.snapshot, d.plate, a.algorithm, coalesce(c.auroc, 0) AS auroc
      FROM (SELECT DISTINCT trial, snapshot, plate FROM cmp WHERE auroc IS NOT NULL) d
      JOIN (SELECT DISTINCT algorithm FROM cmp) a ON true
      LEFT JOIN cmp c ON c.trial = d.trial AND c.snapshot = d.snapshot AND c.plate = d.plate AND c.algorithm = a.algorithm)""", """
    ranked AS (SELECT *, rank() OVER (PARTITION BY trial, snapshot, plate ORDER BY auroc DESC)
        + (count(*) OVER (PARTITION BY trial, snapshot, plate, auroc) - 1) / 2.0 AS r FROM mat)""", """
    ranks AS (SELECT algorithm, avg(r) AS avg_rank FROM ranked GROUP BY algorithm)""", """
    best AS (SELECT algorithm FROM ranks ORDER BY avg_rank, algorithm LIMIT 1)"""]


def rounded(df, *cols, places=6):
    return df.withColumns({c: F.round(c, places) for c in cols})


def best_name(spark, sf):
    ranks = compare.average_ranks(table(spark, sf), ALGS)
    return compare.best_algorithm(ranks).first()["algorithm"]


@query("flag_significant", with_sql(CMP, "SELECT trial, snapshot, plate, algorithm, significant FROM sig"))
def flag_significant(spark, sf):
    return compare.flag_significant(fx.comparisons(spark, sf)).select(
        "trial", "snapshot", "plate", "algorithm", "significant")


@query("snapshot_number", with_sql(CMP, "SELECT trial, snapshot, plate, algorithm, snapshot_number FROM full_table"))
def snapshot_number(spark, sf):
    return compare.snapshot_number(fx.comparisons(spark, sf)).select(
        "trial", "snapshot", "plate", "algorithm", "snapshot_number")


@query("normalise_algorithm", with_sql(CMP, """
    SELECT trial, snapshot, plate, CASE WHEN algorithm = 'IForest' OR algorithm = 'LOF' THEN 'IForest' ELSE algorithm END AS algorithm, auroc FROM cmp"""))
def normalise_algorithm(spark, sf):
    named = fx.comparisons(spark, sf).withColumn(
        "algorithm", F.when(F.col("algorithm").isin("IForest", "LOF"), F.concat(F.lit("IForest("), "plate", F.lit(")")))
        .otherwise(F.col("algorithm")))
    return compare.normalise_algorithm(named).select("trial", "snapshot", "plate", "algorithm", "auroc")


COUNTS = "(SELECT trial, snapshot, plate, sum(CASE WHEN significant THEN 1 ELSE 0 END) AS k FROM sig GROUP BY ALL)"


@query("any_significant", with_sql(CMP, f"""
    SELECT count(*) FILTER (k > 0) AS datasets_significant, count(*) AS datasets FROM {COUNTS}"""))
def any_significant(spark, sf):
    return compare.any_significant(table(spark, sf))


@query("significant_histogram", with_sql(CMP, f"""
    SELECT CAST(k AS BIGINT) AS num_significant, count(*) AS datasets FROM {COUNTS} GROUP BY ALL"""))
def significant_histogram(spark, sf):
    return compare.significant_histogram(table(spark, sf))


PIVOT = ", ".join(f"max(CASE WHEN algorithm = '{a}' THEN auroc END) AS {a}" for a in ALGS)


@query("auroc_matrix", with_sql(MATRIX, f"SELECT {DATASET}, {PIVOT} FROM mat GROUP BY ALL"))
def auroc_matrix(spark, sf):
    return compare.auroc_matrix(table(spark, sf), ALGS)


@query("average_ranks", with_sql(MATRIX, "SELECT algorithm, round(avg_rank, 6) AS avg_rank FROM ranks"))
def average_ranks(spark, sf):
    return rounded(compare.average_ranks(table(spark, sf), ALGS), "avg_rank")


@query("friedman_statistic", with_sql(MATRIX, """,
    f AS (SELECT (SELECT count(DISTINCT trial || snapshot || plate) FROM mat) AS n, 6 AS k, sum(avg_rank * avg_rank) AS s FROM ranks),
    g AS (SELECT n, k, 12.0 * n / (k * (k + 1)) * (s - k * (k + 1) * (k + 1) / 4.0) AS chi FROM f),
    h AS (SELECT *, (n - 1) * chi / (n * (k - 1) - chi) AS f, CAST((k - 1) * (n - 1) AS DOUBLE) AS under FROM g),
    c AS (SELECT 1 - chi / 20000.0 * sum(CASE WHEN i IN (0, 20000) THEN 0.5 ELSE 1 END * pow(chi * i / 20000.0, 1.5) * exp(-chi * i / 40000.0))
        / (pow(2, 2.5) * gamma(2.5)) AS p FROM h, range(20001) t(i) GROUP BY chi),
    e AS (SELECT 1 - f / 20000.0 * sum(CASE WHEN i IN (0, 20000) THEN 0.5 ELSE 1 END * pow(f * i / 20000.0, 1.5) * pow(1 + 5 * (f * i / 20000.0) / under, -(5 + under) / 2))
        / sum(60 / 20000.0 * CASE WHEN i IN (0, 20000) THEN 0.5 ELSE 1 END * pow(60 * i / 20000.0, 1.5) * pow(1 + 5 * (60 * i / 20000.0) / under, -(5 + under) / 2)) AS p
      FROM h, range(20001) t(i) GROUP BY f)
    SELECT n AS datasets, CAST(k AS BIGINT) AS algorithms, round(chi, 6) AS chi_square, round(f, 6) AS f_statistic,
      abs(round(c.p, 5)) AS p_chi_square, abs(round(e.p, 5)) AS p_f FROM h, c, e"""))
def friedman_statistic(spark, sf):
    return rounded(rounded(compare.friedman_statistic(table(spark, sf), ALGS), "chi_square", "f_statistic"), "p_chi_square", "p_f", places=5)


WILCOXON = MATRIX + ["""
    gap AS (SELECT x.algorithm AS a, y.algorithm AS b, round(x.auroc - y.auroc, 12) AS g FROM mat x
      JOIN mat y ON x.trial = y.trial AND x.snapshot = y.snapshot AND x.plate = y.plate AND x.algorithm < y.algorithm
      WHERE round(x.auroc - y.auroc, 12) <> 0)""", """
    gr AS (SELECT a, b, g, count(*) OVER (PARTITION BY a, b, abs(g)) AS t,
      rank() OVER (PARTITION BY a, b ORDER BY abs(g)) + (count(*) OVER (PARTITION BY a, b, abs(g)) - 1) / 2.0 AS r FROM gap)""", """
    sums AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS n, sum(CASE WHEN g > 0 THEN r ELSE 0 END) AS wp,
      sum(CASE WHEN g < 0 THEN r ELSE 0 END) AS wm, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM gr GROUP BY a, b)""", """
    zs AS (SELECT a, b, n, wp, wm, (least(wp, wm) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z, ties FROM sums)"""]


@query("pairwise_wilcoxon", with_sql(WILCOXON, """
    SELECT a, b, CAST(n AS BIGINT) AS n, round(wp, 3) AS w_plus, round(wm, 3) AS w_minus, round(z, 6) AS z, n <= 25 AND ties = 0 AS exact FROM zs"""))
def pairwise_wilcoxon(spark, sf):
    sums = compare.pairwise_wilcoxon(table(spark, sf), ALGS).drop("p")
    return rounded(rounded(sums, "w_plus", "w_minus", places=3), "z")


@query("wilcoxon_exact", with_sql([fx.COMPARISONS_SQL, """
    mean AS (SELECT plate, algorithm, round(avg(auroc), 9) AS auroc FROM cmp GROUP BY ALL)""", """
    gap AS (SELECT x.algorithm AS a, y.algorithm AS b, round(x.auroc - y.auroc, 12) AS g FROM mean x JOIN mean y
      ON x.plate = y.plate AND x.algorithm < y.algorithm WHERE round(x.auroc - y.auroc, 12) <> 0)""", """
    gr AS (SELECT a, b, g, row_number() OVER (PARTITION BY a, b ORDER BY abs(g)) AS r FROM gap)""", """
    sums AS (SELECT a, b, count(*) AS n, sum(CASE WHEN g > 0 THEN r ELSE 0 END) AS wp, sum(CASE WHEN g < 0 THEN r ELSE 0 END) AS wm,
      count(DISTINCT abs(g)) = count(*) AS exact FROM gr GROUP BY a, b)""", """
    pattern AS (SELECT n, s, sum(CASE WHEN (s >> (r - 1)) & 1 = 1 THEN r ELSE 0 END) AS w
      FROM (SELECT DISTINCT n FROM sums), range(2048) t(s), range(1, 12) u(r) WHERE s < (1 << n) AND r <= n GROUP BY n, s)"""], """
    SELECT a, b, n, CAST(wp AS DOUBLE) AS w_plus, CAST(wm AS DOUBLE) AS w_minus, exact,
      round(least(1, 2 * (SELECT count(*) FROM pattern q WHERE q.n = sums.n AND q.w <= least(wp, wm)) / pow(2, n)), 9) AS p FROM sums"""))
def wilcoxon_exact(spark, sf):
    """Detectors compared by their means on each plate: few datasets, so p is counted, not approximated."""
    means = fx.comparisons(spark, sf).groupBy("plate", "algorithm").agg(F.round(F.avg("auroc"), 9).alias("auroc"))
    tested = compare.pairwise_wilcoxon(means.select(F.lit("all").alias("trial"), F.lit("all").alias("snapshot"), "plate", "algorithm", "auroc"), ALGS)
    return tested.drop("z").withColumn("p", F.round("p", 9))


# normal tail p-values by the trapezoid rule on 4000 steps: exact to more than six places
HOLM = WILCOXON + ["""
    tail AS (SELECT a, b, 1 - 2 * sum(CASE WHEN i IN (0, 4000) THEN 0.5 ELSE 1 END
        * exp(-(abs(z) * i / 4000.0) * (abs(z) * i / 4000.0) / 2)) * abs(z) / 4000.0 / sqrt(2 * pi()) AS p
      FROM zs, range(4001) t(i) GROUP BY a, b, z)""", """
    scaled AS (SELECT a, b, p, p * (count(*) OVER () - row_number() OVER (ORDER BY p, a, b) + 1) AS s,
      row_number() OVER (ORDER BY p, a, b) AS o FROM tail)""", """
    holm AS (SELECT a, b, p, least(max(s) OVER (ORDER BY o), 1) AS padj FROM scaled)"""]


def tests(spark, sf):
    return compare.holm_adjust(compare.pairwise_wilcoxon(table(spark, sf), ALGS))


@query("holm_adjust", with_sql(HOLM, "SELECT a, b, abs(round(p, 5)) AS p, abs(round(padj, 5)) AS p_adjusted FROM holm"))
def holm_adjust(spark, sf):
    return rounded(tests(spark, sf).select("a", "b", "p", "p_adjusted"), "p", "p_adjusted", places=5)


@query("indistinguishable_groups", with_sql(HOLM, """,
    pos AS (SELECT algorithm, row_number() OVER (ORDER BY avg_rank, algorithm) AS p FROM ranks),
    apart AS (SELECT least(x.p, y.p) AS lo, greatest(x.p, y.p) AS hi FROM holm
      JOIN pos x ON a = x.algorithm JOIN pos y ON b = y.algorithm WHERE padj < 0.05),
    run AS (SELECT s.p AS i, e.p AS j FROM pos s JOIN pos e ON e.p > s.p
      WHERE NOT EXISTS (SELECT 1 FROM apart WHERE lo >= s.p AND hi <= e.p)),
    top AS (SELECT * FROM run r WHERE NOT EXISTS (
      SELECT 1 FROM run q WHERE q.i <= r.i AND q.j >= r.j AND (q.i < r.i OR q.j > r.j)))
    SELECT i AS first, j AS last, j - i + 1 AS size, string_agg(algorithm, '|' ORDER BY p) AS members
    FROM top JOIN pos ON p BETWEEN i AND j GROUP BY i, j"""))
def indistinguishable_groups(spark, sf):
    ranks = compare.average_ranks(table(spark, sf), ALGS)
    return compare.indistinguishable_groups(ranks, tests(spark, sf)).withColumn(
        "members", F.array_join("members", "|"))


@query("mean_performance", with_sql(MATRIX, "SELECT algorithm, round(avg(auroc), 6) AS mean_auroc FROM mat GROUP BY ALL"))
def mean_performance(spark, sf):
    return rounded(compare.mean_performance(table(spark, sf), ALGS), "mean_auroc")


@query("best_algorithm", with_sql(MATRIX, "SELECT algorithm, round(avg_rank, 6) AS avg_rank FROM ranks WHERE algorithm = (FROM best)"))
def best_algorithm(spark, sf):
    return rounded(compare.best_algorithm(compare.average_ranks(table(spark, sf), ALGS)), "avg_rank")


@query("best_significance", with_sql(MATRIX, """
    SELECT count(*) FILTER (significant) AS significant, round(count(*) FILTER (significant) / CAST(count(*) AS DOUBLE), 6) AS fraction
    FROM sig WHERE algorithm = (FROM best)"""))
def best_significance(spark, sf):
    return rounded(compare.best_significance(table(spark, sf), best_name(spark, sf)), "fraction")


@query("best_loses", with_sql(MATRIX, """
    SELECT count(*) AS datasets FROM (SELECT trial, snapshot, plate, bool_or(significant) AS s,
      bool_or(significant) FILTER (algorithm = (FROM best)) AS m FROM sig GROUP BY ALL) WHERE s AND NOT m"""))
def best_loses(spark, sf):
    return compare.best_loses(table(spark, sf), best_name(spark, sf))


@query("winner_breakdown", with_sql(MATRIX, """,
    w AS (SELECT algorithm FROM (SELECT *, row_number() OVER (PARTITION BY trial, snapshot, plate ORDER BY auroc DESC, algorithm) AS k FROM mat) WHERE k = 1)
    SELECT algorithm, count(*) AS wins, round(count(*) / CAST((SELECT count(*) FROM w) AS DOUBLE), 6) AS fraction FROM w GROUP BY ALL"""))
def winner_breakdown(spark, sf):
    return rounded(compare.winner_breakdown(table(spark, sf), ALGS), "fraction")


@query("snapshot_success", with_sql(CMP, """
    SELECT trial, snapshot_number, round(avg(CASE WHEN s THEN 1.0 ELSE 0.0 END), 6) AS success_fraction FROM (
      SELECT trial, snapshot_number, plate, bool_or(significant) AS s FROM full_table GROUP BY ALL) GROUP BY ALL"""))
def snapshot_success(spark, sf):
    return rounded(compare.snapshot_success(table(spark, sf)), "success_fraction")


@query("irregularity_distribution", with_sql(CMP, """
    SELECT trial, snapshot_number, round(quantile_cont(p, 0), 6) AS minimum, round(quantile_cont(p, 0.25), 6) AS q1,
      round(quantile_cont(p, 0.5), 6) AS median, round(quantile_cont(p, 0.75), 6) AS q3, round(quantile_cont(p, 1), 6) AS maximum
    FROM (SELECT DISTINCT trial, plate, snapshot_number, anomaly_proportion AS p FROM full_table) GROUP BY ALL"""))
def irregularity_distribution(spark, sf):
    return rounded(compare.irregularity_distribution(table(spark, sf)), *compare.QUARTILES)


NUMBERS = ", ".join(f'round(avg(auroc) FILTER (snapshot_number = {i}), 6) AS "{i}"' for i in range(5))


@query("best_by_trial_snapshot", with_sql(MATRIX, f"""
    SELECT trial, {NUMBERS} FROM full_table WHERE algorithm = (FROM best) GROUP BY trial"""))
def best_by_trial_snapshot(spark, sf):
    out = compare.best_by_trial_snapshot(table(spark, sf), best_name(spark, sf), [0, 1, 2, 3, 4])
    return rounded(out, *[str(i) for i in range(5)])


SUMMARY = """SELECT coalesce(trial, 'total') AS trial, count(*) AS datasets, avg(num_samples) AS avg_instances,
    avg(num_columns) AS avg_features, avg(anomaly_proportion) * 100 AS pct_irregular
    FROM sig WHERE algorithm = (FROM best) GROUP BY ROLLUP (trial)"""
SUMMARY_COLS = ("avg_instances", "avg_features", "pct_irregular")
SUMMARY_OUT = ", ".join(f"round({c}, 6) AS {c}" for c in SUMMARY_COLS)


@query("trial_summary", with_sql(MATRIX, f"SELECT trial, datasets, {SUMMARY_OUT} FROM ({SUMMARY})"))
def trial_summary(spark, sf):
    return rounded(compare.trial_summary(table(spark, sf), best_name(spark, sf)), *SUMMARY_COLS)


FACTS_SQL = " UNION ALL ".join(
    f"SELECT 'T{i}' AS trial, CAST({p} AS BIGINT) AS participants, CAST({c} AS BIGINT) AS centres, CAST({n} AS BIGINT) AS countries"
    for i, (_, p, c, n) in enumerate(compare.TRIAL_FACTS))


@query("join_trial_facts", with_sql(MATRIX, f"""
    SELECT trial, participants, centres, countries, coalesce(datasets, 0) AS datasets, {SUMMARY_OUT}
    FROM ({FACTS_SQL}) FULL JOIN ({SUMMARY}) USING (trial)""").replace(
        "participants, centres, countries, coal", "coalesce(participants, 0) AS participants, coalesce(centres, 0) AS centres, coalesce(countries, 0) AS countries, coal"))
def join_trial_facts(spark, sf):
    rows = [(f"T{i}", *row[1:]) for i, row in enumerate(compare.TRIAL_FACTS)]
    facts = spark.createDataFrame(rows, compare.FACTS_SCHEMA)
    summary = compare.trial_summary(table(spark, sf), best_name(spark, sf))
    joined = rounded(compare.join_trial_facts(summary, facts), *SUMMARY_COLS)
    return joined.na.fill(0, ["participants", "centres", "countries", "datasets"])


@query("trial_algorithm_means", with_sql(MATRIX, """
    SELECT trial, round(avg(auroc) FILTER (algorithm = 'KNN'), 6) AS KNN, round(avg(auroc) FILTER (algorithm = 'ECOD'), 6) AS ECOD,
      round(avg(auroc) FILTER (algorithm = 'PCA'), 6) AS PCA FROM mat GROUP BY trial"""))
def trial_algorithm_means(spark, sf):
    return rounded(compare.trial_algorithm_means(table(spark, sf), ALGS, ["KNN", "ECOD", "PCA"]), "KNN", "ECOD", "PCA")


@query("report_tables", with_sql(MATRIX, """
    SELECT trial, printf('%.3f', avg(auroc) FILTER (algorithm = 'KNN')) AS KNN, printf('%.3f', avg(auroc) FILTER (algorithm = 'PCA')) AS PCA,
      '-' AS missing FROM mat GROUP BY trial"""))
def report_tables(spark, sf):
    root = scratch_path(spark, "report")
    means = compare.trial_algorithm_means(table(spark, sf), ALGS, ["KNN", "PCA"])
    src.report_tables({
        "trial_algorithm_means": means.withColumn("missing", F.lit(None).cast("double")),
        "trial_summary": compare.trial_summary(table(spark, sf), best_name(spark, sf)),
        "best_by_trial_snapshot": compare.best_by_trial_snapshot(table(spark, sf), best_name(spark, sf), [0, 1, 2, 3, 4]),
    }, root)
    return spark.read.option("header", True).csv(f"{root}/trial_algorithm_means")


# --- selection --------------------------------------------------------------------------

# one row per (dataset, pos)
FEATURE_STATS = CELLS + ["""
    fs AS (SELECT dataset, pos, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS sd, min(value) AS "min", max(value) AS "max",
      count(DISTINCT value) / CAST(count(*) AS DOUBLE) AS distinct_share,
      count(*) FILTER (value = 0) / CAST(count(*) AS DOUBLE) AS zero_share,
      quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.99) AS q99,
      kurtosis_pop(value) AS kurtosis FROM cell GROUP BY ALL)""", """
    ent AS (SELECT dataset, pos, -sum(p * ln(p)) AS entropy FROM (
      SELECT dataset, pos, count(*) / CAST(sum(count(*)) OVER (PARTITION BY dataset, pos) AS DOUBLE) AS p FROM cell GROUP BY dataset, pos, value) GROUP BY ALL)""", """
    sk AS (SELECT c.dataset, c.pos, avg(pow((value - mean) / sd, 3)) AS skewness FROM cell c JOIN fs USING (dataset, pos) GROUP BY ALL)""", """
    cr AS (SELECT dataset, abs(corr(x.value, y.value)) AS r FROM cell x JOIN cell y USING (dataset, rec_id) WHERE x.pos < y.pos GROUP BY dataset, x.pos, y.pos)"""]

STAT_COLS = ["mean", "sd", "min", "max", "distinct_share", "zero_share", "q25", "q50", "q99", "kurtosis", "entropy", "skewness"]
FOLDED = " UNION ALL ".join(
    f"""SELECT dataset, '{c}_{name}' AS feature, {fn}("{c}") AS value FROM fs JOIN ent USING (dataset, pos) JOIN sk USING (dataset, pos) GROUP BY dataset"""
    for c in STAT_COLS for name, fn in (("min", "min"), ("max", "max"), ("mean", "avg"), ("sd", "stddev_pop")))
STATS_SQL = f"""
    mf AS ({FOLDED}
      UNION ALL SELECT dataset, 'n_rows', CAST(max(n) AS DOUBLE) FROM fs GROUP BY 1
      UNION ALL SELECT dataset, 'n_features', CAST(count(*) AS DOUBLE) FROM fs GROUP BY 1
      UNION ALL SELECT dataset, 'corr_mean', avg(r) FROM cr GROUP BY 1
      UNION ALL SELECT dataset, 'corr_max', max(r) FROM cr GROUP BY 1
      UNION ALL SELECT dataset, 'corr_min', min(r) FROM cr GROUP BY 1
      UNION ALL SELECT dataset, 'corr_sd', stddev_pop(r) FROM cr GROUP BY 1)"""
CHECKED = [f"{c}_{s}" for c in STAT_COLS for s in ("min", "max", "mean", "sd")] + [
    "n_rows", "n_features", "corr_mean", "corr_max", "corr_min", "corr_sd"]


@query("meta_features_stats", with_sql(FEATURE_STATS + [STATS_SQL], "SELECT dataset, feature, round(value, 5) AS value FROM mf"))
def meta_features_stats(spark, sf):
    cells = selector.meta_features_stats(plates(spark, sf))
    return rounded(cells.filter(F.col("feature").isin(CHECKED)), "value", places=5)


@query("meta_features_landmarks")
def meta_features_landmarks(spark, sf):
    return selector.meta_features_landmarks(plates(spark, sf))


@query("performance_matrix", with_sql(MATRIX, f"SELECT {DATASET}, {PIVOT} FROM mat GROUP BY ALL"))
def performance_matrix(spark, sf):
    return selector.performance_matrix(table(spark, sf), ALGS)


def meta_cells(spark, sf):
    """Long statistics of the comparison datasets; some missing, infinite or empty."""
    named = table(spark, sf).withColumn("dataset", selector.dataset_name())
    wide = named.groupBy("dataset", "trial", "snapshot", "plate").agg(
        F.sum("num_samples").cast("double").alias("rows"),
        F.max("num_columns").cast("double").alias("cols"),
        F.avg("anomaly_proportion").alias("share"),
    )
    third = F.col("plate") == "P3"
    empty = (F.col("plate") == "P5") & (F.col("snapshot") == "S2")
    wide = wide.withColumns({
        "share": F.when(third, F.lit(float("inf"))).when(~empty, F.col("share")),
        "rows": F.when(~empty, F.col("rows")), "cols": F.when(~empty & (F.col("plate") != "P7"), F.col("cols")),
    })
    return wide.unpivot(["dataset", "trial", "snapshot", "plate"], ["rows", "cols", "share"], "feature", "value")


META = CMP + ["""
    mw AS (SELECT trial || '/' || snapshot || '/' || plate AS dataset, trial, snapshot, plate,
      CAST(sum(num_samples) AS DOUBLE) AS n, CAST(max(num_columns) AS DOUBLE) AS c, avg(anomaly_proportion) AS p,
      plate = 'P5' AND snapshot = 'S2' AS gone FROM cmp GROUP BY ALL)""", """
    mc AS (SELECT dataset, trial, snapshot, plate, 'rows' AS feature, CASE WHEN NOT gone THEN n END AS value FROM mw
      UNION ALL SELECT dataset, trial, snapshot, plate, 'cols', CASE WHEN NOT gone AND plate <> 'P7' THEN c END FROM mw
      UNION ALL SELECT dataset, trial, snapshot, plate, 'share', CASE WHEN NOT gone AND plate <> 'P3' THEN p END FROM mw)""", """
    clean AS (SELECT * FROM mc WHERE dataset IN (SELECT dataset FROM mw WHERE NOT gone))""", """
    sc AS (SELECT feature, min(value) AS lo, max(value) AS hi, avg(value) AS m FROM clean GROUP BY feature)"""]


@query("meta_training_set", with_sql(MATRIX + META[len(CMP):], f"""
    SELECT dataset, feature, round(value, 6) AS value, {PIVOT} FROM clean JOIN mat USING ({DATASET}) GROUP BY dataset, feature, value"""))
def meta_training_set(spark, sf):
    cells = selector.clean_metafeatures(meta_cells(spark, sf))
    out = selector.meta_training_set(cells, selector.performance_matrix(table(spark, sf), ALGS))
    return rounded(out.drop("trial", "snapshot", "plate"), "value")


@query("clean_metafeatures", with_sql(META, "SELECT dataset, feature, round(value, 6) AS value FROM clean"))
def clean_metafeatures(spark, sf):
    return rounded(selector.clean_metafeatures(meta_cells(spark, sf)).select("dataset", "feature", "value"), "value")


@query("scale_metafeatures", with_sql(META, """
    SELECT dataset, feature, round(CASE WHEN hi > lo THEN (coalesce(value, m) - lo) / (hi - lo) ELSE 0 END, 6) AS value
    FROM clean JOIN sc USING (feature)"""))
def scale_metafeatures(spark, sf):
    cells = selector.clean_metafeatures(meta_cells(spark, sf))
    out = selector.scale_metafeatures(cells, selector.fit_scaling(cells))
    return rounded(out.select("dataset", "feature", "value"), "value")


@query("apply_scaling", with_sql(META, """
    , part AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM clean WHERE trial <> 'T0' GROUP BY feature)
    SELECT dataset, feature, round(CASE WHEN hi > lo THEN least(greatest((CASE WHEN plate = 'P3' AND feature = 'share' THEN hi + 1
      ELSE coalesce(value, 0) END - lo) / (hi - lo), 0), 1) ELSE 0 END, 6) AS value FROM mc JOIN part USING (feature)"""))
def apply_scaling(spark, sf):
    cells = selector.clean_metafeatures(meta_cells(spark, sf)).filter("trial <> 'T0'")
    out = selector.apply_scaling(meta_cells(spark, sf), selector.fit_scaling(cells))
    return rounded(out.select("dataset", "feature", "value"), "value")


@query("leave_one_trial_out", with_sql(CMP, """
    SELECT trial, snapshot, plate, algorithm, CASE WHEN trial = 'T0' THEN 'validation' ELSE 'training' END AS part
    FROM cmp WHERE trial <> 'T4'"""))
def leave_one_trial_out(spark, sf):
    return selector.leave_one_trial_out(table(spark, sf), "T4").select(
        "trial", "snapshot", "plate", "algorithm", "part")


LEFT_OUT = "T4"


def trial_records(spark, sf):
    """Stored records of the plates of all trials."""
    rows = fx.load(spark, sf, "lineitem").count()
    raw = preprocess.to_plates(fx.trial_plates(spark, sf), "dataset", "rec_id", "y", fx.TRIAL_FEATURES)
    return shared(spark, sf, "trial records", lambda: store_records(preprocess.preprocess_plates(raw), rows))


def trial_rows(spark, sf):
    """Performance of every detector on every plate of the trials."""

    def build():
        rows = reporting.comparison_rows(evaluation.evaluate_detectors(trial_records(spark, sf)))
        return settle(rows.withColumn("dataset", selector.dataset_name()))

    return shared(spark, sf, "trial rows", build)


def trial_metafeatures(spark, sf):
    """Statistics and landmarks of every plate of the trials."""
    return shared(spark, sf, "trial meta-features", lambda: settle(selector.meta_features(trial_records(spark, sf))))


def of_trial(df, trial=LEFT_OUT):
    return df.filter(F.col("dataset").startswith(f"{trial}/"))


def trained(spark, sf, fit=fit_rank_selector):
    """Selector trained on the plates of all trials but one; the least of the others is for validation."""
    rows = selector.leave_one_trial_out(trial_rows(spark, sf), LEFT_OUT)
    return fit(trial_metafeatures(spark, sf), rows, ALGS)


def rank_trained(spark, sf):
    return shared(spark, sf, "rank selector", lambda: trained(spark, sf))


@query("trial_comparisons")
def trial_comparisons(spark, sf):
    return trial_rows(spark, sf).drop("dataset")


@query("fit_selector")
def fit_selector(spark, sf):
    """How both kinds of selectors choose on the trial that neither has seen."""
    cells, rows = of_trial(trial_metafeatures(spark, sf)), of_trial(trial_rows(spark, sf))
    kinds = {"rank loss": rank_trained(spark, sf), "squared loss": trained(spark, sf, selector.fit_selector)}
    parts = [
        selector.choice_ranks(selector.predict_performance([s], cells), rows).select(F.lit(kind).alias("loss"), "dataset", "algorithm", "auroc", "place")
        for kind, s in kinds.items()
    ]
    return parts[0].unionByName(parts[1])


@query("tune_selector")
def tune_selector(spark, sf):
    """Choices on the unseen trial of the selector whose rank served the validation trial best."""
    rows = selector.leave_one_trial_out(trial_rows(spark, sf), LEFT_OUT)
    tuned = selector.tune_selector(trial_metafeatures(spark, sf), rows, ALGS, (1, 3), fit_rank_selector, steps=30)
    return selector.choice_ranks(selector.predict_performance([tuned], of_trial(trial_metafeatures(spark, sf))), of_trial(trial_rows(spark, sf)))


@query("predict_performance")
def predict_performance(spark, sf):
    return selector.predict_performance([rank_trained(spark, sf)], of_trial(trial_metafeatures(spark, sf)))


@query("save_load_selector")
def save_load_selector(spark, sf):
    path = scratch_path(spark, "selector")
    rank_trained(spark, sf).save(path)
    return selector.predict_performance([RankSelector.load(spark, path)], of_trial(trial_metafeatures(spark, sf)))


@query("top_models", with_sql([PREDICTED_SQL], "SELECT dataset, algorithm, r AS place FROM predicted WHERE r <= 2"))
def top_models(spark, sf):
    return selector.top_models(predictions(spark, sf), 2).drop("predicted")


@query("score_with_selector")
def score_with_selector(spark, sf):
    """Scores of the detector chosen for each plate of the unseen trial; only the chosen ones run."""
    records = store_records(of_trial(trial_records(spark, sf)), fx.load(spark, sf, "lineitem").count())
    return evaluation.score_with_selector(records, [rank_trained(spark, sf)], metafeatures=of_trial(trial_metafeatures(spark, sf)))


@query("evaluate_selection")
def evaluate_selection(spark, sf):
    records = store_records(of_trial(trial_records(spark, sf)), fx.load(spark, sf, "lineitem").count())
    rows = selector.leave_one_trial_out(trial_rows(spark, sf), LEFT_OUT)
    cells = trial_metafeatures(spark, sf)
    squared = [trained(spark, sf, selector.fit_selector)]
    return evaluation.evaluate_selection(
        records, (cells, rows), pretrained=squared, metafeatures=of_trial(cells), retrained=[rank_trained(spark, sf)])

"""Nothing is cut silently: duplicates, equal results, failing tables, paths, prefixes of neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapsift.config import StudyConfig
from snapsift.operators import compare, selector
from snapsift.operators.detectors import iforest, neighbors, ocsvm, pool
from snapsift.plans import evaluation, reporting, study
from snapsift.sources import tables as src


@pytest.fixture(scope="module")
def results(spark):
    rows = [("T", "S", f"P{i}", a, v) for i in range(30) for a, v in (("A", 0.5 + i / 100), ("B", 0.5 + i / 100), ("C", 0.4 + (i * 7 % 11) / 50))]
    return spark.createDataFrame(rows, "trial string, snapshot string, plate string, algorithm string, auroc double")


def test_several_results_for_one_cell_raise(results):
    twice = results.union(results.filter("algorithm = 'A'").limit(1).withColumn("auroc", F.lit(0.9)))
    for use in (compare.auroc_matrix, compare.winner_breakdown, selector.performance_matrix):
        with pytest.raises(Exception, match="several results of an algorithm"):
            use(twice, ["A", "B", "C"]).collect()


def test_equal_pair_is_a_test_with_p_one(results):
    tests = {(r.a, r.b): r for r in compare.holm_adjust(compare.pairwise_wilcoxon(results, ["A", "B", "C"])).collect()}
    assert set(tests) == {("A", "B"), ("A", "C"), ("B", "C")}
    assert tests["A", "B"].n == 0 and tests["A", "B"].p == tests["A", "B"].p_adjusted == 1.0
    assert tests["A", "C"].p_adjusted == pytest.approx(min(1, 3 * tests["A", "C"].p))


def test_a_failing_table_is_one_failure_row(spark, tmp_path):
    good = spark.range(20).selectExpr("cast(id % 2 as int) centre", "cast(id as int) id", "cast(id * 2.5 as double) v", "cast(id as string) t")
    gold = good.withColumn("v", F.when(F.col("id") == 3, 1.0).otherwise(F.col("v")))
    broken = gold.withColumn("v", F.when(F.col("id") >= 0, F.raise_error(F.lit("unreadable"))).cast("double"))
    config = StudyConfig("demo", "", "gold", ("S1",))
    cells, status, records = study.study_diff(spark, config, {"S1": {"x": good, "y": good}}, {"x": gold, "y": broken})
    found = {r.table_name: (r.success, r.error, r.n_rows) for r in status.collect()}
    assert found == {"x": (True, None, 20), "y": (False, "DataFrameLoadingException", None)}
    assert cells.count() == 1
    labelled = study.derive_labels(cells, status, records)
    row = labelled.filter("any_change").first()
    assert row.text_names == ["t"] and row.texts == ["3"] and row.value_names == ["v"]
    assert study.derive_labels(cells, status, records, record_threshold=0.6).filter("record_change").count() == 0


def test_a_study_without_success_keeps_its_status(spark):
    config = StudyConfig("demo", "", "gold", ("S1",))
    table = spark.range(5).selectExpr("cast(id as int) centre", "cast(id as int) id", "id v")
    cells, status, records = study.study_diff(spark, config, {"S1": {"x": table}}, {})
    assert cells.count() == records.count() == 0
    assert [(r.table_name, r.error) for r in status.collect()] == [("x", "GoldStandardTableNotFound")]


def test_listing_below_a_repeated_name(spark, tmp_path):
    root = f"{tmp_path}/gold+1/export/gold+1"
    spark.range(3).write.parquet(f"{root}/orders.parquet")
    assert {r.file for r in src.list_snapshot(spark, root).collect()} == {"orders.parquet"}
    rows = spark.createDataFrame([("P", 3, "T 1")], "plate string, num_samples long, trial string")
    src.write_trial_comparisons(rows, root)
    assert [(r.trial, r.plate) for r in src.read_comparisons(spark, root, "plate string, num_samples long").collect()] == [("T 1", "P")]


def test_table_named_like_a_title(spark, tmp_path):
    (tmp_path / "list.csv").write_text("visits,of the study\nno,SAS libraries\n1,visits\n2,bloods\n3,\n")
    study_config = StudyConfig("demo", str(tmp_path), "gold", (), metadata_filename="list.csv")
    assert sorted(r[0] for r in src.read_metadata(spark, study_config).collect()) == ["bloods", "visits"]


@pytest.fixture(scope="module")
def plates(spark):
    rng = np.random.default_rng(0)
    rows = [(f"d{i % 2}", i, [float(v) for v in rng.normal(size=4)], int(i % 9 == 0)) for i in range(400)]
    return spark.createDataFrame(rows, "dataset string, rec_id long, features array<double>, y int").cache()


def test_forest_scores_do_not_depend_on_the_company(plates):
    def scores(settings):
        frame = iforest.score_iforest_settings(plates, settings).filter(F.col("algorithm") == iforest.setting_name(20, 0.5))
        return {(r.dataset, r.rec_id): r.score for r in frame.collect()}

    assert scores([(20, 0.5)]) == scores([(20, 0.1), (20, 0.5), (10, 1.0)])


def test_prefixes_of_neighbours_score_as_alone():
    rng = np.random.default_rng(1)
    p, v = rng.normal(size=(5, 3)), rng.normal(size=(5, 12, 3))
    v[0, 2] = p[0]
    ks = [1, 3, 5, 12]
    angles, chains = neighbors.angle_variances(p, v, ks), neighbors.chain_distances(p, v, ks)
    for i in range(5):
        for j, k in enumerate(ks):
            gap = v[i, :k] - p[i]
            size = (gap * gap).sum(1)
            gap, size = gap[size > 0], size[size > 0]
            a, b = np.triu_indices(len(size), 1)
            assert angles[i, j] == pytest.approx(-np.var((gap @ gap.T)[a, b] / (size[a] * size[b])) if len(size) > 1 else 0.0)
            near, left, total = np.linalg.norm(v[i, :k] - p[i], axis=1), list(range(k)), 0.0
            for step in range(1, k + 1):
                best = min(left, key=lambda x: (near[x], x))
                total += 2 * (k + 1 - step) / (k * (k + 1)) * near[best]
                left.remove(best)
                near = np.minimum(near, np.linalg.norm(v[i, :k] - v[i, best], axis=1))
            assert chains[i, j] == pytest.approx(total)


def test_svm_parameters(plates):
    few = ocsvm.score_ocsvm_settings(plates, [(0.5, "linear")], steps=2, landmarks=3)
    assert few.count() == 400 and few.filter("score is null").count() == 0
    at_once = ocsvm.score_ocsvm_settings(plates, [(0.5, "rbf")], steps=50, tolerance=1e9)
    assert at_once.count() == 400


def test_only_the_chosen_detectors_run(plates, monkeypatch, spark):
    ran = []
    for name in ("HBOS", "ECOD"):
        monkeypatch.setitem(pool.DETECTORS, name, lambda records, name=name, **_: ran.append(
            (name, [r[0] for r in records.select("dataset").distinct().collect()])) or records.select("dataset", "rec_id", F.lit(1.0).alias("score")))
    chosen = spark.createDataFrame([("d0", "HBOS"), ("d1", "ECOD")], "dataset string, algorithm string")
    scored = evaluation.score_chosen(plates, chosen, {"HBOS": {}, "ECOD": {}, "KNN": {"k": [5]}})
    assert scored.count() == 400 and sorted(ran) == [("ECOD", ["d1"]), ("HBOS", ["d0"])]


def test_validation_rows_are_not_trained_on(spark):
    rng = np.random.default_rng(2)
    cells = [(f"d{i}", f"m{j}", float(rng.normal())) for i in range(24) for j in range(3)]
    rows = [(f"d{i}", a, float(rng.uniform(0.4, 0.9)), "validation" if i < 6 else "training") for i in range(24) for a in ("A", "B", "C")]
    features = spark.createDataFrame(cells, "dataset string, feature string, value double")
    table = spark.createDataFrame(rows, "dataset string, algorithm string, auroc double, part string")
    noisy = table.withColumn("auroc", F.when(F.col("part") == "validation", 99.0).otherwise(F.col("auroc")))
    a, b = (selector.fit_selector(features, t, ["A", "B", "C"], 2, trees=3) for t in (table, noisy))
    assert a.scaling.count() == b.scaling.count() == 3
    assert {r.algorithm: r.g for r in a.algorithms.collect()} == {r.algorithm: r.g for r in b.algorithms.collect()}
    assert selector.tune_selector(features, table, ["A", "B", "C"], (1, 2), trees=3).rank in (1, 2)


def test_report_over_a_folder(spark, tmp_path, results):
    rows = results.selectExpr("*", "10L num_samples", "3L num_columns", "1L num_anomalies", "0.1D anomaly_proportion", "'' hyperparameters",
                              "auroc - 0.05 auroc_lower", "auroc auroc_upper", "auroc auroc_lower_corrected", "auroc auroc_upper_corrected", "auroc aupr", "cast(null as string) error")
    reporting.write_study_comparisons(rows, f"{tmp_path}/c")
    out = reporting.report(spark, f"{tmp_path}/c", f"{tmp_path}/r")
    assert out["pairwise"].count() == 3 and out["winner_breakdown"].count() >= 1
    assert spark.read.option("header", True).csv(f"{tmp_path}/r/trial_summary").count() == 2

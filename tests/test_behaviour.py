"""Failure kinds, invariants and edge rows."""

import math

import pytest
from pyspark.sql import functions as F

from snapsift import fixtures as fx
from snapsift.config import FAILURES, StudyConfig, TableFailure
from snapsift.operators import compare, ensemble, guards, labels, metrics, preprocess, selector, snapdiff, summary
from snapsift.operators.detectors import iforest, loda, ocsvm, pool
from snapsift.plans import study as plans
from snapsift.sources import tables as src

FORM = "centre int, id int, a double, b string"


def form(spark, rows, schema=FORM):
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def base(spark):
    return form(spark, [(1, 1, 1.0, "x"), (1, 2, 2.0, "y"), (2, 3, None, "z")])


def kind(call):
    with pytest.raises(TableFailure) as error:
        call()
    assert error.value.kind in FAILURES
    return error.value.kind


def test_failure_kinds(spark, base):
    diff = snapdiff.compute_table_diff
    changed = base.withColumn("a", F.lit(9.0))
    wide = base.select("*", *[F.lit(0).alias(f"c{i}") for i in range(5)])
    assert kind(lambda: diff(None, base)) == "DataFrameLoadingException"
    assert kind(lambda: diff(base, None)) == "GoldStandardTableNotFound"
    assert kind(lambda: diff(base.filter("id < 0"), base)) == "EmptyTableSnapshot"
    assert kind(lambda: diff(base.drop("centre"), base)) == "ParticipantIdentifierNotAvailable"
    assert kind(lambda: diff(base, base)) == "NoMeaningfulData"
    assert kind(lambda: diff(base.select("centre", "id"), base.select("centre", "id"))) == "NoMeaningfulData"
    assert kind(lambda: diff(changed.withColumn("b", F.lit(1)), base)) == "SnapshotSchemaChange"
    assert kind(lambda: diff(changed.withColumnRenamed("b", "q"), base)) == "SnapshotSchemaChange"
    assert kind(lambda: guards.guard_width(wide, base, 0, 5)) == "PreliminarySnapshotTooWide"
    assert kind(lambda: guards.guard_width(base, wide, 0, 5)) == "GoldStandardSnapshotTooWide"
    assert kind(lambda: guards.guard_width(base, wide, 6, 50)) == "PreliminarySnapshotTooNarrow"
    assert kind(lambda: guards.guard_width(wide, base, 6, 50)) == "GoldStandardSnapshotTooNarrow"
    assert kind(lambda: snapdiff.dup_count(base, ["nope"])) == "DuplicatesUncountable"
    twice = base.unionByName(base)
    assert kind(lambda: diff(twice, twice)) == "SufficientIdentifiersNotAvailable"
    assert kind(lambda: snapdiff.guard_diff_key(twice.withColumn("diff", F.lit("C")), ["id"])) == "DiffIdentifiersInsufficient"
    assert kind(lambda: src.valid_tables(None)) == "MetadataUnavailable"
    assert kind(lambda: src.read_snapshot_table(spark, "/nonexistent/path")) == "DataFrameLoadingException"
    study = StudyConfig("s", "", "g", ("p",), exclude_tables=("t",))
    assert snapdiff.process_table(study, "p", "t", base, base, "unused")[1][4] == "ExcludedTable"


def test_align_only_when_counts_differ(base):
    renamed = base.withColumnRenamed("b", "q")
    assert guards.align_schemas(renamed, base)[0].columns == renamed.columns
    assert guards.align_schemas(renamed, base, strict=False)[0].columns == ["centre", "id", "a"]
    assert guards.align_schemas(base.drop("b"), base)[1].columns == ["centre", "id", "a"]


def test_diff_invariants(spark, sf):
    pre = guards.prune_columns(fx.orders_snapshot(spark, sf, 1))
    gold = fx.orders_gold(spark, sf)
    count = lambda df: {r["diff"]: r["count"] for r in df.groupBy("diff").count().collect()}
    assert set(count(snapdiff.diff_snapshots(pre, pre, fx.ORDER_KEY))) == {"N"}
    there, back = (count(snapdiff.diff_snapshots(a, b, fx.ORDER_KEY)) for a, b in ((pre, gold), (gold, pre)))
    assert there["I"] == back["D"] and there["D"] == back["I"]
    assert there["C"] == back["C"] and there["N"] == back["N"]


def test_null_keys_match_and_underscores_survive(spark):
    schema = "id int, my_long_name double"
    pre, gold = form(spark, [(None, 1.0), (1, 2.0)], schema), form(spark, [(None, 5.0), (1, 2.0)], schema)
    diff = snapdiff.diff_snapshots(pre, gold, ["id"])
    assert {r["diff"] for r in diff.collect()} == {"C", "N"}
    cells = snapdiff.salient_cells(guards.filter_changes(diff), ["id"]).collect()
    assert [(c["column"], c["left"], c["right"]) for c in cells] == [("my_long_name", "1.0", "5.0")]


def test_fused_cells_equal_stepwise(spark, sf):
    pre = guards.prune_columns(fx.orders_snapshot(spark, sf, 2))
    changes = guards.filter_changes(snapdiff.diff_snapshots(pre, fx.orders_gold(spark, sf), fx.ORDER_KEY))
    fused = snapdiff.salient_cells(changes, fx.ORDER_KEY)
    steps = guards.filter_salient(snapdiff.pivot_sides(snapdiff.unpivot_diff(changes, fx.ORDER_KEY), fx.ORDER_KEY))
    assert fused.exceptAll(steps.select(*fused.columns)).isEmpty() and fused.count() == steps.count() > 0


def test_key_prefers_identifier_names(spark):
    rows = [(1, 1, i, i * 1.0, i) for i in range(4)]
    df = form(spark, rows, "centre int, id int, aaa int, b double, visit int")
    assert snapdiff.discover_key(df, df, ["centre", "id"]) == ["centre", "id", "visit"]
    assert snapdiff.discover_key(df.drop("visit"), df.drop("visit"), ["centre", "id"])[-1] == "aaa"
    assert kind(lambda: snapdiff.discover_key(df, df, ["centre", "id"], max_cols=2)) == "SufficientIdentifiersNotAvailable"


def test_labels_ignore_fill_ins_deletions_and_unreliable_columns(spark):
    pre = form(spark, [(1, i, 1.0, None if i == 2 else "x") for i in range(1, 11)])
    gold = form(spark, [(1, i, 5.0 if i <= 1 else 1.0, "x" if i != 9 else "q") for i in range(1, 10)])
    diff = snapdiff.compute_table_diff(pre, gold)
    out = {r["id"]: r for r in labels.derive_table_labels(diff.records, diff.cells, diff.key).collect()}
    assert [i for i in out if out[i]["any_change"]] == [1, 9]
    assert out[1]["change_frac"] == 0.5 and out[1]["record_change"] and out[2]["change_count"] == 0


def test_study_from_files(spark, tmp_path, sf):
    root = str(tmp_path)
    gold = fx.orders_gold(spark, sf)
    gold.write.parquet(f"{root}/Data/gold/orders.parquet")
    fx.customer_form(spark, sf).write.parquet(f"{root}/Data/gold/other.parquet")
    for k in (1, 2):
        fx.orders_snapshot(spark, sf, k).write.parquet(f"{root}/Data/s{k}/orders.parquet")
        fx.supplier_form(spark, sf).write.parquet(f"{root}/Data/s{k}/suppliers.parquet")
        fx.customer_form(spark, sf).withColumn("c_acctbal", F.lit(0.0)).write.parquet(f"{root}/Data/s{k}/other.parquet")
    (tmp_path / "tables.csv").write_text("Title,,\nnumber,SAS libraries,x\n1,orders,a\n2,orders,b\n3,absent,c\n")
    (tmp_path / "study.toml").write_text(f"""
name = "demo"
root = "{root}"
[metadata]
filename = "tables.csv"
[snapshots]
root_subdir = "Data"
gold_standard = "gold"
preliminary = ["s1", "s2"]
[label_derivation]
exclude_fields = ["o_custkey"]
""")
    study = StudyConfig.from_toml(f"{root}/study.toml")
    assert study.snapshot_root("gold") == f"{root}/Data/gold"
    out = str(tmp_path / "out")
    plans.run_study(spark, study, out)
    status = spark.read.parquet(f"{out}/status")
    errors = {(r["snapshot"], r["table_name"]): r["error"] for r in status.collect()}
    assert errors[("s1", "suppliers")] == "GoldStandardTableNotFound" and errors[("s2", "orders")] is None
    labelled = src.read_labelled(spark, f"{out}/derived")
    assert {r["table_name"] for r in labelled.select("table_name").distinct().collect()} == {"orders"}
    rows = {s: fx.orders_snapshot(spark, sf, k).count() for k, s in ((1, "s1"), (2, "s2"))}
    assert {r["snapshot"]: r["count"] for r in labelled.groupBy("snapshot").count().collect()} == rows
    assert 0 < labelled.agg(F.sum("y")).first()[0] < sum(rows.values())
    pruned = src.read_diff(spark, f"{out}/diffs", "s1", "orders")
    assert "PartitionFilters: [isnotnull(snapshot" in pruned._jdf.queryExecution().executedPlan().toString()
    totals = summary.study_totals(summary.table_summary(status), 2).first()
    assert (totals["tables"], totals["attempts"], totals["successful"]) == (3, 6, 4)


INF, NAN = float("inf"), float("nan")


def scores_of(spark, values, ys):
    rows = [("d", "A", i, v, y) for i, (v, y) in enumerate(zip(values, ys))]
    return spark.createDataFrame(rows, "dataset string, algorithm string, rec_id long, score double, y int")


def test_clean_scores_edges(spark):
    clean = lambda v, y: [r["score"] for r in metrics.clean_scores(scores_of(spark, v, y)).orderBy("rec_id").collect()]
    assert clean([1.0, INF, -INF, 3.0, NAN], [0, 1, 0, 1, 0]) == [1.0, 3.0, 1.0, 3.0, 2.0]
    error = lambda v, y: metrics.score_profile(scores_of(spark, v, y)).first()["error"]
    assert error([1.0, 2.0], [1, 1]) == "no meaningful labels"
    assert error([INF, -INF], [0, 1]) == "all infinity predictions"
    assert error([NAN, NAN], [0, 1]) == "missing predictions"
    assert error([1.0, 2.0], [0, 1]) is None
    assert metrics.auroc(scores_of(spark, [1.0, 2.0], [1, 1])).first()["auroc"] is None


def test_auroc_invariants(spark, sf):
    scores = fx.document_scores(spark, sf)
    up = {r["dataset"]: r["auroc"] for r in metrics.auroc(scores).collect()}
    down = {r["dataset"]: r["auroc"] for r in metrics.auroc(scores.withColumn("score", -F.col("score"))).collect()}
    for d in up:
        assert (up[d] is None and down[d] is None) or math.isclose(up[d], 1 - down[d])
    ci = metrics.auroc_ci(scores_of(spark, [1.0, 2.0, 3.0, 4.0], [0, 0, 1, 1])).first()
    assert ci["auroc"] == 1.0 and ci["auroc_upper"] == 1.0


def test_prune_inf_and_ensembles(spark):
    s = scores_of(spark, [1.0, INF, NAN, -INF, 5.0], [0] * 5).drop("y")
    got = [r["score"] for r in ensemble.prune_inf(s).orderBy("rec_id").collect()]
    assert got[:2] == [1.0, 5.0] and math.isnan(got[2]) and got[3:] == [1.0, 5.0]
    none = ensemble.prune_inf(scores_of(spark, [INF, INF], [0, 0]).drop("y")).collect()
    assert [r["score"] for r in none] == [0.0, 0.0]
    flat = ensemble.minmax_scores(scores_of(spark, [2.0, 2.0], [0, 0]).drop("y")).collect()
    assert [r["score"] for r in flat] == [0.0, 0.0]
    one = scores_of(spark, [1.0, 4.0, 2.0], [0] * 3).drop("y")
    assert [r["score"] for r in ensemble.naive_ensemble(one).orderBy("rec_id").collect()] == [1.0, 4.0, 2.0]


def test_seeded_detectors_repeat(spark, sf):
    records = fx.vectors(spark, sf)
    for score in (iforest.score_iforest, loda.score_loda, ocsvm.score_ocsvm):
        a, b = (score(records).orderBy("rec_id").toPandas() for _ in range(2))
        assert len(a) == 500 and a["score"].round(9).equals(b["score"].round(9))


def test_forest_isolates_an_outlier(spark):
    rows = [("d", i, [math.sin(i * 1.7), math.cos(i * 2.3)]) for i in range(300)] + [("d", 999, [25.0, -25.0])]
    records = spark.createDataFrame(rows, "dataset string, rec_id long, features array<double>")
    for score in (iforest.score_iforest, ocsvm.score_ocsvm):
        assert score(records).orderBy(F.desc("score")).first()["rec_id"] == 999


def test_pool_has_all_settings():
    assert sum(len(pool.settings_of(n, pool.POOL)) for n in pool.POOL) == 302
    assert pool.combinations({}) == [{}]


def test_preprocess_drops_thin_plates_and_empty_columns(spark):
    rows = [("a", i, [1.0, 2.0, None if i else 3.0, float(i % 2), 5.0, None], 0) for i in range(12)]
    rows += [("short", i, [1.0] * 6, 0) for i in range(9)]
    rows += [("thin", i, [1.0, None, None, None, None, None], 0) for i in range(20)]
    plates = spark.createDataFrame(rows, "dataset string, rec_id long, values array<double>, y int")
    out = preprocess.preprocess_plates(plates).collect()
    assert {r["dataset"] for r in out} == {"a"} and len(out) == 12
    assert all(r["features"] == [1.0, 2.0, 3.0, r["rec_id"] % 2, 5.0] for r in out)
    # ties go to the smallest value
    tie = preprocess.feature_profile(plates).filter("dataset = 'a' and pos = 3").first()
    assert tie["mode"] == 0.0


def test_ranks_and_groups(spark, sf):
    table = compare.flag_significant(fx.comparisons(spark, sf))
    sums = compare.dataset_ranks(table, fx.ALGORITHMS).groupBy(*compare.DATASET).agg(F.sum("rank").alias("s"))
    assert sums.filter("s <> 21").isEmpty()
    ranks = spark.createDataFrame([("A", 1.0), ("B", 2.0), ("C", 3.0), ("D", 4.0)], "algorithm string, avg_rank double")
    rows = [("A", "B", 0.5), ("A", "C", 0.01), ("A", "D", 0.01), ("B", "C", 0.5), ("B", "D", 0.5), ("C", "D", 0.9)]
    tests = spark.createDataFrame(rows, "a string, b string, p_adjusted double")
    got = {tuple(r["members"]) for r in compare.indistinguishable_groups(ranks, tests).collect()}
    assert got == {("A", "B"), ("B", "C", "D")}


def test_holm(spark):
    tests = spark.createDataFrame([("a", "b", 0.01), ("a", "c", 0.04), ("b", "c", 0.03)], "a string, b string, p double")
    got = {(r["a"], r["b"]): round(r["p_adjusted"], 6) for r in compare.holm_adjust(tests).collect()}
    assert got == {("a", "b"): 0.03, ("b", "c"): 0.06, ("a", "c"): 0.06}


def test_selector_learns_the_better_algorithm(spark):
    """Algorithm A wins on large datasets, B on small ones."""
    rows, perf = [], []
    for i in range(60):
        large = i % 2
        rows.append((f"d{i:02d}", "size", 10.0 * large + i / 60))
        perf += [(f"d{i:02d}", "A", 0.9 if large else 0.4), (f"d{i:02d}", "B", 0.4 if large else 0.9)]
    cells = spark.createDataFrame(rows, "dataset string, feature string, value double")
    fitted = selector.fit_selector(cells, spark.createDataFrame(perf, "dataset string, algorithm string, auroc double"), ["A", "B"], rank=2)
    new = spark.createDataFrame([("big", "size", 10.5), ("small", "size", 0.4)], cells.schema)
    best = selector.top_models(selector.predict_performance([fitted], new))
    assert {r["dataset"]: r["algorithm"] for r in best.collect()} == {"big": "A", "small": "B"}


def test_no_python_rows_in_diff_plan(spark, sf):
    """The diff stays in generated code and joins once."""
    result = snapdiff.compute_table_diff(fx.orders_snapshot(spark, sf, 1), fx.orders_gold(spark, sf))
    plan = result.cells._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join ") == 1 and "Python" not in plan and "CartesianProduct" not in plan

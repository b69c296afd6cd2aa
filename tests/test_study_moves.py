"""Key search and study: gold rows are not moved more often than needed."""

import pytest
from pyspark.sql import functions as F

from snapsift.config import StudyConfig
from snapsift.operators import snapdiff
from snapsift.plans import study as plans


def lines(spark, rows=400):
    return spark.createDataFrame(
        [(1, i // 4, i % 4, float(i % 4 if i < rows - 4 else 0), i // 3) for i in range(rows)],
        "centre int, id int, dfseq int, amount double, part int")


def plain_order(name):
    return (name,)


@pytest.mark.parametrize("names", [["amount", "dfseq", "part"], ["amount", "part"], ["part"]])
@pytest.mark.parametrize("share", [1, 3, 1_000_003])
def test_best_candidate_is_that_of_all_counts(spark, monkeypatch, names, share):
    monkeypatch.setattr(snapdiff, "KEYS_PER_TRIED", share)
    gold = lines(spark)
    every = {r["candidate"]: r["dup_count"] for r in snapdiff.candidate_dup_counts(gold, ["centre", "id"], names).collect()}
    found = snapdiff.GoldCounts().best(gold, ["centre", "id"], names, plain_order)
    assert found == min(names, key=lambda c: (every[c], c))


def test_candidates_that_cannot_win_are_not_counted_over_all_rows(spark, monkeypatch):
    seen, count = [], snapdiff.candidate_dup_counts
    monkeypatch.setattr(snapdiff, "candidate_dup_counts", lambda df, key, names: seen.append(df.count()) or count(df, key, names))
    gold = lines(spark)
    assert snapdiff.discover_key(gold, gold, ["centre", "id"]) == ["centre", "id", "dfseq"]
    assert max(seen) < 400


def test_gold_rows_move_once_for_all_snapshots(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        gold = lines(spark)
        study = StudyConfig("s", "", "gold", ("A", "B"))
        pre = {s: {"lines": gold.withColumn("amount", F.col("amount") + i)} for i, s in enumerate(("A", "B"), 1)}
        cells, status, _ = plans.study_diff(spark, study, pre, {"lines": gold})
        assert len({r[0].rsplit("/", 1)[0] for r in cells.select(F.input_file_name()).distinct().collect()}) == 1
        assert {(r["snapshot"], r["n_diffs"]) for r in status.collect()} == {("A", 400), ("B", 400)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_snapshot_that_fails_leaves_the_others_of_its_table_alone(spark):
    gold = lines(spark)
    study = StudyConfig("s", "", "gold", ("A", "B", "C"))
    good = gold.withColumn("amount", F.col("amount") + 1)
    broken = gold.withColumn("amount", F.raise_error(F.lit("unreadable")).cast("double"))
    cells, status, records = plans.study_diff(
        spark, study, {"A": {"lines": good}, "B": {"lines": broken}, "C": {"lines": gold}}, {"lines": gold})
    got = {r["snapshot"]: (r["success"], r["error"], r["n_diffs"]) for r in status.collect()}
    assert got == {"A": (True, None, 400), "B": (False, "DataFrameLoadingException", None), "C": (False, "NoMeaningfulData", None)}
    assert cells.count() == 400 and records.count() == 400
    assert "unreadable" in status.filter("snapshot = 'B'").first()["error_message"]

"""Excluded columns as features, and messages of failed tables."""

import pytest
from pyspark.sql import functions as F

from snapsift.config import StudyConfig
from snapsift.operators import labels, snapdiff
from snapsift.plans import study


@pytest.fixture
def sides(spark):
    pre = spark.range(40).selectExpr("1 centre", "cast(id as int) id", "double(id) a", "double(id) b", "concat('n', id) note", "'no' checked")
    gold = pre.withColumns({"checked": F.lit("yes"), "a": F.when(F.col("id") == 7, -1.0).otherwise(F.col("a"))})
    return pre, gold


def test_excluded_columns_of_a_study(spark, sides):
    config = StudyConfig("demo", "", "gold", ("S1",))
    cells, status, records = study.study_diff(spark, config, {"S1": {"t": sides[0]}}, {"t": sides[1]})
    for drop in (True, False):
        rows = study.derive_labels(cells, status, records, drop_excluded=drop).collect()
        row = next(r for r in rows if r.key == ["1", "7"])
        assert len(rows) == 40 and sum(r.any_change for r in rows) == 1 and row.change_count == 1
        assert ("checked" in row.text_names) is not drop
        assert row.change_frac == pytest.approx(1 / (3 if drop else 4))


def test_excluded_columns_of_a_table(sides):
    diff = snapdiff.compute_table_diff(*sides, ("centre", "id"))
    for drop in (True, False):
        out = labels.derive_table_labels(diff.records, diff.cells, diff.key, drop_excluded=drop)
        assert ("checked" in out.columns) is not drop
        assert [r.id for r in out.filter("any_change").collect()] == [7]
        assert out.filter("id = 7").first().change_frac == pytest.approx(1 / (3 if drop else 4))


def test_switch_from_a_file(tmp_path):
    text = 'name = "n"\nroot = "r"\n[snapshots]\ngold_standard = "g"\npreliminary = ["p"]\n[label_derivation]\n'
    for line, want in (("", True), ("drop_excluded = false\n", False)):
        (tmp_path / "s.toml").write_text(text + line)
        assert StudyConfig.from_toml(str(tmp_path / "s.toml")).drop_excluded is want


def test_message_of_a_failed_table(spark, sides, tmp_path):
    config = StudyConfig("demo", "", "gold", ("S1",))
    broken = sides[0].withColumn("a", F.raise_error(F.lit("cell out of order")).cast("double"))
    result, row = snapdiff.process_table(config, "S1", "t", broken, sides[1], f"{tmp_path}/cells")
    assert result is None and row[4] == "DataFrameLoadingException" and "cell out of order" in row[5]

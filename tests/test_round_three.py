"""What the third review found: work that grew faster than its input."""

from collections import Counter

import pytest

from snapsift.config import StudyConfig, TableFailure
from snapsift.operators import snapdiff
from snapsift.plans import study as plans


def form(spark, rows=400):
    cells = [(i % 5 if i % 7 else None, i % 40, i // 40, [0.0, -0.0, float("nan"), 1.5, None][i % 5], "x" if i < 100 else str(i)) for i in range(rows)]
    return spark.createDataFrame(cells, "centre int, id long, dfseq int, amount double, note string")


def brute(rows, key, column):
    value = lambda x: "nan" if x != x else x
    return max(Counter((*[r[k] for k in key], value(r[column])) for r in rows).values())


@pytest.mark.parametrize("group_cells", [3, 40, 200_000])
@pytest.mark.parametrize("key", [["id"], ["centre"], ["centre", "id"]])
def test_candidates_are_counted_alike_in_groups_and_spread(spark, key, group_cells):
    df, names = form(spark), ["dfseq", "amount", "note"]
    got = {r["candidate"]: r["dup_count"] for r in snapdiff.candidate_dup_counts(df, key, names, group_cells).collect()}
    rows = df.collect()
    assert got == {c: brute(rows, key, c) for c in names}


def test_rows_are_not_multiplied_by_candidates_before_they_move(spark):
    df = form(spark).repartition(4)
    plan = snapdiff.candidate_dup_counts(df, ["centre", "id"], ["dfseq", "amount", "note"])._jdf.queryExecution().executedPlan().toString()
    exploded = next(line for line in plan.splitlines() if "posexplode" in line)
    below = plan[plan.index(exploded):]
    assert "hashpartitioning(centre" in below and "hashpartitioning(_pos" not in below


def test_a_gold_table_is_counted_once_for_all_snapshots(spark, monkeypatch):
    calls, count = [], snapdiff.candidate_dup_counts
    monkeypatch.setattr(snapdiff, "candidate_dup_counts", lambda df, key, names: calls.append(names) or count(df, key, names))
    lines = spark.createDataFrame([(1, i // 4, i % 4, float(i)) for i in range(40)], "centre int, id int, dfseq int, amount double")
    changed = lines.selectExpr("centre", "id", "dfseq", "amount + id % 2 as amount")
    study = StudyConfig("s", "", "gold", ("A", "B"))
    _, status, _ = plans.study_diff(spark, study, {"A": {"lines": changed}, "B": {"lines": changed}}, {"lines": lines})
    assert [r["key_cols"] for r in status.collect()] == [["centre", "id", "dfseq"]] * 2
    assert len(calls) == 1


def test_an_empty_gold_table_still_has_no_count(spark):
    lines = spark.createDataFrame([(1, i // 4, i % 4) for i in range(8)], "centre int, id int, dfseq int")
    with pytest.raises(TableFailure, match="cannot be counted"):
        snapdiff.discover_key(lines, lines.limit(0), ["centre", "id"])

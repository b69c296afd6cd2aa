"""Every registered query against its SQL, or at least for rows and a stable schema."""

import pandas as pd
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def canonical(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(None if pd.isna(v) else v for v in row) for row in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, sf, con):
    ours = QUERIES[name](spark, sf).toPandas()
    theirs = con.execute(ORACLES[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) > 0
    assert canonical(ours) == canonical(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(name, spark, sf):
    rows = QUERIES[name](spark, sf).toPandas()
    assert len(rows) > 0
    if "score" in rows:
        assert rows["score"].notna().all()


def test_entry(spark):
    assert entry.entry(spark).count() == 1

import random

import duckdb
import pandas as pd
import pytest

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))


def words(rng, n, size=400):
    return " ".join(f"k{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing column names."""
    rng = random.Random(5)
    passage = words(rng, 60)
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \n\t", "en", "a"), (4, "one", "en", "b"), (4, "one", "en", "b"),
        (None, passage, "en", None), (5, passage, "en", "b"), (5, passage + " more", "en", "c"), (6, LONG, "de", "c"), (7, LONG, None, "c"),
        (8, "Mail a.b@c.de or +1 (415) 555-0100, card 4111 1111 1111 1111 at 10.0.0.256 10.0.0.1", "en", "é"),
        (9, "12345 67890 !!! ***", "en", "z"), (10, "Licensed under the Apache License, Version 2.0.\nAll rights reserved.", "en", "z"),
        (11, "éè \U0001f600 ABC abc \x00 x", "fr", "z"), (None, None, None, None),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, hit string, spans string"
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "s", "z", None, "x") for r in rows], schema)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("doc_id > 1000")


@pytest.fixture(scope="session")
def in_duckdb():
    """Runs SQL over pandas frames given by table name."""

    def run(sql, **tables):
        con = duckdb.connect()
        for name, frame in tables.items():
            con.register(f"_{name}", frame)
            con.execute(f"CREATE TABLE {name} AS SELECT * FROM _{name}")
        return con.execute(sql).fetchdf()

    return run


def _plain(v):
    if pd.isna(v):
        return None
    return float(v) if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind in "iuf" or isinstance(v, int) and not isinstance(v, bool) else v


@pytest.fixture(scope="session")
def same_rows():
    def check(ours, theirs):
        columns = sorted(theirs.columns)
        a, b = ([tuple(map(_plain, r)) for r in df[columns].astype(object).itertuples(index=False)] for df in (ours, theirs))
        assert sorted(a, key=repr) == sorted(b, key=repr)

    return check

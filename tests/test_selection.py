"""The selector trained on a ranking loss, and selection on plates of several trials."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from snapsift import fixtures as fx
from snapsift.catalog import reports
from snapsift.operators import rank_selector as rs
from snapsift.operators import selector

NAMES = ["a", "b", "c", "d"]


def test_gradient_like_differences():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(7, 5)), rng.random((7, 6))
    y[3] = 0.5  # no difference between algorithms
    gain = rs.gains(y)
    weights, factors = rng.normal(size=(5, 3)), rng.normal(size=(6, 3))
    loss, by_weights, by_factors = rs.loss_sums(x, gain, weights, factors, 0.7)
    for values, slope in ((weights, by_weights), (factors, by_factors)):
        for place in np.ndindex(values.shape):
            old, step = values[place], 1e-6
            values[place] = old + step
            more = rs.loss_sums(x, gain, weights, factors, 0.7)[0]
            values[place] = old - step
            less = rs.loss_sums(x, gain, weights, factors, 0.7)[0]
            values[place] = old
            assert abs((more - less) / (2 * step) - slope[place]) < 1e-6
    assert np.isclose(loss, sum(rs.loss_sums(x[i:i + 1], gain[i:i + 1], weights, factors, 0.7)[0] for i in range(7)))


def test_loss_of_perfect_and_reversed_order():
    y = np.array([[0.9, 0.5, 0.1]])
    right, _ = rs.rank_loss(y * 1000, rs.gains(y))
    wrong, _ = rs.rank_loss(-y * 1000, rs.gains(y))
    assert right[0] < 1e-9 < 0.3 < wrong[0]


@pytest.fixture(scope="module")
def offsets(spark):
    """Which algorithm is best follows one meta-feature; how hard a dataset is, far more of the spread, follows others."""
    rng = np.random.default_rng(5)
    cells, rows = [], []
    for t in range(6):
        for i in range(40):
            name = f"T{t}/S0/P{i}"
            kind, ease, noise = rng.random(), rng.random(), rng.random()
            cells += [(name, "kind", kind), (name, "ease", ease), (name, "noise", noise), (name, "broken", float("inf") if i % 9 == 0 else None)]
            gaps = {"a": 0.1 * kind, "b": 0.1 * (1 - kind), "c": 0.045, "d": 0.0}
            rows += [(f"T{t}", name, a, 0.1 + 0.75 * ease + gaps[a]) for a in NAMES]
    schema = "trial string, dataset string, algorithm string, auroc double"
    return spark.createDataFrame(cells, "dataset string, feature string, value double").cache(), spark.createDataFrame(rows, schema).cache()


def test_chooses_better_than_squared_loss(offsets):
    cells, rows = offsets
    left, seen = rows.filter("trial = 'T5'"), selector.leave_one_trial_out(rows, "T5")
    own = cells.filter("dataset like 'T5%'")
    places = {}
    for name, fitted in (("rank", rs.fit_rank_selector(cells, seen, NAMES, rank=1)), ("squared", selector.fit_selector(cells, seen, NAMES, rank=1))):
        places[name] = selector.choice_ranks(selector.predict_performance([fitted], own), left).agg(F.avg("place")).first()[0]
    assert places["rank"] < 1.2 and places["rank"] + 0.3 < places["squared"]


def test_same_result_again_and_after_saving(spark, offsets, tmp_path):
    cells, rows = offsets
    seen = selector.leave_one_trial_out(rows, "T5")
    one, two = (rs.fit_rank_selector(cells, seen, NAMES, rank=2, steps=8) for _ in range(2))
    assert one.losses == two.losses and one.losses[-1] < one.losses[0]
    one.save(str(tmp_path / "s"))
    loaded = rs.RankSelector.load(spark, str(tmp_path / "s"))
    key = lambda r: (r.dataset, r.algorithm)
    ours = sorted(loaded.predict(cells).collect(), key=key)
    # the stored factors, applied by SQL
    con = duckdb.connect()
    con.register("cells", cells.toPandas())
    for name in ("scaling", "weights", "algorithms"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/s/{name}/*.parquet')")
    theirs = con.execute("""
        WITH scaled AS (
          SELECT dataset, feature, CASE WHEN hi > lo THEN least(greatest((CASE WHEN isnan(value) THEN 0 ELSE coalesce(value, 0) END - lo) / (hi - lo), 0), 1) ELSE 0 END AS v
          FROM cells JOIN scaling USING (feature)
          UNION ALL SELECT DISTINCT dataset, '', 1.0 FROM cells),
        hidden AS (SELECT dataset, i, sum(v * w[i]) AS h FROM scaled JOIN weights USING (feature), range(1, 4) r(i) GROUP BY ALL)
        SELECT dataset, algorithm, sum(h * g[i]) AS predicted FROM hidden, algorithms GROUP BY ALL ORDER BY 1, 2""").fetchall()
    assert len(ours) == len(theirs) == 960
    assert all((a.dataset, a.algorithm) == b[:2] and abs(a.predicted - b[2]) < 1e-9 for a, b in zip(ours, theirs, strict=True))


def test_validation_rows_are_not_trained_on(offsets):
    cells, rows = offsets
    seen = selector.leave_one_trial_out(rows, "T5")
    spoiled = seen.withColumn("auroc", F.when(F.col("part") == "validation", 1 - F.col("auroc")).otherwise(F.col("auroc")))
    first = [rs.fit_rank_selector(cells, s, NAMES, rank=1, steps=1).weights.orderBy("feature").collect() for s in (seen, spoiled)]
    assert first[0] == first[1]
    scaling = rs.fit_rank_selector(cells.union(cells.limit(0)), seen.filter("part = 'training'"), NAMES, rank=1, steps=1).scaling
    assert scaling.filter("feature = 'ease'").first().hi <= 1


def test_choice_ranks_average_ties(spark):
    rows = spark.createDataFrame([("x", "a", 0.5), ("x", "b", 0.5), ("x", "c", 0.9), ("y", "a", None), ("y", "b", 0.1)], "dataset string, algorithm string, auroc double")
    predicted = spark.createDataFrame([("x", "a", 0.9), ("x", "c", 0.1), ("y", "a", 0.9)], "dataset string, algorithm string, predicted double")
    assert {(r.dataset, r.algorithm, r.place) for r in selector.choice_ranks(predicted, rows).collect()} == {("x", "a", 2.5), ("y", "a", 2.0)}


def test_plates_of_trials(spark, sf):
    plates = fx.trial_plates(spark, sf)
    names = {r[0] for r in plates.select("dataset").distinct().collect()}
    assert len(names) == 42 and plates.filter("y = 1").select("dataset").distinct().count() == 42
    assert plates.count() == fx.load(spark, sf, "lineitem").count() == plates.select("rec_id").distinct().count()


def test_only_chosen_detectors_run(spark, sf, monkeypatch):
    from snapsift.plans import evaluation

    ran = []
    real = evaluation.pool.score_all
    monkeypatch.setattr(evaluation.pool, "score_all", lambda records, grid: ran.append(list(grid)) or real(records, grid))
    records = reports.of_trial(reports.trial_records(spark, sf))
    chosen = spark.createDataFrame([("T4/S0/P0", "HBOS"), ("T4/S0/P1", "PCA")], "dataset string, algorithm string")
    scores = evaluation.score_chosen(records, chosen)
    assert ran == [["HBOS"], ["PCA"]]
    assert {(r.dataset, r.algorithm) for r in scores.select("dataset", "algorithm").distinct().collect()} == {("T4/S0/P0", "HBOS"), ("T4/S0/P1", "PCA")}

"""What moves: repeated values and features stay where they are, scores are made once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapsift.operators import metrics
from snapsift.operators.detectors import ann, ecod, neighbors


def test_repeated_values_are_looked_up_in_place(spark):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, 3, 200), np.round(rng.normal(size=200), 1), np.arange(200)]).astype(float)
    rows = [("A", i, [float(v) for v in row]) for i, row in enumerate(x)]
    records = spark.createDataFrame(rows, "dataset string, rec_id long, features array<double>")
    scores = ecod.score_ecod(records, heavy_rows=5)
    assert "isnull(_repeated" in scores._jdf.queryExecution().optimizedPlan().toString()
    low = -np.log((x[None] <= x[:, None]).mean(1))
    high = -np.log((x[None] >= x[:, None]).mean(1))
    chosen = np.where(((x - x.mean(0)) ** 3).mean(0) < 0, low, high)
    right = np.max([low.sum(1), high.sum(1), chosen.sum(1)], axis=0)
    assert {r.rec_id: r.score for r in scores.collect()} == pytest.approx(dict(enumerate(right)))


def test_records_with_missing_values_keep_a_row(spark):
    rows = [("A", i, [float(i % 2), None if i < 3 else float(i)]) for i in range(20)] + [("A", 20, [None, None])]
    records = spark.createDataFrame(rows, "dataset string, rec_id long, features array<double>")
    for heavy in (1, 1000):
        got = {r.rec_id: r.score for r in ecod.score_ecod(records, heavy_rows=heavy).collect()}
        assert sorted(got) == list(range(21)) and got[20] is None and got[0] is not None


def test_points_meet_once_at_a_hub_that_many_ask(spark, monkeypatch):
    monkeypatch.setattr(ann, "ASKING", 10)
    points = spark.range(60).selectExpr("'A' as dataset", "id as point", "array(id * 1.0D) as features")
    edges = [(i, 0) for i in range(1, 60)] + [(0, i) for i in range(1, 8)] + [(5, 9)]
    met = ann.meetings(spark.createDataFrame([("A", *e) for e in edges], "dataset string, point long, other long"), points).collect()
    rooms = {}
    for r in met:
        rooms.setdefault((r.hub, r.part), []).append(r)
    asked = sorted((hub, a.point, b.point) for (hub, _), rs in rooms.items() for a in rs for b in rs if a.asks and b.offered)
    offers = lambda hub: [o for p, o in edges if p == hub]
    assert asked == sorted((h, p, c) for p, h in edges for c in offers(h))
    assert max(sum(r.asks for r in rs) for rs in rooms.values()) < 30


@pytest.mark.parametrize("edges_per_group", [40, 2_000])
def test_a_round_moves_features_by_edge(spark, monkeypatch, edges_per_group):
    """All candidates of a round are compared, and features move at most twice per edge."""
    monkeypatch.setattr(ann, "EDGES_PER_GROUP", edges_per_group)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(90, 6))
    points = spark.createDataFrame(
        [("A", i, [float(v) for v in row], [i]) for i, row in enumerate(x)],
        "dataset string, point long, features array<double>, ids array<long>").cache()
    start = [("A", i, [(float(np.linalg.norm(x[i] - x[j])), int(j), int(j)) for j in rng.choice(90, 6, replace=False) if j != i]) for i in range(90)]
    lists = spark.createDataFrame(start, "dataset string, point long, nn array<struct<distance: double, id: long, point: long>>").cache()
    moved, meet = [], ann.meetings
    monkeypatch.setattr(ann, "meetings", lambda e, p: moved.append((e.count(), meet(e, p).count())) or meet(e, p))
    merge = lambda both, k: neighbors.best_lists(both, k, distinct=True)
    after, tried = ann.refine(points, lists, 8, "euclidean", 4, merge)
    edges = {(r.point, r.other) for r in ann._edges(lists, 4).collect()}
    known = {p: {b for _, _, b in nn} for _, p, nn in start}
    want = {p: {c for q, h in edges if q == p for g, c in edges if g == h} - known[p] - {p} for p in range(90)}
    assert {r.point: r.n for r in tried.collect()} == {p: len(c) for p, c in want.items() if c}
    for r in after.collect():
        best = sorted((float(np.linalg.norm(x[r.point] - x[j])), j) for j in want[r.point] | known[r.point])[:8]
        assert [n.point for n in r.nn] == [j for _, j in best]
    assert moved and moved[0][1] <= 2 * moved[0][0]


def test_distances_are_the_same_from_either_side():
    x, y = np.random.default_rng(1).normal(size=(2, 30, 64))
    for metric, power in (("euclidean", 2), ("manhattan", 1)):
        far = ann.distances(x, y, metric)
        assert (far == ann.distances(y, x, metric).T).all()
        assert far == pytest.approx((np.abs(x[:, None] - y[None]) ** power).sum(2) ** (1 / power))


def test_scores_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def score(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf[["dataset", "rec_id"]].assign(algorithm="X", params="", score=pdf["rec_id"] * 7.0 % 13)

    records = spark.range(300).select(
        F.lit("A").alias("dataset"), F.col("id").alias("rec_id"), F.array(F.lit(1.0)).alias("features"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    scores = records.mapInPandas(score, "dataset string, rec_id long, algorithm string, params string, score double")
    row = metrics.evaluate_scores(scores, records, 1).first()
    assert row.num_samples == 300 and 0 < row.auroc < 1 and made.value == 300

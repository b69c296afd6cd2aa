"""Block-to-block routing of the exact neighbour graph, and the approximate option."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapsift import fixtures as fx
from snapsift.functions.runtime import store
from snapsift.operators.detectors import ann, neighbors


def clusters(spark, n, dims=64, within=4, copies=0):
    """Points of few inner dimensions in a space of many, some of them repeated."""
    rng = np.random.default_rng(2)
    basis = rng.normal(size=(within, dims))
    x = rng.normal(size=(n, within)) @ basis
    rows = [("c", i, x[i % (n - copies)].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "dataset string, rec_id long, features array<double>").repartition(4).cache()


def brute(records, k):
    pdf = records.toPandas().sort_values("rec_id")
    x, ids = np.array(pdf["features"].tolist()), pdf["rec_id"].to_numpy()
    out = {}
    for i in range(len(ids)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        order = np.lexsort((ids, d))[:k]
        out[int(ids[i])] = [(int(ids[j]), d[j]) for j in order]
    return out


def as_lists(graph):
    out = {}
    for r in graph.orderBy("rec_id", "rank").collect():
        out.setdefault(r.rec_id, []).append((r.neighbor, r.distance))
    return out


def same(got, expected):
    assert got.keys() == expected.keys()
    for rec, rows in expected.items():
        assert np.allclose([d for _, d in got[rec]], [d for _, d in rows])
        assert [i for i, _ in got[rec]] == [i for i, _ in rows]


def test_pairs_of_blocks_are_routed(spark, sf):
    records = fx.vectors(spark, sf)
    points = store(neighbors.collapse_copies(records, 11))
    own = store(neighbors._own_blocks(neighbors.split_blocks(points, 64), 11, "euclidean"))
    boxes = own.filter("lo is not null").select("dataset", "block", "lo", "hi", "reach")
    routed = neighbors.route_blocks(boxes, "euclidean")
    blocks = boxes.count()
    assert routed.count() <= blocks * (blocks - 1) < points.count() * (blocks - 1) / 20
    assert not {"features", "point"} & set(routed.columns)


def test_far_blocks_are_not_routed(spark):
    rng = np.random.default_rng(6)
    rows = [("c", i, (rng.normal(size=3) + 1000.0 * (i % 4)).tolist()) for i in range(400)]
    records = spark.createDataFrame(rows, "dataset string, rec_id long, features array<double>")
    own = store(neighbors._own_blocks(neighbors.split_blocks(store(neighbors.collapse_copies(records, 6)), 32), 6, "euclidean"))
    boxes = own.filter("lo is not null").select("dataset", "block", "lo", "hi", "reach")
    home = {r.block: round(r.lo[0] / 1000) for r in boxes.collect()}
    routed = neighbors.route_blocks(boxes, "euclidean").collect()
    assert routed and all(home[r.block] == home[r.target] for r in routed)
    same(as_lists(neighbors.knn_graph(records, 5, block_rows=32)), brute(records, 5))


def test_blocks_cut_by_hash(spark, monkeypatch):
    """Parts that are still too large after all levels of splits."""
    monkeypatch.setattr(neighbors, "MAX_LEVELS", 0)
    records = clusters(spark, 300, dims=5, copies=60)
    same(as_lists(neighbors.knn_graph(records, 4, block_rows=24)), brute(records, 4))


@pytest.mark.parametrize("copies", [0, 500])
def test_approximate_graph_of_structured_points(spark, copies):
    records = clusters(spark, 1600, copies=copies)
    how = ann.Approximation(block_rows=64)
    graph = neighbors.knn_points(records, 10, approximate=how)
    rows = neighbors.neighbor_rows(graph).cache()
    exact = neighbors.knn_graph(records, 10)
    found = ann.recall(rows, exact).first()
    assert found.rows == 1600 and found.recall >= 0.95
    most = graph.candidates.agg(F.max("n")).first()[0]
    assert most <= how.most_candidates() and graph.candidates.agg(F.avg("n")).first()[0] < 1000
    # the distances are right, and none is below the exact one of its rank
    lists, right = as_lists(rows), as_lists(exact)
    assert all(len(v) == 10 for v in lists.values())
    assert all(a >= b - 1e-9 for rec in lists for (_, a), (_, b) in zip(lists[rec], right[rec], strict=True))


def test_approximate_graph_says_so(spark):
    records = clusters(spark, 200, dims=6)
    rows = neighbors.knn_graph(records, 3, approximate=ann.Approximation(tables=2, rounds=1))
    assert {r.exact for r in rows.collect()} == {False}
    assert "exact" not in neighbors.knn_graph(records, 3).columns and neighbors.knn_points(records, 3).exact
    again = neighbors.knn_graph(records, 3, approximate=ann.Approximation(tables=2, rounds=1))
    assert sorted(rows.collect()) == sorted(again.collect())


def test_recall_on_the_vectors(spark, sf):
    from snapsift.catalog import QUERIES

    row = QUERIES["knn_graph_recall"](spark, sf).first()
    assert row.recall >= 0.95 and row.most_candidates <= row.bound


def test_chunks_of_visitors_grow_with_the_points():
    """A unit's points were copied for every four blocks of visitors, however many there were."""
    assert neighbors.visitors(100_000, 8, 11, 1024) == 4096
    assert neighbors.visitors(5_400_000, 6, 11, 1024) == neighbors.MOST_VISITORS * 1024 == 16_384
    assert 4096 < neighbors.visitors(360_000, 6, 11, 1024) < 8192
    assert neighbors.visitors(5_400_000, 6, 101, 1024) * 101 <= neighbors.VISITOR_NEIGHBOURS


def test_chunks_of_many_blocks_find_the_same(spark, monkeypatch):
    records = clusters(spark, 1500, copies=100)
    monkeypatch.setattr(neighbors, "visitors", lambda total, cores, keep, block_rows: total)
    same(as_lists(neighbors.knn_graph(records, 4, block_rows=16)), brute(records, 4))

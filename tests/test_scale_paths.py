"""The paths taken for large or skewed data give the same rows as the simple ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from snapsift.functions.models import score_with_models, feature_stats
from snapsift.functions.running import running_totals
from snapsift.functions.skew import skew_lookup
from snapsift.operators import compare, metrics, selector
from snapsift.operators.detectors import ecod, hbos, iforest, loda, neighbors, ocsvm, pca


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def skewed_records(spark, n=240, d=3, seed=1, dataset="A"):
    """A third of the records are copies of one point."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)) * 4, 2)
    x[: n // 3] = x[0]
    ids = rng.permutation(n)
    return spark.createDataFrame(
        [(dataset, int(i), [float(v) for v in row]) for i, row in zip(ids, x)],
        "dataset string, rec_id long, features array<double>",
    )


def same(a, b, keys=("dataset", "rec_id"), places=9):
    a, b = (df.toPandas().sort_values(list(keys)).reset_index(drop=True) for df in (a, b))
    pd.testing.assert_frame_equal(a[sorted(a)], b[sorted(b)], check_exact=False, atol=10**-places)


def test_running_totals_across_pieces(spark):
    cells = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("g"),
        (F.col("id") * 7919 % 3001).alias("v"), (F.col("id") % 5).alias("c"),
    )
    plain = running_totals(cells, ["g"], "v", {"r": "c"}, 3000)
    pieces = running_totals(cells, ["g"], "v", {"r": "c"}, None, window_rows=100)
    same(plain, pieces, ("g", "v"))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_skew_lookup_with_heavy_key(spark, how):
    left = spark.range(2000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).cast("long").alias("k"))
    right = left.filter("k < 45").groupBy("k").agg(F.count(F.lit(1)).alias("w"), F.max("id").alias("top"))
    plain = left.join(right.drop("w"), "k", how)
    split = skew_lookup(left, right, ["k"], "w", 2000, how, heavy_rows=100, measure=False)
    same(plain, split.select(*plain.columns), ("id",))
    assert split.count() == plain.count()


def test_models_meet_in_chunks(spark):
    records = skewed_records(spark).unionByName(skewed_records(spark, 60, 5, 2, "B"))
    for score in (hbos.score_hbos, pca.score_pca, loda.score_loda, iforest.score_iforest):
        same(score(records), score(records, broadcast_bytes=0, chunk_rows=50))
    same(ocsvm.score_ocsvm(records, steps=3), ocsvm.score_ocsvm(records, steps=3, broadcast_bytes=0, chunk_rows=50), places=6)


def test_models_keep_every_record(spark):
    records = skewed_records(spark)
    scored = score_with_models(records, feature_stats(records), lambda x, m: x[:, 0], broadcast_bytes=0, chunk_rows=7)
    assert scored.count() == scored.select("rec_id").distinct().count() == 240


def test_ecod_large_and_heavy(spark):
    records = skewed_records(spark)
    same(ecod.score_ecod(records), ecod.score_ecod(records, window_rows=40, heavy_rows=30))


def test_metrics_large(spark):
    scores = skewed_records(spark, 300).select(
        "dataset", "rec_id", F.lit("A").alias("algorithm"), F.col("features")[0].alias("score"),
        (F.col("rec_id") % 4 == 0).cast("int").alias("y"))
    same(metrics.auroc(scores), metrics.auroc(scores, window_rows=50), ("dataset",))
    same(metrics.average_precision(scores), metrics.average_precision(scores, window_rows=50), ("dataset",))


def test_meta_features_large(spark):
    records = skewed_records(spark)
    same(selector.meta_features_stats(records), selector.meta_features_stats(records, window_rows=40), ("dataset", "feature"))


def test_wilcoxon_large(spark):
    rng = np.random.default_rng(5)
    rows = [("t", "s", f"p{i}", a, float(round(rng.random(), 2))) for i in range(200) for a in "ABC"]
    table = frame(spark, rows, "trial string, snapshot string, plate string, algorithm string, auroc double")
    names = ["A", "B", "C"]
    same(compare.wilcoxon_sums(table, names), compare.wilcoxon_sums(table, names, window_rows=20), ("a", "b"))


# --- neighbours against brute force ----------------------------------------------------------


def brute(records, k, metric="euclidean"):
    pdf = records.toPandas().sort_values("rec_id").reset_index(drop=True)
    x, ids = np.array(pdf["features"].tolist()), pdf["rec_id"].to_numpy()
    gap = np.abs(x[:, None] - x[None])
    d = gap.sum(2) if metric == "manhattan" else np.sqrt((gap**2).sum(2))
    out = {}
    for i in range(len(ids)):
        others = [j for j in range(len(ids)) if j != i]
        out[i] = sorted(others, key=lambda j: (d[i, j], ids[j]))[:k]
    return x, ids, d, out


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("block_rows", [8, 24, 1024])
def test_graph_is_exact(spark, block_rows, metric):
    records = skewed_records(spark)
    x, ids, d, near = brute(records, 4, metric)
    got = neighbors.knn_graph(records, 4, metric, block_rows).toPandas().sort_values(["rec_id", "rank"])
    assert len(got) == 4 * len(ids)
    for i, rec in enumerate(ids):
        rows = got[got["rec_id"] == rec]
        assert rows["neighbor"].tolist() == [ids[j] for j in near[i]]
        assert np.allclose(rows["distance"], [d[i, j] for j in near[i]])


def test_graph_of_many_points_and_datasets(spark):
    rng = np.random.default_rng(3)
    rows = [(f"d{s}", int(i), [float(v) for v in rng.normal(size=2)]) for s, n in ((0, 700), (1, 90), (2, 3)) for i in range(n)]
    records = frame(spark, rows, "dataset string, rec_id long, features array<double>")
    got = neighbors.knn_graph(records, 5, block_rows=16).toPandas()
    for name in ("d0", "d1", "d2"):
        part = records.filter(F.col("dataset") == name)
        x, ids, d, near = brute(part, 5)
        mine = got[got["dataset"] == name].sort_values(["rec_id", "rank"]).groupby("rec_id")["neighbor"].apply(list)
        assert {int(r): n for r, n in mine.items()} == {int(ids[i]): [int(ids[j]) for j in near[i]] for i in near}


def test_detectors_on_copies_match_brute_force(spark):
    records = skewed_records(spark, 120)
    k = 5
    x, ids, d, near = brute(records, k)
    kd = {i: d[i, near[i][-1]] for i in near}
    lrd = {i: 1 / (np.mean([max(kd[j], d[i, j]) for j in near[i]]) + 1e-10) for i in near}
    ac = {i: neighbors.chain_distances(x[i][None], x[near[i]][None], [len(near[i])])[0, 0] for i in near}
    expected = {
        "knn": {i: np.median([d[i, j] for j in near[i]]) for i in near},
        "lof": {i: np.mean([lrd[j] for j in near[i]]) / lrd[i] for i in near},
        "abod": {i: neighbors.angle_variances(x[i][None], x[near[i]][None], [len(near[i])])[0, 0] for i in near},
    }
    got = {
        "knn": neighbors.score_knn(records, k, "median"), "lof": neighbors.score_lof(records, k),
        "abod": neighbors.score_abod(records, k), "cof": neighbors.score_cof(records, k),
    }
    # copies of a point share its score, so neighbours are compared by position
    expected["cof"] = {}
    for i in near:
        mean = np.mean([ac[j] for j in near[i]])
        expected["cof"][i] = ac[i] / mean if mean > 0 else (np.inf if ac[i] > 0 else 1.0)
    for name, df in got.items():
        scores = df.toPandas().set_index("rec_id")["score"]
        assert len(scores) == len(ids)
        assert np.allclose([scores[ids[i]] for i in range(len(ids))], [expected[name][i] for i in range(len(ids))])


def test_chain_distance_by_hand():
    p, v = np.array([0.0]), np.array([[1.0], [3.0], [-1.5]])
    # steps: 1 (to 1), then 1.5 (to -1.5, from 0), then 2 (to 3, from 1)
    weights = [2 * (4 - i) / 12 for i in (1, 2, 3)]
    assert neighbors.chain_distances(p[None], v[None], [len(v)])[0, 0] == pytest.approx(np.dot(weights, [1.0, 1.5, 2.0]))

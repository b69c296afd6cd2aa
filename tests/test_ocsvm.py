"""The one-class machine: its gap, and small sets against the optimum."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapsift.operators.detectors import ocsvm

SETTINGS = [(0.1, "rbf"), (0.5, "rbf"), (0.3, "poly"), (0.5, "linear")]


@pytest.fixture(scope="module")
def records(spark):
    rng = np.random.default_rng(3)
    rows = [(f"d{s}", i, (rng.normal(size=3) * [1, 2, 1] + 3).tolist()) for s, n in ((0, 60), (1, 25)) for i in range(n)]
    return spark.createDataFrame(rows, "dataset string, rec_id long, features array<double>").repartition(3).cache()


def optimum(gram, nu, rounds=60_000):
    """Least a'Ka / 2 with a in [0, 1 / (nu n)] summing to 1, by moving weight between pairs."""
    n = len(gram)
    most = 1 / (nu * n)
    a = np.full(n, 1 / n)
    for _ in range(rounds):
        slope = gram @ a
        low = np.flatnonzero(a < most - 1e-15)
        high = np.flatnonzero(a > 1e-15)
        i, j = low[slope[low].argmin()], high[slope[high].argmax()]
        if slope[j] - slope[i] < 1e-10:
            break
        curve = gram[i, i] + gram[j, j] - 2 * gram[i, j]
        move = min(most - a[i], a[j], (slope[j] - slope[i]) / max(curve, 1e-300))
        a[i] += move
        a[j] -= move
    return a @ gram @ a / 2, a


def test_agrees_with_the_optimum(records):
    models = ocsvm.fit_ocsvm(records, SETTINGS, steps=60, landmarks=60, tolerance=1e-4)
    found = {(r.dataset, r.algorithm): r for r in ocsvm.ocsvm_gaps(models, SETTINGS, 1e-4).collect()}
    scores = {(r.dataset, r.rec_id, r.algorithm): r.score for r in ocsvm.score_ocsvm_settings(records, SETTINGS, 60, landmarks=60, tolerance=1e-4).collect()}
    for name in ("d0", "d1"):
        pdf = records.filter(F.col("dataset") == name).toPandas().sort_values("rec_id")
        x = np.array(pdf["features"].tolist())
        z = (x - x.mean(0)) / x.std(0)
        for nu, kernel in SETTINGS:
            setting = ocsvm.setting_name(nu, kernel)
            gram = ocsvm.kernel_matrix(z, z, kernel)
            best, a = optimum(gram, nu)
            row, scale = found[name, setting], float(np.trace(gram)) / len(gram)
            assert row.converged and row.gap <= 1e-4 * scale
            # every stop lies between the optimum and the gap above it
            assert -1e-6 * scale <= -row.objective - best <= row.gap + 1e-6 * scale
            if kernel == "rbf":
                mine = np.array([scores[name, i, setting] for i in pdf["rec_id"]])
                right = -(gram @ a)
                assert np.corrcoef(mine, right)[0, 1] > 0.999
                # at most the share nu lies outside, at least nu outside or on the boundary
                assert (mine > 5e-3).mean() <= nu <= (mine > -5e-3).mean()


def test_says_when_it_stopped_early(records):
    models = ocsvm.fit_ocsvm(records, SETTINGS[:1], steps=1, tolerance=1e-9)
    row = ocsvm.ocsvm_gaps(models, SETTINGS[:1], 1e-9).filter("dataset = 'd0'").first()
    assert row.steps == 1 and not row.converged and row.gap > 0
    with pytest.warns(UserWarning, match="stopped after 1 steps"):
        ocsvm.score_ocsvm(records, 0.1, "rbf", 1, tolerance=1e-9)
    longer = ocsvm.fit_ocsvm(records, SETTINGS[:1], steps=12, tolerance=1e-9)
    assert ocsvm.ocsvm_gaps(longer, SETTINGS[:1]).filter("dataset = 'd0'").first().gap < row.gap / 3


def test_constant_and_single_records(spark):
    rows = [("same", i, [1.0, 2.0]) for i in range(5)] + [("one", 1, [3.0, 4.0])]
    records = spark.createDataFrame(rows, "dataset string, rec_id long, features array<double>")
    scores = ocsvm.score_ocsvm(records, 0.5, "rbf").collect()
    assert len(scores) == 6 and all(np.isfinite(r.score) and abs(r.score) < 1e-6 for r in scores)

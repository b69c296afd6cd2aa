"""Tail probabilities and the exact signed-rank test."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapsift.functions.tails import beta_share, chi_square_tail, f_tail, log_gamma
from snapsift.operators import compare


def test_known_tails(spark):
    one = spark.range(1)
    # Percentage points of printed tables.
    chi = {1: 3.841458821, 2: 5.991464547, 3: 7.814727903, 5: 11.070497694, 10: 18.307038053, 30: 43.772971825}
    for degrees, x in chi.items():
        assert one.select(chi_square_tail(F.lit(x), degrees)).first()[0] == pytest.approx(0.05, abs=1e-9)
    assert one.select(chi_square_tail(F.lit(10.827566170), 1)).first()[0] == pytest.approx(0.001, abs=1e-11)
    for over, under, x in ((1, 1, 161.4476387975), (1, 10, 4.9646027438), (5, 10, 3.3258345304), (10, 20, 2.3478775671)):
        assert one.select(f_tail(F.lit(x), F.lit(over), F.lit(under))).first()[0] == pytest.approx(0.05, abs=1e-7)
    got = one.select(chi_square_tail(F.lit(0.0), 3), f_tail(F.lit(-1.0), F.lit(2), F.lit(3)), f_tail(F.lit(None), F.lit(2), F.lit(3)), chi_square_tail(F.lit(-2.0), 4)).first()
    assert list(got) == [1.0, 1.0, None, 1.0]


def test_beta_and_gamma_by_sums(spark):
    one = spark.range(1)
    for x in (0.5, 1.0, 4.5, 120.0, 5000.5):
        import math

        assert one.select(log_gamma(F.lit(x))).first()[0] == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-12)
    t = (np.arange(400_000) + 0.5) / 400_000
    for a, b in ((2.5, 3.0), (8.0, 1.5), (1.0, 40.0)):
        density = t ** (a - 1) * (1 - t) ** (b - 1)
        for x in (0.1, 0.5, 0.93):
            share = one.select(beta_share(F.lit(x), F.lit(a), F.lit(b))).first()[0]
            assert share == pytest.approx(density[t < x].sum() / density.sum(), abs=1e-6)


@pytest.mark.parametrize("n", [0, 1, 2, 5, 12])
def test_signed_ranks_like_all_patterns(n):
    sums = [sum(p) for p in itertools.product(*[(0, r) for r in range(1, n + 1)])]
    assert compare.signed_rank_counts(n) == [sums.count(s) for s in range(n * (n + 1) // 2 + 1)]
    assert compare.exact_tails(n)[n] == [min(1.0, 2 * sum(s <= w for s in sums) / len(sums)) for w in range(n * (n + 1) // 4 + 1)]


def test_exact_only_without_ties_and_for_few(spark):
    rng = np.random.default_rng(2)

    def rows(n, step=None):
        gaps = rng.permutation(np.arange(1, n + 1)) * np.where(rng.random(n) < 0.8, 1, -1) / 1000 if step is None else np.full(n, step)
        return [("t", "s", f"p{i}", a, 0.5 + (float(g) if a == "A" else 0.0)) for i, g in enumerate(gaps) for a in "AB"], gaps

    schema = "trial string, snapshot string, plate string, algorithm string, auroc double"
    for n in (6, 25, 26):
        data, gaps = rows(n)
        row = compare.pairwise_wilcoxon(spark.createDataFrame(data, schema), ["A", "B"]).first()
        ranks = np.abs(gaps).argsort().argsort() + 1
        assert (row.w_plus, row.w_minus) == (ranks[gaps > 0].sum(), ranks[gaps < 0].sum()) and row.exact == (n <= 25)
        if n <= 25:
            assert row.p == compare.exact_tails(n)[n][int(min(row.w_plus, row.w_minus))]
    tied = compare.pairwise_wilcoxon(spark.createDataFrame(rows(6, 0.1)[0], schema), ["A", "B"]).first()
    assert not tied.exact and 0 < tied.p < 0.05
    # six differences of one sign can't do better than 2 / 64
    one_sided = [("t", "s", f"p{i}", a, 0.5 + (0.01 * (i + 1) if a == "A" else 0.0)) for i in range(6) for a in "AB"]
    assert compare.pairwise_wilcoxon(spark.createDataFrame(one_sided, schema), ["A", "B"]).first().p == 2 / 64


def test_overall_test_gates_the_pairs(spark):
    tests = spark.createDataFrame([("A", "B", 0.01)], "a string, b string, p_adjusted double")
    ranks = spark.createDataFrame([("A", 1.2), ("B", 1.8)], "algorithm string, avg_rank double")
    overall = lambda p: spark.createDataFrame([(p,)], "p_f double")
    assert compare.indistinguishable_groups(ranks, compare.gate_pairs(tests, overall(0.2))).count() == 1
    assert compare.indistinguishable_groups(ranks, compare.gate_pairs(tests, overall(0.01))).count() == 0
    assert compare.indistinguishable_groups(ranks, compare.gate_pairs(tests, overall(None))).count() == 0

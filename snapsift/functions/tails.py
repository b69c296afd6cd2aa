"""Tail probabilities as column expressions.

For whole degrees of freedom the chi-square tail is a finite sum, which for odd ones begins with the
complement of the error function. The F tail is an incomplete beta function, by its continued fraction
(Lentz), which a fold over a fixed sequence walks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the continued fraction; it converges in some tens of them on the side that is taken.
TERMS = 400
_TINY = 1e-300
#: Coefficients of the Lanczos approximation of the gamma function (g = 7, n = 9).
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x of at least 0.5."""
    t = x + 6.5
    series = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:]):
        series = series + F.lit(c) / (x + i)
    return F.lit(0.5 * math.log(2 * math.pi)) + (x - 0.5) * F.log(t) - t + F.log(series)


def chi_square_tail(x: Column, degrees: int) -> Column:
    """P(X >= x) of a chi-square variable; 1 for x below 0."""
    if degrees < 1:
        return F.lit(None).cast("double")
    half = x / 2
    if degrees % 2 == 0:
        terms = [F.exp(i * F.log(half) - half - math.lgamma(i + 1)) for i in range(1, degrees // 2)]
        tail = sum(terms, F.exp(-half))
    else:
        terms = [F.exp((i - 0.5) * F.log(half) - half - math.lgamma(i + 0.5)) for i in range(1, (degrees + 1) // 2)]
        tail = sum(terms, _erfc(F.sqrt(half)))
    return F.when(x.isNull(), F.lit(None)).when(x <= 0, F.lit(1.0)).otherwise(F.least(tail, F.lit(1.0)))


def _erfc(z: Column) -> Column:
    """Complement of the error function for z above 0: a series below 2, a continued fraction above."""
    square = z * z
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), F.struct(z.alias("term"), z.alias("sum")),
        lambda s, n: F.struct((-s["term"] * square / n).alias("term"), (s["sum"] - s["term"] * square / n / (2 * n + 1)).alias("sum")),
        lambda s: s["sum"],
    )
    # from the last term back to the first: z + (k / 2) / (z + ((k + 1) / 2) / ..)
    fraction = F.aggregate(F.sequence(F.lit(120), F.lit(1), F.lit(-1)), z, lambda f, k: z + k / 2 / f)
    root = F.lit(math.sqrt(math.pi))
    return F.when(z < 2, 1 - 2 / root * series).otherwise(F.exp(-square) / root / fraction)


def _beta_fraction(x: Column, a: Column, b: Column) -> Column:
    """Continued fraction of the incomplete beta function."""
    safe = lambda v: F.when(F.abs(v) < _TINY, F.lit(_TINY)).otherwise(v)
    d = 1 / safe(1 - (a + b) * x / (a + 1))

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))

        def turn(s: Column, by: Column) -> Column:
            d, c = 1 / safe(1 + by * s["d"]), safe(1 + by / s["c"])
            return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

        # each state is computed once: a fold over the two coefficients
        return F.aggregate(F.array(even, odd), s, turn)

    start = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s["h"])


def beta_share(x: Column, a: Column, b: Column) -> Column:
    """Regularised incomplete beta function I_x(a, b), for x from 0 to 1."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    low = front * _beta_fraction(x, a, b) / a
    high = 1 - front * _beta_fraction(1 - x, b, a) / b
    inside = F.when(x < (a + 1) / (a + b + 2), low).otherwise(high)
    return F.when(x.isNull(), F.lit(None)).when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(inside)


def f_tail(x: Column, over: Column, under: Column) -> Column:
    """P(X >= x) of an F variable with ``over`` and ``under`` degrees of freedom."""
    x, over, under = x.cast("double"), over.cast("double"), under.cast("double")
    share = beta_share(under / (under + over * x), under / 2, over / 2)
    return F.when(x.isNull(), F.lit(None)).when(x <= 0, F.lit(1.0)).otherwise(share)

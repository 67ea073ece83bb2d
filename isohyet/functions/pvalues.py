"""Tail probabilities from built-in expressions (Spark SQL has no erf or beta).

Student t: continued fraction of the incomplete beta function, a fixed number of
steps for any degrees of freedom.  Normal: the polynomial of A&S 7.1.26.  F(2, d): closed form.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: coefficients of A&S 7.1.26
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    a = F.abs(x)
    u = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * a)
    poly = F.lit(0.0)
    for c in reversed(ERF_A):
        poly = (poly + F.lit(c)) * u
    return F.signum(x) * (F.lit(1.0) - poly * F.exp(-a * a))


def normal_two_sided(z: Column) -> Column:
    return F.lit(1.0) - erf(F.abs(z) / F.lit(math.sqrt(2.0)))


# steps of the continued fraction: enough for 1e-12 at any degrees of freedom, see tests
STEPS = 24
# fixed values: ln gamma(z + 1/2) - ln gamma(z) is ln(z) / 2 plus these times odd powers of 1/z
HALF_STEP = (-1 / 8, 1 / 192, -1 / 640, 17 / 14336, -31 / 18432)


def half_gamma_ratio(a: Column) -> Column:
    """gamma(a + 1/2) / gamma(a) for a >= 1/2: the asymptotic series at a + 16, stepped back down."""
    z = a + 16.0
    series = F.lit(0.0)
    for c in reversed(HALF_STEP):
        series = series / (z * z) + F.lit(c)
    steps = F.lit(1.0)
    for j in range(16):
        steps = steps * ((a + float(j)) / (a + (j + 0.5)))
    return F.sqrt(z) * F.exp(series / z) * steps


def _fraction(p: Column) -> Column:
    """Continued fraction of the incomplete beta function I_x(a, b), from its last step back to the first."""

    def step(f: Column, m: Column) -> Column:
        a, b, x = p["a"], p["b"], p["x"]
        top = a + 2.0 * m
        even = (m + 1.0) * (b - 1.0 - m) * x / ((top + 1.0) * (top + 2.0))
        odd = (a + m) * (a + b + m) * x / (top * (top + 1.0))
        return 1.0 - odd / (1.0 + even / f)

    return 1.0 / F.aggregate(F.array(*[F.lit(float(m)) for m in reversed(range(STEPS))]), F.lit(1.0), step)


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| > |t|); NULL when df < 1 or t is NULL.

    The tail is the incomplete beta function I_x(df / 2, 1 / 2) at x = df / (df + t^2).  Its continued fraction takes the same
    few steps for every df: the tail's own beyond t^2 = 8, that of the complement inside.
    """
    half, u = df.cast("double") / 2.0, t * t / df.cast("double")
    inside = t * t < 8.0
    whole = F.lit(1.0) + u
    # computed once per row: the steps only read these
    terms = F.struct(
        F.when(inside, 0.5).otherwise(half).alias("a"), F.when(inside, half).otherwise(0.5).alias("b"),
        F.when(inside, u / whole).otherwise(1.0 / whole).alias("x"),
        (half_gamma_ratio(half) * F.exp(-half * F.log1p(u)) * F.sqrt(u / whole) / math.sqrt(math.pi)).alias("front"),
        inside.alias("inside"),
    )

    def tail(p: Column) -> Column:
        mass = p["front"] / p["a"] * _fraction(p)
        return F.greatest(F.lit(0.0), F.when(p["inside"], 1.0 - mass).otherwise(mass))

    return F.when((df >= 1) & t.isNotNull(), F.transform(F.array(terms), tail)[0])


def f2_tail(f: Column, d: Column) -> Column:
    """P(F > f) for (2, d) degrees of freedom; 1 for non-positive f."""
    v = d.cast("double")
    return F.when(f > 0, F.pow(F.lit(1.0) + 2.0 * f / v, -v / 2.0)).otherwise(F.lit(1.0))

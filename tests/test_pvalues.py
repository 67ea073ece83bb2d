import math

import numpy as np
import pytest

from isohyet.functions.pvalues import f2_tail, normal_two_sided, t_two_sided
from pyspark.sql import functions as F


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "t, df, p",
    [(2.0, 10, 0.0733880348), (1.3, 7, 0.2347678354), (2.5, 58, 0.0152692296), (1.0, 1, 0.5), (0.0, 5, 1.0), (1.0, 2, 0.4226497308)],
)
def test_student_tail(spark, t, df, p):
    assert one(spark, t_two_sided(F.lit(t), F.lit(df))) == pytest.approx(p, abs=1e-9)


def test_student_tail_of_long_series_is_near_normal(spark):
    assert one(spark, t_two_sided(F.lit(1.96), F.lit(50_000))) == pytest.approx(0.05, abs=1e-4)
    assert one(spark, t_two_sided(F.lit(1.96), F.lit(9_999))) == pytest.approx(0.05002, abs=1e-4)


def test_student_tail_undefined(spark):
    assert one(spark, t_two_sided(F.lit(1.0), F.lit(0))) is None
    assert one(spark, t_two_sided(F.lit(None).cast("double"), F.lit(5))) is None


def test_f_tail(spark):
    assert one(spark, f2_tail(F.lit(3.2), F.lit(40))) == pytest.approx(0.0513854561, abs=1e-9)
    assert one(spark, f2_tail(F.lit(-1.0), F.lit(40))) == 1.0


@pytest.mark.parametrize("z", [0.0, 0.5, 1.0, 1.96, 3.0, 5.0])
def test_normal_tail(spark, z):
    assert one(spark, normal_two_sided(F.lit(z))) == pytest.approx(math.erfc(z / math.sqrt(2)), abs=2e-7)


def test_t_tail_has_no_step_at_large_degrees_of_freedom(spark):
    df = spark.createDataFrame([(9_999,), (10_000,), (10_001,), (20_001,), (1_000_000,)], "df int")
    p = [r[0] for r in df.orderBy("df").select(t_two_sided(F.lit(3.0), F.col("df"))).collect()]
    assert all(a > b for a, b in zip(p[:-1], p[1:])) and p[0] - p[2] < 1e-8
    assert abs(p[4] - 0.0026998) < 1e-6


def integrated_tail(t, df):
    """Two-sided tail by Gauss-Legendre pieces over the angle, with gamma functions of the standard library."""
    x, w = np.polynomial.legendre.leggauss(40)
    edges = np.linspace(math.atan(t / math.sqrt(df)), min(math.pi / 2, math.atan((t + 60) / math.sqrt(df)) if df > 50 else math.pi / 2), 401)
    nodes = (edges[1:, None] + edges[:-1, None]) / 2 + (edges[1:, None] - edges[:-1, None]) / 2 * x
    area = (np.cos(nodes) ** (df - 1) * w * (edges[1:, None] - edges[:-1, None]) / 2).sum()
    # Wallis' product by steps of two from the exact start
    whole, k = (math.pi / 2, 1) if df % 2 == 1 else (1.0, 2)
    log = math.log(whole) + (sum(math.log1p(-1 / (j + 1)) for j in range(k, df, 2)) if df < 5000 else 0.0)
    if df >= 5000:
        log = math.log(math.sqrt(math.pi) / 2) - 0.5 * math.log(df / 2) + 1 / (4 * df) - 1 / (24 * df**3)
    return area / math.exp(log)


def test_student_tail_equals_numeric_integration(spark):
    dfs = [1, 2, 3, 4, 5, 7, 10, 15, 30, 57, 58, 100, 333, 1000, 9_999, 50_000, 1_000_000]
    ts = [1e-9, 0.01, 0.3, 1.0, 1.7, 2.0, 2.5, 2.82, 2.83, 2.84, 3.0, 4.0, 6.0, 9.0, 20.0]
    frame = spark.createDataFrame([(float(t), v) for t in ts for v in dfs], "t double, df int")
    for r in frame.withColumn("p", t_two_sided(F.col("t"), F.col("df"))).collect():
        want = integrated_tail(r["t"], r["df"])
        assert r["p"] == pytest.approx(want, abs=1e-10, rel=1e-8), (r, want)

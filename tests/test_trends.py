import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohyet.operators import trends as T
from tests.conftest import rows


def only(df):
    out = rows(df)
    assert len(out) == 1
    return out[0]


def test_exact_line(make_series):
    df = make_series({(1, "temperature"): [2 + 0.5 * t for t in range(72)]})
    r = only(T.linear_trend(df))
    assert r["slope_per_year"] == pytest.approx(6.0)
    assert r["r_squared"] == pytest.approx(1.0)
    assert r["p_value"] == pytest.approx(0.0, abs=1e-12)
    assert r["trend_strength"] == "very_strong" or r["trend_strength"] == "very_strong"
    mk = only(T.mann_kendall(df))
    assert (mk["s"], mk["trend_direction"], mk["tau"]) == (72 * 71 // 2, "increasing", 1.0)
    assert mk["sen_slope"] == pytest.approx(0.5)
    p = only(T.project_linear(df))
    assert p["projected_change"] == pytest.approx(60.0)
    assert p["projected_mean"] == pytest.approx(2 + 0.5 * (72 + 59.5))


def test_constant_series_is_guarded(make_series):
    df = make_series({(1, "a"): [7.0] * 60})
    r = only(T.linear_trend(df))
    assert (r["slope_per_year"], r["r_squared"], r["trend_strength"]) == (0.0, 0.0, "undefined")
    mk = only(T.mann_kendall(df))
    assert (mk["s"], mk["z_statistic"], mk["trend_direction"], mk["sen_slope"]) == (0, 0.0, "no trend", 0.0)
    assert T.poly_trend(df).count() == 3


@pytest.mark.parametrize("n", [0, 1, 2, 5, 11])
def test_short_series_do_not_fail(make_series, n):
    df = make_series({(1, "a"): [float(x) for x in range(n)], (2, "a"): [1.0] * 30})
    for f in (T.linear_trend, T.mann_kendall, T.poly_trend, T.seasonal_trends, T.decadal_comparison, T.validate_trend):
        f(df).collect()


def test_all_missing_series(make_series):
    df = make_series({(1, "a"): [None] * 40})
    for f in (T.linear_trend, T.mann_kendall, T.seasonal_trends, T.project_linear, T.quadratic_label):
        f(df).collect()


def test_kendall_score_against_pairs(make_series):
    rng = random.Random(5)
    values = {(i, "a"): [rng.choice([None, *range(1 + 3 * i)]) for _ in range(20 + 17 * i)] for i in range(1, 6)}
    got = {r["location_id"]: r for r in rows(T.kendall_score(make_series(values)))}
    for (loc, _), vs in values.items():
        v = [x for x in vs if x is not None]
        s = sum((b > a) - (b < a) for a, b in itertools.combinations(v, 2))
        n = len(v)
        tied = sum(c * (c - 1) * (2 * c + 5) for c in (v.count(x) for x in set(v)))
        assert got[loc]["s"] == s
        assert got[loc]["var_s"] == pytest.approx((n * (n - 1) * (2 * n + 5) - tied) / 18)


def test_kendall_never_forms_pairs(make_series):
    plan = T.kendall_score(make_series({(1, "a"): range(50)}))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan
    assert plan.count("Join") == 1  # scores with tie counts, one row per series each


@pytest.mark.parametrize("digits", [0, 1, 12])
def test_sen_slope_has_the_bits_of_all_pairs(digits):
    rng = np.random.default_rng(3)
    for n in (2, 3, 4, 40, 75, 160):
        t = np.sort(rng.choice(10 * n, n, replace=False)).astype(float)
        x = np.round(rng.normal(size=n) * 5 + 0.03 * t, digits)
        direct = float(np.median([(x[j] - x[i]) / (t[j] - t[i]) for i in range(n) for j in range(i + 1, n)]))
        for block in (1, 50, 10**6):
            assert T.median_pair_slope(t, x, block) == direct
    assert math.isnan(T.median_pair_slope(np.zeros(1), np.zeros(1)))
    assert T.median_pair_slope(np.arange(300.0), np.full(300, -4.0), 100) == 0.0


def test_exact_cubic_with_holes(make_series):
    values = [None if t in (3, 4, 20) else 1 + 2 * t - 0.3 * t**2 + 0.01 * t**3 for t in range(40)]
    out = rows(T.poly_trend(make_series({(1, "a"): values})), "degree")
    cubic = out[2]
    assert [cubic[f"c{i}"] for i in range(4)] == pytest.approx([1, 2, -0.3, 0.01], rel=1e-6)
    x = np.array([t for t, v in enumerate(values) if v is not None])
    y = np.array([v for v in values if v is not None])
    want = np.polyfit(x, y, 2)[::-1]
    assert [out[1][f"c{i}"] for i in range(3)] == pytest.approx(list(want), rel=1e-8)
    assert only(T.best_polynomial(T.poly_trend(make_series({(1, "a"): values}))))["best_degree"] == 3


def test_winter_uses_december_of_the_same_year(make_series):
    values = []
    for year in range(6):
        values += [100.0 * year if m in (0, 1, 11) else 0.0 for m in range(12)]
    out = {r["season"]: r for r in rows(T.seasonal_trends(make_series({(1, "a"): values})))}
    assert out["winter"]["slope_per_year"] == pytest.approx(100.0)
    assert out["summer"]["slope_per_year"] == 0.0


def test_confidence_uses_what_is_known(spark):
    col = lambda sig, p, r2, ml=None, poly=None: T.trend_confidence(F.lit(sig), F.lit(p), F.lit(r2), ml, poly)
    r = spark.range(1).select(
        col(True, 0.02, 0.5).alias("a"), col(False, 0.5, 0.3).alias("b"), col(True, 0.0, 0.4, F.lit(0.6), F.lit(0.8)).alias("c")
    ).first()
    assert (r["a"], r["b"], r["c"]) == pytest.approx((0.74, 0.3, 0.7))


def test_summary_text(spark):
    text = T.trend_summary_text(
        F.lit("temperature"), F.lit(True), F.lit("increasing"), F.lit("high"), F.lit(0.123456), F.lit("weak"),
        F.lit(True), F.lit("increasing"), F.lit(0.7),
    )
    quiet = T.trend_summary_text(F.lit("humidity"), F.lit(False), F.lit("no trend"), F.lit("low"), F.lit(0.001), F.lit("weak"))
    r = spark.range(1).select(text.alias("a"), quiet.alias("b")).first()
    assert r["a"] == (
        "temperature - fitted line moves by 0.123 a year, weak, rank test finds it increasing (confidence high), "
        "its level breaks at some period, learned models expect it increasing (70%)"
    )
    assert r["b"] == "humidity - nothing stands out"

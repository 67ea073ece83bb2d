import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohyet.operators import forecast, resample, rolling, stats
from isohyet.plans import reports
from isohyet.series import KEY
from tests.conftest import rows


def only(df):
    out = rows(df)
    assert len(out) == 1
    return out[0]


def season(n, step=1.0):
    return [10 * math.sin(2 * math.pi * t / 12) + step * (t // 12) for t in range(n)]


def test_seasonal_subset_adds_the_trend_again(make_series):
    df = make_series({(1, "a"): season(96)})
    plain = [r["value"] for r in rows(rolling.seasonal_adjusted_subset(df, 1, adjust=False), "t")]
    moved = [r["value"] for r in rows(rolling.seasonal_adjusted_subset(df, 1), "t")]
    assert plain == pytest.approx(list(range(8)))
    assert moved == pytest.approx([2 * x for x in range(8)])


def test_short_subset_is_not_moved(make_series):
    df = make_series({(1, "a"): season(60)})
    assert [r["value"] for r in rows(rolling.seasonal_adjusted_subset(df, 1), "t")] == pytest.approx(list(range(5)))


def test_fallbacks(make_series):
    few = make_series({(1, "a"): [1.0, 2.0, 3.0]})
    assert only(forecast.seasonal_mean_forecast(few, 1))["method"] == "overall_mean_fallback"
    r = only(forecast.trend_adjusted_forecast(few, 1))
    assert (r["prediction"], r["confidence"], r["best_model"]) == (2.0, 0.3, "fallback")
    r = only(forecast.trend_adjusted_forecast(make_series({(1, "a"): season(60)}), 1))
    assert r["prediction"] == pytest.approx(5.0)
    r = only(forecast.trend_adjusted_forecast(make_series({(1, "a"): season(36)}), 1))
    assert r["prediction"] == pytest.approx(1.0)


def test_probabilities_are_bounded(spark, make_series):
    df = make_series({(1, "temperature"): season(240)})
    seasonal = rolling.seasonal_adjusted_subset(df, 1)
    hot = spark.createDataFrame([(1, "temperature", 1e6, 1.0)], "location_id bigint, variable string, prediction double, confidence double")
    base = {r["condition"]: r["probability"] for r in rows(stats.exceedance_probabilities(seasonal))}
    out = {r["condition"]: r["probability"] for r in rows(stats.adjust_probabilities(stats.exceedance_probabilities(seasonal), hot, seasonal))}
    assert out["above_very_hot"] == pytest.approx(base["above_very_hot"] + 25)
    assert out["above_hot"] == pytest.approx(base["above_hot"] + 15)
    assert sum(out.values()) <= 80 + 1e-9 and min(out.values()) >= 0.1


def test_conditions_by_variable(make_series):
    df = make_series({(1, v): range(1, 41) for v in ("temperature", "precipitation", "wind_speed", "pressure")})
    got = {}
    for r in rows(stats.exceedance_probabilities(df)):
        got.setdefault(r["variable"], set()).add(r["condition"])
    assert {k: len(v) for k, v in got.items()} == {"temperature": 4, "precipitation": 3, "wind_speed": 2, "pressure": 4}


def test_describe_matches_numpy(make_series):
    v = np.array([3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0])
    r = only(stats.describe_series(make_series({(1, "a"): [None, *v, None]})))
    z = (v - v.mean()) / v.std()
    assert r["skewness"] == pytest.approx((z**3).mean()) and r["kurtosis"] == pytest.approx((z**4).mean() - 3)
    for p in (5, 10, 25, 50, 75, 90, 95):
        assert r[f"p{p}"] == pytest.approx(np.percentile(v, p))


def test_bootstrap_is_repeatable_and_spread_like_theory(make_series):
    rng = np.random.default_rng(0)
    v = rng.normal(size=240)
    df = make_series({(1, "a"): v, (2, "a"): [1.0] * 60, (3, "a"): range(24)})
    a = {r["location_id"]: r["trend_uncertainty"] for r in rows(resample.bootstrap_trend(df))}
    b = {r["location_id"]: r["trend_uncertainty"] for r in rows(resample.bootstrap_trend(df))}
    assert a == b and a[2] == 0.0 and a[3] == 0.0
    n = len(v)
    theory = 12 * v.std() / math.sqrt(n * (n * n - 1) / 12 / 1)
    assert 0.6 * theory < a[1] < 1.5 * theory


def test_draws_look_uniform(spark):
    d = spark.range(100).crossJoin(spark.range(360).withColumnRenamed("id", "t")).select(
        resample.draw(42, F.col("id"), F.col("t"), F.lit(360)).alias("d"), "id"
    )
    counts = [r["count"] for r in d.groupBy("d").count().collect()]
    assert len(counts) == 360 and 50 < min(counts) and max(counts) < 160
    unique = d.groupBy("id").agg(F.countDistinct("d").alias("u")).agg(F.avg("u")).first()[0]
    assert unique / 360 == pytest.approx(1 - math.exp(-1), abs=0.03)  # with replacement


def test_intervals_nest_and_line_is_exact(make_series):
    out = rows(resample.bootstrap_intervals(make_series({(1, "a"): [2 + 0.5 * t for t in range(60)]}), 3), "lead")
    assert [r["upper_95"] for r in out] == pytest.approx([32, 32.5, 33])
    noisy = make_series({(1, "a"): [t + (t * 7919 % 13) for t in range(60)]})
    for r in rows(resample.bootstrap_intervals(noisy, 5)):
        assert r["lower_95"] <= r["lower_80"] <= r["upper_80"] <= r["upper_95"]


def test_leads_follow_thirty_day_steps():
    assert forecast.lead_dates(dt.date(2024, 1, 31), 3) == [(1, 3, 2024), (2, 3, 2024), (3, 4, 2024)]


def test_extended_forecast_modes(make_series):
    df = make_series({(1, "a"): season(120)})
    live = rows(forecast.extended_forecast(df, dt.date(2024, 1, 1), 6), "lead")
    calm = rows(forecast.extended_forecast(df, dt.date(2024, 1, 1), 6, "pretrained"), "lead")
    assert len(live) == len(calm) == 6
    assert (live[0]["confidence_score"], calm[0]["confidence_score"]) == (pytest.approx(0.6), pytest.approx(0.5))
    for r in live:
        assert r["lower_95"] <= r["lower_80"] <= r["predicted_value"] <= r["upper_80"] <= r["upper_95"]


def test_agreement(spark):
    r = spark.range(1).select(
        forecast.agreement_confidence(F.lit(10.0), F.lit(1.0)).alias("a"),
        forecast.agreement_confidence(F.lit(0.0), F.lit(1.0)).alias("b"),
        forecast.agreement_confidence(F.lit(1.0), F.lit(5.0), 0.4).alias("c"),
    ).first()
    assert (r["a"], r["b"], r["c"]) == (pytest.approx(0.9), 0.5, 0.4)


def test_reports_keep_every_series(make_series):
    df = make_series(
        {(1, "temperature"): season(120), (2, "precipitation"): [5.0] * 70, (3, "wind_speed"): [None] * 50 + [1.0] * 3, (4, "pressure"): [1.0, 2.0]},
        lat=45.0, lon=5.0,
    )
    out = {r["location_id"]: r for r in rows(reports.weather_probability(df, 1, replicates=5))}
    assert set(out) == {1, 2, 3, 4}
    assert out[1]["climate_zone"] == "temperate" and out[1]["extreme_probabilities"]
    trends = {r["location_id"]: r for r in rows(reports.climate_trends(df))}
    assert set(trends) == {1, 2, 3, 4}
    assert trends[4]["status"] == "insufficient_data" and trends[1]["status"] == "ok"
    fast = {r["location_id"]: r for r in rows(reports.climate_trends(df, "fast"))}
    assert "chow_break_point" not in fast[1] and fast[1]["summary"].startswith("temperature - ")

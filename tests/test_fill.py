import numpy as np
import pytest
from pyspark.sql import functions as F

from isohyet.operators import events, fill, rolling
from tests.conftest import rows

N = None


def filled(df):
    return [r["filled"] for r in rows(df, "t")]


def test_gaps_include_both_ends(make_series):
    out = rows(fill.find_gaps(make_series({(1, "a"): [N, 1, N, N, 2, N]})), "gap_start")
    assert [(r["gap_start"], r["gap_end"], r["gap_size"]) for r in out] == [(0, 0, 1), (2, 3, 2), (5, 5, 1)]


def test_linear_fill_extrapolates_at_the_ends(make_series):
    df = make_series({(1, "a"): [N, 4, 6, N, N, 12, 15, N, N]})
    assert filled(fill.fill_linear(df)) == pytest.approx([2, 4, 6, 8, 10, 12, 15, 18, 21])


def test_gap_limit(make_series):
    df = make_series({(1, "a"): [0, N, N, N, N, 5, N, 7]})
    assert filled(fill.fill_linear(df, 3)) == [0, N, N, N, N, 5, 6, 7]
    assert filled(fill.fill_linear(df, 4)) == pytest.approx([0, 1, 2, 3, 4, 5, 6, 7])


@pytest.mark.parametrize("values", [[N, N, N], [N, 3, N], []])
def test_too_few_valid_points_stay_missing(make_series, values):
    df = make_series({(1, "a"): values, (2, "a"): [1, N, 3]})
    out = [r["filled"] for r in rows(fill.fill_linear(df).filter("location_id = 1"), "t")]
    assert out == values


def test_seasonal_fill_takes_the_same_phase(make_series):
    df = make_series({(1, "a"): [1, 2, 3, 10, N, 30, 100, 200, 300]})
    assert filled(fill.fill_seasonal(df, period=3))[4] == pytest.approx((2 + 200) / 2)


def test_spline_reproduces_a_cubic(make_series):
    f = lambda t: 1 + 2 * t - 0.3 * t**2 + 0.01 * t**3
    values = [N if t in (0, 7, 8, 25, 39) else f(t) for t in range(40)]
    assert filled(fill.fill_spline(make_series({(1, "a"): values}))) == pytest.approx([f(t) for t in range(40)], abs=1e-8)


@pytest.mark.parametrize("n", [4, 5, 6, 40])
def test_spline_equals_dense_equations(make_series, n):
    rng = np.random.default_rng(n)
    t, v = np.cumsum(rng.integers(1, 4, n)), rng.normal(size=n)
    h, slope = np.diff(t).astype(float), np.diff(v) / np.diff(t)
    m, rhs = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        m[i, i - 1 : i + 2], rhs[i] = (h[i - 1], 2 * (h[i - 1] + h[i]), h[i]), 6 * (slope[i] - slope[i - 1])
    m[0, :3], m[-1, -3:] = (h[1], -(h[0] + h[1]), h[0]), (h[-1], -(h[-2] + h[-1]), h[-2])
    curve = np.linalg.solve(m, rhs)
    at = np.arange(t[-1] + 3)
    i = np.clip(np.searchsorted(t, at, side="right") - 1, 0, n - 2)
    d = at - t[i]
    want = v[i] + d * (slope[i] - h[i] * (2 * curve[i] + curve[i + 1]) / 6 + d * (curve[i] / 2 + d * (curve[i + 1] - curve[i]) / (6 * h[i])))
    known = dict(zip(t.tolist(), v.tolist()))
    got = filled(fill.fill_spline(make_series({(1, "a"): [known.get(x, N) for x in at.tolist()]}), 5))
    assert got == pytest.approx(want, rel=1e-7, abs=1e-7)


def test_spline_stays_on_the_jvm_with_one_exchange(make_series):
    plan = fill.fill_spline(make_series({(1, "a"): [1, N, 3, 4, 9]}))._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_long_series_with_a_gap_near_each_end(make_series):
    f = lambda t: 3 + 0.5 * t - 0.01 * t**2
    values = [N if t in (1, 2, 2500, 4998) else f(t) for t in range(5000)]
    assert filled(fill.fill_spline(make_series({(1, "a"): values}))) == pytest.approx([f(t) for t in range(5000)], rel=1e-9, abs=1e-6)


def test_spline_falls_back_to_lines(make_series):
    assert filled(fill.fill_spline(make_series({(1, "a"): [1, N, 3, N]}))) == pytest.approx([1, 2, 3, 4])


def test_quality_fill(make_series):
    df = make_series({(1, "a"): [1, 50, 3, N, 5], (2, "a"): [1, N, N, 2, 3]})
    df = df.withColumn("quality_flag", F.when((F.col("location_id") == 1) & (F.col("t") == 1), 0).otherwise(1))
    one = lambda d, loc: [r["filled"] for r in rows(d.filter(f"location_id = {loc}"), "t")]
    kept = fill.quality_fill(df, 5)
    assert one(kept, 1) == [1, 50, 3, 4, 5]
    assert one(fill.quality_fill(df, 5, replace_flagged=True), 1) == [1, 2, 3, 4, 5]
    strict = rows(fill.quality_fill(df, 1).filter("location_id = 2"), "t")
    assert {r["status"] for r in strict} == {"too_many_missing"}
    assert strict[0]["max_consecutive_missing"] == 2
    assert [r["filled"] for r in strict] == [1, N, N, 2, 3]


def test_asof_exact_inside_outside(spark, make_series):
    series = make_series({(1, "a"): [N, 10, N, 30, N]})
    asked = spark.createDataFrame(
        [(1, "a", 1, 1.0), (1, "a", 2, 1.5), (1, "a", 3, 0.5), (1, "a", 4, 3.5), (2, "a", 5, 1.0)],
        "location_id bigint, variable string, point_id bigint, x double",
    )
    out = {r["point_id"]: r for r in rows(fill.asof_interpolate(asked, series))}
    assert (out[1]["interpolated_value"], out[1]["method"], out[1]["confidence"]) == (10.0, "exact_match", 1.0)
    assert (out[2]["interpolated_value"], out[2]["weight"]) == (15.0, 0.25)
    assert {out[i]["method"] for i in (3, 4, 5)} == {"outside_range"}


def test_runs_with_an_open_end(make_series):
    df = make_series({(1, "a"): [5, 5, 1, 5, 5, 5, 1, N, 6, 7, 8]})
    out = rows(events.consecutive_events(df, F.lit(4.0), 3), "start_t")
    assert [(r["start_t"], r["end_t"], r["duration"], r["peak"]) for r in out] == [(3, 5, 3, 5.0), (8, 10, 3, 8.0)]
    low = rows(events.consecutive_events(df, F.lit(4.0), 1, above=False), "start_t")
    assert [(r["start_t"], r["peak"]) for r in low] == [(2, 1.0), (6, 1.0)]


def test_dry_spell_open_at_the_edge_counts_once(make_series):
    values = [0.0] * 10 + [0.0, 0.0] + [5.0] * 50 + [0.0] * 3 + [5.0] * 65
    assert len(values) == 130
    r = rows(events.dry_spell_frequency(make_series({(1, "a"): [v + 0.001 * (i % 2) * (v > 0) for i, v in enumerate(values)]})))[0]
    assert r["dry_spell_frequency"] in (0.0, 0.2)


def test_decomposition_adds_up_and_edges(make_series):
    df = make_series({(1, "a"): [float(t % 12) + t for t in range(48)]})
    for r in rows(rolling.seasonal_decompose(df), "t"):
        assert r["trend"] + r["seasonal"] + r["residual"] == pytest.approx(r["value"])
    out = rows(rolling.seasonal_decompose(df), "t")
    values = [r["value"] for r in out]
    assert out[6]["trend"] == pytest.approx(sum(values[:12]) / 12)
    assert [r["trend"] for r in out] == pytest.approx(list(np.convolve(values, np.ones(12) / 12, "same")))
    assert rows(rolling.seasonal_decompose(df, edges="null"), "t")[0]["trend"] is None
    assert rolling.seasonal_decompose(make_series({(1, "a"): [1.0] * 23})).count() == 0


def test_autocorrelation_of_constant_is_zero(make_series):
    out = {r["lag"]: r["autocorrelation"] for r in rows(rolling.autocorrelation(make_series({(1, "a"): [2.0] * 30}), 3))}
    assert out == {0: 1.0, 1: 0.0, 2: 0.0, 3: 0.0}


def test_asof_over_gaps_and_past_the_last_value(spark, make_series):
    series = make_series({(1, "a"): [5, N, N, 11, N]})
    asked = spark.createDataFrame([(1, "a", i, x) for i, x in enumerate([0.0, 1.0, 2.25, 3.0, 3.5, 9.0, -1.0])] + [(1, "a", 7, None)], "location_id bigint, variable string, point_id bigint, x double")
    out = rows(fill.asof_interpolate(asked, series), "point_id")
    assert [r["interpolated_value"] for r in out] == [5, 7, 9.5, 11, N, N, N, N]
    assert [r["method"] for r in out] == ["exact_match", "linear_temporal", "linear_temporal", "exact_match"] + ["outside_range"] * 4


def test_places_without_elevation_or_trend_keep_their_rows(spark, make_series):
    from isohyet.operators import quality
    from isohyet.plans import reports

    series = make_series({(1, "temperature"): [10, 20], (2, "temperature"): [10, 20]})
    high = spark.createDataFrame([(1, 1000.0)], "location_id bigint, elevation double")
    assert [r["value"] for r in rows(quality.elevation_correct(series, high), "location_id", "t")] == pytest.approx([3.5, 13.5, 10, 20])
    trend = spark.createDataFrame([(1, "temperature", 0.5, 0.01, "strong")], "location_id bigint, variable string, slope_per_year double, p_value double, trend_strength string")
    out = rows(reports.attach_trends(series.select("location_id", "variable").distinct(), trend), "location_id")
    assert [(r["slope_per_year"], r["p_value"], r["trend_strength"]) for r in out] == [(0.5, 0.01, "strong"), (0.0, 1.0, "unknown")]

import math

import numpy as np
import pytest

from isohyet.operators import changepoints as C
from tests.conftest import rows

STEP = [(0 if t < 60 else 10) + (1 if t % 2 else -1) for t in range(120)]
VOLATILE = [(1 if t < 60 else 5) * (1 if t % 2 else -1) for t in range(120)]


def only(df):
    out = rows(df)
    assert len(out) == 1
    return out[0]


def test_step_is_found_by_every_scan(make_series):
    df = make_series({(1, "a"): STEP})
    cusum = only(C.cusum(df))
    assert cusum["change_point_detected"] and cusum["change_point_index"] in (58, 59, 60)
    shift = only(C.mean_shift_scan(df))
    assert (shift["shift_index"], shift["shift_direction"]) == (60, "upward")
    assert shift["shift_magnitude"] == pytest.approx(10.0)
    chow = only(C.chow_scan(df))
    assert chow["structural_break_detected"] and chow["break_point"] == 60


def test_volatility(make_series):
    r = only(C.variance_scan(make_series({(1, "a"): VOLATILE})))
    assert r["change_detected"] and r["change_index"] == 60
    assert r["variance_ratio"] == pytest.approx(25.0)
    h = only(C.variance_halves(make_series({(1, "a"): VOLATILE})))
    assert h["variance_ratio"] == pytest.approx(1 / 25) and h["change_type"] == "increased_volatility"


def test_flat_window_followed_by_spread(make_series):
    values = [5.0] * 60 + [5.0 + (-1) ** t for t in range(60)]
    r = only(C.variance_scan(make_series({(1, "a"): values})))
    assert r["variance_ratio"] > 0


def test_constant_series(make_series):
    df = make_series({(1, "a"): [3.0] * 120})
    assert not only(C.cusum(df))["change_point_detected"]
    assert not only(C.mean_shift_scan(df))["shift_detected"]
    assert not only(C.trend_change_scan(df))["trend_change_detected"]
    assert C.chow_tests(df).count() == 0
    assert only(C.variance_scan(df))["variance_ratio"] == 1.0


@pytest.mark.parametrize("n", [1, 11, 47, 48, 59])
def test_short_series(make_series, n):
    df = make_series({(1, "a"): [float(t % 7) for t in range(n)]})
    for f in (C.cusum, C.rolling_zscore_change, C.variance_halves, C.variance_scan, C.mean_shift_scan, C.trend_change_scan, C.chow_scan):
        f(df).collect()


def test_windows_with_gaps_match_numpy(make_series):
    rng = np.random.default_rng(1)
    raw = [None if t % 9 == 4 else float(x) for t, x in enumerate(rng.normal(size=150).cumsum())]
    v = np.array([x for x in raw if x is not None])
    times = [t for t, x in enumerate(raw) if x is not None]
    n, w = len(v), max(24, len(v) // 4)
    ratios = {i: v[i : i + w].var() / v[i - w : i].var() for i in range(w, n - w)}
    best = max(ratios, key=lambda i: abs(math.log(ratios[i])))
    r = only(C.variance_scan(make_series({(1, "a"): raw})))
    assert r["variance_ratio"] == pytest.approx(ratios[best])
    assert r["change_index"] == (times[best] if abs(math.log(ratios[best])) > 0.5 else None)


def test_restricted_line_ignores_a_steady_trend(make_series):
    values = [0.5 * t + (1 if t % 2 else -1) for t in range(120)]
    df = make_series({(1, "a"): values})
    assert only(C.chow_scan(df))["structural_break_detected"]
    assert not only(C.chow_scan(df, restricted="line"))["structural_break_detected"]


def test_trend_reversal(make_series):
    values = [float(t) if t < 90 else 180.0 - t for t in range(180)]
    r = only(C.trend_change_scan(make_series({(1, "a"): [x + 0.1 * (i % 3) for i, x in enumerate(values)]})))
    assert r["change_description"] == "trend_reversal_positive_to_negative"

"""Checks for features, forecasts and composed reports."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import functions as F

from checks import aggregates as aggregate_checks
from checks import trends as trend_checks
from checks.aggregates import BOOT_SQL, FORECAST_SQL, MODELS_SQL, PROBS_SQL, QS, RECORDS_SQL, SEASONAL_SQL, SKEW, _skill
from checks.data import (
    BUCKETS_SQL,
    MONTHLY_SQL,
    POINTS_SQL,
    SHIP_SQL,
    SITES_SQL,
    buckets,
    lat_sql,
    lon_sql,
    monthly,
    placed,
    points,
    ship,
    sites,
    with_sql,
)
from checks.joins import MOVED_SQL, _exact_points
from checks.mathsql import haversine, mean_cents, zone
from checks.scans import _two_variables
from checks.spec import Check
from checks.trends import CUSUM_SQL, LINEAR_SQL, PAIRS_SQL, RECURRENCE_SQL, RUNS_SQL, SCAN_SQL, SEASONS_SQL, ZONED_SQL, _runs_total
from checks.windows import FRAME, LAGS, O, SLOPE_OVER, STATS, W3, W6, W12, W24
from isohyet.functions.zones import latitude_climatology
from isohyet.models import panel
from isohyet.operators import features, forecast, resample, stats, trends
from isohyet.plans import reports
from isohyet.plans.base import materialise
from isohyet.series import KEY

LATLON = f"{lat_sql('location_id')} / 90 AS lat_norm, {lon_sql('location_id')} / 180 AS lon_norm, abs({lat_sql('location_id')}) / 90 AS abs_lat_norm"
CYCLE = lambda x, name: f"sin(2 * pi() * ({x}) / 12) AS {name}_sin, cos(2 * pi() * ({x}) / 12) AS {name}_cos, ({x}) / 12.0 AS {name}_norm"
COLS = lambda names: " ".join(f"{c}:d" for c in names)
MEASURES = "arg_max(value, t) FILTER (WHERE value IS NOT NULL)"
FC = FORECAST_SQL(4).strip()

FEATURES_BODY = f"""
SELECT location_id, variable, t, value, {LAGS(1, 12)}, {CYCLE('t % 12 + 1', 'month')},
  CASE WHEN t >= 24 THEN coalesce({SLOPE_OVER('w12')}, 0) ELSE 0 END AS slope_12, CASE WHEN t >= 24 THEN coalesce({SLOPE_OVER('w24')}, 0) ELSE 0 END AS slope_24,
  {STATS('w12', '12')}, {LATLON}, CASE WHEN t >= 15 THEN lag(value, 13) OVER o ELSE 0 END AS lag_13, CASE WHEN t >= 15 THEN lag(value, 14) OVER o ELSE 0 END AS lag_14,
  CASE WHEN t >= 15 THEN lag(value, 15) OVER o ELSE 0 END AS lag_15, CASE WHEN t >= 14 THEN avg(value) OVER w3 ELSE 0 END AS mean_3ly,
  CASE WHEN t >= 14 THEN stddev_pop(value) OVER w3 ELSE 0 END AS std_3ly, CASE WHEN t >= 14 THEN max(value) OVER w3 - min(value) OVER w3 ELSE 0 END AS range_3ly,
  CASE WHEN t >= 24 THEN coalesce(lag(value, 1) OVER o - lag(value, 13) OVER o, 0) ELSE 0 END AS yoy
FROM series WINDOW {O}, {W12}, {W24}, {W3}"""

# one made-up row after the end turns "the coming period" into an ordinary row
TARGET_SQL = f"""
{MONTHLY_SQL.strip().replace('series AS (', 'past AS (')},
series AS (SELECT location_id, variable, t, value FROM past UNION ALL SELECT DISTINCT location_id, variable, 80, NULL FROM past)"""
TARGET_BODY = FEATURES_BODY.replace("t % 12 + 1", "4").replace(
    f"coalesce({SLOPE_OVER('w12')}, 0)", SLOPE_OVER("w12")
).replace(f"coalesce({SLOPE_OVER('w24')}, 0)", SLOPE_OVER("w24")).replace(
    "coalesce(lag(value, 1) OVER o - lag(value, 13) OVER o, 0)", "lag(value, 1) OVER o - lag(value, 13) OVER o"
)

TREND_BODY = f"""
SELECT location_id, variable, t, value, t / 80.0 AS time_norm, {CYCLE('t % 12', 'phase')}, {STATS('w12', '12')}, stddev_pop(value) OVER w12 AS variability_12,
  lag(value) OVER o AS previous, avg(value) OVER w6 AS mean_6, CASE WHEN t >= 24 THEN coalesce({SLOPE_OVER('w12')}, 0) ELSE 0 END AS slope_12,
  CASE WHEN t >= 24 THEN coalesce({SLOPE_OVER('w24')}, 0) ELSE 0 END AS slope_24, {LATLON} FROM series WINDOW {O}, {W12}, {W24}, {W6}"""

RECENT_SQL = f"""
recent AS (
  SELECT location_id, variable, avg(value) FILTER (WHERE t >= 68) AS mean_12, stddev_pop(value) FILTER (WHERE t >= 68) AS std_12,
    max(value) FILTER (WHERE t >= 68) - min(value) FILTER (WHERE t >= 68) AS range_12, max(value) FILTER (WHERE t = 79) AS previous,
    {MEASURES} AS last_value, avg(value) FILTER (WHERE t >= 74) AS mean_6, regr_slope(value, t) FILTER (WHERE t >= 68) AS slope_12,
    regr_slope(value, t) FILTER (WHERE t >= 56) AS slope_24, {LATLON} FROM series GROUP BY location_id, variable
)"""

BASELINE_SQL = f"""
{MONTHLY_SQL.strip()},
ph AS (SELECT location_id, variable, t % 12 AS phase, value, row_number() OVER (PARTITION BY location_id, t % 12 ORDER BY t) - 1 AS k,
  count(*) OVER (PARTITION BY location_id, t % 12) AS c FROM series WHERE value IS NOT NULL AND t < 72),
adj AS (SELECT location_id, variable, phase, CASE WHEN c > 5 AND abs(regr_slope(value, k) OVER g) > 0.01 THEN value + k * regr_slope(value, k) OVER g ELSE value END AS value
  FROM ph WINDOW g AS (PARTITION BY location_id, phase)),
base AS (SELECT location_id, variable, phase, avg(value) AS baseline, stddev_pop(value) AS baseline_std, count(*) AS baseline_points FROM adj GROUP BY 1, 2, 3),
leads AS (SELECT k AS lead, CAST(month(d) AS BIGINT) AS month, CAST(year(d) AS BIGINT) AS year FROM (SELECT k, DATE '2001-09-15' + CAST(30 * k AS INTEGER) AS d FROM range(1, 7) r(k))),
lb AS (SELECT base.*, lead, month, year FROM base JOIN leads ON month = phase + 1)"""


def _blend(spark, sf):
    m = monthly(spark, sf)
    leads = forecast.expand_leads(forecast.seasonal_baselines(m), forecast.lead_dates(dt.date(2001, 9, 15), 6))
    return forecast.blend_forecast(leads, forecast.trend_adjusted_forecast(m, 4))


def _extended(mode):
    return lambda s, d: forecast.extended_forecast(monthly(s, d), dt.date(2001, 9, 15), 6, mode)


def _extended_sql(alpha, share, conf):
    return with_sql(BASELINE_SQL, "," + LINEAR_SQL(MONTHLY_SQL).replace(MONTHLY_SQL.strip() + ",", "").strip(), body=f"""
, f AS (SELECT lb.*, baseline + CASE WHEN p_value < {alpha} THEN slope_per_year * lead / 12.0 * {share} ELSE 0 END AS v,
  1.96 * baseline_std / sqrt(baseline_points) AS m FROM lb JOIN linear USING (location_id, variable))
SELECT location_id, variable, lead, month, year, v AS predicted_value, v - m AS lower_95, v - 0.67 * m AS lower_80, v + 0.67 * m AS upper_80, v + m AS upper_95,
  33.3 AS above_normal, 33.3 AS normal, 33.4 AS below_normal, {conf} AS confidence_score FROM f""").replace(",\n,", ",\n")


def _site_predictions(spark, sf):
    """Each site repeats the seasonal forecast of its nation, plus its own offset."""
    f = forecast.seasonal_mean_forecast(monthly(spark, sf), 4)
    return sites(spark, sf).join(f, F.col("nation") == F.col("location_id")).select(
        "site_id", (F.col("prediction") + F.col("site_id") % 7).alias("prediction")
    )


def _spatial(spark, sf):
    return forecast.spatial_predict(_exact_points(spark, sf), sites(spark, sf), _site_predictions(spark, sf), 4)


CLIMO = "(30 - 0.6 * abs(lat) + (5 + 0.3 * abs(lat)) * cos(2 * pi() * (4 - CASE WHEN lat >= 0 THEN 7 ELSE 1 END) / 12))"


SEASON_NAMES = ["winter", "spring", "summer", "autumn"]
CONDITIONS = [
    "above_very_hot", "above_hot", "below_cold", "below_very_cold", "above_heavy_rain", "above_very_heavy_rain", "below_dry", "above_windy", "above_very_windy",
]


def _spread(df, name: str, keys):
    """One column per key of a map column."""
    return df.withColumns({f"{name}_{k}": F.col(name)[k] for k in keys})


def spread_probability(report):
    return _spread(_spread(report, "extreme_probabilities", CONDITIONS), "seasonal_slopes", SEASON_NAMES)


def _probability(spark, sf):
    return spread_probability(reports.weather_probability(placed(monthly(spark, sf)), 4, replicates=100))


def _trend_report(mode):
    def run(spark, sf):
        return _spread(reports.climate_trends(placed(buckets(spark, sf)), mode), "seasonal_slopes", SEASON_NAMES)

    return run


def _simple(spark, sf):
    b = buckets(spark, sf)
    return reports.simple_summary(stats.describe_series(b), _skill(spark, sf), 30, 2025)


def _indicators(spark, sf):
    return reports.climate_indicators(placed(buckets(spark, sf)))


def _text(spark, sf):
    b = buckets(spark, sf).withColumn("value", F.col("value") + F.col("t") * F.col("location_id") / 50)
    rows = trends.mann_kendall(b, slope=False).join(trends.linear_trend(b).drop("p_value", "points"), KEY)
    return rows.select(
        *KEY,
        trends.trend_summary_text(F.col("variable"), F.col("is_significant"), F.col("trend_direction"), F.col("confidence"),
                                  F.col("slope_per_year"), F.col("trend_strength")).alias("summary"),
        trends.trend_description(F.col("trend_direction"), F.col("slope_per_year"), F.col("trend_strength")).alias("description"),
        trends.trend_confidence(F.col("is_significant"), F.col("p_value"), F.col("r_squared")).alias("confidence_score"),
    )


DRIFT_SQL = BUCKETS_SQL.replace("k.t, c.value\n", "k.t, c.value + k.t * k.location_id / 50 AS value\n")
DESCRIPTION_SQL = """CASE WHEN trend_direction = 'no trend' THEN concat('steady, spread ', trend_strength)
    ELSE printf('%s by %.3f a year (%s)', CASE WHEN trend_direction = 'increasing' AND slope_per_year > 0 THEN 'rises'
      WHEN trend_direction = 'decreasing' AND slope_per_year < 0 THEN 'falls' WHEN trend_direction = 'increasing' THEN 'ranks go up, line falls'
      ELSE 'ranks go down, line rises' END, abs(slope_per_year), trend_strength) END"""
TEXT_BODY = """
, x AS (SELECT m.location_id, m.variable, is_significant, trend_direction, confidence, m.p_value, slope_per_year, r_squared, trend_strength FROM mann_kendall m JOIN linear l USING (location_id))
SELECT location_id, variable, concat(variable, ' - ', CASE WHEN is_significant OR abs(slope_per_year) > 0.01 THEN concat_ws(', ',
    CASE WHEN abs(slope_per_year) > 0.01 THEN printf('fitted line moves by %.3f a year, %s', abs(slope_per_year), trend_strength) END,
    CASE WHEN is_significant THEN concat('rank test finds it ', trend_direction, ' (confidence ', confidence, ')') END)
  ELSE 'nothing stands out' END) AS summary,
  """ + DESCRIPTION_SQL + """ AS description,
  CASE WHEN is_significant THEN (1 - p_value + r_squared) / 2 ELSE r_squared END AS confidence_score FROM x"""

_rest = lambda sql, base: sql.replace(base.strip() + ",", "").strip()

# the other features of a row without gaps are sums of these, which elimination without pivots cannot take
STEP_COLUMNS = [*[f"lag_{k}" for k in range(1, 13)], "month_sin", "month_cos", "month_norm", "std_12", "range_12"]
_STEP_GRAM = ", ".join(
    "[" + ", ".join(f"covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b}))" for b in [*STEP_COLUMNS, "value"]) + "]" for a in STEP_COLUMNS
)
STEP_SQL = with_sql(f"RECURSIVE {MONTHLY_SQL.strip()}", body=f"""
, f AS (SELECT * FROM ({FEATURES_BODY}) WHERE t >= 12),
x AS (SELECT * FROM f WHERE value + {' + '.join(STEP_COLUMNS)} IS NOT NULL),
stats AS (SELECT variable, k, avg(value) AS my, stddev_pop(value) AS sy, [{', '.join(f'avg({c})' for c in STEP_COLUMNS)}] AS mx,
  [{', '.join(f'stddev_pop({c})' for c in STEP_COLUMNS)}] AS sx, [{_STEP_GRAM}] AS m FROM x JOIN range(68, 80) r(k) ON t < k GROUP BY variable, k),
steps AS (
  SELECT variable, k, 0 AS i, m FROM stats
  UNION ALL
  SELECT variable, k, i + 1, list_transform(m, lambda r, p: CASE WHEN p = i + 1 THEN list_transform(r, lambda v: v / m[i + 1][i + 1])
    ELSE list_transform(r, lambda v, j: v - r[i + 1] * m[i + 1][j] / m[i + 1][i + 1]) END) FROM steps WHERE i < {len(STEP_COLUMNS)}),
done AS (SELECT s.*, list_transform(steps.m, lambda r, i: r[{len(STEP_COLUMNS) + 1}] * s.sy / s.sx[i]) AS w
  FROM steps JOIN stats s ON s.variable = steps.variable AND s.k = steps.k WHERE i = {len(STEP_COLUMNS)}),
past AS (SELECT location_id, t, avg(value) OVER (PARTITION BY location_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mean FROM series)
SELECT f.location_id, f.variable, f.t, f.value AS actual,
  coalesce(my + {' + '.join(f'w[{i + 1}] * ({c} - mx[{i + 1}])' for i, c in enumerate(STEP_COLUMNS))}, mean) AS prediction
FROM f JOIN past ON past.location_id = f.location_id AND past.t = f.t LEFT JOIN done ON done.variable = f.variable AND done.k = f.t WHERE f.t >= 68 AND f.value IS NOT NULL""")



def _sql_of(checks, name: str, was: str = "", base: str = "", rows: str = "series") -> str:
    """The SQL of an operator's own check, over other facts or over other rows of the same."""
    sql = next(c.sql for c in checks.CHECKS if c.name == name)
    head, cut, body = sql.partition(was.strip()) if was else ("", "", sql)
    assert not was or cut, name
    return head + (base or was).strip() + (re.sub(r"\bseries\b", rows, body) if rows != "series" else body)


def _joined(first: str, parts: list[tuple[str, str, str]], columns: str = "") -> str:
    """One row per series: ``first`` and, from each (alias, SQL, columns), the named columns, with the alias before them after a colon."""
    chosen = [c for _, _, cols in parts for c in cols.split(", ")]
    joins = "\n".join(f"LEFT JOIN ({sql}) {alias} USING (location_id, variable)" for alias, sql, _ in parts)
    return f"SELECT location_id, variable, {', '.join(chosen)}{columns} FROM ({first}) place\n{joins}"


def _under(alias: str, columns: str, prefix: str = "") -> str:
    return ", ".join(f"{alias}.{c} AS {prefix}{c}" for c in columns.split())


def _seasons_sql(base: str, years: int, least: int) -> str:
    wide = ", ".join(f"max(slope_per_year) FILTER (WHERE season = '{x}') AS seasonal_slopes_{x}" for x in SEASON_NAMES)
    return with_sql(SEASONS_SQL(base, years), body=f"SELECT location_id, variable, {wide} FROM seasons WHERE years >= {least} GROUP BY ALL")


_BEST_SQL = """SELECT location_id, variable, degree AS best_degree, r_squared AS best_r_squared, aic AS best_aic FROM poly
QUALIFY row_number() OVER (PARTITION BY location_id ORDER BY aic, degree) = 1"""
_SLOPES_AT = """SELECT location_id, variable, CASE WHEN n <= 36 THEN 'insufficient_data' WHEN square > 0 THEN 'accelerating' WHEN square < 0 THEN 'decelerating' ELSE 'linear' END AS trend_type,
  CASE WHEN n <= 36 THEN 0 ELSE square END AS acceleration, n > 36 AND abs(square) > 0.001 AS curvature_significant FROM poly WHERE degree = 2"""


def _trend_report_sql(full: bool) -> str:
    """All columns of the trend report of the two-hour series, from each operator's own SQL."""
    b, t = BUCKETS_SQL, trend_checks
    turning = _sql_of(t, "trend_change_scan")
    turning = re.sub(r"c\.value \+ sin\(k\.t / 40\.0\) \* 40 AS value", "c.value", turning)
    parts = [
        ("mk", _sql_of(t, "mann_kendall"), _under("mk", "trend_direction is_significant p_value tau sen_slope confidence", "mk_")),
        ("lr", _sql_of(t, "linear_trend", MONTHLY_SQL, b), _under("lr", "slope_per_year r_squared p_value trend_strength", "lr_")),
        ("se", _seasons_sql(b, 30, 5), ", ".join(f"seasonal_slopes_{x}" for x in SEASON_NAMES)),
        ("de", _sql_of(t, "decadal_comparison"), _under("de", "difference p_value is_significantly_different", "decadal_")),
        ("pr", _sql_of(t, "project_linear", MONTHLY_SQL, b).replace("(80 + h", "(360 + h"), _under("pr", "projected_change projected_mean uncertainty_range")),
        ("zo", _sql_of(t, "zone_context", MONTHLY_SQL, b), _under("zo", "climate_zone expected_low expected_high anomaly_threshold")),
    ]
    if full:
        parts += [
            ("po", with_sql(RECURRENCE_SQL(b), body=_BEST_SQL), _under("po", "best_degree best_r_squared best_aic")),
            ("cu", CUSUM_SQL(b, 2.5), _under("cu", "change_point_detected change_point_index", "cusum_")),
            ("va", _sql_of(t, "variance_scan", MONTHLY_SQL, b), _under("va", "change_detected variance_ratio", "variance_")),
            ("sh", _sql_of(t, "mean_shift_scan"), _under("sh", "shift_detected shift_index shift_magnitude", "shift_")),
            ("sl", turning, _under("sl", "trend_change_detected change_index", "slope_")),
            ("ch", _sql_of(t, "chow_scan", SHIP_SQL, b), _under("ch", "structural_break_detected break_point", "chow_")),
        ]
    change = "CASE WHEN cusum_change_point_detected THEN 'its level breaks at some period' END" if full else "NULL"
    counted = with_sql(b, body=f"SELECT location_id, variable, count(value) AS points, any_value({lat_sql('location_id')}) AS lat FROM series GROUP BY 1, 2")
    texts = f"""concat_ws(', ', CASE WHEN abs(lr_slope_per_year) > 0.01 THEN printf('fitted line moves by %.3f a year, %s', abs(lr_slope_per_year), lr_trend_strength) END,
  CASE WHEN mk_is_significant THEN concat('rank test finds it ', mk_trend_direction, ' (confidence ', mk_confidence, ')') END, {change})"""
    score = f"list_avg(list_filter([CASE WHEN mk_is_significant THEN 1 - mk_p_value END, lr_r_squared, {'best_r_squared' if full else 'NULL'}], lambda x: x IS NOT NULL))"
    return f"""SELECT *, 'ok' AS status, concat(variable, ' - ', CASE WHEN words = '' THEN 'nothing stands out' ELSE words END) AS summary, {score} AS confidence_score
FROM (SELECT *, {texts} AS words FROM ({_joined(counted, parts, ', place.points, place.lat')}) AS joined) AS worded"""


TREND_REPORT = (
    "location_id:i variable:s points:i lat:d mk_trend_direction:s mk_is_significant:b mk_p_value:d mk_tau:d mk_sen_slope:d mk_confidence:s lr_slope_per_year:d "
    "lr_r_squared:d lr_p_value:d lr_trend_strength:s seasonal_slopes_winter:d seasonal_slopes_spring:d seasonal_slopes_summer:d seasonal_slopes_autumn:d "
    "decadal_difference:d decadal_p_value:d decadal_is_significantly_different:b projected_change:d projected_mean:d uncertainty_range:d climate_zone:s "
    "expected_low:d expected_high:d anomaly_threshold:d status:s summary:s confidence_score:d"
)
FULL_REPORT = TREND_REPORT + (
    " best_degree:i best_r_squared:d best_aic:d cusum_change_point_detected:b cusum_change_point_index:i variance_change_detected:b variance_variance_ratio:d "
    "shift_shift_detected:b shift_shift_index:i shift_shift_magnitude:d slope_trend_change_detected:b slope_change_index:i chow_structural_break_detected:b chow_break_point:i"
)


def _probability_sql() -> str:
    """All columns of the probability report of April of the monthly series, from each operator's own SQL."""
    a, t, m = aggregate_checks, trend_checks, MONTHLY_SQL
    april = SEASONAL_SQL(4)
    likely = ", ".join(f"max(probability) FILTER (WHERE condition = '{c}') AS extreme_probabilities_{c}" for c in CONDITIONS)
    described = "mean median std min max skewness kurtosis p5 p10 p25 p50 p75 p90 p95"
    parts = [
        ("ds", _sql_of(a, "describe_series", m, april, "seasonal"), _under("ds", described)),
        ("ro", _sql_of(a, "robust_stats", BUCKETS_SQL, april, "seasonal"), _under("ro", "iqr robust_mean coefficient_of_variation")),
        ("fo", with_sql(april, "," + FC, body="SELECT fc.*, variable FROM fc JOIN (SELECT DISTINCT location_id, variable FROM seasonal) USING (location_id)").replace(",\n,", ",\n"),
         "fo.prediction, 0.6 AS prediction_confidence"),
        ("ad", f"SELECT location_id, variable, {likely} FROM ({_sql_of(a, 'adjust_probabilities')}) AS adjusted GROUP BY ALL",
         ", ".join(f"extreme_probabilities_{c}" for c in CONDITIONS)),
        ("mk", _sql_of(t, "mann_kendall", BUCKETS_SQL, m), _under("mk", "trend_direction is_significant p_value tau z_statistic", "mk_")),
        ("lr", _sql_of(t, "linear_trend"), _under("lr", "slope_per_year r_squared p_value standard_error trend_strength", "lr_")),
        ("po", with_sql(RECURRENCE_SQL(m), body=_SLOPES_AT), _under("po", "trend_type acceleration curvature_significant", "poly_")),
        ("se", _seasons_sql(m, 6, 3), ", ".join(f"seasonal_slopes_{x}" for x in SEASON_NAMES)),
        ("cu", _sql_of(t, "cusum"), _under("cu", "change_point_detected change_point_index change_magnitude", "cusum_")),
        ("rz", _sql_of(t, "rolling_zscore_change"), _under("rz", "change_point_detected change_point_index", "rolling_")),
        ("ha", _sql_of(t, "variance_halves"), _under("ha", "variance_ratio variance_change_detected", "halves_")),
        ("un", _sql_of(a, "uncertainty"),
         _under("un", "trend_uncertainty seasonal_uncertainty total_uncertainty uncertainty_level lower_68 upper_68 lower_95 upper_95")),
        ("pf", _sql_of(a, "seasonal_profile"), _under("pf", "amplitude peak_month trough_month seasonality_strength")),
        ("iv", _sql_of(a, "interannual_variability", BUCKETS_SQL, m).replace("FROM series GROUP BY ALL", "FROM series WHERE t < 72 GROUP BY ALL"), "iv.interannual"),
        ("ef", _sql_of(a, "extreme_frequency", BUCKETS_SQL, m), _under("ef", "hot_extremes_percent cold_extremes_percent extreme_threshold_hot extreme_threshold_cold")),
        ("sa", with_sql(april, body="SELECT location_id, variable, count(*) AS sample_size FROM seasonal GROUP BY ALL"), "sa.sample_size"),
    ]
    place = with_sql(m, body=f"""SELECT location_id, variable, any_value({lat_sql('location_id')}) AS lat, any_value({lon_sql('location_id')}) AS lon, count(*) AS periods,
  any_value({zone(lat_sql('location_id'))}) AS climate_zone FROM series GROUP BY 1, 2""")
    words = DESCRIPTION_SQL
    for name in ("trend_direction", "slope_per_year", "trend_strength"):
        words = re.sub(rf"\b{name}\b", ("mk_" if name == "trend_direction" else "lr_") + name, words)
    return f"""SELECT *, {words} AS trend_description, 100.0 * sample_size / (periods // 12) AS completeness, periods // 12 AS data_span_years
FROM ({_joined(place, parts, ', place.lat, place.lon, place.periods, place.climate_zone')}) AS joined"""


PROBABILITY_REPORT = (
    "location_id:i variable:s lat:d lon:d periods:i climate_zone:s mean:d median:d std:d min:d max:d skewness:d kurtosis:d p5:d p10:d p25:d p50:d p75:d p90:d p95:d "
    "iqr:d robust_mean:d coefficient_of_variation:d prediction:d prediction_confidence:d " + " ".join(f"extreme_probabilities_{c}:d" for c in CONDITIONS) +
    " mk_trend_direction:s mk_is_significant:b mk_p_value:d mk_tau:d mk_z_statistic:d lr_slope_per_year:d lr_r_squared:d lr_p_value:d lr_standard_error:d "
    "lr_trend_strength:s poly_trend_type:s poly_acceleration:d poly_curvature_significant:b " + " ".join(f"seasonal_slopes_{x}:d" for x in SEASON_NAMES) +
    " cusum_change_point_detected:b cusum_change_point_index:i cusum_change_magnitude:d rolling_change_point_detected:b rolling_change_point_index:i "
    "halves_variance_ratio:d halves_variance_change_detected:b trend_uncertainty:d seasonal_uncertainty:d total_uncertainty:d uncertainty_level:s lower_68:d "
    "upper_68:d lower_95:d upper_95:d amplitude:d peak_month:i trough_month:i seasonality_strength:s interannual:d hot_extremes_percent:d "
    "cold_extremes_percent:d extreme_threshold_hot:d extreme_threshold_cold:d sample_size:i trend_description:s completeness:d data_span_years:i"
)


CHECKS = [
    Check(
        "walk_forward_linear", lambda s, d: panel.walk_forward_linear(placed(monthly(s, d)), columns=STEP_COLUMNS),
        "location_id:i variable:s t:i prediction:d actual:d", STEP_SQL,
    ),
    Check(
        "forecast_features", lambda s, d: features.forecast_features(placed(monthly(s, d))), "location_id:i t:i value:d " + COLS(features.FORECAST_COLUMNS),
        with_sql(MONTHLY_SQL, body=f"SELECT * FROM ({FEATURES_BODY}) WHERE t >= 12"),
    ),
    Check(
        "target_features", lambda s, d: features.target_features(placed(monthly(s, d)), 4), "location_id:i " + COLS(features.FORECAST_COLUMNS),
        with_sql(TARGET_SQL, body=f"SELECT * FROM ({TARGET_BODY}) WHERE t = 80"),
    ),
    Check(
        "trend_features", lambda s, d: features.trend_features(placed(monthly(s, d))), "location_id:i t:i value:d " + COLS(features.TREND_COLUMNS),
        with_sql(MONTHLY_SQL, body=f"SELECT * FROM ({TREND_BODY}) WHERE t >= 12"),
    ),
    Check(
        "future_features", lambda s, d: features.future_features(placed(monthly(s, d)), 60), "location_id:i step:i " + COLS(features.TREND_COLUMNS),
        with_sql(MONTHLY_SQL, "," + RECENT_SQL, body=f"""
SELECT *, std_12 AS variability_12, (80 + step) / 140.0 AS time_norm, {CYCLE('(80 + step) % 12', 'phase')} FROM recent CROSS JOIN range(60) r(step)""").replace(",\n,", ",\n"),
    ),
    Check(
        "panel_features", lambda s, d: features.panel_features(placed(monthly(s, d))), "location_id:i t:i value:d " + COLS(features.PANEL_COLUMNS),
        with_sql(MONTHLY_SQL, body=f"SELECT * FROM ({TREND_BODY}) WHERE t >= 12"),
    ),
    Check(
        "panel_predict_features", lambda s, d: features.panel_predict_features(placed(monthly(s, d)), 4), "location_id:i " + COLS(features.PANEL_COLUMNS),
        with_sql(MONTHLY_SQL, "," + RECENT_SQL, body=f"SELECT * EXCLUDE (previous), last_value AS previous, 0.8 AS time_norm, {CYCLE('4', 'phase')} FROM recent").replace(",\n,", ",\n"),
    ),
    Check(
        "bootstrap_intervals", lambda s, d: resample.bootstrap_intervals(monthly(s, d), 12, 100), "location_id:i variable:s lead:i lower_95:d lower_80:d upper_80:d upper_95:d",
        with_sql(BOOT_SQL(MONTHLY_SQL, 100), body="""
, f AS (SELECT location_id, variable, b, regr_slope(value, t) AS s, regr_intercept(value, t) AS a FROM draws GROUP BY 1, 2, 3),
p AS (SELECT location_id, variable, lead, a + s * (80 + lead - 1) AS v FROM f CROSS JOIN range(1, 13) r(lead))
SELECT location_id, variable, lead, quantile_cont(v, 0.025) AS lower_95, quantile_cont(v, 0.1) AS lower_80, quantile_cont(v, 0.9) AS upper_80, quantile_cont(v, 0.975) AS upper_95 FROM p GROUP BY ALL"""),
    ),
    Check(
        "walk_forward", lambda s, d: forecast.walk_forward_metrics(buckets(s, d)), "location_id:i variable:s mae:d rmse:d mape:d r_squared:d skill:d accuracy:d",
        with_sql(BUCKETS_SQL, body="""
, v AS (SELECT * FROM series WHERE value IS NOT NULL),
tr AS (SELECT c.location_id, c.variable, c.t AS cut, c.value AS actual, p.value, p.t, row_number() OVER (PARTITION BY c.location_id, c.t ORDER BY p.t) - 1 AS k
  FROM v c JOIN v p ON p.location_id = c.location_id AND p.t < c.t AND p.t % 12 = c.t % 12 WHERE c.t >= 348),
f AS (SELECT location_id, variable, cut, any_value(actual) AS a, CASE WHEN count(*) > 3 THEN arg_max(value, k) + regr_slope(value, k) ELSE avg(value) END AS p FROM tr GROUP BY 1, 2, 3),
e AS (SELECT location_id, variable, avg(abs(p - a)) AS mae, sqrt(avg((p - a) ** 2)) AS rmse, 100 * avg(abs((p - a) / a)) AS mape, 1 - avg((p - a) ** 2) / var_pop(a) AS r_squared, stddev_pop(a) AS sd FROM f GROUP BY 1, 2)
SELECT *, greatest(0, 1 - rmse / sd) AS skill, greatest(0, 100 * (1 - mae / sd)) AS accuracy FROM e"""),
    ),
    Check(
        "blend_forecast", _blend, "location_id:i variable:s lead:i month:i year:i predicted_value:d lower_95:d lower_80:d upper_80:d upper_95:d baseline:d confidence:d uncertainty_level:s",
        with_sql(BASELINE_SQL, "," + _rest(SEASONAL_SQL(4), MONTHLY_SQL), "," + FC, body="""
, m AS (SELECT lb.*, prediction_std AS sd, 0.6 * prediction + 0.4 * baseline AS v FROM lb JOIN fc USING (location_id))
SELECT location_id, variable, lead, month, year, v AS predicted_value, v - 1.96 * sd AS lower_95, v - 1.28 * sd AS lower_80, v + 1.28 * sd AS upper_80, v + 1.96 * sd AS upper_95,
  baseline, 0.6 AS confidence, 'high' AS uncertainty_level FROM m""").replace(",\n,", ",\n"),
    ),
    Check(
        "extended_forecast", _extended("live_training"),
        "location_id:i variable:s lead:i month:i year:i predicted_value:d lower_95:d lower_80:d upper_80:d upper_95:d above_normal:d normal:d below_normal:d confidence_score:d",
        _extended_sql(0.05, 1.0, 0.6),
    ),
    Check(
        "extended_forecast_pretrained", _extended("pretrained"),
        "location_id:i variable:s lead:i month:i year:i predicted_value:d lower_95:d lower_80:d upper_80:d upper_95:d above_normal:d normal:d below_normal:d confidence_score:d",
        _extended_sql(0.1, 0.5, 0.5),
    ),
    Check(
        "spatial_predict", _spatial, "point_id:i ensemble_prediction:d prediction_confidence:d coverage:s members:i",
        with_sql(MOVED_SQL, "," + SEASONAL_SQL(4).strip(), body=f"""
, nf AS (SELECT location_id, avg(value) AS p FROM ranked GROUP BY 1),
sp AS (SELECT site_id, lat, lon, p + site_id % 7 AS p FROM sites JOIN nf ON nation = location_id),
near AS (SELECT m.point_id, s.p, 1 / (d + 1) AS w FROM (SELECT m.point_id, s.site_id, {haversine('m.lat', 'm.lon', 's.lat', 's.lon')} AS d
    FROM moved m CROSS JOIN sites s QUALIFY row_number() OVER (PARTITION BY m.point_id ORDER BY d, s.site_id) <= 5) m JOIN sp s USING (site_id) WHERE d < 1000),
zs AS (SELECT z, avg(p) AS p FROM (SELECT site_id, {zone('lat')} AS z FROM sites QUALIFY row_number() OVER (PARTITION BY {zone('lat')} ORDER BY site_id) <= 3) JOIN sp USING (site_id) GROUP BY 1),
mem AS (SELECT * FROM near UNION ALL SELECT point_id, p, 0.3 FROM moved JOIN zs ON z = {zone('lat')} UNION ALL SELECT point_id, {CLIMO}, 0.2 FROM moved),
mix AS (SELECT point_id, sum(p * w) / sum(w) AS e, stddev_pop(p) AS sd, count(*) AS members FROM mem GROUP BY 1)
SELECT point_id, coalesce(sp.p, e) AS ensemble_prediction, CASE WHEN sp.p IS NOT NULL THEN 0.65 ELSE greatest(0.4, 1 - sd / abs(e)) END AS prediction_confidence,
  CASE WHEN sp.p IS NOT NULL THEN 'exact_site' ELSE 'interpolated' END AS coverage, members
FROM mix JOIN moved USING (point_id) LEFT JOIN sp ON sp.site_id = moved.exact_id""").replace(",\n,", ",\n"),
    ),
    Check(
        "latitude_climatology", lambda s, d: points(s, d).select("point_id", latitude_climatology(F.col("lat"), F.lit(4)).alias("prediction")), "point_id:i prediction:d",
        with_sql(POINTS_SQL, body=f"SELECT point_id, {CLIMO} AS prediction FROM points"),
    ),
    Check(
        "trend_texts", _text, "location_id:i variable:s summary:s description:s confidence_score:d",
        with_sql(PAIRS_SQL(DRIFT_SQL), "," + _rest(LINEAR_SQL(DRIFT_SQL), DRIFT_SQL), body=TEXT_BODY).replace(",\n,", ",\n"),
    ),
    Check("weather_probability", _probability, PROBABILITY_REPORT, _probability_sql()),
    Check("climate_trends_fast", _trend_report("fast"), TREND_REPORT, _trend_report_sql(False)),
    Check("climate_trends", _trend_report("full"), FULL_REPORT, _trend_report_sql(True)),
    Check(
        "climate_indicators", _indicators, "location_id:i variable:s indicator:s value:d",
        with_sql(ZONED_SQL(BUCKETS_SQL), "," + RUNS_SQL("hw", "value > hot", 3), "," + RUNS_SQL("cs", "value < cold", 3), "," + RUNS_SQL("dr", "value < dry", 6),
                 "," + RUNS_SQL("fl", "value > wet", 2), body=f"""
, q AS (SELECT location_id, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.95) AS p95,
  coalesce(quantile_cont(value, 0.75) FILTER (WHERE value > 0), 1) AS w FROM series GROUP BY 1),
yr AS (SELECT location_id, 10 * regr_slope(v, y) AS rate FROM (SELECT location_id, t // 12 AS y, avg(value) AS v FROM series GROUP BY ALL) GROUP BY 1),
f AS (SELECT z.*, p10, p25, p90, p95, w, t >= 240 AS late, coalesce(value < p25, false) AS is_dry FROM zoned z JOIN q USING (location_id)),
sp AS (SELECT location_id, count(*) FILTER (WHERE is_dry AND NOT was) / 10 AS spells FROM
  (SELECT location_id, is_dry, coalesce(lag(is_dry) OVER (PARTITION BY location_id ORDER BY t), false) AS was FROM f WHERE late) GROUP BY 1),
a AS (SELECT location_id, variable, stddev_pop(value) FILTER (WHERE late) - stddev_pop(value) FILTER (WHERE NOT late) AS vc,
  100.0 * count(*) FILTER (WHERE late AND value > p90) / count(value) FILTER (WHERE late) AS hot_pc, 100.0 * count(*) FILTER (WHERE late AND value < p10) / count(value) FILTER (WHERE late) AS cold_pc,
  1.0 * count(*) FILTER (WHERE late AND value > w) / count(value) FILTER (WHERE late) - 1.0 * count(*) FILTER (WHERE NOT late AND value > w) / count(value) FILTER (WHERE NOT late) AS wet_ch,
  1.0 * count(*) FILTER (WHERE late AND value > p95) / count(value) FILTER (WHERE late) - 1.0 * count(*) FILTER (WHERE NOT late AND value > p95) / count(value) FILTER (WHERE NOT late) AS ext_ch,
  count(*) FILTER (WHERE value > hot) AS hots, count(*) FILTER (WHERE value < cold) AS colds, count(*) FILTER (WHERE value > wet) AS wets, count(*) FILTER (WHERE value < dry) AS dries,
  stddev_pop(value) / avg(value) AS cv FROM f GROUP BY 1, 2),
m AS (SELECT a.*, rate, spells, {_runs_total('hw')} AS hw, {_runs_total('cs')} AS cs, {_runs_total('dr')} AS dr, {_runs_total('fl')} AS fl FROM a JOIN yr USING (location_id) JOIN sp USING (location_id))
SELECT location_id, variable, unnest(['warming_rate_per_decade', 'recent_hot_percent', 'recent_cold_percent', 'variability_change', 'hot_periods', 'cold_periods', 'heat_waves', 'cold_spells']) AS indicator,
  unnest([rate, hot_pc, cold_pc, vc, hots, colds, hw, cs]) AS value FROM m WHERE variable = 'temperature'
UNION ALL SELECT location_id, variable, unnest(['intense_precipitation_change', 'precipitation_variability_change', 'dry_spell_frequency', 'wet_periods', 'dry_periods', 'variability_index', 'droughts', 'flood_risk_periods']),
  unnest([100 * wet_ch, vc, spells, wets, dries, cv, dr, fl]) FROM m WHERE variable = 'precipitation'
UNION ALL SELECT location_id, variable, unnest(['variability_change', 'extreme_frequency_change']), unnest([vc, ext_ch]) FROM m WHERE variable NOT IN ('temperature', 'precipitation')""").replace(",\n,", ",\n"),
    ),
    Check(
        "simple_summary", _simple, "location_id:i variable:s prediction_value:d confidence:d accuracy_text:s data_points:s training_period:s",
        with_sql(MODELS_SQL, body="""
, e AS (SELECT location_id, avg(abs(seasonal - actual)) AS m, avg(abs(baseline - actual)) AS b, 1 - avg((seasonal - actual) ** 2) / var_pop(actual) AS r2 FROM held GROUP BY 1)
SELECT location_id, variable, round_even(avg(value), 2) AS prediction_value, round_even(100 * greatest(0.5, least(0.98, any_value(r2))), 1) AS confidence,
  printf('%.1f%%', greatest(20.0, least(98.0, 100 * (any_value(b) - any_value(m)) / any_value(b)))) AS accuracy_text, '360 months' AS data_points, '1995-2024' AS training_period
FROM series JOIN e USING (location_id) GROUP BY location_id, variable"""),
    ),
    Check(
        "verify_report", lambda s, d: reports.verify_report(_two_variables(s, d), 1995, 2001),
        "location_id:i points:i temp_min:d temp_max:d temp_mean:d temp_median:d temp_std:d rain_total:d decades:i temperature_change:d completeness:d quality_rating:s sufficient_for_ml:b recommendation:s",
        with_sql(RECORDS_SQL, body=f"""
, w AS (SELECT location_id, count(*) AS decades, CASE WHEN count(*) >= 2 THEN arg_max(avg_temperature, decade) - arg_min(avg_temperature, decade) END AS temperature_change FROM decades GROUP BY 1)
SELECT location_id, count(temperature_c) AS points, min(temperature_c) AS temp_min, max(temperature_c) AS temp_max, {mean_cents('temperature_c')} AS temp_mean, round_even(median(temperature_c), 2) AS temp_median,
  round_even(stddev_pop(temperature_c), 2) AS temp_std, coalesce(round_even(sum(precipitation_mm), 2), 0) AS rain_total, any_value(decades) AS decades, any_value(temperature_change) AS temperature_change,
  100.0 * count(temperature_c) / 84 AS completeness, CASE WHEN 100.0 * count(temperature_c) / 84 > 95 THEN 'EXCELLENT' WHEN 100.0 * count(temperature_c) / 84 > 90 THEN 'GOOD' ELSE 'FAIR' END AS quality_rating,
  false AS sufficient_for_ml, '23 more years wanted for training' AS recommendation FROM records LEFT JOIN w USING (location_id) GROUP BY 1 HAVING count(temperature_c) > 0"""),
    ),
]

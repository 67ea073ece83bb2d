"""Checks for aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.data import BUCKETS_SQL, MONTHLY_SQL, buckets, lat_sql, monthly, placed, with_sql
from checks.mathsql import mean_cents
from checks.scans import _two_variables
from checks.spec import Check
from isohyet.operators import events, forecast, resample, rolling, stats
from isohyet.plans import reports
from isohyet.series import KEY
from isohyet.sources.exports import monthly_records

QS = "quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.10) AS p10, quantile_cont(value, 0.25) AS p25, " \
     "quantile_cont(value, 0.50) AS p50, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.90) AS p90, quantile_cont(value, 0.95) AS p95"

SKEW = "(avg(pow(value - m, 3)) / nullif(pow(stddev_pop(value), 3), 0))"
RECORDS_SQL = f"""
{MONTHLY_SQL.strip()},
records AS (
  SELECT location_id // 3 AS location_id, t, 1995 + t // 12 AS year,
    round_even(max(value) FILTER (WHERE variable = 'temperature'), 2) AS temperature_c,
    round_even(max(value) FILTER (WHERE variable = 'precipitation'), 2) AS precipitation_mm
  FROM series WHERE variable IN ('temperature', 'precipitation') GROUP BY 1, 2, 3
),
decades AS (
  SELECT location_id, year // 10 * 10 AS decade, {mean_cents('temperature_c')} AS avg_temperature,
    coalesce({mean_cents('precipitation_mm')}, 0) AS avg_precipitation, count(temperature_c) AS months_count
  FROM records GROUP BY ALL HAVING count(temperature_c) > 0
)"""

SEASONAL_SQL = lambda month: f"""
{MONTHLY_SQL.strip()},
ranked AS (
  SELECT location_id, variable, t, value, row_number() OVER (PARTITION BY location_id ORDER BY t) - 1 AS k,
    count(*) OVER (PARTITION BY location_id) AS c
  FROM series WHERE value IS NOT NULL AND t < 72 AND t % 12 = {month - 1}
),
seasonal AS (
  SELECT location_id, variable, t, k, CASE WHEN c > 5 AND abs(regr_slope(value, k) OVER g) > 0.01
    THEN value + regr_slope(value, k) OVER g * k ELSE value END AS value, value AS plain
  FROM ranked WINDOW g AS (PARTITION BY location_id)
)"""

CONDITIONS_SQL = """
conditions AS (SELECT * FROM (VALUES
 ('temperature','above_very_hot','p95'),('temperature','above_hot','p90'),('temperature','below_cold','p10'),('temperature','below_very_cold','p5'),
 ('precipitation','above_heavy_rain','p90'),('precipitation','above_very_heavy_rain','p95'),('precipitation','below_dry','p10'),
 ('wind_speed','above_windy','p90'),('wind_speed','above_very_windy','p95')) v(variable, condition, p))"""

PROBS_SQL = lambda month: f"""
{SEASONAL_SQL(month).strip()},
{CONDITIONS_SQL.strip()},
q AS (SELECT location_id, {QS} FROM seasonal GROUP BY 1),
probs AS (
  SELECT s.location_id, s.variable, c.condition,
    any_value(CASE c.p WHEN 'p95' THEN p95 WHEN 'p90' THEN p90 WHEN 'p10' THEN p10 ELSE p5 END) AS threshold,
    100 * avg(CASE WHEN CASE c.p WHEN 'p95' THEN value > p95 WHEN 'p90' THEN value > p90 WHEN 'p10' THEN value < p10 ELSE value < p5 END
      THEN 1.0 ELSE 0.0 END) AS probability
  FROM seasonal s JOIN q USING (location_id) JOIN conditions c USING (variable) GROUP BY ALL
)"""

# the trend-adjusted same-month forecast
FORECAST_SQL = lambda month: f"""
fc AS (
  SELECT location_id, CASE WHEN count(*) > 3 THEN arg_max(value, k) + regr_slope(value, k) ELSE avg(value) END AS prediction,
    stddev_pop(value) AS prediction_std, count(*) AS c
  FROM ranked GROUP BY 1
)"""


def _models(spark, sf):
    """Three deterministic predictions of each series' last twelve periods."""
    b = rolling.holdout_split(buckets(spark, sf))
    g = F.col("is_holdout")
    from pyspark.sql import Window

    w = Window.partitionBy(*KEY)
    train = F.when(~g, F.col("value"))
    rows = b.withColumns(
        {
            "baseline": F.avg(train).over(w),
            "seasonal": F.avg(train).over(Window.partitionBy(*KEY, F.col("t") % 12)),
            "last": F.max_by(train, F.when(train.isNotNull(), F.col("t"))).over(w),
        }
    ).filter(g & F.col("value").isNotNull())
    return rows


MODELS_SQL = f"""
{BUCKETS_SQL.strip()},
held AS (
  SELECT * FROM (SELECT location_id, variable, t, value AS actual,
    avg(value) FILTER (WHERE t < 348) OVER (PARTITION BY location_id) AS baseline,
    avg(value) FILTER (WHERE t < 348) OVER (PARTITION BY location_id, t % 12) AS seasonal,
    arg_max(value, t) FILTER (WHERE t < 348 AND value IS NOT NULL) OVER (PARTITION BY location_id) AS last FROM series)
  WHERE t >= 348 AND actual IS NOT NULL
)"""


def _metrics(spark, sf):
    rows = _models(spark, sf).select(*KEY, F.col("value").alias("actual"), F.col("seasonal").alias("prediction"))
    return stats.error_metrics(rows)


def _skill(spark, sf):
    rows = _models(spark, sf).select(*KEY, F.col("value").alias("actual"), F.col("seasonal").alias("prediction"), "baseline")
    return stats.skill_score(rows)


def _ensemble(spark, sf):
    rows = _models(spark, sf)
    long = rows.select(
        *KEY, "value",
        F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("prediction")) for m in ("baseline", "seasonal", "last")])),
    )
    members = long.groupBy(*KEY, "model").agg(
        F.avg(F.abs(F.col("prediction") - F.col("value"))).alias("validation_mae"), F.avg("prediction").alias("prediction")
    )
    return forecast.weighted_ensemble(members)


def _agreement(spark, sf):
    e = _ensemble(spark, sf)
    return e.withColumns({
        "confidence": forecast.agreement_confidence(F.col("ensemble_prediction"), F.col("prediction_std")),
        "confidence_spatial": forecast.agreement_confidence(F.col("ensemble_prediction"), F.col("prediction_std") * 10, 0.4),
    })


MEMBERS_SQL = f"""
{MODELS_SQL.strip()},
long AS (
  SELECT location_id, variable, actual, unnest(['baseline', 'seasonal', 'last']) AS model, unnest([baseline, seasonal, last]) AS prediction FROM held
),
members AS (SELECT location_id, variable, model, avg(abs(prediction - actual)) AS validation_mae, avg(prediction) AS prediction FROM long GROUP BY ALL),
ens AS (
  SELECT location_id, variable, sum(prediction / (validation_mae + 0.01)) / sum(1 / (validation_mae + 0.01)) AS ensemble_prediction,
    stddev_pop(prediction) AS prediction_std, arg_min(model, validation_mae) AS best_model, count(*) AS models FROM members GROUP BY ALL
)"""


def _adjust(spark, sf):
    m = monthly(spark, sf)
    seasonal = rolling.seasonal_adjusted_subset(m, 4)
    return stats.adjust_probabilities(
        stats.exceedance_probabilities(seasonal), forecast.trend_adjusted_forecast(m, 4), seasonal
    )


def _uncertainty(spark, sf):
    m = monthly(spark, sf)
    return forecast.uncertainty(rolling.seasonal_adjusted_subset(m, 4), resample.bootstrap_trend(m, 100))


def _nullable(a: str, b: str) -> str:
    return f"{a} / nullif({b}, 0)"


BOOT_SQL = lambda base, reps: f"""
{base.strip()},
obs AS (SELECT location_id, variable, row_number() OVER (PARTITION BY location_id ORDER BY t) - 1 AS i, t, value,
  count(*) OVER (PARTITION BY location_id) AS n FROM series WHERE value IS NOT NULL),
x0 AS (SELECT o.location_id, o.variable, o.n, b, o.i AS pos,
  ((b + 1) * 48271 + (o.i + 1) * 69621 + 42 * 16807) % 2147483647 AS x FROM obs o CROSS JOIN range({reps}) r(b)),
x1 AS (SELECT location_id, variable, n, b, pos, (x * x + 48271) % 2147483647 AS x FROM x0),
x2 AS (SELECT location_id, variable, n, b, pos, ((x * x + 69621) % 2147483647) % n AS pick FROM x1),
draws AS (SELECT x2.*, o.t, o.value FROM x2 JOIN obs o ON o.location_id = x2.location_id AND o.i = x2.pick)"""

LATE = lambda n, c: f"({c}) FILTER (WHERE t >= {n - 120})"

CHECKS = [
    Check(
        "describe_series", lambda s, d: stats.describe_series(monthly(s, d)),
        "location_id:i variable:s mean:d median:d std:d min:d max:d skewness:d kurtosis:d p5:d p10:d p25:d p50:d p75:d p90:d p95:d",
        with_sql(MONTHLY_SQL, body=f"""
SELECT location_id, variable, avg(value) AS mean, median(value) AS median, stddev_pop(value) AS std, min(value) AS min, max(value) AS max,
  {SKEW} AS skewness, kurtosis_pop(value) AS kurtosis, {QS}
FROM (SELECT *, avg(value) OVER (PARTITION BY location_id) AS m FROM series) GROUP BY location_id, variable"""),
    ),
    Check(
        "percentiles", lambda s, d: stats.percentiles(buckets(s, d)), "location_id:i variable:s p5:d p10:d p25:d p50:d p75:d p90:d p95:d",
        with_sql(BUCKETS_SQL, body=f"SELECT location_id, variable, {QS} FROM series GROUP BY ALL"),
    ),
    Check(
        "robust_stats", lambda s, d: stats.robust_stats(buckets(s, d)), "location_id:i variable:s iqr:d robust_mean:d coefficient_of_variation:d",
        with_sql(BUCKETS_SQL, body="""
, q AS (SELECT location_id, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM series GROUP BY 1)
SELECT location_id, variable, any_value(b - a) AS iqr, avg(value) FILTER (WHERE value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) AS robust_mean,
  stddev_pop(value) / avg(value) AS coefficient_of_variation FROM series JOIN q USING (location_id) GROUP BY ALL"""),
    ),
    Check(
        "return_periods", lambda s, d: stats.return_periods(monthly(s, d), [20.0, 25.0, 30.0, 40.0]), "location_id:i variable:s level:d return_period:d",
        with_sql(MONTHLY_SQL, body="""
SELECT location_id, variable, level, count(value) / (count(*) FILTER (WHERE value >= level) + 1) AS return_period
FROM series CROSS JOIN (VALUES (20.0), (25.0), (30.0), (40.0)) l(level) GROUP BY ALL"""),
    ),
    Check(
        "outliers_iqr", lambda s, d: stats.outliers_iqr(buckets(s, d)), "location_id:i variable:s t:i value:d lower_bound:d upper_bound:d",
        with_sql(BUCKETS_SQL, body="""
, q AS (SELECT location_id, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM series GROUP BY 1)
SELECT location_id, variable, t, value, a - 1.5 * (b - a) AS lower_bound, b + 1.5 * (b - a) AS upper_bound FROM series JOIN q USING (location_id)
WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)"""),
    ),
    Check(
        "outliers_iqr_summary", lambda s, d: stats.outliers_iqr_summary(buckets(s, d)),
        "location_id:i variable:s outlier_count:i outlier_percentage:d lower_bound:d upper_bound:d",
        with_sql(BUCKETS_SQL, body="""
, q AS (SELECT location_id, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM series GROUP BY 1)
SELECT location_id, variable, count(*) FILTER (WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS outlier_count,
  100.0 * count(*) FILTER (WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) / count(value) AS outlier_percentage,
  any_value(a - 1.5 * (b - a)) AS lower_bound, any_value(b + 1.5 * (b - a)) AS upper_bound FROM series JOIN q USING (location_id) GROUP BY ALL"""),
    ),
    Check(
        "outliers_zscore", lambda s, d: stats.outliers_zscore(buckets(s, d)), "location_id:i variable:s t:i value:d zscore:d",
        with_sql(BUCKETS_SQL, body="""
SELECT * FROM (SELECT location_id, variable, t, value,
  (value - avg(value) OVER (PARTITION BY location_id)) / stddev_pop(value) OVER (PARTITION BY location_id) AS zscore FROM series) WHERE abs(zscore) > 3"""),
    ),
    Check(
        "exceedance_probabilities", lambda s, d: stats.exceedance_probabilities(rolling.seasonal_adjusted_subset(monthly(s, d), 4)),
        "location_id:i variable:s condition:s threshold:d probability:d", with_sql(PROBS_SQL(4), body="SELECT * FROM probs"),
    ),
    Check(
        "adjust_probabilities", _adjust, "location_id:i variable:s condition:s probability:d",
        with_sql(PROBS_SQL(4), "," + FORECAST_SQL(4), body="""
, raw AS (SELECT p.location_id, p.variable, p.condition, p.probability + 0.6 * CASE
    WHEN prediction > p95 THEN CASE condition WHEN 'above_very_hot' THEN 25 WHEN 'above_hot' THEN 15 ELSE 0 END
    WHEN prediction > p90 THEN CASE condition WHEN 'above_very_hot' THEN 10 WHEN 'above_hot' THEN 20 ELSE 0 END
    WHEN prediction < p10 THEN CASE condition WHEN 'below_cold' THEN 20 WHEN 'below_very_cold' THEN 15 ELSE 0 END ELSE 0 END AS r
  FROM probs p JOIN fc USING (location_id) JOIN q USING (location_id)),
tot AS (SELECT *, sum(r) OVER (PARTITION BY location_id) AS total FROM raw)
SELECT location_id, variable, condition, greatest(0.1, CASE WHEN total > 80 THEN r * 80 / total ELSE r END) AS probability FROM tot""").replace(",\n,", ",\n"),
    ),
    Check(
        "extreme_frequency", lambda s, d: stats.extreme_frequency(buckets(s, d)),
        "location_id:i variable:s hot_extremes_percent:d cold_extremes_percent:d extreme_threshold_hot:d extreme_threshold_cold:d",
        with_sql(BUCKETS_SQL, body="""
, q AS (SELECT location_id, quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.95) AS b FROM series GROUP BY 1)
SELECT location_id, variable, 100.0 * count(*) FILTER (WHERE value > b) / count(value) AS hot_extremes_percent,
  100.0 * count(*) FILTER (WHERE value < a) / count(value) AS cold_extremes_percent, any_value(b) AS extreme_threshold_hot, any_value(a) AS extreme_threshold_cold
FROM series JOIN q USING (location_id) GROUP BY ALL"""),
    ),
    Check(
        "seasonal_profile", lambda s, d: stats.seasonal_profile(monthly(s, d)),
        "location_id:i variable:s amplitude:d peak_month:i trough_month:i seasonality_strength:s",
        with_sql(MONTHLY_SQL, body="""
, m AS (SELECT location_id, variable, t % 12 + 1 AS month, avg(value) AS v FROM series WHERE t < 72 GROUP BY ALL),
sd AS (SELECT location_id, stddev_pop(value) AS std FROM series GROUP BY 1)
SELECT location_id, variable, max(v) - min(v) AS amplitude, arg_max(month, v) AS peak_month, arg_min(month, v) AS trough_month,
  CASE WHEN max(v) - min(v) > any_value(std) THEN 'high' WHEN max(v) - min(v) > any_value(std) / 2 THEN 'moderate' ELSE 'low' END AS seasonality_strength
FROM m JOIN sd USING (location_id) GROUP BY ALL"""),
    ),
    Check(
        "interannual_variability", lambda s, d: stats.interannual_variability(buckets(s, d)), "location_id:i variable:s years:i interannual:d",
        with_sql(BUCKETS_SQL, body="""
SELECT location_id, variable, count(*) AS years, stddev_pop(v) AS interannual FROM
 (SELECT location_id, variable, t // 12 AS y, avg(value) AS v FROM series GROUP BY ALL) GROUP BY ALL"""),
    ),
    Check(
        "decade_stats", lambda s, d: stats.decade_stats(monthly_records(_two_variables(s, d), 1995)),
        "location_id:i decade:i year_range:s avg_temperature:d avg_precipitation:d months_count:i",
        with_sql(RECORDS_SQL, body="SELECT *, printf('%d-%d', decade, decade + 9) AS year_range FROM decades"),
    ),
    Check(
        "warming_between_decades",
        lambda s, d: stats.warming_between_decades(stats.decade_stats(monthly_records(_two_variables(s, d), 1995)), 7),
        "location_id:i decades:i temperature_change:d warming_rate:d warming_trend:s",
        with_sql(RECORDS_SQL, body="""
SELECT location_id, count(*) AS decades, CASE WHEN count(*) >= 2 THEN arg_max(avg_temperature, decade) - arg_min(avg_temperature, decade) END AS temperature_change,
  CASE WHEN count(*) >= 2 THEN round_even((arg_max(avg_temperature, decade) - arg_min(avg_temperature, decade)) / 7, 3) END AS warming_rate,
  CASE WHEN count(*) >= 2 THEN printf('%s%.2f°C over %d years (%.3f°C/year)', CASE WHEN temperature_change > 0 THEN '+' ELSE '' END, temperature_change, 7, warming_rate) ELSE 'N/A' END AS warming_trend
FROM decades GROUP BY 1"""),
    ),
    Check(
        "completeness", lambda s, d: stats.completeness(buckets(s, d)), "location_id:i variable:s points:i expected:i completeness:d rating:s",
        with_sql(BUCKETS_SQL, body="""
SELECT location_id, variable, count(value) AS points, count(*) AS expected, 100.0 * count(value) / count(*) AS completeness,
  CASE WHEN 100.0 * count(value) / count(*) > 95 THEN 'EXCELLENT' WHEN 100.0 * count(value) / count(*) > 90 THEN 'GOOD' ELSE 'FAIR' END AS rating
FROM series GROUP BY ALL"""),
    ),
    Check(
        "range_statistics", lambda s, d: stats.range_statistics(monthly(s, d)),
        "location_id:i variable:s min:d max:d mean:d median:d std_deviation:d total:d data_points:i",
        with_sql(MONTHLY_SQL, body="""
SELECT location_id, variable, round_even(min(value), 2) AS min, round_even(max(value), 2) AS max, round_even(avg(value), 2) AS mean,
  round_even(median(value), 2) AS median, round_even(stddev_pop(value), 2) AS std_deviation,
  CASE WHEN variable = 'precipitation' THEN round_even(sum(value), 2) END AS total, count(value) AS data_points FROM series GROUP BY location_id, variable"""),
    ),
    Check(
        "uncertainty", _uncertainty,
        "location_id:i variable:s historical_std:d coefficient_of_variation:d trend_uncertainty:d seasonal_uncertainty:d "
        "total_uncertainty:d lower_68:d upper_68:d lower_95:d upper_95:d uncertainty_level:s",
        with_sql(BOOT_SQL(SEASONAL_SQL(4), 100), body="""
, slopes AS (SELECT location_id, b, 12 * regr_slope(value, pos) AS s, any_value(n) AS n FROM draws GROUP BY 1, 2),
tr AS (SELECT location_id, CASE WHEN any_value(n) > 24 THEN stddev_pop(s) ELSE 0 END AS trend_uncertainty FROM slopes GROUP BY 1),
u AS (SELECT location_id, variable, avg(s.value) AS m, stddev_pop(s.value) AS historical_std, stddev_pop(s.value) / avg(s.value) AS coefficient_of_variation,
  any_value(trend_uncertainty) AS trend_uncertainty, stddev_pop(s.value) / sqrt(count(*)) AS seasonal_uncertainty FROM seasonal s JOIN tr USING (location_id) GROUP BY ALL),
w AS (SELECT *, sqrt(historical_std ** 2 + trend_uncertainty ** 2 + seasonal_uncertainty ** 2) AS total_uncertainty FROM u)
SELECT *, m - total_uncertainty AS lower_68, m + total_uncertainty AS upper_68, m - 2 * total_uncertainty AS lower_95, m + 2 * total_uncertainty AS upper_95,
  CASE WHEN total_uncertainty > historical_std THEN 'high' WHEN total_uncertainty > historical_std / 2 THEN 'medium' ELSE 'low' END AS uncertainty_level FROM w"""),
    ),
    Check(
        "bootstrap_trend", lambda s, d: resample.bootstrap_trend(buckets(s, d)), "location_id:i variable:s points:i trend_uncertainty:d",
        with_sql(BOOT_SQL(BUCKETS_SQL, 100), body="""
SELECT location_id, variable, any_value(n) AS points, stddev_pop(s) AS trend_uncertainty FROM
 (SELECT location_id, variable, b, any_value(n) AS n, 12 * regr_slope(value, pos) AS s FROM draws GROUP BY 1, 2, 3) GROUP BY ALL"""),
    ),
    Check(
        "seasonal_mean_forecast", lambda s, d: forecast.seasonal_mean_forecast(monthly(s, d), 4),
        "location_id:i variable:s prediction:d confidence:d prediction_std:d method:s",
        with_sql(SEASONAL_SQL(4), body="""
SELECT location_id, variable, avg(value) AS prediction, 0.65 AS confidence, stddev_pop(value) AS prediction_std, 'statistical_fallback' AS method
FROM ranked GROUP BY ALL"""),
    ),
    Check(
        "trend_adjusted_forecast", lambda s, d: forecast.trend_adjusted_forecast(monthly(s, d), 4),
        "location_id:i variable:s prediction:d confidence:d prediction_std:d best_model:s",
        with_sql(SEASONAL_SQL(4), body="""
SELECT location_id, variable, CASE WHEN count(*) > 3 THEN arg_max(value, k) + regr_slope(value, k) ELSE avg(value) END AS prediction,
  0.6 AS confidence, stddev_pop(value) AS prediction_std, 'statistical' AS best_model FROM ranked GROUP BY ALL"""),
    ),
    Check(
        "error_metrics", _metrics, "location_id:i variable:s mae:d rmse:d mape:d r_squared:d skill:d accuracy:d",
        with_sql(MODELS_SQL, body="""
, e AS (SELECT location_id, variable, avg(abs(seasonal - actual)) AS mae, sqrt(avg((seasonal - actual) ** 2)) AS rmse,
  100 * avg(abs((seasonal - actual) / actual)) AS mape, 1 - sum((seasonal - actual) ** 2) / (var_pop(actual) * count(*)) AS r_squared, stddev_pop(actual) AS sd
  FROM held GROUP BY ALL)
SELECT *, greatest(0, 1 - rmse / sd) AS skill, greatest(0, (1 - mae / sd) * 100) AS accuracy FROM e"""),
    ),
    Check(
        "skill_score", _skill, "location_id:i variable:s model_mae:d baseline_mae:d r_squared:d skill:d accuracy:d confidence:d",
        with_sql(MODELS_SQL, body="""
, e AS (SELECT location_id, variable, avg(abs(seasonal - actual)) AS model_mae, avg(abs(baseline - actual)) AS baseline_mae,
  1 - sum((seasonal - actual) ** 2) / (var_pop(actual) * count(*)) AS r_squared FROM held GROUP BY ALL)
SELECT *, (baseline_mae - model_mae) / baseline_mae AS skill, greatest(20, least(98, 100 * (baseline_mae - model_mae) / baseline_mae)) AS accuracy,
  greatest(0.5, least(0.98, r_squared)) AS confidence FROM e"""),
    ),
    Check(
        "weighted_ensemble", _ensemble, "location_id:i variable:s ensemble_prediction:d prediction_std:d best_model:s models:i",
        with_sql(MEMBERS_SQL, body="SELECT * FROM ens"),
    ),
    Check(
        "agreement_confidence", _agreement, "location_id:i variable:s confidence:d confidence_spatial:d",
        with_sql(MEMBERS_SQL, body="""
SELECT location_id, variable, greatest(0.5, 1 - prediction_std / abs(ensemble_prediction)) AS confidence,
  greatest(0.4, 1 - 10 * prediction_std / abs(ensemble_prediction)) AS confidence_spatial FROM ens"""),
    ),
    Check(
        "temperature_indicators", lambda s, d: stats.temperature_indicators(buckets(s, d)),
        "location_id:i variable:s warming_rate_per_decade:d recent_hot_percent:d recent_cold_percent:d variability_change:d",
        with_sql(BUCKETS_SQL, body="""
, q AS (SELECT location_id, quantile_cont(value, 0.1) AS a, quantile_cont(value, 0.9) AS b FROM series GROUP BY 1),
w AS (SELECT location_id, 10 * regr_slope(v, y) AS warming_rate_per_decade FROM (SELECT location_id, t // 12 AS y, avg(value) AS v FROM series GROUP BY ALL) GROUP BY 1)
SELECT location_id, variable, any_value(warming_rate_per_decade) AS warming_rate_per_decade,
  100.0 * count(*) FILTER (WHERE t >= 240 AND value > b) / count(value) FILTER (WHERE t >= 240) AS recent_hot_percent,
  100.0 * count(*) FILTER (WHERE t >= 240 AND value < a) / count(value) FILTER (WHERE t >= 240) AS recent_cold_percent,
  stddev_pop(value) FILTER (WHERE t >= 240) - stddev_pop(value) FILTER (WHERE t < 240) AS variability_change
FROM series JOIN q USING (location_id) JOIN w USING (location_id) GROUP BY ALL"""),
    ),
    Check(
        "precipitation_indicators", lambda s, d: stats.precipitation_indicators(buckets(s, d)),
        "location_id:i variable:s intense_precipitation_change:d precipitation_variability_change:d dry_spell_frequency:d",
        with_sql(BUCKETS_SQL, body="""
, q AS (SELECT location_id, coalesce(quantile_cont(value, 0.75) FILTER (WHERE value > 0), 1) AS wet, quantile_cont(value, 0.25) AS dry FROM series GROUP BY 1),
f AS (SELECT s.*, wet, coalesce(value < dry, false) AS is_dry FROM series s JOIN q USING (location_id)),
d AS (SELECT location_id, count(*) FILTER (WHERE is_dry AND NOT was) / 10 AS dry_spell_frequency FROM
  (SELECT location_id, is_dry, coalesce(lag(is_dry) OVER (PARTITION BY location_id ORDER BY t), false) AS was FROM f WHERE t >= 240) GROUP BY 1)
SELECT location_id, variable, 100.0 * count(*) FILTER (WHERE t >= 240 AND value > wet) / count(value) FILTER (WHERE t >= 240)
  - 100.0 * count(*) FILTER (WHERE t < 240 AND value > wet) / count(value) FILTER (WHERE t < 240) AS intense_precipitation_change,
  stddev_pop(value) FILTER (WHERE t >= 240) - stddev_pop(value) FILTER (WHERE t < 240) AS precipitation_variability_change,
  any_value(dry_spell_frequency) AS dry_spell_frequency FROM f JOIN d USING (location_id) GROUP BY ALL"""),
    ),
    Check(
        "general_indicators", lambda s, d: stats.general_indicators(buckets(s, d)), "location_id:i variable:s variability_change:d extreme_frequency_change:d",
        with_sql(BUCKETS_SQL, body="""
, q AS (SELECT location_id, quantile_cont(value, 0.95) AS hi FROM series GROUP BY 1)
SELECT location_id, variable, stddev_pop(value) FILTER (WHERE t >= 240) - stddev_pop(value) FILTER (WHERE t < 240) AS variability_change,
  1.0 * count(*) FILTER (WHERE t >= 240 AND value > hi) / count(value) FILTER (WHERE t >= 240)
  - 1.0 * count(*) FILTER (WHERE t < 240 AND value > hi) / count(value) FILTER (WHERE t < 240) AS extreme_frequency_change
FROM series JOIN q USING (location_id) GROUP BY ALL"""),
    ),
    Check(
        "recency_weighted_mean", lambda s, d: stats.recency_weighted_mean(rolling.seasonal_adjusted_subset(monthly(s, d), 4, adjust=False)),
        "location_id:i variable:s weighted_mean:d",
        with_sql(SEASONAL_SQL(4), body="""
SELECT location_id, variable, sum(w * value) / sum(w) AS weighted_mean FROM (SELECT *, exp(-1 + coalesce(k / nullif(c - 1, 0), 0)) AS w FROM ranked) GROUP BY ALL"""),
    ),
]

"""Checks for trend tests, change points and window functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.aggregates import SEASONAL_SQL
from checks.data import (
    BUCKETS_SQL,
    MONTHLY_SQL,
    SHIP_SQL,
    buckets,
    lat_sql,
    monthly,
    placed,
    ship,
    with_sql,
)
from checks.mathsql import (
    P_VALUE,
    R2,
    SLOPE,
    STD_ERROR,
    line,
    normal_two_sided,
    season,
    strength,
    t_two_sided,
    zone,
)
from checks.spec import Check
from isohyet.operators import changepoints as cp
from isohyet.operators import events, fill, rolling, trends
from isohyet.series import KEY

UP = "CASE WHEN {0} > 0 THEN 'increasing' ELSE 'decreasing' END"

# Gram polynomials on u = t - (n - 1) / 2: an independent route for complete series
POLY_SQL = f"""
{SHIP_SQL.strip()},
g AS (
  SELECT location_id, variable, t, value, value - avg(value) OVER (PARTITION BY location_id) AS c, 83 AS n, t - 41.0 AS u FROM series
),
p AS (SELECT *, u AS p1, u * u - (n * n - 1) / 12.0 AS p2, u * u * u - u * (3 * n * n - 7) / 20.0 AS p3 FROM g),
b AS (
  SELECT location_id, variable, count(*) AS n, avg(value) AS b0, sum(p1 * c) / sum(p1 * p1) AS b1, sum(p2 * c) / sum(p2 * p2) AS b2,
    sum(p3 * c) / sum(p3 * p3) AS b3, sum(p1 * p1) AS q1, sum(p2 * p2) AS q2, sum(p3 * p3) AS q3, sum(c * c) AS tss,
    (83 * 83 - 1) / 12.0 AS k2, (3 * 83 * 83 - 7) / 20.0 AS k3, 41.0 AS m
  FROM p GROUP BY 1, 2
),
fits AS (
  SELECT location_id, variable, n, tss, d AS degree, m,
    b0 - CASE WHEN d >= 2 THEN b2 * k2 ELSE 0 END AS e0,
    b1 - CASE WHEN d >= 3 THEN b3 * k3 ELSE 0 END AS e1,
    CASE WHEN d >= 2 THEN b2 ELSE 0 END AS e2, CASE WHEN d >= 3 THEN b3 ELSE 0 END AS e3,
    tss - b1 * b1 * q1 - CASE WHEN d >= 2 THEN b2 * b2 * q2 ELSE 0 END - CASE WHEN d >= 3 THEN b3 * b3 * q3 ELSE 0 END AS rss
  FROM b CROSS JOIN range(1, 4) r(d)
),
poly AS (
  SELECT location_id, variable, degree, e0 - e1 * m + e2 * m ** 2 - e3 * m ** 3 AS c0, e1 - 2 * e2 * m + 3 * e3 * m ** 2 AS c1,
    e2 - 3 * e3 * m AS c2, e3 AS c3, 1 - rss / tss AS r_squared, n * ln(rss / n) + 2 * (degree + 1) AS aic, n
  FROM fits
)"""

# monic orthogonal polynomials of the series' own periods by the three-term recurrence, gaps or not
RECURRENCE_SQL = lambda base: f"""
{base.strip()},
r0 AS (SELECT location_id, variable, CAST(t AS DOUBLE) AS t, value - avg(value) OVER g AS c, t - avg(t) OVER g AS p1 FROM series WHERE value IS NOT NULL WINDOW g AS (PARTITION BY location_id)),
r1 AS (SELECT *, (t - sum(t * p1 * p1) OVER g / sum(p1 * p1) OVER g) * p1 - sum(p1 * p1) OVER g / count(*) OVER g AS p2 FROM r0 WINDOW g AS (PARTITION BY location_id)),
r2 AS (SELECT *, (t - sum(t * p2 * p2) OVER g / sum(p2 * p2) OVER g) * p2 - sum(p2 * p2) OVER g / sum(p1 * p1) OVER g * p1 AS p3 FROM r1 WINDOW g AS (PARTITION BY location_id)),
r3 AS (SELECT location_id, variable, count(*) AS n, sum(c * c) AS tss, sum(c * p2) / sum(p2 * p2) AS square, sum(c * p1) ** 2 / sum(p1 * p1) AS g1,
  sum(c * p2) ** 2 / sum(p2 * p2) AS g2, sum(c * p3) ** 2 / sum(p3 * p3) AS g3 FROM r2 GROUP BY 1, 2),
degrees AS (SELECT *, d AS degree, tss - g1 - CASE WHEN d >= 2 THEN g2 ELSE 0 END - CASE WHEN d >= 3 THEN g3 ELSE 0 END AS rss FROM r3 CROSS JOIN range(1, 4) r(d)),
poly AS (SELECT location_id, variable, degree, square, n, 1 - rss / tss AS r_squared, n * ln(rss / n) + 2 * (degree + 1) AS aic FROM degrees)"""

PAIRS_SQL = lambda base: f"""
{base.strip()},
v AS (SELECT * FROM series WHERE value IS NOT NULL),
pairs AS (
  SELECT a.location_id, a.variable, sum(sign(b.value - a.value)) AS s, median((b.value - a.value) / (b.t - a.t)) AS sen_slope
  FROM v a JOIN v b ON a.location_id = b.location_id AND a.t < b.t GROUP BY 1, 2
),
ties AS (
  SELECT location_id, sum(c) AS n, sum(CAST(c AS DOUBLE) * (c - 1) * (2 * c + 5)) AS tied
  FROM (SELECT location_id, value, count(*) AS c FROM v GROUP BY 1, 2) GROUP BY 1
),
mk AS (
  SELECT p.location_id, p.variable, n AS points, s, sen_slope, (s - sign(s)) / sqrt((CAST(n AS DOUBLE) * (n - 1) * (2 * n + 5) - tied) / 18) AS z,
    s / (n * (n - 1) / 2) AS tau
  FROM pairs p JOIN ties USING (location_id)
),
mann_kendall AS (
  SELECT *, z AS z_statistic, abs(z) > 1.959963984540054 AS is_significant, {normal_two_sided('z')} AS p_value,
    CASE WHEN z > 1.959963984540054 THEN 'increasing' WHEN z < -1.959963984540054 THEN 'decreasing' ELSE 'no trend' END AS trend_direction,
    CASE WHEN {normal_two_sided('z')} < 0.01 THEN 'high' WHEN {normal_two_sided('z')} < 0.05 THEN 'medium' ELSE 'low' END AS confidence
  FROM mk
)"""

LINEAR_SQL = lambda base: f"""
{base.strip()},
fits AS (SELECT location_id, variable, {line('value', 't')}, stddev_pop(value) AS std, count(*) AS periods FROM series GROUP BY 1, 2),
linear AS (
  SELECT location_id, variable, cnt AS points, {SLOPE} * 12 AS slope_per_year, {R2} AS r_squared, {P_VALUE} AS p_value,
    {STD_ERROR} AS standard_error, {strength(f'({SLOPE} * 12)', 'std')} AS trend_strength, mx, my, {SLOPE} AS slope, std, periods FROM fits
)"""

# positions over valid rows, for the scans
POS_SQL = lambda base: f"""
{base.strip()},
pos AS (
  SELECT location_id, variable, t, value, row_number() OVER (PARTITION BY location_id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY location_id) AS n
  FROM series WHERE value IS NOT NULL
)"""

# both windows around every scan point, recomputed from the raw rows
SCAN_SQL = lambda base, width: f"""
{POS_SQL(base).strip()},
scan AS (
  SELECT x.location_id, x.variable, x.t, x.i, {width} AS w, x.n FROM pos x WHERE x.i >= {width} AND x.i < x.n - {width}
),
win AS (
  SELECT s.location_id, s.variable, s.t, s.i, any_value(s.w) AS w,
    avg(p.value) FILTER (WHERE p.i < s.i) AS mb, avg(p.value) FILTER (WHERE p.i >= s.i) AS ma,
    var_pop(p.value) FILTER (WHERE p.i < s.i) AS vb, var_pop(p.value) FILTER (WHERE p.i >= s.i) AS va,
    regr_sxx(p.value, p.i) FILTER (WHERE p.i < s.i) AS xxb, regr_syy(p.value, p.i) FILTER (WHERE p.i < s.i) AS yyb, regr_sxy(p.value, p.i) FILTER (WHERE p.i < s.i) AS xyb,
    regr_sxx(p.value, p.i) FILTER (WHERE p.i >= s.i) AS xxa, regr_syy(p.value, p.i) FILTER (WHERE p.i >= s.i) AS yya, regr_sxy(p.value, p.i) FILTER (WHERE p.i >= s.i) AS xya
  FROM scan s JOIN pos p ON p.location_id = s.location_id AND p.i >= s.i - s.w AND p.i < s.i + s.w
  GROUP BY 1, 2, 3, 4
)"""


def _p_of(xx: str, yy: str, xy: str) -> str:
    r2 = f"({xy} * {xy} / ({xx} * {yy}))"
    return t_two_sided(f"(sqrt({r2}) * sqrt((w - 2) / ((1 - sqrt({r2}) + 1e-20) * (1 + sqrt({r2}) + 1e-20))))", "(w - 2)")


SHIFT_T = "(abs(ma - mb) / sqrt((va + vb) / (w - 1)))"

CUSUM_SQL = lambda base, factor: with_sql(base, body=f"""
, c AS (SELECT location_id, variable, t, value, value - avg(value) OVER (PARTITION BY location_id) AS d FROM series WHERE value IS NOT NULL),
s AS (SELECT *, abs(sum(d) OVER (PARTITION BY location_id ORDER BY t)) AS x FROM c),
a AS (SELECT location_id, variable, max(x) AS change_magnitude, arg_max(t, x) AS spot, {factor} * stddev_pop(value) * sqrt(count(*)) AS significance_threshold FROM s GROUP BY 1, 2)
SELECT *, change_magnitude > significance_threshold AS change_point_detected, CASE WHEN change_magnitude > significance_threshold THEN spot END AS change_point_index,
  CASE WHEN change_magnitude > 1.5 * significance_threshold THEN 'high' WHEN change_magnitude > significance_threshold THEN 'medium' ELSE 'low' END AS confidence FROM a""")

CHOW_SQL = lambda base: f"""
{POS_SQL(base).strip()},
bp AS (SELECT DISTINCT location_id, variable, n, b FROM pos, range(24, 400, 6) r(b) WHERE b < n - 24 AND n >= 60),
seg AS (
  SELECT bp.location_id, bp.variable, bp.b, bp.n,
    regr_syy(value, i) FILTER (WHERE i < b) - regr_sxy(value, i) FILTER (WHERE i < b) ** 2 / regr_sxx(value, i) FILTER (WHERE i < b) AS r1,
    regr_syy(value, i) FILTER (WHERE i >= b) - regr_sxy(value, i) FILTER (WHERE i >= b) ** 2 / regr_sxx(value, i) FILTER (WHERE i >= b) AS r2,
    regr_slope(value, i) FILTER (WHERE i < b) AS slope_before, regr_slope(value, i) FILTER (WHERE i >= b) AS slope_after, regr_syy(value, i) AS tss
  FROM bp JOIN pos USING (location_id, variable) GROUP BY 1, 2, 3, 4
),
chow AS (
  SELECT *, b AS break_point, ((tss - r1 - r2) / 2) / ((r1 + r2) / (n - 4)) AS f_statistic,
    CASE WHEN tss > r1 + r2 THEN pow(1 + (tss - r1 - r2) / (r1 + r2), -(n - 4) / 2.0) ELSE 1 END AS p_value FROM seg
)"""


def _extremes(spark, sf):
    rows = events.attach_zone_limits(placed(buckets(spark, sf)))
    return trends.extremes_trend(rows, F.col("hot"), F.col("cold"))


ZONED_SQL = lambda base: f"""
{base.strip()},
zoned AS (
  SELECT s.*, z.* FROM (SELECT *, {zone(lat_sql('location_id'))} AS zone FROM series) s JOIN (VALUES
    ('equatorial',32.0,22.0,200.0,50.0,1.5,1.0,3.0,20.0,80.0),('tropical',35.0,18.0,150.0,20.0,1.8,2.0,5.0,30.0,120.0),
    ('subtropical',38.0,5.0,100.0,10.0,2.0,3.0,8.0,15.0,60.0),('temperate',30.0,-5.0,80.0,15.0,2.2,5.0,12.0,10.0,40.0),
    ('polar',15.0,-20.0,50.0,5.0,2.5,8.0,20.0,5.0,25.0)) z(z, hot, cold, wet, dry, mult, tl, th, pl, ph) ON z.z = s.zone
)"""

RUNS_SQL = lambda name, condition, minimum: f"""
{name} AS (
  SELECT location_id, count(*) AS c FROM (
    SELECT location_id, t - row_number() OVER (PARTITION BY location_id ORDER BY t) AS isl FROM zoned WHERE {condition} ) q
  GROUP BY location_id, isl HAVING count(*) >= {minimum}
)"""


def _runs_total(name: str) -> str:
    return f"(SELECT count(*) FROM {name} r WHERE r.location_id = a.location_id)"


EXTREMES_SQL = f"""
hotfit AS (SELECT location_id, variable, {line('CASE WHEN value > hot THEN 1.0 WHEN value <= hot THEN 0.0 END', 't')} FROM zoned GROUP BY 1, 2),
coldfit AS (SELECT location_id, variable, {line('CASE WHEN value < cold THEN 1.0 WHEN value >= cold THEN 0.0 END', 't')} FROM zoned GROUP BY 1, 2),
ext AS (
  SELECT h.location_id, h.variable, hot_slope_per_year, hot_r_squared, hot_p_value, coalesce(hot_p_value < 0.05, false) AS hot_significant,
    CASE WHEN hot_slope_per_year > 0 THEN 'increasing' ELSE 'decreasing' END AS hot_direction,
    cold_slope_per_year, cold_r_squared, cold_p_value, coalesce(cold_p_value < 0.05, false) AS cold_significant,
    CASE WHEN cold_slope_per_year > 0 THEN 'increasing' ELSE 'decreasing' END AS cold_direction
  FROM (SELECT location_id, variable, {SLOPE} * 12 AS hot_slope_per_year, {R2} AS hot_r_squared, {P_VALUE} AS hot_p_value FROM hotfit) h
  JOIN (SELECT location_id, {SLOPE} * 12 AS cold_slope_per_year, {R2} AS cold_r_squared, {P_VALUE} AS cold_p_value FROM coldfit) k USING (location_id)
)"""
EXT_COLS = (
    "hot_slope_per_year:d hot_r_squared:d hot_p_value:d hot_significant:b hot_direction:s "
    "cold_slope_per_year:d cold_r_squared:d cold_p_value:d cold_significant:b cold_direction:s"
)

SEASONS_SQL = lambda base, years: f"""
{base.strip()},
sm AS (
  SELECT location_id, variable, {season('(t % 12 + 1)')} AS season, t // 12 AS y, avg(value) AS m
  FROM series WHERE t < {years} * 12 GROUP BY ALL
),
sf AS (SELECT location_id, variable, season, {line('m', 'y')}, stddev_pop(m) AS std FROM sm GROUP BY 1, 2, 3),
seasons AS (
  SELECT location_id, variable, season, cnt AS years, {SLOPE} AS slope_per_year, {R2} AS r_squared, {P_VALUE} AS p_value,
    coalesce({P_VALUE} < 0.05, false) AS is_significant, {strength(SLOPE, 'std')} AS trend_strength FROM sf
)"""

CHECKS = [
    Check(
        "linear_trend", lambda s, d: trends.linear_trend(monthly(s, d)),
        "location_id:i variable:s points:i slope_per_year:d r_squared:d p_value:d standard_error:d trend_strength:s",
        with_sql(LINEAR_SQL(MONTHLY_SQL), body="SELECT * FROM linear"),
    ),
    Check(
        "poly_trend", lambda s, d: trends.poly_trend(ship(s, d)),
        "location_id:i variable:s degree:i c0:d c1:d c2:d c3:d r_squared:d trend_direction:s aic:d",
        with_sql(POLY_SQL, body="""
SELECT *, CASE degree WHEN 1 THEN CASE WHEN c1 > 0 THEN 'increasing' ELSE 'decreasing' END
  WHEN 2 THEN CASE WHEN c2 > 0 THEN 'accelerating' ELSE 'decelerating' END ELSE 'complex' END AS trend_direction FROM poly"""),
    ),
    Check(
        "best_polynomial", lambda s, d: trends.best_polynomial(trends.poly_trend(ship(s, d))),
        "location_id:i variable:s best_degree:i best_r_squared:d best_aic:d",
        with_sql(POLY_SQL, body="""
SELECT location_id, variable, degree AS best_degree, r_squared AS best_r_squared, aic AS best_aic FROM poly
QUALIFY row_number() OVER (PARTITION BY location_id ORDER BY aic, degree) = 1"""),
    ),
    Check(
        "quadratic_label", lambda s, d: trends.quadratic_label(ship(s, d)), "location_id:i variable:s trend_type:s acceleration:d curvature_significant:b",
        with_sql(POLY_SQL, body="""
SELECT location_id, variable, CASE WHEN n <= 36 THEN 'insufficient_data' WHEN c2 > 0 THEN 'accelerating' WHEN c2 < 0 THEN 'decelerating' ELSE 'linear' END AS trend_type,
  c2 AS acceleration, abs(c2) > 0.001 AS curvature_significant FROM poly WHERE degree = 2"""),
    ),
    Check(
        "mann_kendall", lambda s, d: trends.mann_kendall(buckets(s, d)),
        "location_id:i variable:s points:i s:i trend_direction:s is_significant:b p_value:d z_statistic:d tau:d confidence:s sen_slope:d",
        with_sql(PAIRS_SQL(BUCKETS_SQL), body="SELECT * FROM mann_kendall"),
    ),
    Check(
        "kendall_ties", lambda s, d: trends.kendall_score(monthly(s, d).withColumn("value", F.round("value", 0))), "location_id:i variable:s points:i s:i var_s:d",
        with_sql(PAIRS_SQL(MONTHLY_SQL).replace("v AS (SELECT * FROM series", "v AS (SELECT location_id, variable, t, round(value, 0) AS value FROM series"), body="""
SELECT p.location_id, variable, n AS points, s, (CAST(n AS DOUBLE) * (n - 1) * (2 * n + 5) - tied) / 18 AS var_s FROM pairs p JOIN ties USING (location_id)"""),
    ),
    Check("extremes_trend", _extremes, "location_id:i variable:s " + EXT_COLS, with_sql(ZONED_SQL(BUCKETS_SQL), "," + EXTREMES_SQL, body="SELECT * FROM ext").replace(",\n,", ",\n")),
    Check(
        "seasonal_trends", lambda s, d: trends.seasonal_trends(buckets(s, d)),
        "location_id:i variable:s season:s years:i slope_per_year:d r_squared:d p_value:d is_significant:b trend_strength:s",
        with_sql(SEASONS_SQL(BUCKETS_SQL, 30), body="SELECT * FROM seasons WHERE years >= 5"),
    ),
    Check(
        "decadal_comparison", lambda s, d: trends.decadal_comparison(buckets(s, d)),
        "location_id:i variable:s recent_mean:d historical_mean:d difference:d percent_change:d p_value:d is_significantly_different:b",
        with_sql(BUCKETS_SQL, body=f"""
, a AS (SELECT location_id, variable, avg(value) FILTER (WHERE t >= 240) AS m1, avg(value) FILTER (WHERE t < 240) AS m2, count(value) FILTER (WHERE t >= 240) AS n1,
  count(value) FILTER (WHERE t < 240) AS n2, var_samp(value) FILTER (WHERE t >= 240) AS v1, var_samp(value) FILTER (WHERE t < 240) AS v2 FROM series GROUP BY 1, 2),
x AS (SELECT *, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS tt, n1 + n2 - 2 AS dof FROM a),
y AS (SELECT *, {t_two_sided('tt', 'dof')} AS p_value FROM x)
SELECT location_id, variable, m1 AS recent_mean, m2 AS historical_mean, m1 - m2 AS difference, (m1 - m2) / m2 * 100 AS percent_change, p_value, p_value < 0.05 AS is_significantly_different FROM y"""),
    ),
    Check(
        "project_linear", lambda s, d: trends.project_linear(monthly(s, d)), "location_id:i variable:s projected_change:d projected_mean:d uncertainty_range:d",
        with_sql(LINEAR_SQL(MONTHLY_SQL), body="""
SELECT location_id, variable, slope * 120 AS projected_change, (SELECT avg(my + slope * (80 + h - mx)) FROM range(120) r(h)) AS projected_mean, 2 * std AS uncertainty_range FROM linear"""),
    ),
    Check(
        "validate_trend", lambda s, d: trends.validate_trend(monthly(s, d)), "location_id:i variable:s mae:d rmse:d mape:d trend_direction_accuracy:b skill:d",
        with_sql(MONTHLY_SQL, body="""
, tr AS (SELECT location_id, regr_slope(value, t) AS b, regr_intercept(value, t) AS a FROM series WHERE t < 56 GROUP BY 1),
e AS (SELECT s.location_id, variable, avg(abs(a + b * t - value)) AS mae, sqrt(avg((a + b * t - value) ** 2)) AS rmse, 100 * avg(abs((a + b * t - value) / value)) AS mape,
  (regr_slope(value, t) > 0) = (any_value(b) > 0) AS trend_direction_accuracy, stddev_pop(value) AS sd FROM series s JOIN tr USING (location_id) WHERE t >= 56 AND value IS NOT NULL GROUP BY 1, 2)
SELECT *, greatest(0, 1 - rmse / sd) AS skill FROM e"""),
    ),
    Check(
        "validate_trend_last_value", lambda s, d: trends.validate_trend_last_value(buckets(s, d)), "location_id:i variable:s mae:d rmse:d accuracy_score:d",
        with_sql(BUCKETS_SQL, body="""
, tr AS (SELECT location_id, regr_slope(value, t) AS b, arg_max(value, t) FILTER (WHERE value IS NOT NULL) AS a FROM series WHERE t < 300 GROUP BY 1),
e AS (SELECT s.location_id, variable, avg(abs(a + b * (t - 299) - value)) AS mae, sqrt(avg((a + b * (t - 299) - value) ** 2)) AS rmse, stddev_pop(value) AS sd
  FROM series s JOIN tr USING (location_id) WHERE t >= 300 AND value IS NOT NULL GROUP BY 1, 2)
SELECT location_id, variable, mae, rmse, greatest(0, 1 - rmse / sd) AS accuracy_score FROM e"""),
    ),
    # --- change points ---
    Check("cusum", lambda s, d: cp.cusum(monthly(s, d)), "location_id:i variable:s change_point_detected:b change_point_index:i change_magnitude:d significance_threshold:d confidence:s", CUSUM_SQL(MONTHLY_SQL, 2)),
    Check("cusum_strict", lambda s, d: cp.cusum(ship(s, d), 2.5), "location_id:i variable:s change_point_detected:b change_point_index:i change_magnitude:d significance_threshold:d confidence:s", CUSUM_SQL(SHIP_SQL, 2.5)),
    Check(
        "rolling_zscore_change", lambda s, d: cp.rolling_zscore_change(monthly(s, d)), "location_id:i variable:s change_point_detected:b change_point_index:i max_zscore:d window_size:i",
        with_sql(POS_SQL(MONTHLY_SQL), body="""
, w AS (SELECT *, least(24, n // 4) AS w FROM pos),
z AS (SELECT a.location_id, a.variable, a.t, any_value(a.w) AS w, abs(any_value(a.value) - avg(b.value)) / stddev_samp(b.value) AS z FROM w a JOIN pos b ON a.location_id = b.location_id
  AND b.i >= a.i - a.w // 2 AND b.i <= a.i + (a.w - 1) // 2 WHERE a.w >= 12 GROUP BY 1, 2, 3 HAVING count(*) = any_value(a.w)),
best AS (SELECT location_id, max(z) AS max_zscore, arg_max(t, z) AS change_point_index FROM z WHERE z > 2.5 GROUP BY 1),
k AS (SELECT location_id, variable, any_value(w) AS window_size FROM w GROUP BY 1, 2)
SELECT k.*, change_point_index, max_zscore, change_point_index IS NOT NULL AS change_point_detected FROM k LEFT JOIN best USING (location_id)"""),
    ),
    Check(
        "variance_halves", lambda s, d: cp.variance_halves(monthly(s, d)),
        "location_id:i variable:s first_half_variance:d second_half_variance:d variance_ratio:d variance_change_detected:b change_type:s",
        with_sql(POS_SQL(MONTHLY_SQL), body="""
, h AS (SELECT location_id, variable, var_pop(value) FILTER (WHERE i < n // 2) AS a, var_pop(value) FILTER (WHERE i >= n // 2) AS b FROM pos GROUP BY 1, 2)
SELECT location_id, variable, a AS first_half_variance, b AS second_half_variance, a / b AS variance_ratio, abs(a / b - 1) > 0.5 AS variance_change_detected,
  CASE WHEN a < b THEN 'increased_volatility' WHEN a > b THEN 'decreased_volatility' ELSE 'stable' END AS change_type FROM h"""),
    ),
    Check(
        "variance_scan", lambda s, d: cp.variance_scan(monthly(s, d)), "location_id:i variable:s change_detected:b change_index:i variance_ratio:d change_type:s",
        with_sql(SCAN_SQL(MONTHLY_SQL, "greatest(24, x.n // 4)"), body="""
, r AS (SELECT location_id, variable, t, va / vb AS r, abs(ln(va / vb)) AS l FROM win),
b AS (SELECT location_id, variable, arg_max(r, l) AS variance_ratio, arg_max(t, l) AS spot, max(l) AS l FROM r GROUP BY 1, 2)
SELECT location_id, variable, l > 0.5 AS change_detected, CASE WHEN l > 0.5 THEN spot END AS change_index, variance_ratio,
  CASE WHEN variance_ratio > 1.5 THEN 'increased_volatility' WHEN variance_ratio < 0.67 THEN 'decreased_volatility' ELSE 'stable_volatility' END AS change_type FROM b"""),
    ),
    Check(
        "mean_shift_scan", lambda s, d: cp.mean_shift_scan(buckets(s, d)), "location_id:i variable:s shift_detected:b shift_index:i shift_magnitude:d p_value:d shift_direction:s",
        with_sql(SCAN_SQL(BUCKETS_SQL, "greatest(24, x.n // 4)"), body=f"""
, p AS (SELECT location_id, t, ma - mb AS d, {t_two_sided(SHIFT_T, '(2 * w - 2)')} AS p FROM win),
b AS (SELECT location_id, arg_max(t, abs(d)) AS shift_index, arg_max(d, abs(d)) AS shift_magnitude, arg_max(p, abs(d)) AS p_value FROM p WHERE p < 0.05 GROUP BY 1),
k AS (SELECT DISTINCT location_id, variable FROM series)
SELECT k.*, shift_index IS NOT NULL AS shift_detected, shift_index, shift_magnitude, p_value,
  CASE WHEN shift_magnitude > 0 THEN 'upward' WHEN shift_magnitude IS NOT NULL THEN 'downward' END AS shift_direction FROM k LEFT JOIN b USING (location_id)"""),
    ),
    Check(
        "trend_change_scan", lambda s, d: cp.trend_change_scan(buckets(s, d).withColumn("value", F.col("value") + F.sin(F.col("t") / 40.0) * 40)),
        "location_id:i variable:s trend_change_detected:b change_index:i slope_before:d slope_after:d slope_difference:d change_description:s",
        with_sql(SCAN_SQL(BUCKETS_SQL.replace("SELECT k.location_id, k.variable, k.t, c.value", "SELECT k.location_id, k.variable, k.t, c.value + sin(k.t / 40.0) * 40 AS value"), "greatest(36, x.n // 3)"), body=f"""
, p AS (SELECT location_id, t, xyb / xxb AS sb, xya / xxa AS sa, {_p_of('xxb', 'yyb', 'xyb')} AS pb, {_p_of('xxa', 'yya', 'xya')} AS pa FROM win),
b AS (SELECT location_id, arg_max(t, abs(sa - sb)) AS change_index, arg_max(sb, abs(sa - sb)) AS slope_before, arg_max(sa, abs(sa - sb)) AS slope_after
  FROM p WHERE pb < 0.1 AND pa < 0.1 AND abs(sa - sb) > 0.01 GROUP BY 1),
k AS (SELECT DISTINCT location_id, variable FROM series)
SELECT k.*, change_index IS NOT NULL AS trend_change_detected, change_index, slope_before, slope_after, abs(slope_after - slope_before) AS slope_difference,
  CASE WHEN slope_before > 0 AND slope_after > 0 THEN CASE WHEN slope_after > slope_before THEN 'accelerating_positive_trend' ELSE 'decelerating_positive_trend' END
    WHEN slope_before < 0 AND slope_after < 0 THEN CASE WHEN slope_after < slope_before THEN 'accelerating_negative_trend' ELSE 'decelerating_negative_trend' END
    WHEN slope_before > 0 AND slope_after < 0 THEN 'trend_reversal_positive_to_negative' WHEN slope_before < 0 AND slope_after > 0 THEN 'trend_reversal_negative_to_positive'
    WHEN slope_before IS NOT NULL THEN 'trend_stabilization' END AS change_description FROM k LEFT JOIN b USING (location_id)"""),
    ),
    Check(
        "chow_tests", lambda s, d: cp.chow_tests(buckets(s, d)), "location_id:i variable:s break_point:i f_statistic:d p_value:d slope_before:d slope_after:d significant:b",
        with_sql(CHOW_SQL(BUCKETS_SQL), body="SELECT *, p_value < 0.05 AS significant FROM chow"),
    ),
    Check(
        "chow_scan", lambda s, d: cp.chow_scan(ship(s, d)),
        "location_id:i variable:s structural_break_detected:b total_breaks_tested:i significant_breaks:i break_point:i f_statistic:d p_value:d slope_before:d slope_after:d",
        with_sql(CHOW_SQL(SHIP_SQL), body="""
, a AS (SELECT location_id, variable, count(*) AS total_breaks_tested, count(*) FILTER (WHERE p_value < 0.05) AS significant_breaks, max(f_statistic) AS f FROM chow GROUP BY 1, 2)
SELECT a.location_id, a.variable, significant_breaks > 0 AS structural_break_detected, total_breaks_tested, significant_breaks, c.break_point, c.f_statistic, c.p_value, c.slope_before, c.slope_after
FROM a LEFT JOIN chow c ON c.location_id = a.location_id AND c.f_statistic = a.f AND significant_breaks > 0"""),
    ),
    # --- zones and runs ---
    Check(
        "consecutive_events", lambda s, d: events.consecutive_events(monthly(s, d), F.lit(26.0), 2), "location_id:i variable:s start_t:i end_t:i duration:i intensity:d peak:d",
        with_sql(MONTHLY_SQL, body="""
SELECT location_id, variable, min(t) AS start_t, max(t) AS end_t, count(*) AS duration, avg(value) AS intensity, max(value) AS peak FROM (
  SELECT *, t - row_number() OVER (PARTITION BY location_id ORDER BY t) AS isl FROM series WHERE value > 26) GROUP BY location_id, variable, isl HAVING count(*) >= 2"""),
    ),
    Check(
        "zone_temperature_indicators", lambda s, d: events.zone_temperature_indicators(placed(buckets(s, d))),
        "location_id:i variable:s zone:s hot_periods:i cold_periods:i heat_waves:i cold_spells:i " + EXT_COLS,
        with_sql(ZONED_SQL(BUCKETS_SQL), "," + EXTREMES_SQL, "," + RUNS_SQL("hw", "value > hot", 3), "," + RUNS_SQL("cs", "value < cold", 3), body=f"""
, a AS (SELECT location_id, variable, any_value(zone) AS zone, count(*) FILTER (WHERE value > hot) AS hot_periods, count(*) FILTER (WHERE value < cold) AS cold_periods FROM zoned GROUP BY 1, 2)
SELECT a.*, {_runs_total('hw')} AS heat_waves, {_runs_total('cs')} AS cold_spells, ext.* EXCLUDE (location_id, variable) FROM a JOIN ext USING (location_id)""").replace(",\n,", ",\n"),
    ),
    Check(
        "zone_precipitation_indicators", lambda s, d: events.zone_precipitation_indicators(placed(buckets(s, d))),
        "location_id:i variable:s zone:s wet_periods:i dry_periods:i variability_index:d droughts:i flood_risk_periods:i",
        with_sql(ZONED_SQL(BUCKETS_SQL), "," + RUNS_SQL("dr", "value < dry", 6), "," + RUNS_SQL("fl", "value > wet", 2), body=f"""
, a AS (SELECT location_id, variable, any_value(zone) AS zone, count(*) FILTER (WHERE value > wet) AS wet_periods, count(*) FILTER (WHERE value < dry) AS dry_periods,
  stddev_pop(value) / avg(value) AS variability_index FROM zoned GROUP BY 1, 2)
SELECT a.*, {_runs_total('dr')} AS droughts, {_runs_total('fl')} AS flood_risk_periods FROM a""").replace(",\n,", ",\n"),
    ),
    Check(
        "zone_context", lambda s, d: events.zone_context(placed(monthly(s, d))), "location_id:i variable:s climate_zone:s expected_low:d expected_high:d anomaly_threshold:d",
        with_sql(ZONED_SQL(MONTHLY_SQL), body="""
SELECT location_id, variable, zone AS climate_zone, CASE variable WHEN 'temperature' THEN any_value(tl) WHEN 'precipitation' THEN any_value(pl) ELSE 0 END AS expected_low,
  CASE variable WHEN 'temperature' THEN any_value(th) WHEN 'precipitation' THEN any_value(ph) ELSE 10 END AS expected_high, stddev_pop(value) * any_value(mult) AS anomaly_threshold
FROM zoned GROUP BY location_id, variable, zone"""),
    ),
    Check(
        "dry_spell_frequency", lambda s, d: events.dry_spell_frequency(buckets(s, d)), "location_id:i variable:s dry_spell_frequency:d",
        with_sql(BUCKETS_SQL, body="""
, q AS (SELECT location_id, quantile_cont(value, 0.25) AS dry FROM series GROUP BY 1),
f AS (SELECT s.location_id, s.variable, t, coalesce(value < dry, false) AS d FROM series s JOIN q USING (location_id) WHERE t >= 240)
SELECT location_id, variable, count(*) FILTER (WHERE d AND NOT was) / 10 AS dry_spell_frequency
FROM (SELECT *, coalesce(lag(d) OVER (PARTITION BY location_id ORDER BY t), false) AS was FROM f) GROUP BY 1, 2"""),
    ),
]

"""Checks for rolling windows, gaps and fills."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.aggregates import SEASONAL_SQL
from checks.data import BUCKETS_SQL, MONTHLY_SQL, SHIP_SQL, buckets, monthly, ship, with_sql
from checks.spec import Check
from isohyet.operators import fill, rolling

LAGS = lambda first, last: ", ".join(f"lag(value, {k}) OVER o AS lag_{k}" for k in range(first, last + 1))
O = "o AS (PARTITION BY location_id ORDER BY t)"
FRAME = lambda a, b: f"(PARTITION BY location_id ORDER BY t ROWS BETWEEN {a} AND {b})"
STATS = lambda w, s: (
    f"avg(value) OVER {w} AS mean_{s}, stddev_pop(value) OVER {w} AS std_{s}, max(value) OVER {w} - min(value) OVER {w} AS range_{s}"
)
W12 = f"w12 AS {FRAME('12 PRECEDING', '1 PRECEDING')}"
W24 = f"w24 AS {FRAME('24 PRECEDING', '1 PRECEDING')}"
W6 = f"w6 AS {FRAME('6 PRECEDING', '1 PRECEDING')}"
W3 = f"w3 AS {FRAME('14 PRECEDING', '12 PRECEDING')}"
SLOPE_OVER = lambda w: (
    f"(CASE WHEN regr_sxx(value, t) OVER {w} > 0 THEN regr_sxy(value, t) OVER {w} / regr_sxx(value, t) OVER {w} END)"
)

# neighbours of every gap: nearest valid rows on both sides, two deep
FILL_SQL = lambda base, n: f"""
{base.strip()},
v AS (SELECT location_id, t, value, lag(t) OVER w AS t0, lag(value) OVER w AS v0, lead(t) OVER w AS t9, lead(value) OVER w AS v9
  FROM series WHERE value IS NOT NULL WINDOW w AS (PARTITION BY location_id ORDER BY t)),
miss AS (
  SELECT s.location_id, s.variable, s.t, (SELECT max(t) FROM v WHERE v.location_id = s.location_id AND v.t < s.t) AS pt,
    (SELECT min(t) FROM v WHERE v.location_id = s.location_id AND v.t > s.t) AS nt
  FROM series s WHERE s.value IS NULL
),
est AS (
  SELECT m.location_id, m.variable, m.t, coalesce(nt, {n}) - coalesce(pt, -1) - 1 AS gap_size,
    CASE WHEN pt IS NULL THEN b.value + (b.v9 - b.value) * (m.t - b.t) / (b.t9 - b.t)
      WHEN nt IS NULL THEN a.value + (a.value - a.v0) * (m.t - a.t) / (a.t - a.t0)
      ELSE a.value + (b.value - a.value) * (m.t - a.t) / (b.t - a.t) END AS estimate
  FROM miss m LEFT JOIN v a ON a.location_id = m.location_id AND a.t = m.pt LEFT JOIN v b ON b.location_id = m.location_id AND b.t = m.nt
)"""


def _holes(df):
    """Cut further holes, also at both ends."""
    t = F.col("t")
    gone = (t < 2) | ((t % 17) < F.col("location_id") % 5) | (t >= 79)
    return df.withColumn("value", F.when(~gone, F.col("value")))


HOLES_SQL = MONTHLY_SQL.replace(
    "k.t, c.value\n", "k.t, CASE WHEN NOT (k.t < 2 OR k.t % 17 < k.location_id % 5 OR k.t >= 79) THEN c.value END AS value\n"
)


def _flagged(spark, sf):
    return _holes(monthly(spark, sf)).withColumn("quality_flag", F.when((F.col("t") + F.col("location_id")) % 13 == 0, 0).otherwise(1))


FLAGGED_SQL = lambda replace: f"""
{HOLES_SQL.strip().replace('series AS (', 'base AS (')},
flagged AS (SELECT *, (t + location_id) % 13 = 0 AS bad FROM base),
runs AS (SELECT location_id, max(c) AS longest FROM (SELECT location_id, count(*) AS c FROM (
  SELECT location_id, t - row_number() OVER (PARTITION BY location_id ORDER BY t) AS isl FROM flagged WHERE bad OR value IS NULL) GROUP BY location_id, isl) GROUP BY 1),
totals AS (SELECT location_id, count(*) FILTER (WHERE bad OR value IS NULL) AS missing_points, count(*) FILTER (WHERE bad) AS bad_quality_points FROM flagged GROUP BY 1),
series AS (SELECT location_id, variable, t, {'CASE WHEN NOT bad THEN value END' if replace else 'value'} AS value FROM flagged)"""

QUALITY_BODY = """
SELECT b.location_id, b.variable, b.t, b.value, CASE WHEN longest <= 5 AND s.value IS NULL AND gap_size <= 5 THEN estimate WHEN longest <= 5 THEN s.value ELSE b.value END AS filled,
  CASE WHEN longest <= 5 THEN 'ok' ELSE 'too_many_missing' END AS status, missing_points, bad_quality_points, longest AS max_consecutive_missing
FROM base b JOIN series s USING (location_id, t) JOIN runs USING (location_id) JOIN totals USING (location_id) LEFT JOIN est USING (location_id, t)"""
QUALITY_COLS = "location_id:i variable:s t:i value:d filled:d status:s missing_points:i bad_quality_points:i max_consecutive_missing:i"

CHECKS = [
    Check(
        "lag_features", lambda s, d: rolling.lag_features(monthly(s, d)), "location_id:i t:i " + " ".join(f"lag_{k}:d" for k in range(1, 13)),
        with_sql(MONTHLY_SQL, body=f"SELECT location_id, t, {LAGS(1, 12)} FROM series WINDOW {O}"),
    ),
    Check(
        "rolling_stats", lambda s, d: rolling.rolling_stats(monthly(s, d)), "location_id:i t:i mean_12:d std_12:d range_12:d mean_6:d previous:d",
        with_sql(MONTHLY_SQL, body=f"SELECT * FROM (SELECT location_id, t, {STATS('w12', '12')}, avg(value) OVER w6 AS mean_6, lag(value) OVER o AS previous FROM series WINDOW {O}, {W12}, {W6}) WHERE t >= 12"),
    ),
    Check(
        "rolling_slope", lambda s, d: rolling.rolling_slope(monthly(s, d)), "location_id:i t:i slope_12:d slope_24:d",
        with_sql(MONTHLY_SQL, body=f"""
SELECT location_id, t, CASE WHEN t >= 24 THEN coalesce({SLOPE_OVER('w12')}, 0) ELSE 0 END AS slope_12, CASE WHEN t >= 24 THEN coalesce({SLOPE_OVER('w24')}, 0) ELSE 0 END AS slope_24
FROM series WINDOW {W12}, {W24}"""),
    ),
    Check(
        "moving_average", lambda s, d: rolling.moving_average(monthly(s, d)), "location_id:i t:i ma_3:d ma_6:d ma_12:d",
        with_sql(MONTHLY_SQL, body="SELECT location_id, t, " + ", ".join(
            f"CASE WHEN t >= {w - 1} THEN avg(value) OVER {FRAME(f'{w - 1} PRECEDING', 'CURRENT ROW')} END AS ma_{w}" for w in (3, 6, 12)) + " FROM series"),
    ),
    Check(
        "seasonal_decompose", lambda s, d: rolling.seasonal_decompose(ship(s, d)), "location_id:i t:i value:d trend:d seasonal:d residual:d",
        with_sql(SHIP_SQL, body=f"""
, a AS (SELECT location_id, t, value, sum(value) OVER {FRAME('6 PRECEDING', '5 FOLLOWING')} / 12 AS trend FROM series),
b AS (SELECT *, avg(value - trend) OVER (PARTITION BY location_id, t % 12) AS seasonal FROM a)
SELECT *, value - trend - seasonal AS residual FROM b"""),
    ),
    Check(
        "autocorrelation", lambda s, d: rolling.autocorrelation(buckets(s, d)), "location_id:i variable:s lag:i autocorrelation:d significant:b",
        with_sql(BUCKETS_SQL, body="""
, r AS (SELECT a.location_id, a.variable, b.t - a.t AS lag, corr(a.value, b.value) AS r FROM series a JOIN series b ON a.location_id = b.location_id AND b.t - a.t BETWEEN 0 AND 24 GROUP BY ALL)
SELECT location_id, variable, lag, CASE WHEN lag = 0 THEN 1 ELSE r END AS autocorrelation, lag = 0 OR abs(r) > 0.2 AS significant FROM r"""),
    ),
    Check(
        "gradient", lambda s, d: rolling.gradient(monthly(s, d)), "location_id:i t:i gradient:d",
        with_sql(MONTHLY_SQL, body=f"""
SELECT location_id, t, CASE WHEN t = 0 THEN lead(value) OVER o - value WHEN t = 79 THEN value - lag(value) OVER o ELSE (lead(value) OVER o - lag(value) OVER o) / 2 END AS gradient FROM series WINDOW {O}"""),
    ),
    Check(
        "yoy_change", lambda s, d: rolling.yoy_change(monthly(s, d)), "location_id:i t:i yoy:d",
        with_sql(MONTHLY_SQL, body=f"SELECT location_id, t, CASE WHEN t >= 24 THEN coalesce(lag(value, 1) OVER o - lag(value, 13) OVER o, 0) ELSE 0 END AS yoy FROM series WINDOW {O}"),
    ),
    Check(
        "lag13_15", lambda s, d: rolling.lag13_15(monthly(s, d)), "location_id:i t:i lag_13:d lag_14:d lag_15:d mean_3ly:d std_3ly:d range_3ly:d",
        with_sql(MONTHLY_SQL, body=f"""
SELECT location_id, t, CASE WHEN t >= 15 THEN lag_13 ELSE 0 END AS lag_13, CASE WHEN t >= 15 THEN lag_14 ELSE 0 END AS lag_14, CASE WHEN t >= 15 THEN lag_15 ELSE 0 END AS lag_15,
  CASE WHEN t >= 14 THEN mean_3ly ELSE 0 END AS mean_3ly, CASE WHEN t >= 14 THEN std_3ly ELSE 0 END AS std_3ly, CASE WHEN t >= 14 THEN range_3ly ELSE 0 END AS range_3ly
FROM (SELECT location_id, t, {LAGS(13, 15)}, {STATS('w3', '3ly')} FROM series WINDOW {O}, {W3})"""),
    ),
    Check(
        "seasonal_adjusted_subset", lambda s, d: rolling.seasonal_adjusted_subset(monthly(s, d), 4), "location_id:i variable:s t:i k:i value:d",
        with_sql(SEASONAL_SQL(4), body="SELECT location_id, variable, t, k, value FROM seasonal"),
    ),
    Check(
        "holdout_split", lambda s, d: rolling.holdout_split(monthly(s, d)), "location_id:i variable:s t:i value:d is_holdout:b",
        with_sql(MONTHLY_SQL, body="SELECT *, t >= 68 AS is_holdout FROM series"),
    ),
    Check(
        "find_gaps", lambda s, d: fill.find_gaps(_holes(monthly(s, d))), "location_id:i variable:s gap_start:i gap_end:i gap_size:i",
        with_sql(HOLES_SQL, body="""
SELECT location_id, variable, min(t) AS gap_start, max(t) AS gap_end, count(*) AS gap_size FROM (
  SELECT *, t - row_number() OVER (PARTITION BY location_id ORDER BY t) AS isl FROM series WHERE value IS NULL) GROUP BY location_id, variable, isl"""),
    ),
    Check(
        "fill_linear", lambda s, d: fill.fill_linear(_holes(monthly(s, d))), "location_id:i variable:s t:i value:d gap_size:i filled:d",
        with_sql(FILL_SQL(HOLES_SQL, 80), body="""
SELECT s.location_id, s.variable, s.t, s.value, gap_size, CASE WHEN s.value IS NULL AND gap_size <= 3 THEN estimate ELSE s.value END AS filled
FROM series s LEFT JOIN est USING (location_id, t)"""),
    ),
    Check(
        "fill_seasonal", lambda s, d: fill.fill_seasonal(_holes(monthly(s, d))), "location_id:i variable:s t:i value:d gap_size:i filled:d",
        with_sql(FILL_SQL(HOLES_SQL, 80), body="""
SELECT s.location_id, s.variable, s.t, s.value, gap_size, CASE WHEN gap_size <= 3 THEN avg(s.value) OVER (PARTITION BY s.location_id, s.t % 12) ELSE s.value END AS filled
FROM series s LEFT JOIN est USING (location_id, t)"""),
    ),
    Check(
        "fill_spline", lambda s, d: fill.fill_spline(_holes(monthly(s, d))), "location_id:i variable:s t:i value:d filled:d",
        with_sql(FILL_SQL(HOLES_SQL, 80), body="""
, p AS (SELECT location_id, t, value AS v, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY location_id) AS n, lead(t) OVER w - t AS h,
    (lead(value) OVER w - value) / (lead(t) OVER w - t) AS s FROM series WHERE value IS NOT NULL WINDOW w AS (PARTITION BY location_id ORDER BY t)),
q AS (SELECT location_id, i, n, lag(h) OVER w AS a, h AS b, 6 * (s - lag(s) OVER w) AS r FROM p WHERE n >= 4 WINDOW w AS (PARTITION BY location_id ORDER BY i) QUALIFY i BETWEEN 1 AND n - 2),
e AS (SELECT location_id, i, n, CASE WHEN i = n - 2 THEN a - b * b / a ELSE a END AS below, CASE WHEN i = 1 THEN b - a * a / b ELSE b END AS above, r,
    2 * (a + b) + CASE WHEN i = 1 THEN a * (a + b) / b ELSE 0 END + CASE WHEN i = n - 2 THEN b * (a + b) / a ELSE 0 END AS middle FROM q),
down AS (SELECT location_id, i, n, CAST(middle AS DOUBLE) AS middle, CAST(above AS DOUBLE) AS above, CAST(r AS DOUBLE) AS r FROM e WHERE i = 1
  UNION ALL SELECT e.location_id, e.i, e.n, e.middle - e.below / d.middle * d.above, e.above, e.r - e.below / d.middle * d.r
  FROM down d JOIN e ON e.location_id = d.location_id AND e.i = d.i + 1),
up AS (SELECT location_id, i, r / middle AS c FROM down WHERE i = n - 2
  UNION ALL SELECT d.location_id, d.i, (d.r - d.above * u.c) / d.middle FROM up u JOIN down d ON d.location_id = u.location_id AND d.i = u.i - 1),
cv AS (SELECT p.*, CASE WHEN p.i = 0 THEN ((h + lead(h) OVER w) * lead(c) OVER w - h * lead(c, 2) OVER w) / lead(h) OVER w
    WHEN p.i = n - 1 THEN ((lag(h, 2) OVER w + lag(h) OVER w) * lag(c) OVER w - lag(h) OVER w * lag(c, 2) OVER w) / lag(h, 2) OVER w ELSE c END AS c
  FROM p LEFT JOIN up ON up.location_id = p.location_id AND up.i = p.i WINDOW w AS (PARTITION BY p.location_id ORDER BY p.i)),
seg AS (SELECT location_id, i, n, t AS t1, lead(t) OVER w AS t2, v, h, s, c AS c1, lead(c) OVER w AS c2 FROM cv WINDOW w AS (PARTITION BY location_id ORDER BY i))
SELECT s.location_id, s.variable, s.t, s.value, CASE WHEN s.value IS NULL AND gap_size <= 3
  THEN coalesce(v + (s.t - t1) * (g.s - h * (2 * c1 + c2) / 6 + (s.t - t1) * (c1 / 2 + (s.t - t1) * (c2 - c1) / (6 * h))), estimate) ELSE s.value END AS filled
FROM series s LEFT JOIN est USING (location_id, t)
LEFT JOIN seg g ON g.location_id = s.location_id AND g.i <= g.n - 2 AND (s.t >= t1 OR g.i = 0) AND (s.t < t2 OR g.i = g.n - 2)""").replace("WITH ", "WITH RECURSIVE ", 1),
    ),
    Check("quality_fill", lambda s, d: fill.quality_fill(_flagged(s, d)), QUALITY_COLS, with_sql(FILL_SQL(FLAGGED_SQL(False), 80), body=QUALITY_BODY)),
    Check(
        "quality_fill_replacing", lambda s, d: fill.quality_fill(_flagged(s, d), replace_flagged=True), QUALITY_COLS,
        with_sql(FILL_SQL(FLAGGED_SQL(True), 80), body=QUALITY_BODY),
    ),
]

"""Checks for sources, sinks, filters and predicates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

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
    table,
    with_sql,
)
from checks.mathsql import P_VALUE, SLOPE, haversine, line, zone
from checks.spec import Check
from isohyet.checkpoint import ensure_checkpoint_dir
from isohyet.functions import zones
from isohyet.operators import features, quality, spatial
from isohyet.plans import reports
from isohyet.series import with_calendar
from isohyet.sources import exports, readers, tables

ORDER_KEYS = "o_orderkey"


def _raw_values(spark, sf):
    """Order prices with the service's missing mark on some rows."""
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderkey") % 13 == 0, -999.0).otherwise(F.col("o_totalprice")).alias("value"),
        F.element_at(
            F.array(*[F.lit(v) for v in ("temperature", "precipitation", "snow_depth", "humidity", "pressure")]),
            (F.col("o_custkey") % 5 + 1).cast("int"),
        ).alias("variable"),
        "o_custkey",
        "o_orderdate",
    )


RAW_SQL = """
raw AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN -999.0 ELSE o_totalprice END AS value,
         ['temperature', 'precipitation', 'snow_depth', 'humidity', 'pressure'][o_custkey % 5 + 1] AS variable,
         o_custkey, o_orderdate
  FROM orders
)"""


def _grid_lines(spark, sf):
    """Outlook text lines made from suppliers, with comments and broken lines."""
    s = sites(spark, sf)
    lines = s.select(
        F.explode(F.array(F.lit("temperature"), F.lit("precipitation"))).alias("variable"),
        F.col("site_id").alias("line_no"),
        F.format_string("  %.2f   %.2f %.1f %.1f %.1f", "lat", "lon",
                        (F.col("site_id") % 40 + 20).cast("double"), (F.col("site_id") % 7 + 30).cast("double"),
                        (F.col("site_id") % 11 + 25).cast("double")).alias("good"),
        "site_id",
    )
    i = F.col("site_id")
    text = (
        F.when(i % 17 == 3, F.lit("# comment 1 2 3 4 5")).when(i % 19 == 4, F.lit("   "))
        .when(i % 23 == 5, F.lit("12.5 north 1 2 3")).when(i % 29 == 6, F.lit("10 20 30"))
        .otherwise(F.col("good"))
    )
    return lines.select("variable", "line_no", text.alias("value"))


GRID_LINES_SQL = f"""
{SITES_SQL.strip()},
lines AS (
  SELECT v.variable, site_id AS line_no,
         CASE WHEN site_id % 17 = 3 THEN '# comment 1 2 3 4 5' WHEN site_id % 19 = 4 THEN '   '
              WHEN site_id % 23 = 5 THEN '12.5 north 1 2 3' WHEN site_id % 29 = 6 THEN '10 20 30'
              ELSE printf('  %.2f   %.2f %.1f %.1f %.1f', lat, lon, CAST(site_id % 40 + 20 AS DOUBLE),
                          CAST(site_id % 7 + 30 AS DOUBLE), CAST(site_id % 11 + 25 AS DOUBLE)) END AS value
  FROM sites CROSS JOIN (VALUES ('temperature'), ('precipitation')) v(variable)
),
parts AS (
  SELECT variable, line_no, string_split_regex(trim(value), '\\s+') AS p
  FROM lines WHERE NOT starts_with(value, '#') AND trim(value) <> ''
),
grid AS (
  SELECT * FROM (
    SELECT variable, line_no, TRY_CAST(p[1] AS DOUBLE) AS lat, TRY_CAST(p[2] AS DOUBLE) AS lon,
           TRY_CAST(p[3] AS DOUBLE) AS above_normal, TRY_CAST(p[4] AS DOUBLE) AS normal,
           TRY_CAST(p[5] AS DOUBLE) AS below_normal
    FROM parts WHERE len(p) >= 5)
  WHERE lat IS NOT NULL AND lon IS NOT NULL AND above_normal IS NOT NULL AND normal IS NOT NULL
    AND below_normal IS NOT NULL
)"""


def grid(spark, sf):
    return readers.parse_outlook_lines(_grid_lines(spark, sf))


def _requests(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("id"), (k % 60).alias("years_back"), (k % 9).alias("months_ahead"),
        (k % 230 - 115).cast("double").alias("latitude"), (k % 400 - 200).cast("double").alias("longitude"),
        (k % 13).alias("limit"),
    )


def _valid_request(spark, sf):
    ok, bad = quality.valid_request(_requests(spark, sf))
    return ok.withColumn("problems", F.lit("")).unionByName(bad.withColumn("problems", F.concat_ws(",", "problems")))


def _locations(spark, sf):
    p = points(spark, sf)
    return p.select("point_id", (F.col("point_id") % 700).alias("k"), "c_name")


def _upsert(spark, sf):
    """Existing: suppliers. New: customers over repeating coordinates, some of them known."""
    lat = ((F.col("k") * 7919) % 17001).cast("double") / 100 - 85
    lon = ((F.col("k") * 104729) % 36001).cast("double") / 100 - 180
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    existing = s.select("id", *tables.place_key(lat, lon), "name")
    new = _locations(spark, sf).select(*tables.place_key(lat, lon), F.col("c_name").alias("name"))
    out = tables.upsert_locations(new, existing)
    known = F.col("id").between(0, 10_000_000)
    return out.select("latitude", "longitude", "name", F.when(known, F.col("id")).alias("existing_id"))


def _history(spark, sf):
    """Repeated monthly rows: every order is one version of its customer's month."""
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("location_id"), F.lit("temperature").alias("variable"),
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"),
        F.col("o_totalprice").alias("value"), F.col("o_orderdate").alias("created_at"),
        F.col("o_orderkey").alias("version"),
    )


def _results(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("kind"), F.col("ts").cast("timestamp_ntz").alias("created_at"), "value"
    )


def _write_results(spark, sf):
    """Results of two requests, the second appended to the first, read back from the shared folder."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/results-{uuid.uuid4().hex}"
    m = monthly(spark, sf)
    for part in (0, 1):
        tables.write_results(m.filter(F.col("t") % 2 == part), path)
    return spark.read.parquet(path)


def _drop_expired(spark, sf):
    r = _results(spark, sf)
    both = tables.with_expiry(r.filter("kind = 'view'"), "forecast").unionByName(
        tables.with_expiry(r.filter("kind <> 'view'"), "probability")
    )
    return tables.drop_expired(both, F.lit("2024-01-15").cast("timestamp_ntz"))


def _stored_results(spark, sf):
    """Stored, stored again in part, expired on the stored table, and what comes back."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    both = tables.with_expiry(_results(spark, sf), "probability")
    tables.store_results(both.filter("kind <> 'view'"), path, ["event_id"])
    tables.store_results(both, path, ["event_id"])
    tables.expire_results(spark, path, F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))
    tables.store_results(both.filter(F.col("expires_at") >= F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")), path, ["event_id"])
    return spark.read.parquet(path)


def _expired_count(spark, sf):
    both = tables.with_expiry(_results(spark, sf), "probability")
    return tables.expired_count(both, F.lit("2024-01-15").cast("timestamp_ntz"))


def _nested(spark, sf):
    return (
        exports.nested_years(monthly(spark, sf), 1995)
        .select("location_id", "variable", F.inline("years"))
        .select("location_id", "variable", "year", F.inline("monthly_values"))
    )


def _grid_points(spark, sf):
    """Customers counted on the global grid, empty grid points included."""
    snap = lambda c: (F.round(F.col(c) / 5) * 5).cast("double")
    on = points(spark, sf).groupBy(snap("lat").alias("lat"), snap("lon").alias("lon")).agg(F.count(F.lit(1)).alias("customers"))
    return spatial.global_grid(spark).join(on, ["lat", "lon"], "left").withColumn(
        "customers", F.coalesce("customers", F.lit(0))
    )


def _training(spark, sf):
    n = table(spark, sf, "nation")
    k = F.col("n_nationkey")
    from checks.data import lat_of, lon_of

    loc = n.select(k.cast("bigint").alias("id"), F.col("n_name").alias("name"), lat_of(k).alias("lat"), lon_of(k).alias("lon"))
    return features.training_panel(monthly(spark, sf), loc)


WHOLE_MONTHLY = "t < (80 // 12) * 12"

CHECKS = [
    Check(
        "null_sentinels", lambda s, d: quality.null_sentinels(_raw_values(s, d)), "id:i value:d",
        with_sql(RAW_SQL, body="SELECT id, nullif(value, -999.0) AS value FROM raw"),
    ),
    Check(
        "with_parameter",
        lambda s, d: quality.with_parameter(_raw_values(s, d)),
        "id:i variable:s unit:s parameter:s source_parameter:s",
        with_sql(RAW_SQL, body="""
SELECT id, variable, unit, parameter, source_parameter FROM raw JOIN (VALUES
 ('temperature','°C','T2M','T2M'), ('precipitation','mm','PRECTOT','PRECTOTCORR'), ('wind_speed','m/s','WS10M','WS10M'),
 ('humidity','%','RH2M','RH2M'), ('pressure','hPa','PS','PS')) v(variable, unit, parameter, source_parameter)
USING (variable)"""),
    ),
    Check(
        "read_outlook_grid", grid, "variable:s line_no:i lat:d lon:d above_normal:d normal:d below_normal:d",
        with_sql(GRID_LINES_SQL, body="SELECT * FROM grid"),
    ),
    Check(
        "write_series_csv", lambda s, d: exports.csv_rows(placed(monthly(s, d)), 1995),
        "location_id:i year:i month:i variable:s value:d latitude:d longitude:d",
        with_sql(MONTHLY_SQL, body=f"""
SELECT location_id, 1995 + t // 12 AS year, t % 12 + 1 AS month, variable, value,
       {lat_sql('location_id')} AS latitude, {lon_sql('location_id')} AS longitude
FROM series WHERE {WHOLE_MONTHLY}"""),
    ),
    Check(
        "export_nested_json", _nested, "location_id:i variable:s year:i month:i value:d",
        with_sql(MONTHLY_SQL, body=f"""
SELECT location_id, variable, 1995 + t // 12 AS year, t % 12 + 1 AS month, value FROM series WHERE {WHOLE_MONTHLY}"""),
    ),
    Check(
        "summary_report", lambda s, d: reports.summary_report(monthly(s, d)),
        "location_id:i variable:s mean:d median:d std_deviation:d minimum:d maximum:d data_points:i p10:d p25:d p75:d "
        "p90:d annual_trend:d trend_direction:s trend_magnitude:s",
        with_sql(MONTHLY_SQL, body=f"""
SELECT *, CASE WHEN data_points > 24 THEN {SLOPE} * 12 END AS annual_trend,
  CASE WHEN data_points > 24 THEN CASE WHEN {SLOPE} > 0 THEN 'increasing' ELSE 'decreasing' END END AS trend_direction,
  CASE WHEN data_points > 24 THEN CASE WHEN abs({SLOPE} * 12) > 0.1 * std_deviation THEN 'significant' ELSE 'minimal' END END
    AS trend_magnitude
FROM (SELECT location_id, variable, avg(value) AS mean, median(value) AS median, stddev_pop(value) AS std_deviation,
  min(value) AS minimum, max(value) AS maximum, count(value) AS data_points, quantile_cont(value, 0.10) AS p10,
  quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.90) AS p90,
  {line('value', 't')} FROM series GROUP BY ALL)"""),
    ),
    Check(
        "monthly_records", lambda s, d: exports.monthly_records(_two_variables(s, d), 1995),
        "location_id:i t:i date:s temperature_c:d precipitation_mm:d",
        with_sql(MONTHLY_SQL, body="""
SELECT location_id // 3 AS location_id, t, printf('%04d-%02d', 1995 + t // 12, t % 12 + 1) AS date,
  round_even(max(value) FILTER (WHERE variable = 'temperature'), 2) AS temperature_c,
  round_even(max(value) FILTER (WHERE variable = 'precipitation'), 2) AS precipitation_mm
FROM series WHERE variable IN ('temperature', 'precipitation') GROUP BY 1, 2, 3"""),
    ),
    Check(
        "fingerprint", lambda s, d: exports.fingerprint(ship(s, d)), "location_id:i variable:s fingerprint:s",
        with_sql(SHIP_SQL, body="""
SELECT location_id, variable,
  substr(sha256(string_agg(CAST(CAST(round(value * 10000) AS BIGINT) AS VARCHAR), ',' ORDER BY t)), 1, 16) AS fingerprint
FROM series GROUP BY ALL"""),
    ),
    Check(
        "upsert_locations", _upsert, "latitude:d longitude:d name:s existing_id:i",
        f"""
WITH existing AS (SELECT s_suppkey AS id, {lat_sql('s_suppkey')} AS latitude, {lon_sql('s_suppkey')} AS longitude, s_name AS name FROM supplier),
fresh AS (SELECT {lat_sql('c_custkey % 700')} AS latitude, {lon_sql('c_custkey % 700')} AS longitude, min(c_name) AS name
          FROM customer GROUP BY 1, 2)
SELECT latitude, longitude, name, id AS existing_id FROM existing
UNION ALL
SELECT latitude, longitude, name, NULL FROM fresh f
WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE round(e.latitude, 8) = round(f.latitude, 8) AND round(e.longitude, 8) = round(f.longitude, 8))""",
    ),
    Check(
        "dedupe_history", lambda s, d: tables.dedupe_history(_history(s, d), F.struct("created_at", "version")),
        "location_id:i variable:s year:i month:i value:d version:i",
        """
SELECT o_custkey AS location_id, 'temperature' AS variable, year(o_orderdate) AS year, month(o_orderdate) AS month,
       o_totalprice AS value, o_orderkey AS version
FROM orders QUALIFY row_number() OVER (PARTITION BY 1, year(o_orderdate), month(o_orderdate), o_custkey
  ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    ),
    Check("write_results", _write_results, "location_id:i variable:s t:i value:d", with_sql(MONTHLY_SQL, body="SELECT location_id, variable, t, value FROM series")),
    Check(
        "drop_expired", _drop_expired, "event_id:i kind:s value:d",
        """
SELECT event_id, event_type AS kind, value FROM events
WHERE NOT (ts + to_seconds(CASE WHEN event_type = 'view' THEN 43200 ELSE 86400 END) < TIMESTAMP '2024-01-15')""",
    ),
    Check(
        "stored_results", _stored_results, "event_id:i kind:s value:d expires_on:s",
        """
SELECT event_id, event_type AS kind, value, CAST(CAST(ts + to_seconds(86400) AS DATE) AS VARCHAR) AS expires_on FROM events
WHERE ts IS NULL OR ts + to_seconds(86400) >= TIMESTAMP '2024-01-15 12:00:00'""",
    ),
    Check(
        "expired_count", _expired_count, "deleted:i",
        "SELECT count(*) AS deleted FROM events WHERE ts + to_seconds(86400) < TIMESTAMP '2024-01-15'",
    ),
    Check(
        "global_grid", _grid_points, "lat:d lon:d zone:s customers:i",
        with_sql(POINTS_SQL, body=f"""
, g AS (SELECT CAST(a.lat AS DOUBLE) AS lat, CAST(b.lon AS DOUBLE) AS lon FROM range(-85, 86, 5) a(lat), range(-180, 181, 5) b(lon)),
on_grid AS (SELECT round(lat / 5) * 5 AS lat, round(lon / 5) * 5 AS lon, count(*) AS customers FROM points GROUP BY 1, 2)
SELECT lat, lon, concat(
    CASE WHEN abs(lat) < 5 THEN 'equatorial' WHEN abs(lat) < 23.5 THEN 'tropical' WHEN abs(lat) < 35 THEN 'subtropical'
         WHEN abs(lat) < 60 THEN 'temperate' ELSE 'polar' END, '_',
    CASE WHEN abs(lon) < 20 OR abs(lon - 180) < 20 THEN 'maritime' WHEN abs(lon) > 30 AND abs(lon) < 150 THEN 'continental'
         ELSE 'coastal' END) AS zone, coalesce(customers, 0) AS customers
FROM g LEFT JOIN on_grid USING (lat, lon)"""),
    ),
    Check(
        "training_panel", _training,
        "location_id:i location_name:s t:i target:d time_norm:d phase_norm:d phase_sin:d phase_cos:d mean_12:d std_12:d "
        "previous:d lat_norm:d lon_norm:d abs_lat_norm:d slope_12:d",
        with_sql(MONTHLY_SQL, body=f"""
, f AS (
SELECT location_id, t, value AS target, t / 80.0 AS time_norm, (t % 12) / 12.0 AS phase_norm,
  sin(2 * pi() * (t % 12) / 12) AS phase_sin, cos(2 * pi() * (t % 12) / 12) AS phase_cos,
  avg(value) OVER w AS mean_12, stddev_pop(value) OVER w AS std_12, lag(value) OVER o AS previous,
  {lat_sql('location_id')} / 90 AS lat_norm, {lon_sql('location_id')} / 180 AS lon_norm, abs({lat_sql('location_id')}) / 90 AS abs_lat_norm,
  CASE WHEN t >= 24 THEN coalesce(CASE WHEN regr_sxx(value, t) OVER w > 0 THEN regr_sxy(value, t) OVER w / regr_sxx(value, t) OVER w END, 0) ELSE 0 END AS slope_12
FROM series WHERE variable = 'temperature'
WINDOW o AS (PARTITION BY location_id ORDER BY t), w AS (PARTITION BY location_id ORDER BY t ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
SELECT f.*, n_name AS location_name FROM f JOIN nation ON n_nationkey = location_id WHERE t >= 12"""),
    ),
    # --- predicates ---
    Check(
        "valid_location",
        lambda s, d: _requests(s, d).select(
            "id", zones.valid_location(F.col("latitude"), F.col("longitude")).alias("valid"),
            zones.valid_reason(F.col("latitude"), F.col("longitude")).alias("reason"),
        ),
        "id:i valid:b reason:s",
        """
SELECT p_partkey AS id, abs(p_partkey % 230 - 115) <= 85 AND abs(p_partkey % 400 - 200) <= 180 AS valid,
  CASE WHEN abs(p_partkey % 230 - 115) <= 85 AND abs(p_partkey % 400 - 200) <= 180 THEN 'served'
       ELSE 'outside the served latitudes' END AS reason FROM part""",
    ),
    Check(
        "valid_request", _valid_request, "id:i problems:s",
        """
SELECT p_partkey AS id, concat_ws(',',
  CASE WHEN NOT (p_partkey % 60 BETWEEN 5 AND 50) THEN 'years_back' END,
  CASE WHEN NOT (p_partkey % 9 BETWEEN 1 AND 6) THEN 'months_ahead' END,
  CASE WHEN abs(p_partkey % 230 - 115) > 90 THEN 'latitude' END,
  CASE WHEN abs(p_partkey % 400 - 200) > 180 THEN 'longitude' END,
  CASE WHEN NOT (p_partkey % 13 BETWEEN 1 AND 10) THEN 'limit' END) AS problems FROM part""",
    ),
    Check(
        "history_window", lambda s, d: quality.history_window(with_calendar(monthly(s, d), 1995), 2000, 3),
        "location_id:i variable:s year:i month:i value:d",
        with_sql(MONTHLY_SQL, body="""
SELECT location_id, variable, 1995 + t // 12 AS year, t % 12 + 1 AS month, value FROM series
WHERE 1995 + t // 12 BETWEEN 1997 AND 1999"""),
    ),
    Check(
        "climate_zone", lambda s, d: points(s, d).select("point_id", zones.climate_zone(F.col("lat")).alias("zone")),
        "point_id:i zone:s", with_sql(POINTS_SQL, body=f"SELECT point_id, {zone('lat')} AS zone FROM points"),
    ),
    Check(
        "koppen_zone",
        lambda s, d: points(s, d).select("point_id", zones.koppen_zone(F.col("lat"), F.col("lon")).alias("k")).select("point_id", "k.*"),
        "point_id:i zone:s min:d max:d variation:d",
        with_sql(POINTS_SQL, body="""
, z AS (SELECT point_id, CASE
  WHEN abs(lat) < 10 THEN 'Af'
  WHEN abs(lat) < 23.5 THEN CASE WHEN lon > 70 AND lon < 100 AND lat > 5 THEN 'Am' ELSE 'Aw' END
  WHEN abs(lat) < 35 THEN CASE WHEN lon > -10 AND lon < 40 AND lat > 30 THEN 'Cs' ELSE 'Cfa' END
  WHEN abs(lat) < 60 THEN CASE WHEN lon > -130 AND lon < -60 AND lat > 40 THEN 'Dfb' ELSE 'Cfb' END
  WHEN abs(lat) < 70 THEN 'Dfc' ELSE 'ET' END AS zone FROM points)
SELECT point_id, zone, min, max, variation FROM z JOIN (VALUES ('Af',20,35,5),('Am',15,40,15),('Aw',15,38,10),('Cs',5,35,15),
 ('Cfa',-5,38,20),('Dfb',-30,30,25),('Cfb',-10,30,15),('Dfc',-40,25,30),('ET',-50,10,20)) c(zone, min, max, variation) USING (zone)"""),
    ),
    Check(
        "zone_modifier", lambda s, d: points(s, d).select("point_id", zones.zone_modifier(F.col("lat"), F.col("lon")).alias("zone")),
        "point_id:i zone:s",
        with_sql(POINTS_SQL, body="""
SELECT point_id, concat(CASE WHEN abs(lat) < 5 THEN 'equatorial' WHEN abs(lat) < 23.5 THEN 'tropical'
  WHEN abs(lat) < 35 THEN 'subtropical' WHEN abs(lat) < 60 THEN 'temperate' ELSE 'polar' END,
  CASE WHEN abs(lon) < 20 OR lon > 160 THEN '_maritime' WHEN abs(lon) > 30 AND abs(lon) < 150 THEN '_continental'
  ELSE '_coastal' END) AS zone FROM points"""),
    ),
    Check(
        "outlook_region", lambda s, d: points(s, d).select("point_id", zones.outlook_region(F.col("lat"), F.col("lon")).alias("region")),
        "point_id:i region:s",
        with_sql(POINTS_SQL, body="""
SELECT point_id, CASE WHEN lat > 50 THEN 'arctic'
  WHEN lat > 35 THEN CASE WHEN lon < -100 THEN 'continental' ELSE 'temperate' END
  WHEN lat > 23.5 THEN CASE WHEN lon < -80 THEN 'subtropical' ELSE 'mediterranean' END ELSE 'tropical' END AS region FROM points"""),
    ),
    Check(
        "in_usa", lambda s, d: points(s, d).select("point_id", zones.in_usa(F.col("lat"), F.col("lon")).alias("usa")),
        "point_id:i usa:b",
        with_sql(POINTS_SQL, body="""
SELECT point_id, (lat BETWEEN 24.396308 AND 49.384358 AND lon BETWEEN -125 AND -66.93457)
  OR (lat BETWEEN 51 AND 71.5 AND lon BETWEEN -179 AND -129) OR (lat BETWEEN 18 AND 23 AND lon BETWEEN -162 AND -154) AS usa FROM points"""),
    ),
    Check(
        "elevation_correct",
        lambda s, d: quality.elevation_correct(
            monthly(s, d),
            table(s, d, "nation").select(
                F.col("n_nationkey").cast("bigint").alias("location_id"),
                (F.col("n_nationkey") * 61.0).alias("elevation"),
            ),
        ),
        "location_id:i variable:s t:i value:d",
        with_sql(MONTHLY_SQL, body="""
SELECT location_id, variable, t, CASE WHEN variable = 'temperature' AND location_id * 61.0 * 0.0065 > 1
  THEN value - location_id * 61.0 * 0.0065 ELSE value END AS value FROM series"""),
    ),
    Check(
        "range_correct", lambda s, d: quality.range_correct(placed(_scaled(s, d))), "location_id:i variable:s t:i value:d",
        with_sql(MONTHLY_SQL, body=f"""
, scaled AS (SELECT location_id, variable, t, value * (location_id % 5) AS value, {lat_sql('location_id')} AS lat, {lon_sql('location_id')} AS lon FROM series),
z AS (SELECT *, avg(value) OVER (PARTITION BY location_id) AS m, CASE
  WHEN abs(lat) < 10 THEN [20, 35]
  WHEN abs(lat) < 23.5 THEN CASE WHEN lon > 70 AND lon < 100 AND lat > 5 THEN [15, 40] ELSE [15, 38] END
  WHEN abs(lat) < 35 THEN CASE WHEN lon > -10 AND lon < 40 AND lat > 30 THEN [5, 35] ELSE [-5, 38] END
  WHEN abs(lat) < 60 THEN CASE WHEN lon > -130 AND lon < -60 AND lat > 40 THEN [-30, 30] ELSE [-10, 30] END
  WHEN abs(lat) < 70 THEN [-40, 25] ELSE [-50, 10] END AS r FROM scaled)
SELECT location_id, variable, t, CASE WHEN variable = 'temperature' AND (m < r[1] - 10 OR m > r[2] + 10)
  THEN value + (r[1] + r[2]) / 2.0 - m ELSE value END AS value FROM z"""),
    ),
    Check(
        "same_month", lambda s, d: __import__("isohyet.series", fromlist=["months_of"]).months_of(monthly(s, d), 4),
        "location_id:i variable:s t:i value:d",
        with_sql(MONTHLY_SQL, body="SELECT * FROM series WHERE t % 12 = 3 AND t < 72"),
    ),
    Check(
        "min_length", lambda s, d: quality.min_length(monthly(s, d), 79), "location_id:i variable:s points:i status:s",
        with_sql(MONTHLY_SQL, body="""
SELECT location_id, variable, count(value) AS points, CASE WHEN count(value) >= 79 THEN 'ok' ELSE 'insufficient_data' END AS status
FROM series GROUP BY ALL"""),
    ),
    Check(
        "outlook_valid",
        lambda s, d: grid(s, d).select("variable", "line_no", zones.outlook_valid(F.col("above_normal"), F.col("normal"), F.col("below_normal")).alias("valid")),
        "variable:s line_no:i valid:b",
        with_sql(GRID_LINES_SQL, body="SELECT variable, line_no, above_normal + normal + below_normal BETWEEN 95 AND 105 AS valid FROM grid"),
    ),
]


def _two_variables(spark, sf):
    """Three neighbouring nations act as one location's three variables."""
    return monthly(spark, sf).withColumn("location_id", F.floor(F.col("location_id") / 3))


def _scaled(spark, sf):
    return monthly(spark, sf).withColumn("value", F.col("value") * (F.col("location_id") % 5))


def _outlooks(spark, sf):
    p = points(spark, sf)
    rows = p.select(
        "point_id", "lat", (F.col("point_id") % 12 + 1).cast("int").alias("as_of"), (F.col("point_id") % 6 + 1).cast("int").alias("lead")
    )
    months = zones.lead_months(F.col("as_of"), F.col("lead"))
    return rows.select(
        "point_id",
        zones.temperature_outlook(F.col("lat"), months).alias("t"),
        zones.precipitation_outlook(F.col("lat"), months).alias("p"),
        (zones.outlook_confidence(F.col("lat"), F.col("lead")) * 0.7).alias("confidence"),
    ).select(
        "point_id", *[F.col(f"{k}.{c}").alias(f"{k}_{c}") for k in "tp" for c in ("above_normal", "normal", "below_normal")], "confidence"
    )


OUTLOOK_SQL = with_sql(POINTS_SQL, body="""
, m AS (SELECT point_id, lat, point_id % 6 + 1 AS lead,
  list_transform(range(0, point_id % 6 + 1), lambda i: (point_id % 12 + i) % 12 + 1) AS months FROM points),
b AS (SELECT *, CASE
    WHEN lat > 0 THEN CASE WHEN list_has_any(months, [12, 1, 2]) THEN -2.0 WHEN list_has_any(months, [6, 7, 8]) THEN 3.0 ELSE 0.0 END
    ELSE CASE WHEN list_has_any(months, [6, 7, 8]) THEN -2.0 WHEN list_has_any(months, [12, 1, 2]) THEN 3.0 ELSE 0.0 END END
    + CASE WHEN abs(lat) > 60 THEN 5.0 ELSE 3.0 END AS tb,
  CASE WHEN abs(lat) BETWEEN 30 AND 60 THEN CASE WHEN list_has_any(months, [10, 11, 12, 1, 2, 3]) THEN 5.0 ELSE -3.0 END
    WHEN abs(lat) < 30 THEN CASE WHEN list_has_any(months, [6, 7, 8, 9]) THEN 8.0 ELSE -5.0 END ELSE 0.0 END AS pb FROM m),
c AS (SELECT point_id, lead, lat, greatest(20, least(60, 33.33 + tb)) AS ta, greatest(20, least(60, 33.33 - tb)) AS tl,
  greatest(25, least(50, 33.33 + pb)) AS pa, greatest(25, least(50, 33.33 - pb)) AS pl FROM b)
SELECT point_id, round_even(ta, 1) AS t_above_normal, round_even(100 - ta - tl, 1) AS t_normal, round_even(tl, 1) AS t_below_normal,
  round_even(pa, 1) AS p_above_normal, round_even(100 - pa - pl, 1) AS p_normal, round_even(pl, 1) AS p_below_normal,
  0.7 * greatest(0.3, least(0.9, 0.7 - 0.1 * (lead - 1) + CASE WHEN abs(lat) < 23.5 THEN 0.1 WHEN abs(lat) < 60 THEN 0.0 ELSE -0.1 END)) AS confidence
FROM c""")

CHECKS.append(
    Check(
        "outlook_rules", _outlooks,
        "point_id:i t_above_normal:d t_normal:d t_below_normal:d p_above_normal:d p_normal:d p_below_normal:d confidence:d",
        OUTLOOK_SQL,
    )
)

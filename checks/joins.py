"""Checks for lookups, joins, top-k and set operations."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import functions as F

from checks.data import (
    BUCKETS_SQL,
    MONTHLY_SQL,
    POINTS_SQL,
    SITES_SQL,
    buckets,
    lat_sql,
    lon_sql,
    monthly,
    placed,
    points,
    ship,
    SHIP_SQL,
    sites,
    table,
    with_sql,
)
from checks.mathsql import P_VALUE, SLOPE, haversine, line, strength, zone
from checks.scans import GRID_LINES_SQL, OUTLOOK_SQL, _outlooks, grid
from checks.spec import Check
from isohyet.checkpoint import ensure_checkpoint_dir
from isohyet.operators import events, fill, forecast, quality, spatial, stats, trends
from isohyet.plans import reports
from isohyet.series import KEY

CELL_SQL = f"""
{GRID_LINES_SQL.strip()},
{POINTS_SQL.strip()},
cell AS (
  SELECT p.point_id, p.lat, p.lon, g.variable, g.above_normal, g.normal, g.below_normal
  FROM points p JOIN grid g ON abs(g.lat - round_even(p.lat / 2.5, 0) * 2.5) <= 1.25
   AND abs(g.lon - round_even(p.lon / 2.5, 0) * 2.5) <= 1.25
  QUALIFY row_number() OVER (PARTITION BY p.point_id, g.variable ORDER BY g.line_no) = 1
)"""

REGION_SQL = f"""
{CELL_SQL.strip()},
region AS (
  SELECT p.point_id, g.variable, avg(g.above_normal) AS above_normal, avg(g.normal) AS normal,
         avg(g.below_normal) AS below_normal, count(*) AS grid_lines
  FROM points p JOIN grid g ON abs(g.lat - p.lat) <= 10 AND abs(g.lon - p.lon) <= 10
  GROUP BY ALL
)"""


def _unmatched(spark, sf):
    p, g = points(spark, sf), grid(spark, sf)
    return p.join(spatial.grid_lookup(p, g), "point_id", "left_anti")


def _first_available(spark, sf):
    """Grid cell, then regional mean, then rules, per point and variable."""
    p, g = points(spark, sf), grid(spark, sf)
    values = ["above_normal", "normal", "below_normal"]
    on = ["point_id", "variable"]
    rules = _outlooks(spark, sf).select(
        "point_id",
        F.inline(F.array(*[
            F.struct(F.lit(v).alias("variable"), *[F.col(f"{k}_{c}").alias(c) for c in values])
            for k, v in (("t", "temperature"), ("p", "precipitation"))
        ])),
    )
    return quality.first_available(
        on,
        ("grid", spatial.grid_lookup(p, g).select(*on, *values)),
        ("region", spatial.regional_average(p, g).select(*on, *values)),
        ("rules", rules.select(*on, *values)),
    )


def _idw(spark, sf):
    s = sites(spark, sf).withColumnRenamed("site_id", "sample_id")
    return spatial.idw(points(spark, sf), s.select("sample_id", "lat", "lon", "value", "nation"), ["nation"])


def _idw_all(spark, sf):
    s = sites(spark, sf).withColumnRenamed("site_id", "sample_id")
    return spatial.idw(points(spark, sf), s)


def _nearest(spark, sf):
    s = sites(spark, sf).withColumnRenamed("site_id", "sample_id")
    return spatial.nearest(points(spark, sf), s)


def _exact_points(spark, sf):
    """Every fourth customer is moved onto a supplier."""
    p, s = points(spark, sf), sites(spark, sf)
    at = s.select(F.col("site_id").alias("on"), F.col("lat").alias("slat"), F.col("lon").alias("slon"))
    joined = p.withColumn("on", F.when(F.col("point_id") % 4 == 0, F.floor(F.col("point_id") / 4))).join(at, "on", "left")
    return joined.select(
        "point_id", F.coalesce("slat", "lat").alias("lat"), F.coalesce("slon", "lon").alias("lon")
    )


MOVED_SQL = f"""
{POINTS_SQL.strip()},
{SITES_SQL.strip()},
moved AS (
  SELECT p.point_id, coalesce(s.lat, p.lat) AS lat, coalesce(s.lon, p.lon) AS lon, s.site_id AS exact_id
  FROM points p LEFT JOIN sites s ON p.point_id % 4 = 0 AND s.site_id = p.point_id // 4
)"""


def _asof(spark, sf):
    """Each customer asks its nation's series at a fractional time, some outside."""
    c = table(spark, sf, "customer")
    kind = F.element_at(F.array(F.lit("temperature"), F.lit("precipitation"), F.lit("wind_speed")), (F.col("c_nationkey") % 3 + 1).cast("int"))
    asked = c.select(
        F.col("c_nationkey").cast("bigint").alias("location_id"), kind.alias("variable"), F.col("c_custkey").alias("point_id"),
        (((F.col("c_custkey") * 37) % 340).cast("double") / 4 - 2).alias("x"),
    )
    return fill.asof_interpolate(asked, monthly(spark, sf))


def _attach(spark, sf):
    base = monthly(spark, sf)
    probs = stats.describe_series(base).select(*KEY, "mean", "std")
    return reports.attach_trends(probs, trends.linear_trend(base))


def _leads(spark, sf):
    import datetime as dt

    phases = forecast.seasonal_baselines(monthly(spark, sf))
    return forecast.expand_leads(phases, forecast.lead_dates(dt.date(2001, 9, 15), 6))


def _places(spark, sf):
    return sites(spark, sf).select(
        F.col("site_id").alias("place_id"), "lat", "lon", F.col("s_name").alias("display_name"), F.col("value").alias("importance"), "nation"
    )


MISSPELT = ["suplier#000000017", "Supplier#00000042", "suppleir#000000003"]


def _misspelt(spark, sf):
    """The index is written once; every search reads its own trigrams of it."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/places-{uuid.uuid4().hex}"
    spatial.write_place_index(_places(spark, sf), path)
    found = [spatial.search_place_index(spark.read.parquet(path), x, 7).withColumn("asked", F.lit(x)) for x in MISSPELT]
    return functools.reduce(lambda a, b: a.unionByName(b), found)


GRAMS_SQL = lambda name: f"list_distinct(list_transform(range(1, length({name}) + 2), lambda i: substr('  ' || lower({name}) || ' ', i, 3)))"


def _idw_sources(spark, sf):
    s = sites(spark, sf).withColumnRenamed("site_id", "sample_id")
    return spatial.idw_sources(points(spark, sf), s, 4)


def _head(spark, sf):
    from isohyet.sources.exports import first_records

    return first_records(monthly(spark, sf), 60)


def _merged(spark, sf):
    base = monthly(spark, sf).groupBy(*KEY).agg(
        F.create_map(F.lit("mean"), F.avg("value"), F.lit("max"), F.max("value")).alias("indicators")
    )
    more = monthly(spark, sf).groupBy(*KEY).agg(
        F.create_map(F.lit("max"), F.max("value") + 1, F.lit("min"), F.min("value")).alias("indicators")
    )
    out = quality.merge_indicators(base, more)
    return out.select(*KEY, F.explode("indicators").alias("name", "value"))


KNN_SQL = lambda k, metric, src="points": with_sql(POINTS_SQL, SITES_SQL, body=f"""
SELECT p.point_id, s.site_id, {metric} AS distance_km,
  row_number() OVER (PARTITION BY p.point_id ORDER BY {metric}, s.site_id) AS rank
FROM points p CROSS JOIN sites s
QUALIFY rank <= {k}""")

GREAT_CIRCLE = haversine("p.lat", "p.lon", "s.lat", "s.lon")
PLANAR = "sqrt(pow(s.lat - p.lat, 2) + pow(s.lon - p.lon, 2))"

CHECKS = [
    Check(
        "grid_lookup", lambda s, d: spatial.grid_lookup(points(s, d), grid(s, d)),
        "point_id:i variable:s above_normal:d normal:d below_normal:d", with_sql(CELL_SQL, body="SELECT * FROM cell"),
    ),
    Check(
        "regional_average", lambda s, d: spatial.regional_average(_unmatched(s, d), grid(s, d)),
        "point_id:i variable:s above_normal:d normal:d below_normal:d grid_lines:i",
        with_sql(REGION_SQL, body="SELECT * FROM region WHERE point_id NOT IN (SELECT point_id FROM cell)"),
    ),
    Check(
        "first_available", _first_available, "point_id:i variable:s above_normal:d normal:d below_normal:d source:s",
        f"""
WITH rules AS ({OUTLOOK_SQL}), chain AS (
SELECT * FROM (WITH {REGION_SQL.strip()}
  SELECT 0 AS o, 'grid' AS source, point_id, variable, above_normal, normal, below_normal FROM cell
  UNION ALL SELECT 1, 'region', point_id, variable, above_normal, normal, below_normal FROM region)
UNION ALL SELECT 2, 'rules', point_id, 'temperature', t_above_normal, t_normal, t_below_normal FROM rules
UNION ALL SELECT 2, 'rules', point_id, 'precipitation', p_above_normal, p_normal, p_below_normal FROM rules)
SELECT * FROM chain QUALIFY row_number() OVER (PARTITION BY point_id, variable ORDER BY o) = 1""",
    ),
    Check(
        "knn_haversine", lambda s, d: spatial.knn_haversine(points(s, d), sites(s, d), 5),
        "point_id:i site_id:i distance_km:d rank:i", KNN_SQL(5, GREAT_CIRCLE),
    ),
    Check(
        "exact_site", lambda s, d: spatial.exact_site(_exact_points(s, d), sites(s, d)), "point_id:i site_id:i",
        with_sql(MOVED_SQL, body="SELECT point_id, exact_id AS site_id FROM moved"),
    ),
    Check(
        "zone_sites", lambda s, d: spatial.zone_sites(points(s, d), sites(s, d)), "point_id:i zone:s site_id:i rank:i",
        with_sql(POINTS_SQL, SITES_SQL, body=f"""
SELECT point_id, {zone('p.lat')} AS zone, m.site_id, m.rank FROM points p JOIN (
  SELECT site_id, {zone('lat')} AS z, row_number() OVER (PARTITION BY {zone('lat')} ORDER BY site_id) AS rank FROM sites QUALIFY rank <= 3
) m ON m.z = {zone('p.lat')}"""),
    ),
    Check(
        "idw", _idw, "point_id:i interpolated_value:d source_points:i",
        with_sql(POINTS_SQL, SITES_SQL, body=f"""
SELECT point_id, sum(value / pow(greatest({PLANAR}, 1e-10), 2)) / sum(1 / pow(greatest({PLANAR}, 1e-10), 2)) AS interpolated_value,
  count(*) AS source_points FROM points p JOIN sites s USING (nation) GROUP BY ALL"""),
    ),
    Check(
        "idw_all", _idw_all, "point_id:i interpolated_value:d source_points:i",
        with_sql(POINTS_SQL, SITES_SQL, body=f"""
SELECT point_id, sum(value / pow(greatest({PLANAR}, 1e-10), 2)) / sum(1 / pow(greatest({PLANAR}, 1e-10), 2)) AS interpolated_value,
  count(*) AS source_points FROM points p CROSS JOIN sites s GROUP BY ALL"""),
    ),
    Check(
        "nearest", _nearest, "point_id:i sample_id:i interpolated_value:d nearest_distance:d",
        with_sql(POINTS_SQL, SITES_SQL, body=f"""
SELECT point_id, site_id AS sample_id, value AS interpolated_value, {PLANAR} AS nearest_distance FROM points p CROSS JOIN sites s
QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY {PLANAR}, site_id) = 1"""),
    ),
    Check(
        "asof_interpolate", _asof, "location_id:i point_id:i x:d interpolated_value:d method:s confidence:d weight:d",
        with_sql(MONTHLY_SQL, body="""
, asked AS (SELECT CAST(c_nationkey AS BIGINT) AS location_id, c_custkey AS point_id, CAST((c_custkey * 37) % 340 AS DOUBLE) / 4 - 2 AS x FROM customer),
j AS (SELECT a.location_id, a.point_id, a.x, max(s.t) FILTER (WHERE s.t <= a.x) AS t1, arg_max(s.value, s.t) FILTER (WHERE s.t <= a.x) AS v1,
  min(s.t) FILTER (WHERE s.t >= a.x) AS t2, arg_min(s.value, s.t) FILTER (WHERE s.t >= a.x) AS v2
  FROM asked a LEFT JOIN series s ON s.location_id = a.location_id AND s.value IS NOT NULL GROUP BY ALL)
SELECT location_id, point_id, x, CASE WHEN t1 = t2 THEN v1 ELSE v1 + (x - t1) / (t2 - t1) * (v2 - v1) END AS interpolated_value,
  CASE WHEN t1 = t2 THEN 'exact_match' WHEN t1 IS NULL OR t2 IS NULL THEN 'outside_range' ELSE 'linear_temporal' END AS method,
  CASE WHEN t1 = t2 THEN 1.0 END AS confidence, CASE WHEN t1 <> t2 THEN (x - t1) / (t2 - t1) END AS weight FROM j"""),
    ),
    Check(
        "attach_trends", _attach, "location_id:i variable:s mean:d std:d slope_per_year:d p_value:d trend_strength:s",
        with_sql(MONTHLY_SQL, body=f"""
, fits AS (SELECT location_id, {line('value', 't')}, stddev_pop(value) AS std FROM series GROUP BY 1),
tr AS (SELECT location_id, {SLOPE} * 12 AS slope_per_year, {P_VALUE} AS p_value, {strength(f'({SLOPE} * 12)', 'std')} AS trend_strength FROM fits)
SELECT location_id, variable, avg(value) AS mean, stddev_pop(value) AS std, coalesce(any_value(slope_per_year), 0) AS slope_per_year,
  coalesce(any_value(p_value), 1) AS p_value, coalesce(any_value(trend_strength), 'unknown') AS trend_strength
FROM series LEFT JOIN tr USING (location_id) GROUP BY ALL"""),
    ),
    Check(
        "zone_limits", lambda s, d: events.attach_zone_limits(points(s, d)),
        "point_id:i zone:s hot:d cold:d wet:d dry:d anomaly_multiplier:d",
        with_sql(POINTS_SQL, body=f"""
SELECT point_id, zone, hot, cold, wet, dry, anomaly_multiplier FROM (SELECT point_id, {zone('lat')} AS zone FROM points)
JOIN (VALUES ('equatorial',32,22,200,50,1.5),('tropical',35,18,150,20,1.8),('subtropical',38,5,100,10,2.0),
 ('temperate',30,-5,80,15,2.2),('polar',15,-20,50,5,2.5)) z(zone, hot, cold, wet, dry, anomaly_multiplier) USING (zone)"""),
    ),
    Check(
        "reverse_place",
        lambda s, d: spatial.reverse_place(points(s, d), _places(s, d), ["display_name", "nation"]),
        "point_id:i place_id:i distance_km:d display_name:s nation:i",
        with_sql(POINTS_SQL, SITES_SQL, body=f"""
SELECT p.point_id, s.site_id AS place_id, {GREAT_CIRCLE} AS distance_km, s.s_name AS display_name, s.nation
FROM points p CROSS JOIN sites s QUALIFY row_number() OVER (PARTITION BY p.point_id ORDER BY {GREAT_CIRCLE}, s.site_id) = 1"""),
    ),
    Check(
        "expand_leads", _leads, "location_id:i variable:s lead:i month:i year:i phase:i",
        with_sql(MONTHLY_SQL, body="""
SELECT DISTINCT location_id, variable, lead, month, year, month - 1 AS phase
FROM (SELECT location_id, variable, t % 12 AS ph FROM series WHERE value IS NOT NULL AND t < 72) JOIN (SELECT k AS lead, month(d) AS month, year(d) AS year FROM
 (SELECT k, DATE '2001-09-15' + CAST(30 * k AS INTEGER) AS d FROM range(1, 7) r(k))) l ON l.month = ph + 1"""),
    ),
    Check(
        "top_k_sites", lambda s, d: spatial.nearest_sites(points(s, d), sites(s, d), 3, "planar").withColumnRenamed("distance", "distance_km"),
        "point_id:i site_id:i distance_km:d rank:i", KNN_SQL(3, PLANAR),
    ),
    Check(
        "strongest_point", lambda s, d: stats.strongest_points(monthly(s, d).withColumn("value", F.round("value", 0))), "location_id:i variable:s largest_at:i smallest_at:i",
        with_sql(MONTHLY_SQL, body="""
SELECT location_id, variable, arg_min(t, t) FILTER (WHERE v = hi) AS largest_at, arg_min(t, t) FILTER (WHERE v = lo) AS smallest_at
FROM (SELECT *, round(value, 0) AS v, max(round(value, 0)) OVER (PARTITION BY location_id) AS hi,
  min(round(value, 0)) OVER (PARTITION BY location_id) AS lo FROM series) GROUP BY ALL"""),
    ),
    Check(
        "head_records", _head, "location_id:i variable:s t:i value:d",
        with_sql(MONTHLY_SQL, body="SELECT * FROM series QUALIFY row_number() OVER (PARTITION BY location_id ORDER BY t) <= 60"),
    ),
    Check(
        "search_places", lambda s, d: spatial.search_places(_places(s, d), "#00000001", 10), "place_id:i display_name:s importance:d",
        with_sql(SITES_SQL, body="""
SELECT site_id AS place_id, s_name AS display_name, value AS importance FROM sites WHERE contains(lower(s_name), '#00000001')
ORDER BY value DESC, s_name, site_id LIMIT 10"""),
    ),
    Check(
        "search_places_misspelt", _misspelt, "asked:s place_id:i display_name:s importance:d similarity:d",
        with_sql(SITES_SQL, body=f"""
, asked AS (SELECT unnest({MISSPELT}) AS asked),
g AS (SELECT *, {GRAMS_SQL('asked')} AS a, {GRAMS_SQL('s_name')} AS b FROM asked CROSS JOIN sites),
x AS (SELECT asked, site_id AS place_id, s_name AS display_name, value AS importance, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS similarity FROM g)
SELECT * FROM x WHERE similarity >= 0.3
QUALIFY row_number() OVER (PARTITION BY asked ORDER BY similarity DESC, importance DESC, display_name, place_id) <= 7"""),
    ),
    Check(
        "idw_sources", _idw_sources, "point_id:i sample_id:i value:d distance:d weight:d rank:i",
        with_sql(POINTS_SQL, SITES_SQL, body=f"""
, near AS (SELECT point_id, site_id AS sample_id, value, {PLANAR} AS distance, row_number() OVER (PARTITION BY point_id ORDER BY {PLANAR}, site_id) AS rank
  FROM points p CROSS JOIN sites s QUALIFY rank <= 4)
SELECT *, pow(greatest(distance, 1e-10), -2) / sum(pow(greatest(distance, 1e-10), -2)) OVER (PARTITION BY point_id) AS weight FROM near"""),
    ),
    Check(
        "union_all",
        lambda s, d: quality.union_all(monthly(s, d), ship(s, d), buckets(s, d)).groupBy("variable").agg(
            F.count(F.lit(1)).alias("rows"), F.count("value").alias("points"), F.sum("value").alias("total")),
        "variable:s rows:i points:i total:d",
        f"""
SELECT variable, count(*) AS rows, count(value) AS points, sum(value) AS total FROM (
 SELECT * FROM ({with_sql(MONTHLY_SQL, body='SELECT variable, value FROM series')})
 UNION ALL SELECT * FROM ({with_sql(SHIP_SQL, body='SELECT variable, value FROM series')})
 UNION ALL SELECT * FROM ({with_sql(BUCKETS_SQL, body='SELECT variable, value FROM series')})) GROUP BY 1""",
    ),
    Check(
        "merge_indicators", _merged, "location_id:i variable:s name:s value:d",
        with_sql(MONTHLY_SQL, body="""
, a AS (SELECT location_id, variable, avg(value) AS m, max(value) AS hi, min(value) AS lo FROM series GROUP BY ALL)
SELECT location_id, variable, 'mean' AS name, m AS value FROM a
UNION ALL SELECT location_id, variable, 'max', hi + 1 FROM a
UNION ALL SELECT location_id, variable, 'min', lo FROM a"""),
    ),
    Check(
        "stratified_points",
        lambda s, d: spatial.stratified_points(points(s, d).withColumn("zone", __import__("isohyet.functions.zones", fromlist=["z"]).zone_modifier(F.col("lat"), F.col("lon")))),
        "point_id:i zone:s lat:d lon:d",
        with_sql(POINTS_SQL, body="""
, z AS (SELECT point_id, lat, lon, concat(CASE WHEN abs(lat) < 5 THEN 'equatorial' WHEN abs(lat) < 23.5 THEN 'tropical'
  WHEN abs(lat) < 35 THEN 'subtropical' WHEN abs(lat) < 60 THEN 'temperate' ELSE 'polar' END,
  CASE WHEN abs(lon) < 20 OR lon > 160 THEN '_maritime' WHEN abs(lon) > 30 AND abs(lon) < 150 THEN '_continental'
  ELSE '_coastal' END) AS zone FROM points)
SELECT * FROM z QUALIFY (row_number() OVER (PARTITION BY zone ORDER BY lat, lon) - 1)
  % greatest(1, count(*) OVER (PARTITION BY zone) // 20) = 0"""),
    ),
]

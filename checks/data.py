"""Series, points and sites derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.series import KEY, build_cells, complete_periods, months_since

MONTHS = 80
SHIP_MONTHS = 83
BUCKETS = 360
ORIGIN_YEAR = 1995


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lat_of(key: Column) -> Column:
    return ((key.cast("bigint") * 7919) % 17001).cast("double") / 100 - 85


def lon_of(key: Column) -> Column:
    return ((key.cast("bigint") * 104729) % 36001).cast("double") / 100 - 180


def lat_sql(key: str) -> str:
    return f"(CAST((CAST({key} AS BIGINT) * 7919) % 17001 AS DOUBLE) / 100 - 85)"


def lon_sql(key: str) -> str:
    return f"(CAST((CAST({key} AS BIGINT) * 104729) % 36001 AS DOUBLE) / 100 - 180)"


def placed(df: DataFrame) -> DataFrame:
    return df.withColumns({"lat": lat_of(F.col("location_id")), "lon": lon_of(F.col("location_id"))})


# --- monthly: mean order value per nation ---------------------------------

NATION_VARIABLE = ["temperature", "precipitation", "wind_speed"]


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    """25 series with natural gaps.

    Orders are reduced per customer and month before they meet the customers,
    so a busy customer costs one row per month in the join.
    """
    orders = table(spark, sf, "orders").select(
        "o_custkey", months_since(F.col("o_orderdate"), ORIGIN_YEAR).alias("t"), "o_totalprice"
    )
    per_customer = orders.groupBy("o_custkey", "t").agg(
        F.sum("o_totalprice").alias("total"), F.count("o_totalprice").alias("orders")
    )
    customers = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("location_id"))
    kind = F.element_at(
        F.array(*[F.lit(v) for v in NATION_VARIABLE]), (F.col("location_id") % 3 + 1).cast("int")
    )
    facts = per_customer.join(customers, per_customer.o_custkey == customers.c_custkey).select(
        "location_id", kind.alias("variable"), "t", "total", "orders"
    )
    cells = build_cells(facts, F.sum("total") / F.sum("orders") / 9973)
    return complete_periods(cells, MONTHS)


MONTHLY_SQL = f"""
cells AS (
  SELECT CAST(c_nationkey AS BIGINT) AS location_id,
         (year(o_orderdate) - {ORIGIN_YEAR}) * 12 + month(o_orderdate) - 1 AS t,
         avg(o_totalprice) / 9973 AS value
  FROM orders JOIN customer ON o_custkey = c_custkey
  GROUP BY 1, 2
),
series AS (
  SELECT k.location_id,
         CASE k.location_id % 3 WHEN 0 THEN 'temperature' WHEN 1 THEN 'precipitation' ELSE 'wind_speed' END AS variable,
         k.t, c.value
  FROM (SELECT location_id, unnest(range(least(0, min(t)), greatest({MONTHS}, max(t) + 1))) AS t FROM cells GROUP BY location_id) k
  LEFT JOIN cells c ON c.location_id = k.location_id AND c.t = k.t
)"""

# --- ship: quantity per return flag, complete -----------------------------


def ship(spark: SparkSession, sf: str) -> DataFrame:
    facts = table(spark, sf, "lineitem").select(
        F.ascii("l_returnflag").cast("bigint").alias("location_id"),
        F.lit("precipitation").alias("variable"),
        months_since(F.col("l_shipdate"), ORIGIN_YEAR).alias("t"),
        "l_quantity",
    )
    cells = build_cells(facts, F.sum("l_quantity") / 97)
    return complete_periods(cells, SHIP_MONTHS)


SHIP_SQL = f"""
series AS (
  SELECT CAST(ascii(l_returnflag) AS BIGINT) AS location_id, 'precipitation' AS variable,
         (year(l_shipdate) - {ORIGIN_YEAR}) * 12 + month(l_shipdate) - 1 AS t,
         sum(l_quantity) / 97 AS value
  FROM lineitem GROUP BY ALL
)"""

# --- buckets: mean event value per two hours, 30 cycles of 12 -------------

EVENT_SERIES = {
    "click": (1, "temperature"),
    "error": (2, "precipitation"),
    "purchase": (3, "wind_speed"),
    "signup": (4, "humidity"),
    "view": (5, "temperature"),
}


def buckets(spark: SparkSession, sf: str) -> DataFrame:
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    at = F.timestamp_diff("SECOND", start, F.col("ts").cast("timestamp_ntz"))
    pairs = [x for k, (i, v) in EVENT_SERIES.items() for x in (F.lit(k), F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(v).alias("v")))]
    key = F.create_map(*pairs)[F.col("event_type")]
    facts = table(spark, sf, "events").select(
        key["i"].alias("location_id"), key["v"].alias("variable"), F.floor(at / 7200).cast("int").alias("t"), "value"
    )
    cells = facts.groupBy(*KEY, "t").agg((F.avg("value") / 1.7).alias("value"))
    return complete_periods(cells, BUCKETS)


_cases = lambda i: " ".join(
    f"WHEN '{k}' THEN " + (str(v[i]) if i == 0 else f"'{v[i]}'") for k, v in EVENT_SERIES.items()
)
BUCKETS_SQL = f"""
cells AS (
  SELECT CASE event_type {_cases(0)} END AS location_id,
         CASE event_type {_cases(1)} END AS variable,
         CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 7200) AS BIGINT) AS t,
         avg(value) / 1.7 AS value
  FROM events GROUP BY ALL
),
series AS (
  SELECT k.location_id, k.variable, k.t, c.value
  FROM (SELECT location_id, variable, unnest(range(least(0, min(t)), greatest({BUCKETS}, max(t) + 1))) AS t FROM cells GROUP BY location_id, variable) k
  LEFT JOIN cells c ON c.location_id = k.location_id AND c.t = k.t
)"""

# --- points and sites -----------------------------------------------------


def points(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        c.alias("point_id"), lat_of(c).alias("lat"), lon_of(c).alias("lon"),
        F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), "c_name", "c_mktsegment",
    )


POINTS_SQL = f"""
points AS (
  SELECT c_custkey AS point_id, {lat_sql('c_custkey')} AS lat, {lon_sql('c_custkey')} AS lon,
         c_nationkey AS nation, c_acctbal AS balance, c_name, c_mktsegment
  FROM customer
)"""


def sites(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers; the keys are shifted so that they do not sit on customers."""
    k = F.col("s_suppkey") * 3 + 50_000
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("site_id"), lat_of(k).alias("lat"), lon_of(k).alias("lon"),
        F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("value"), "s_name",
    )


_site_key = "(s_suppkey * 3 + 50000)"
SITES_SQL = f"""
sites AS (
  SELECT s_suppkey AS site_id, {lat_sql(_site_key)} AS lat, {lon_sql(_site_key)} AS lon,
         s_nationkey AS nation, s_acctbal AS value, s_name
  FROM supplier
)"""


def with_sql(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body.strip()

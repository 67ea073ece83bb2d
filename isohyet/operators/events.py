"""Runs of periods beyond a threshold, and the zone-specific indicators on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isohyet.functions.numeric import percentile, ratio
from isohyet.functions.zones import climate_zone
from isohyet.series import KEY, by_series, in_time_order, with_length

# fixed values: zone, hot and cold limits, wet and dry limits, anomaly multiplier,
# expected temperature spread (low, high), expected precipitation spread (low, high)
ZONE_ROWS = [
    ("equatorial", 32.0, 22.0, 200.0, 50.0, 1.5, 1.0, 3.0, 20.0, 80.0),
    ("tropical", 35.0, 18.0, 150.0, 20.0, 1.8, 2.0, 5.0, 30.0, 120.0),
    ("subtropical", 38.0, 5.0, 100.0, 10.0, 2.0, 3.0, 8.0, 15.0, 60.0),
    ("temperate", 30.0, -5.0, 80.0, 15.0, 2.2, 5.0, 12.0, 10.0, 40.0),
    ("polar", 15.0, -20.0, 50.0, 5.0, 2.5, 8.0, 20.0, 5.0, 25.0),
]
ZONE_FIELDS = ["zone", "hot", "cold", "wet", "dry", "anomaly_multiplier", "t_low", "t_high", "p_low", "p_high"]
# fixed values: limits for a zone that is not listed
ZONE_DEFAULTS = {"hot": 30.0, "cold": 0.0, "wet": 100.0, "dry": 20.0, "anomaly_multiplier": 2.0}


def zone_limits(spark: SparkSession) -> DataFrame:
    schema = ", ".join(f"{f} {'string' if f == 'zone' else 'double'}" for f in ZONE_FIELDS)
    return spark.createDataFrame(ZONE_ROWS, schema)


def attach_zone_limits(df: DataFrame) -> DataFrame:
    """Limits of each row's zone from its ``lat``; five rows, always broadcast."""
    rows = df.withColumn("zone", climate_zone(F.col("lat")))
    joined = rows.join(F.broadcast(zone_limits(df.sparkSession)), "zone", "left")
    return joined.withColumns(
        {c: F.coalesce(F.col(c), F.lit(v)) for c, v in ZONE_DEFAULTS.items()}
    )


def consecutive_events(
    df: DataFrame, threshold: Column, min_duration: int = 3, above: bool = True
) -> DataFrame:
    """Runs strictly beyond ``threshold``: start, end, duration, intensity, peak."""
    v = F.col("value")
    beyond = df.filter(v > threshold if above else v < threshold)
    island = F.col("t") - F.row_number().over(in_time_order())
    peak = F.max(v) if above else F.min(v)
    return (
        beyond.withColumn("_island", island)
        .groupBy(*KEY, "_island")
        .agg(
            F.min("t").alias("start_t"),
            F.max("t").alias("end_t"),
            F.count(F.lit(1)).alias("duration"),
            F.avg(v).alias("intensity"),
            peak.alias("peak"),
        )
        .filter(F.col("duration") >= min_duration)
        .drop("_island")
    )


def dry_spell_frequency(df: DataFrame, recent: int = 120) -> DataFrame:
    """Runs below the series' p25 in the last ``recent`` periods, per year of ten."""
    level = percentile("value", 25).over(by_series())[0]
    late = with_length(df.withColumn("_p25", level)).filter(F.col("t") >= F.col("n") - recent)
    dry = F.coalesce(F.col("value") < F.col("_p25"), F.lit(False))
    late = late.withColumn("_dry", dry).withColumn(
        "_starts", F.col("_dry") & ~F.coalesce(F.lag("_dry").over(in_time_order()), F.lit(False))
    )
    return late.groupBy(*KEY).agg((F.count_if("_starts") / 10).alias("dry_spell_frequency"))


def _event_counts(df: DataFrame, limit: str, min_duration: int, above: bool, name: str) -> DataFrame:
    return (
        consecutive_events(df, F.col(limit), min_duration, above)
        .groupBy(*KEY)
        .agg(F.count(F.lit(1)).alias(name))
    )


def _zone_report(df: DataFrame, base: DataFrame, *events: tuple[DataFrame, str]) -> DataFrame:
    for counted, name in events:
        base = base.join(counted, KEY, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return base


def zone_temperature_indicators(df: DataFrame) -> DataFrame:
    """Hot and cold periods against zone limits; needs a ``lat`` column."""
    from isohyet.operators.trends import extremes_trend

    rows = attach_zone_limits(df)
    v = F.col("value")
    base = rows.groupBy(*KEY).agg(
        F.max("zone").alias("zone"),
        F.count_if(v > F.col("hot")).alias("hot_periods"),
        F.count_if(v < F.col("cold")).alias("cold_periods"),
    )
    base = _zone_report(
        df,
        base,
        (_event_counts(rows, "hot", 3, True, "heat_waves"), "heat_waves"),
        (_event_counts(rows, "cold", 3, False, "cold_spells"), "cold_spells"),
    )
    return base.join(extremes_trend(rows, F.col("hot"), F.col("cold")), KEY)


def zone_precipitation_indicators(df: DataFrame) -> DataFrame:
    rows = attach_zone_limits(df)
    v = F.col("value")
    base = rows.groupBy(*KEY).agg(
        F.max("zone").alias("zone"),
        F.count_if(v > F.col("wet")).alias("wet_periods"),
        F.count_if(v < F.col("dry")).alias("dry_periods"),
        F.when(F.avg(v) > 0, ratio(F.stddev_pop(v), F.avg(v))).otherwise(0.0).alias("variability_index"),
    )
    return _zone_report(
        df,
        base,
        (_event_counts(rows, "dry", 6, False, "droughts"), "droughts"),
        (_event_counts(rows, "wet", 2, True, "flood_risk_periods"), "flood_risk_periods"),
    )


def zone_context(df: DataFrame) -> DataFrame:
    """Expected spread of the zone and the series' own anomaly threshold."""
    var = F.col("variable")
    rows = attach_zone_limits(df)

    def expected(t: str, p: str, other: float) -> Column:
        return (
            F.when(var == "temperature", F.coalesce(F.col(t), F.lit(other)))
            .when(var == "precipitation", F.coalesce(F.col(p), F.lit(other)))
            .otherwise(other)
        )

    return rows.groupBy(*KEY).agg(
        F.max("zone").alias("climate_zone"),
        F.max(expected("t_low", "p_low", 0.0)).alias("expected_low"),
        F.max(expected("t_high", "p_high", 10.0)).alias("expected_high"),
        (F.stddev_pop("value") * F.max("anomaly_multiplier")).alias("anomaly_threshold"),
    )

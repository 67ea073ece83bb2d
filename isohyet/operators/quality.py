"""Row-level checks and corrections applied when observations arrive."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.functions.zones import elevation_corrected, koppen_zone
from isohyet.series import KEY, by_series

SENTINEL = -999.0
FIRST_YEAR, LAST_YEAR = 1981, 2024
# fixed values: variable, unit, parameter, name the monthly service uses
VARIABLES = [
    ("temperature", "°C", "T2M", "T2M"),
    ("precipitation", "mm", "PRECTOT", "PRECTOTCORR"),
    ("wind_speed", "m/s", "WS10M", "WS10M"),
    ("humidity", "%", "RH2M", "RH2M"),
    ("pressure", "hPa", "PS", "PS"),
]


def variables(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        VARIABLES, "variable string, unit string, parameter string, source_parameter string"
    )


def null_sentinels(df: DataFrame, sentinel: float = SENTINEL, columns: Sequence[str] = ("value",)) -> DataFrame:
    """Missing marks and NaN become NULL; the row stays so time does not shift."""
    return df.withColumns({c: F.when((F.col(c) != sentinel) & ~F.isnan(c), F.col(c)) for c in columns})


def with_parameter(df: DataFrame) -> DataFrame:
    """Attach unit and source parameter; rows of unknown variables are dropped."""
    return df.join(F.broadcast(variables(df.sparkSession)), "variable")


def request_problems() -> Column:
    """Names of the limits a request row breaks."""
    rules = {
        "years_back": F.col("years_back").between(5, 50),
        "months_ahead": F.col("months_ahead").between(1, 6),
        "latitude": F.col("latitude").between(-90, 90),
        "longitude": F.col("longitude").between(-180, 180),
        "limit": F.col("limit").between(1, 10),
    }
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))


def valid_request(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with their ``problems``)."""
    checked = df.withColumn("problems", request_problems())
    return (
        checked.filter(F.size("problems") == 0).drop("problems"),
        checked.filter(F.size("problems") > 0),
    )


def history_window(df: DataFrame, as_of_year: int, years_back: int) -> DataFrame:
    """Years [as_of - back, as_of - 1] inside what the source covers."""
    first, last = max(FIRST_YEAR, as_of_year - years_back), min(LAST_YEAR, as_of_year - 1)
    return df.filter(F.col("year").between(first, last))


def verification_window(start_year: int, end_year: int) -> tuple[int, int]:
    start, end = max(FIRST_YEAR, start_year), min(LAST_YEAR, end_year)
    if start >= end:
        raise ValueError("Start year must be before end year")
    return start, end


def elevation_correct(df: DataFrame, elevations: DataFrame) -> DataFrame:
    """Lapse-rate correction of temperatures by ``location_id``; unknown means sea level."""
    rows = df.join(elevations.select("location_id", "elevation"), "location_id", "left")
    fixed = F.when(
        F.col("variable") == "temperature", elevation_corrected(F.col("value"), F.col("elevation"))
    ).otherwise(F.col("value"))
    return rows.withColumn("value", fixed).drop("elevation")


def range_correct(df: DataFrame) -> DataFrame:
    """Shift a temperature series whose mean is far outside its climate class."""
    rows = df.withColumns(
        {"_k": koppen_zone(F.col("lat"), F.col("lon")), "_mean": F.avg("value").over(by_series())}
    )
    low, high, mean = F.col("_k.min"), F.col("_k.max"), F.col("_mean")
    off = (F.col("variable") == "temperature") & ((mean < low - 10) | (mean > high + 10))
    shifted = F.when(off, F.col("value") + (low + high) / 2 - mean).otherwise(F.col("value"))
    return rows.withColumn("value", shifted).drop("_k", "_mean")


def min_length(df: DataFrame, required: int) -> DataFrame:
    """Label every series as long enough or not."""
    out = df.groupBy(*KEY).agg(F.count("value").alias("points"))
    return out.withColumn(
        "status", F.when(F.col("points") >= required, "ok").otherwise("insufficient_data")
    )


def first_available(keys: Sequence[str], *sources: tuple[str, DataFrame]) -> DataFrame:
    """First source with a row per key wins; adds a ``source`` label.

    Sources are stacked with their order and reduced per key, so a long chain
    of fallbacks costs one shuffle instead of a join each.
    """
    stacked = [
        df.withColumns({"source": F.lit(name), "_order": F.lit(i)}) for i, (name, df) in enumerate(sources)
    ]
    both = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stacked)
    payload = [c for c in both.columns if c not in (*keys, "_order")]
    best = F.min_by(F.struct(*payload), F.col("_order"))
    return both.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def union_all(*frames: DataFrame) -> DataFrame:
    """Stack the rows of several variables or locations by column name."""
    return functools.reduce(lambda a, b: a.unionByName(b), frames)


def merge_indicators(base: DataFrame, enhanced: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Two map<string,double> columns named ``indicators``; the enhanced one wins."""
    joined = base.withColumnRenamed("indicators", "_base").join(
        enhanced.withColumnRenamed("indicators", "_more"), list(keys), "left"
    )
    more = F.coalesce("_more", F.create_map().cast("map<string,double>"))
    kept = F.map_filter("_base", lambda k, _: ~F.map_contains_key(more, k))
    return joined.select(*keys, F.map_concat(kept, more).alias("indicators"))

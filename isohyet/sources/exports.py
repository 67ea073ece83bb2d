"""Export frames and the sinks that write them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.series import KEY, PERIOD, whole_years, with_calendar


def csv_rows(df: DataFrame, origin_year: int, period: int = PERIOD) -> DataFrame:
    """Long export rows of whole years; needs ``lat`` and ``lon``."""
    rows = with_calendar(whole_years(df, period), origin_year, period)
    return rows.select(
        "location_id",
        "year",
        "month",
        "variable",
        "value",
        F.col("lat").alias("latitude"),
        F.col("lon").alias("longitude"),
    )


def write_series_csv(df: DataFrame, path: str, origin_year: int) -> None:
    csv_rows(df, origin_year).write.mode("overwrite").option("header", True).csv(path)


def nested_years(df: DataFrame, origin_year: int, period: int = PERIOD) -> DataFrame:
    """Per series an array of {year, monthly_values: [{month, value}]}.

    Twelve values nest into a year and the calendar's years into a series.
    """
    rows = with_calendar(whole_years(df, period), origin_year, period)
    years = rows.groupBy(*KEY, "year").agg(
        F.array_sort(F.collect_list(F.struct("month", "value"))).alias("monthly_values")
    )
    return years.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("year", "monthly_values"))).alias("years")
    )


def export_nested_json(
    df: DataFrame,
    path: str,
    origin_year: int,
    metadata: dict[str, Column] | None = None,
    analysis: DataFrame | None = None,
) -> None:
    """One JSON line per location: metadata, raw data by variable, analysis."""
    per_location = nested_years(df, origin_year).groupBy("location_id").agg(
        F.map_from_entries(F.collect_list(F.struct("variable", "years"))).alias("raw_data")
    )
    if metadata:
        per_location = per_location.withColumn(
            "metadata", F.struct(*[c.alias(k) for k, c in metadata.items()])
        )
    if analysis is not None:
        fields = F.struct(*[c for c in analysis.columns if c not in KEY])
        by_location = analysis.groupBy("location_id").agg(
            F.map_from_entries(F.collect_list(F.struct(F.col("variable"), fields.alias("a")))).alias("analysis")
        )
        per_location = per_location.join(by_location, "location_id", "left")
    per_location.write.mode("overwrite").json(path)


def monthly_records(df: DataFrame, origin_year: int, period: int = PERIOD) -> DataFrame:
    """Temperature and precipitation of a month side by side, 2 decimals."""
    both = df.filter(F.col("variable").isin("temperature", "precipitation"))
    side = lambda v: F.bround(F.max(F.when(F.col("variable") == v, F.col("value"))), 2)
    rows = both.groupBy("location_id", "t").agg(
        side("temperature").alias("temperature_c"), side("precipitation").alias("precipitation_mm")
    )
    rows = with_calendar(rows, origin_year, period)
    return rows.withColumn("date", F.format_string("%04d-%02d", "year", "month"))


def first_records(records: DataFrame, limit: int = 60) -> DataFrame:
    """The opening months of each location: a period bound, no ranking needed."""
    return records.filter(F.col("t") < limit)


def fingerprint(df: DataFrame, keys: tuple[str, ...] = tuple(KEY)) -> DataFrame:
    """First 16 hex digits of SHA-256 over the series as text (value x 10^4).

    The text of a series is bounded by its calendar.
    """
    text = F.coalesce(F.round(F.col("value") * 10_000).cast("bigint").cast("string"), F.lit("null"))
    ordered = F.array_sort(F.collect_list(F.struct("t", text.alias("x"))))
    joined = F.concat_ws(",", F.transform(ordered, lambda e: e["x"]))
    return df.groupBy(*keys).agg(F.substring(F.sha2(joined, 256), 1, 16).alias("fingerprint"))

"""Feature frames for the forecast models: one window pass over each series."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.functions.ols import slope_agg
from isohyet.operators.rolling import (
    from_second_cycle,
    lag_columns,
    last_year_columns,
    rows,
    slope_column,
    stats_columns,
    yoy_column,
)
from isohyet.series import KEY, PERIOD, in_time_order, with_length

PLACE = ["lat_norm", "lon_norm", "abs_lat_norm"]
FORECAST_COLUMNS = [
    *[f"lag_{k}" for k in range(1, 13)],
    *["month_sin", "month_cos", "month_norm", "slope_12", "slope_24"],
    *["mean_12", "std_12", "range_12", *PLACE],
    *["lag_13", "lag_14", "lag_15", "mean_3ly", "std_3ly", "range_3ly", "yoy"],
]
TREND_COLUMNS = [
    *["time_norm", "phase_norm", "phase_sin", "phase_cos", "mean_12", "std_12", "previous", "mean_6"],
    *["slope_12", "slope_24", *PLACE, "variability_12", "range_12"],
]
PANEL_COLUMNS = [
    *["time_norm", "phase_norm", "phase_sin", "phase_cos", "mean_12", "std_12", "previous"],
    *[*PLACE, "slope_12"],
]


def _angle(x: Column, period: int = PERIOD) -> Column:
    return 2 * math.pi * x / period


def _cycle(x: Column, name: str, period: int = PERIOD) -> dict[str, Column]:
    return {
        f"{name}_sin": F.sin(_angle(x, period)),
        f"{name}_cos": F.cos(_angle(x, period)),
        f"{name}_norm": x / period,
    }


def _place() -> dict[str, Column]:
    return {
        "lat_norm": F.col("lat") / 90.0,
        "lon_norm": F.col("lon") / 180.0,
        "abs_lat_norm": F.abs("lat") / 90.0,
    }


def forecast_features(df: DataFrame) -> DataFrame:
    """Thirty columns known before each period; the target is ``value`` itself."""
    out = df.withColumns(
        {
            **lag_columns(12),
            **_cycle(F.col("t") % PERIOD + 1, "month"),
            "slope_12": from_second_cycle(slope_column(12)),
            "slope_24": from_second_cycle(slope_column(24)),
            **stats_columns(-12, -1, "12"),
            **_place(),
            **last_year_columns(),
            "yoy": yoy_column(),
        }
    )
    return out.filter(F.col("t") >= 12).select(*KEY, "t", "value", *FORECAST_COLUMNS)


def _tail(width: int, value: str = "value") -> Column:
    return F.when(F.col("t") >= F.col("n") - width, F.col(value))


def target_features(df: DataFrame, month: int) -> DataFrame:
    """The same thirty columns for the first period after each series, as ``month``."""
    x = F.col("t").cast("double")
    at = lambda k: F.max(F.when(F.col("t") == F.col("n") - k, F.col("value")))
    last12 = _tail(12)
    year_ago = F.when(
        F.col("t").between(F.col("n") - 14, F.col("n") - 12), F.col("value")
    )
    n = F.max("n")
    m = F.lit(month)
    guard = lambda need, c: F.when(n >= need, c).otherwise(0.0)
    stats = lambda c: [F.avg(c), F.stddev_pop(c), F.max(c) - F.min(c)]
    mean12, std12, range12 = stats(last12)
    columns = {
        **{f"lag_{k}": at(k) for k in range(1, 13)},
        "slope_12": slope_agg(last12, x),
        "slope_24": guard(24, slope_agg(_tail(24), x)),
        "mean_12": mean12,
        "std_12": std12,
        "range_12": range12,
        **{f"lag_{k}": guard(15, at(k)) for k in (13, 14, 15)},
        **{
            f"{name}_3ly": guard(14, c)
            for name, c in zip(("mean", "std", "range"), stats(year_ago))
        },
        "yoy": guard(24, at(1) - at(13)),
        "lat": F.max("lat"),
        "lon": F.max("lon"),
    }
    out = with_length(df).groupBy(*KEY).agg(*[c.alias(name) for name, c in columns.items()])
    return out.withColumns({**_cycle(m, "month"), **_place()}).select(*KEY, *FORECAST_COLUMNS)


def trend_features(df: DataFrame) -> DataFrame:
    phase = F.col("t") % PERIOD
    out = with_length(df).withColumns(
        {
            "time_norm": F.col("t") / F.col("n"),
            **_cycle(phase, "phase"),
            **stats_columns(-12, -1, "12"),
            "previous": F.lag("value").over(in_time_order()),
            "mean_6": F.avg("value").over(rows(-6, -1)),
            "slope_12": from_second_cycle(slope_column(12)),
            "slope_24": from_second_cycle(slope_column(24)),
            **_place(),
        }
    )
    return out.filter(F.col("t") >= 12).select(
        *KEY, "t", "value", *[F.col("std_12").alias(c) if c == "variability_12" else c for c in TREND_COLUMNS]
    )


def future_features(df: DataFrame, horizon: int = 60) -> DataFrame:
    """Trend columns for ``horizon`` coming periods, recent context frozen."""
    x = F.col("t").cast("double")
    last12 = _tail(12)
    recent = with_length(df).groupBy(*KEY).agg(
        F.max("n").alias("n"),
        F.avg(last12).alias("mean_12"),
        F.stddev_pop(last12).alias("std_12"),
        (F.max(last12) - F.min(last12)).alias("range_12"),
        F.max(_tail(1)).alias("previous"),
        F.avg(_tail(6)).alias("mean_6"),
        F.when(F.max("n") >= 24, slope_agg(last12, x)).otherwise(0.0).alias("slope_12"),
        F.when(F.max("n") >= 24, slope_agg(_tail(24), x)).otherwise(0.0).alias("slope_24"),
        F.max("lat").alias("lat"),
        F.max("lon").alias("lon"),
    )
    steps = recent.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))))
    at = F.col("n") + F.col("step")
    out = steps.withColumns(
        {
            "time_norm": at / (F.col("n") + horizon),
            **_cycle(at % PERIOD, "phase"),
            "variability_12": F.col("std_12"),
            **_place(),
        }
    )
    return out.select(*KEY, "step", *TREND_COLUMNS)


def panel_features(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Eleven columns shared by all locations; target is ``value``."""
    out = with_length(df).withColumns(
        {
            "time_norm": F.col("t") / F.col("n"),
            **_cycle(F.col("t") % PERIOD, "phase"),
            **stats_columns(-12, -1, "12"),
            "previous": F.lag("value").over(in_time_order()),
            "slope_12": from_second_cycle(slope_column(12)),
            **_place(),
        }
    )
    return out.filter(F.col("t") >= 12).select(*KEY, "t", "value", *keep, *PANEL_COLUMNS)


def panel_predict_features(df: DataFrame, month: int) -> DataFrame:
    """The panel columns at prediction time; the month is 1-based here."""
    x = F.col("t").cast("double")
    last12 = _tail(12)
    recent = with_length(df).groupBy(*KEY).agg(
        F.avg(last12).alias("mean_12"),
        F.stddev_pop(last12).alias("std_12"),
        F.coalesce(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("t"))), F.lit(20.0)).alias("previous"),
        F.when(F.max("n") >= 12, slope_agg(last12, x)).otherwise(0.0).alias("slope_12"),
        F.max("lat").alias("lat"),
        F.max("lon").alias("lon"),
    )
    return recent.withColumns(
        {"time_norm": F.lit(0.8), **_cycle(F.lit(month), "phase"), **_place()}
    ).select(*KEY, *PANEL_COLUMNS)


def training_panel(series: DataFrame, locations: DataFrame, variable: str = "temperature") -> DataFrame:
    """Panel features of all locations with their names and a named target."""
    names = locations.select(
        F.col("id").alias("location_id"), F.col("name").alias("location_name"), "lat", "lon"
    )
    # one row per place: AQE broadcasts them while they are small
    placed = series.filter(F.col("variable") == variable).select(*KEY, "t", "value").join(names, "location_id")
    return panel_features(placed, keep=("location_name", "lat", "lon")).withColumnRenamed("value", "target")

"""Rolling windows and lags over the series order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.functions.numeric import ratio
from isohyet.functions.ols import slope_agg
from isohyet.series import KEY, PERIOD, by_series, in_time_order, months_of, with_length


def rows(first: int, last: int):
    return in_time_order().rowsBetween(first, last)


def lag_columns(count: int = PERIOD, first: int = 1) -> dict[str, Column]:
    w = in_time_order()
    return {f"lag_{k}": F.lag("value", k).over(w) for k in range(first, first + count)}


def lag_features(df: DataFrame, count: int = PERIOD) -> DataFrame:
    return df.withColumns(lag_columns(count))


def stats_columns(first: int, last: int, suffix: str) -> dict[str, Column]:
    w = rows(first, last)
    return {
        f"mean_{suffix}": F.avg("value").over(w),
        f"std_{suffix}": F.stddev_pop("value").over(w),
        f"range_{suffix}": F.max("value").over(w) - F.min("value").over(w),
    }


def rolling_stats(df: DataFrame) -> DataFrame:
    """Statistics of the periods before each one, from the second year on."""
    return df.withColumns(
        {
            **stats_columns(-12, -1, "12"),
            "mean_6": F.avg("value").over(rows(-6, -1)),
            "previous": F.lag("value").over(in_time_order()),
        }
    ).filter(F.col("t") >= 12)


def slope_column(width: int) -> Column:
    """Slope over the ``width`` rows before each one."""
    v, t = F.col("value"), F.col("t").cast("double")
    w = rows(-width, -1)
    return ratio(F.regr_sxy(v, t).over(w), F.regr_sxx(v, t).over(w))


def from_second_cycle(c: Column, start: int = 24) -> Column:
    return F.when(F.col("t") >= start, F.coalesce(c, F.lit(0.0))).otherwise(0.0)


def rolling_slope(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "slope_12": from_second_cycle(slope_column(12)),
            "slope_24": from_second_cycle(slope_column(24)),
        }
    )


def moving_average(df: DataFrame, windows: Sequence[int] = (3, 6, 12)) -> DataFrame:
    """Trailing means, NULL until the window is complete."""
    return df.withColumns(
        {
            f"ma_{w}": F.when(F.col("t") >= w - 1, F.avg("value").over(rows(-(w - 1), 0)))
            for w in windows
        }
    )


def seasonal_decompose(df: DataFrame, period: int = PERIOD, edges: str = "zero") -> DataFrame:
    """Trend, seasonal and residual parts; series shorter than two cycles are dropped.

    ``edges="zero"`` divides by ``period`` even where the window is cut off;
    ``edges="null"`` leaves those trends NULL.
    """
    back = period // 2
    w = rows(-back, period - back - 1)
    trend = F.sum("value").over(w) / period
    if edges == "null":
        trend = F.when(F.count(F.lit(1)).over(w) == period, trend)
    out = with_length(df).filter(F.col("n") >= 2 * period).withColumn("trend", trend)
    phase = by_series(F.col("t") % period)
    out = out.withColumn("seasonal", F.avg(F.col("value") - F.col("trend")).over(phase))
    return out.withColumn("residual", F.col("value") - F.col("trend") - F.col("seasonal")).drop("n")


def autocorrelation(df: DataFrame, max_lag: int = 24) -> DataFrame:
    """Pearson correlation with the own past, 0 where it is undefined."""
    w = in_time_order()
    pairs = F.array(
        *[
            F.struct(F.lit(k).alias("lag"), F.lag("value", k).over(w).alias("x"))
            for k in range(1, max_lag + 1)
        ],
        F.struct(F.lit(0).alias("lag"), F.col("value").alias("x")),
    )
    rows_ = df.select(*KEY, "value", pairs.alias("_p")).select(*KEY, "value", F.inline("_p"))
    both = F.col("value").isNotNull() & F.col("x").isNotNull()
    x, y = F.when(both, F.col("x")), F.when(both, F.col("value"))
    out = rows_.groupBy(*KEY, "lag").agg(
        ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("_r")
    )
    r = F.when(F.col("lag") == 0, 1.0).otherwise(F.coalesce("_r", F.lit(0.0)))
    return out.select(*KEY, "lag", r.alias("autocorrelation")).withColumn(
        "significant", F.abs("autocorrelation") > 0.2
    )


def gradient(df: DataFrame) -> DataFrame:
    """Central differences, one-sided at both ends."""
    w = in_time_order()
    before, after, v = F.lag("value").over(w), F.lead("value").over(w), F.col("value")
    first, last = F.col("t") == 0, F.col("t") == F.col("n") - 1
    g = F.when(first, after - v).when(last, v - before).otherwise((after - before) / 2)
    return with_length(df).withColumn("gradient", g).drop("n")


def yoy_column(period: int = PERIOD) -> Column:
    w = in_time_order()
    return from_second_cycle(F.lag("value", 1).over(w) - F.lag("value", period + 1).over(w), 2 * period)


def yoy_change(df: DataFrame, period: int = PERIOD) -> DataFrame:
    return df.withColumn("yoy", yoy_column(period))


def last_year_columns() -> dict[str, Column]:
    """Lags 13-15 and the three months ending a year before the previous one."""
    cols = {
        f"lag_{k}": F.when(F.col("t") >= 15, F.lag("value", k).over(in_time_order())).otherwise(0.0)
        for k in (13, 14, 15)
    }
    for name, c in stats_columns(-14, -12, "3ly").items():
        cols[name] = F.when(F.col("t") >= 14, c).otherwise(0.0)
    return cols


def lag13_15(df: DataFrame) -> DataFrame:
    return df.withColumns(last_year_columns())


def seasonal_adjusted_subset(df: DataFrame, month: int, adjust: bool = True, period: int = PERIOD) -> DataFrame:
    """Same-month values; a clear trend over them is added once more per step.

    The double counting is the documented default; ``adjust=False`` keeps the
    plain values.
    """
    valid = months_of(df, month, period).filter(F.col("value").isNotNull())
    ranked = valid.withColumns(
        {"k": F.row_number().over(in_time_order()) - 1, "_n": F.count(F.lit(1)).over(by_series())}
    )
    slope = slope_agg_over(F.col("value"), F.col("k").cast("double"))
    out = ranked.withColumn("_slope", slope)
    moved = F.when(
        (F.col("_n") > 5) & (F.abs("_slope") > 0.01), F.col("value") + F.col("_slope") * F.col("k")
    ).otherwise(F.col("value"))
    return out.select(*KEY, "t", "k", (moved if adjust else F.col("value")).alias("value"))


def slope_agg_over(y: Column, x: Column) -> Column:
    g = by_series()
    return ratio(F.regr_sxy(y, x).over(g), F.regr_sxx(y, x).over(g))


def holdout_split(df: DataFrame, holdout: int = 12) -> DataFrame:
    """Flag the last ``holdout`` periods of each series."""
    return with_length(df).withColumn("is_holdout", F.col("t") >= F.col("n") - holdout).drop("n")



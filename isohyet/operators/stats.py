"""Descriptive statistics per series: one shuffle on the series key each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.functions.numeric import clamp, mean_to, percentile, ratio
from isohyet.series import KEY, PERIOD, by_series, in_time_order, whole_years, with_length

PERCENTILES = (5, 10, 25, 50, 75, 90, 95)
RECENT = 120


def percentiles(
    df: DataFrame, ps: Sequence[float] = PERCENTILES, keys: Sequence[str] = KEY, exact: bool = True
) -> DataFrame:
    """Columns p5, p10, ...  ``exact=False`` bounds the state of very long series."""
    shares = [p / 100.0 for p in ps]
    q = percentile("value", *ps) if exact else F.percentile_approx("value", shares, 10_000)
    out = df.groupBy(*keys).agg(q.alias("_q"))
    return out.select(*keys, *[F.col("_q")[i].alias(f"p{p:g}") for i, p in enumerate(ps)])


def describe_columns(value: Column | str = "value") -> list[Column]:
    v = F.col(value) if isinstance(value, str) else value
    return [
        F.avg(v).alias("mean"),
        F.percentile(v, F.lit(0.5)).alias("median"),
        F.stddev_pop(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.skewness(v).alias("skewness"),
        F.kurtosis(v).alias("kurtosis"),
        percentile(v, *PERCENTILES).alias("_q"),
    ]


def describe_series(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    out = df.groupBy(*keys).agg(*describe_columns())
    return out.select(
        *keys,
        *["mean", "median", "std", "min", "max", "skewness", "kurtosis"],
        *[F.col("_q")[i].alias(f"p{p}") for i, p in enumerate(PERCENTILES)],
    )


def with_quantiles(df: DataFrame, *ps: float) -> DataFrame:
    """Quantiles of the series next to every row, as p5, p10, ..."""
    q = percentile("value", *ps).over(by_series())
    out = df.withColumn("_q", q)
    return out.withColumns({f"p{p:g}": F.col("_q")[i] for i, p in enumerate(ps)}).drop("_q")


def iqr_bounds(df: DataFrame) -> DataFrame:
    out = with_quantiles(df, 25, 75)
    iqr = F.col("p75") - F.col("p25")
    return out.withColumns(
        {
            "iqr": iqr,
            "lower_bound": F.col("p25") - 1.5 * iqr,
            "upper_bound": F.col("p75") + 1.5 * iqr,
        }
    )


def robust_stats(df: DataFrame) -> DataFrame:
    v = F.col("value")
    return (
        iqr_bounds(df)
        .groupBy(*KEY)
        .agg(
            F.max("iqr").alias("iqr"),
            F.avg(F.when(v.between(F.col("lower_bound"), F.col("upper_bound")), v)).alias("robust_mean"),
            F.coalesce(ratio(F.stddev_pop(v), F.avg(v)), F.when(F.avg(v) == 0, 0.0)).alias(
                "coefficient_of_variation"
            ),
        )
    )


def strongest_points(df: DataFrame) -> DataFrame:
    """Periods of each series' largest and smallest value, the first of equals; null where a series has no value."""
    v = F.col("value")
    known = lambda score: F.when(v.isNotNull(), score)
    return df.groupBy(*KEY).agg(
        F.max_by("t", known(F.struct(v, -F.col("t")))).alias("largest_at"),
        F.min_by("t", known(F.struct(v, F.col("t")))).alias("smallest_at"),
    )


def return_periods(df: DataFrame, values: Sequence[float]) -> DataFrame:
    """How many periods pass, on average, until each value is reached again."""
    v = F.col("value")
    counted = df.groupBy(*KEY).agg(
        F.count(v).alias("_n"),
        *[F.count_if(v >= x).alias(f"_c{i}") for i, x in enumerate(values)],
    )
    rows = F.array(
        *[
            F.struct(F.lit(float(x)).alias("level"), (F.col(f"_c{i}") + 1).alias("rank"))
            for i, x in enumerate(values)
        ]
    )
    return counted.select(*KEY, "_n", F.inline(rows)).select(
        *KEY, "level", (F.col("_n") / F.col("rank")).alias("return_period")
    )


def outliers_iqr(df: DataFrame) -> DataFrame:
    """The outlying rows; see :func:`outliers_iqr_summary` for the counts."""
    v = F.col("value")
    return iqr_bounds(df).filter((v < F.col("lower_bound")) | (v > F.col("upper_bound"))).select(
        *KEY, "t", "value", "lower_bound", "upper_bound"
    )


def outliers_iqr_summary(df: DataFrame) -> DataFrame:
    v = F.col("value")
    out = (v < F.col("lower_bound")) | (v > F.col("upper_bound"))
    return iqr_bounds(df).groupBy(*KEY).agg(
        F.count_if(out).alias("outlier_count"),
        (ratio(F.count_if(out), F.count(v)) * 100).alias("outlier_percentage"),
        F.max("lower_bound").alias("lower_bound"),
        F.max("upper_bound").alias("upper_bound"),
    )


def outliers_zscore(df: DataFrame, threshold: float = 3.0) -> DataFrame:
    g = by_series()
    z = ratio(F.col("value") - F.avg("value").over(g), F.stddev_pop("value").over(g))
    return df.withColumn("zscore", z).filter(F.abs("zscore") > threshold).select(
        *KEY, "t", "value", "zscore"
    )


# fixed values: condition names by variable, with the percentile they compare to
CONDITIONS = {
    "temperature": [("above_very_hot", 95), ("above_hot", 90), ("below_cold", 10), ("below_very_cold", 5)],
    "precipitation": [("above_heavy_rain", 90), ("above_very_heavy_rain", 95), ("below_dry", 10)],
    "wind_speed": [("above_windy", 90), ("above_very_windy", 95)],
}
OTHER_CONDITIONS = [("above_high", 90), ("above_very_high", 95), ("below_low", 10), ("below_very_low", 5)]


def _conditions_of(variable: Column) -> Column:
    """array<struct<condition, threshold, probability>> for the row's variable."""

    def rows(conditions):
        return F.array(
            *[
                F.struct(
                    F.lit(name).alias("condition"),
                    F.col(f"p{p}").alias("threshold"),
                    F.col(f"_share{p}").alias("probability"),
                )
                for name, p in conditions
            ]
        )

    out = None
    for name, conditions in CONDITIONS.items():
        hit = variable == name
        out = F.when(hit, rows(conditions)) if out is None else out.when(hit, rows(conditions))
    return out.otherwise(rows(OTHER_CONDITIONS))


def exceedance_probabilities(seasonal: DataFrame) -> DataFrame:
    """Percent of values beyond the series' own extremes, one row per condition."""
    v = F.col("value")
    ps = (5, 10, 90, 95)
    shares = [
        (F.avg((v > F.col(f"p{p}") if p >= 90 else v < F.col(f"p{p}")).cast("double")) * 100).alias(
            f"_share{p}"
        )
        for p in ps
    ]
    wide = with_quantiles(seasonal, *ps).groupBy(*KEY).agg(
        *[F.max(f"p{p}").alias(f"p{p}") for p in ps], *shares
    )
    return wide.select(*KEY, F.inline(_conditions_of(F.col("variable"))))


def adjust_probabilities(probabilities: DataFrame, predictions: DataFrame, seasonal: DataFrame) -> DataFrame:
    """Shift temperature extremes towards a prediction, then bound the total.

    ``predictions`` has ``prediction`` and ``confidence`` per series; a series without
    one keeps its probabilities.
    """
    quantiles = percentiles(seasonal, (10, 90, 95))
    p, c = F.col("prediction"), F.col("condition")
    # fixed values: percentage points by how extreme the prediction is
    points = (
        F.when(
            p > F.col("p95"),
            F.when(c == "above_very_hot", 25.0).when(c == "above_hot", 15.0),
        )
        .when(
            p > F.col("p90"),
            F.when(c == "above_very_hot", 10.0).when(c == "above_hot", 20.0),
        )
        .when(
            p < F.col("p10"),
            F.when(c == "below_cold", 20.0).when(c == "below_very_cold", 15.0),
        )
    )
    shifted = (
        probabilities.join(predictions.select(*KEY, "prediction", "confidence"), KEY, "left")
        .join(quantiles, KEY, "left")
        .withColumn(
            "_raw", F.col("probability") + F.coalesce(points * F.col("confidence"), F.lit(0.0))
        )
    )
    total = F.sum("_raw").over(by_series())
    scaled = F.when(total > 80, F.col("_raw") * 80.0 / total).otherwise(F.col("_raw"))
    return shifted.select(
        *KEY, "condition", F.greatest(F.lit(0.1), scaled).alias("probability")
    )


def extreme_frequency(df: DataFrame) -> DataFrame:
    v = F.col("value")
    return with_quantiles(df, 5, 95).groupBy(*KEY).agg(
        (F.avg((v > F.col("p95")).cast("double")) * 100).alias("hot_extremes_percent"),
        (F.avg((v < F.col("p5")).cast("double")) * 100).alias("cold_extremes_percent"),
        F.max("p95").alias("extreme_threshold_hot"),
        F.max("p5").alias("extreme_threshold_cold"),
    )


def seasonal_profile(df: DataFrame, period: int = PERIOD) -> DataFrame:
    """Amplitude and extreme months of the mean year; the spread is the whole series'."""
    spread = F.stddev_pop("value").over(by_series())
    months = (
        whole_years(df.withColumn("_std", spread), period)
        .withColumn("month", (F.col("t") % period + 1).cast("int"))
        .groupBy(*KEY, "month")
        .agg(F.avg("value").alias("mean"), F.max("_std").alias("_std"))
    )
    mean, month = F.col("mean"), F.col("month")
    out = months.groupBy(*KEY).agg(
        (F.max(mean) - F.min(mean)).alias("amplitude"),
        F.max_by(month, F.when(mean.isNotNull(), F.struct(mean, -month))).alias("peak_month"),
        F.min_by(month, F.when(mean.isNotNull(), F.struct(mean, month))).alias("trough_month"),
        F.max("_std").alias("_std"),
    )
    amp, std = F.col("amplitude"), F.col("_std")
    return out.select(
        *KEY,
        "amplitude",
        "peak_month",
        "trough_month",
        F.when(amp > std, "high").when(amp > std / 2, "moderate").otherwise("low").alias(
            "seasonality_strength"
        ),
    )


def annual_means(df: DataFrame, period: int = PERIOD) -> DataFrame:
    return (
        whole_years(df, period)
        .groupBy(*KEY, F.floor(F.col("t") / period).cast("int").alias("year"))
        .agg(F.avg("value").alias("annual_mean"))
    )


def interannual_variability(df: DataFrame, period: int = PERIOD) -> DataFrame:
    return annual_means(df, period).groupBy(*KEY).agg(
        F.count("annual_mean").alias("years"),
        F.when(F.count("annual_mean") > 1, F.stddev_pop("annual_mean"))
        .otherwise(0.0)
        .alias("interannual"),
    )


def decade_stats(records: DataFrame) -> DataFrame:
    """Per location and decade from side-by-side monthly records."""
    decade = (F.floor(F.col("year") / 10) * 10).cast("int").alias("decade")
    temp, rain = F.col("temperature_c"), F.col("precipitation_mm")
    return (
        records.groupBy("location_id", decade)
        .agg(
            mean_to(temp, 2).alias("avg_temperature"),
            F.coalesce(mean_to(rain, 2), F.lit(0.0)).alias("avg_precipitation"),
            F.count(temp).alias("months_count"),
        )
        .filter(F.col("months_count") > 0)
        .withColumn(
            "year_range",
            F.format_string("%d-%d", F.col("decade"), F.col("decade") + 9),
        )
    )


def warming_between_decades(decades: DataFrame, years_span: int) -> DataFrame:
    out = decades.groupBy("location_id").agg(
        F.count(F.lit(1)).alias("decades"),
        (F.max_by("avg_temperature", "decade") - F.min_by("avg_temperature", "decade")).alias("_change"),
    )
    enough = F.col("decades") >= 2
    change = F.col("_change")
    return out.select(
        "location_id",
        "decades",
        F.when(enough, F.bround(change, 2)).alias("temperature_change"),
        F.when(enough, F.bround(change / years_span, 3)).alias("warming_rate"),
        F.when(
            enough,
            F.format_string(
                "%s%.2f°C over %d years (%.3f°C/year)",
                F.when(change > 0, "+").otherwise(""),
                F.bround(change, 2),
                F.lit(years_span),
                F.bround(change / years_span, 3),
            ),
        )
        .otherwise("N/A")
        .alias("warming_trend"),
    )


def quality_rating(percent: Column) -> Column:
    return F.when(percent > 95, "EXCELLENT").when(percent > 90, "GOOD").otherwise("FAIR")


def completeness(df: DataFrame, expected: int | None = None) -> DataFrame:
    """Share of expected periods that have a value; expected defaults to the span."""
    total = F.lit(expected) if expected else F.max("t") + 1
    out = df.groupBy(*KEY).agg(F.count("value").alias("points"), total.cast("int").alias("expected"))
    percent = F.col("points") / F.col("expected") * 100
    return out.withColumns({"completeness": percent, "rating": quality_rating(percent)})


def range_statistics(df: DataFrame) -> DataFrame:
    """Rounded range statistics; the total only makes sense for precipitation."""
    v = F.col("value")
    two = lambda c: F.bround(c, 2)
    rainy = F.col("variable") == "precipitation"
    return df.groupBy(*KEY).agg(
        two(F.min(v)).alias("min"),
        two(F.max(v)).alias("max"),
        two(F.avg(v)).alias("mean"),
        two(F.percentile(v, F.lit(0.5))).alias("median"),
        two(F.stddev_pop(v)).alias("std_deviation"),
        F.when(rainy, two(F.sum(v))).alias("total"),
        F.count(v).alias("data_points"),
    )


def recency_weighted_mean(df: DataFrame) -> DataFrame:
    """Weights rise exponentially from exp(-1) for the oldest value to 1."""
    w = in_time_order()
    valid = df.filter(F.col("value").isNotNull()).withColumns(
        {"_i": F.row_number().over(w) - 1, "_k": F.count(F.lit(1)).over(by_series())}
    )
    weight = F.exp(F.coalesce(ratio(F.col("_i"), F.col("_k") - 1), F.lit(0.0)) - 1.0)
    return valid.groupBy(*KEY).agg(
        ratio(F.sum(weight * F.col("value")), F.sum(weight)).alias("weighted_mean")
    )


def temperature_indicators(df: DataFrame, period: int = PERIOD, recent: int = RECENT) -> DataFrame:
    v = F.col("value")
    late = F.col("t") >= F.col("n") - recent
    rows = with_length(with_quantiles(df, 10, 90))
    spread = rows.groupBy(*KEY).agg(
        (F.avg(F.when(late, (v > F.col("p90")).cast("double"))) * 100).alias("recent_hot_percent"),
        (F.avg(F.when(late, (v < F.col("p10")).cast("double"))) * 100).alias("recent_cold_percent"),
        (F.stddev_pop(F.when(late, v)) - F.stddev_pop(F.when(~late, v))).alias("variability_change"),
    )
    y, x = F.col("annual_mean"), F.col("year")
    warming = annual_means(df, period).groupBy(*KEY).agg(
        (ratio(F.regr_sxy(y, x), F.regr_sxx(y, x)) * 10).alias("warming_rate_per_decade")
    )
    return warming.join(spread, KEY)


def recent_change(df: DataFrame, share_above: Column, recent: int = RECENT) -> DataFrame:
    """Change of spread and of the share above a level, last ``recent`` vs earlier."""
    v = F.col("value")
    late = F.col("t") >= F.col("n") - recent
    above = (v > share_above).cast("double")
    return with_length(df).groupBy(*KEY).agg(
        (F.stddev_pop(F.when(late, v)) - F.stddev_pop(F.when(~late, v))).alias("variability_change"),
        (F.avg(F.when(late, above)) - F.avg(F.when(~late, above))).alias("share_change"),
    )


def precipitation_indicators(df: DataFrame, recent: int = RECENT) -> DataFrame:
    from isohyet.operators.events import dry_spell_frequency

    wet = F.percentile(F.when(F.col("value") > 0, F.col("value")), F.lit(0.75)).over(by_series())
    rows = df.withColumn("_wet", F.coalesce(wet, F.lit(1.0)))
    change = recent_change(rows, F.col("_wet"), recent).select(
        *KEY,
        (F.col("share_change") * 100).alias("intense_precipitation_change"),
        F.col("variability_change").alias("precipitation_variability_change"),
    )
    return change.join(dry_spell_frequency(df, recent), KEY)


def general_indicators(df: DataFrame, recent: int = RECENT) -> DataFrame:
    return recent_change(with_quantiles(df, 95), F.col("p95"), recent).select(
        *KEY,
        "variability_change",
        F.col("share_change").alias("extreme_frequency_change"),
    )


def error_metrics(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """MAE, RMSE, MAPE, R² and skill of ``prediction`` against ``actual``."""
    a, e = F.col("actual"), F.col("prediction") - F.col("actual")
    both = df.filter(F.col("actual").isNotNull() & F.col("prediction").isNotNull())
    out = both.groupBy(*keys).agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(F.abs(ratio(e, a))) * 100).alias("mape"),
        (1.0 - ratio(F.avg(e * e), F.var_pop(a))).alias("r_squared"),
        F.stddev_pop(a).alias("_std"),
    )
    return out.select(
        *keys,
        "mae",
        "rmse",
        "mape",
        "r_squared",
        F.greatest(F.lit(0.0), 1.0 - ratio(F.col("rmse"), F.col("_std"))).alias("skill"),
        F.greatest(F.lit(0.0), (1.0 - ratio(F.col("mae"), F.col("_std"))) * 100).alias("accuracy"),
    )


def skill_score(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Skill against always predicting the training mean (``baseline`` column)."""
    a = F.col("actual")
    e = F.col("prediction") - a
    out = df.groupBy(*keys).agg(
        F.avg(F.abs(e)).alias("model_mae"),
        F.avg(F.abs(a - F.col("baseline"))).alias("baseline_mae"),
        (1.0 - ratio(F.avg(e * e), F.var_pop(a))).alias("r_squared"),
    )
    skill = F.coalesce(
        ratio(F.col("baseline_mae") - F.col("model_mae"), F.col("baseline_mae")), F.lit(0.0)
    )
    return out.withColumn("skill", skill).withColumns(
        {
            "accuracy": clamp(F.col("skill") * 100, 20.0, 98.0),
            "confidence": clamp(F.col("r_squared"), 0.50, 0.98),
        }
    )

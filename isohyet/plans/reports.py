"""Reports composed from the operators, one row per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.functions.labels import up_or_down
from isohyet.functions.numeric import mean_to, percentile
from isohyet.functions.ols import fit
from isohyet.functions.zones import climate_zone
from isohyet.operators import changepoints, events, forecast, resample, rolling, stats, trends
from isohyet.plans.base import as_map, materialise, one_row_per_series, prefixed
from isohyet.series import KEY, PERIOD, with_length
from isohyet.sources.exports import fingerprint, monthly_records


def summary_report(df: DataFrame, period: int = PERIOD) -> DataFrame:
    """Key statistics with a simple trend: one aggregate over each series."""
    v = F.col("value")
    aggs, line = fit(v, F.col("t").cast("double"))
    out = df.groupBy(*KEY).agg(
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std_deviation"),
        F.min(v).alias("minimum"),
        F.max(v).alias("maximum"),
        F.count(v).alias("data_points"),
        percentile(v, 10, 25, 50, 75, 90).alias("_q"),
        *aggs,
    )
    yearly = line.slope * period
    enough = F.col("data_points") > 24
    return out.select(
        *KEY,
        "mean",
        F.col("_q")[2].alias("median"),
        *["std_deviation", "minimum", "maximum", "data_points"],
        *[F.col("_q")[i].alias(f"p{p}") for i, p in ((0, 10), (1, 25), (3, 75), (4, 90))],
        F.when(enough, yearly).alias("annual_trend"),
        F.when(enough, up_or_down(yearly)).alias("trend_direction"),
        F.when(
            enough,
            F.when(F.abs(yearly) > 0.1 * F.col("std_deviation"), "significant").otherwise("minimal"),
        ).alias("trend_magnitude"),
    )


def climate_patterns(series: DataFrame) -> DataFrame:
    return one_row_per_series(
        stats.seasonal_profile(series),
        stats.interannual_variability(series).select(*KEY, "interannual"),
        stats.extreme_frequency(series),
    )


def weather_probability(
    series: DataFrame,
    month: int,
    predictions: DataFrame | None = None,
    replicates: int = 100,
    shared: bool = False,
) -> DataFrame:
    """Everything known about one calendar month of every series.

    ``series`` has lat and lon per row.  ``predictions`` (prediction,
    confidence, prediction_std) default to the trend-adjusted seasonal
    forecast; pass the MLlib ensemble's for the trained mode.  ``shared`` says
    that ``series`` is already materialised.
    """
    base = series if shared else materialise(series, "lat", "lon")
    seasonal = rolling.seasonal_adjusted_subset(base, month)
    if predictions is None:
        predictions = forecast.trend_adjusted_forecast(base, month)
    place = with_length(base).groupBy(*KEY).agg(
        F.max("lat").alias("lat"), F.max("lon").alias("lon"), F.max("n").alias("periods")
    )
    probabilities = stats.adjust_probabilities(
        stats.exceedance_probabilities(seasonal), predictions, seasonal
    )
    linear = trends.linear_trend(base)
    mk = trends.mann_kendall(base, slope=False)
    sample = seasonal.groupBy(*KEY).agg(F.count("value").alias("sample_size"))
    seasons = trends.seasonal_trends(base, min_years=3)
    out = one_row_per_series(
        place.withColumn("climate_zone", climate_zone(F.col("lat"))),
        stats.describe_series(seasonal),
        stats.robust_stats(seasonal),
        predictions.select(*KEY, "prediction", F.col("confidence").alias("prediction_confidence")),
        as_map(probabilities, "condition", "probability", "extreme_probabilities"),
        prefixed(mk, "mk_", "trend_direction", "is_significant", "p_value", "tau", "z_statistic"),
        prefixed(linear, "lr_", "slope_per_year", "r_squared", "p_value", "standard_error", "trend_strength"),
        prefixed(trends.quadratic_label(base), "poly_", "trend_type", "acceleration", "curvature_significant"),
        as_map(seasons, "season", "slope_per_year", "seasonal_slopes"),
        prefixed(changepoints.cusum(base), "cusum_", "change_point_detected", "change_point_index", "change_magnitude"),
        prefixed(changepoints.rolling_zscore_change(base), "rolling_", "change_point_detected", "change_point_index"),
        prefixed(changepoints.variance_halves(base), "halves_", "variance_ratio", "variance_change_detected"),
        forecast.uncertainty(seasonal, resample.bootstrap_trend(base, replicates)).select(
            *KEY, "trend_uncertainty", "seasonal_uncertainty", "total_uncertainty", "uncertainty_level",
            "lower_68", "upper_68", "lower_95", "upper_95",
        ),
        climate_patterns(base),
        sample,
    )
    years = F.greatest(F.lit(1), F.floor(F.col("periods") / PERIOD))
    return out.withColumns(
        {
            "trend_description": trends.trend_description(
                F.col("mk_trend_direction"), F.col("lr_slope_per_year"), F.col("lr_trend_strength")
            ),
            "completeness": F.col("sample_size") / years * 100,
            "data_span_years": F.floor(F.col("periods") / PERIOD),
        }
    )


def climate_trends(series: DataFrame, mode: str = "full", ml: DataFrame | None = None, shared: bool = False) -> DataFrame:
    """Trend report per series; ``fast`` skips polynomials and scans.

    ``ml`` optionally holds ensemble_direction and ensemble_confidence from
    the trained direction models.  Series under 60 points only get a status.
    """
    base = series if shared else materialise(series, "lat", "lon")
    counted = base.groupBy(*KEY).agg(F.count("value").alias("points"), F.max("lat").alias("lat"))
    linear = trends.linear_trend(base)
    mk = trends.mann_kendall(base)
    frames = [
        counted,
        prefixed(mk, "mk_", "trend_direction", "is_significant", "p_value", "tau", "sen_slope", "confidence"),
        prefixed(linear, "lr_", "slope_per_year", "r_squared", "p_value", "trend_strength"),
        as_map(trends.seasonal_trends(base), "season", "slope_per_year", "seasonal_slopes"),
        prefixed(trends.decadal_comparison(base), "decadal_", "difference", "p_value", "is_significantly_different"),
        trends.project_linear(base),
        events.zone_context(base),
    ]
    poly_r2: Column | None = None
    change: Column | None = None
    if mode == "full":
        frames += [
            trends.best_polynomial(trends.poly_trend(base)),
            prefixed(changepoints.cusum(base, 2.5), "cusum_", "change_point_detected", "change_point_index"),
            prefixed(changepoints.variance_scan(base), "variance_", "change_detected", "variance_ratio"),
            prefixed(changepoints.mean_shift_scan(base), "shift_", "shift_detected", "shift_index", "shift_magnitude"),
            prefixed(changepoints.trend_change_scan(base), "slope_", "trend_change_detected", "change_index"),
            prefixed(changepoints.chow_scan(base), "chow_", "structural_break_detected", "break_point"),
        ]
        poly_r2, change = F.col("best_r_squared"), F.col("cusum_change_point_detected")
    if ml is not None:
        frames.append(prefixed(ml, "ml_", "ensemble_direction", "ensemble_confidence"))
    out = one_row_per_series(*frames)
    ml_conf = F.col("ml_ensemble_confidence") if ml is not None else None
    enough = F.col("points") >= 60
    text = trends.trend_summary_text(
        F.col("variable"),
        F.col("mk_is_significant"),
        F.col("mk_trend_direction"),
        F.col("mk_confidence"),
        F.col("lr_slope_per_year"),
        F.col("lr_trend_strength"),
        change,
        F.col("ml_ensemble_direction") if ml is not None else None,
        ml_conf,
    )
    score = trends.trend_confidence(
        F.col("mk_is_significant"), F.col("mk_p_value"), F.col("lr_r_squared"), ml_conf, poly_r2
    )
    return out.withColumns(
        {
            "status": F.when(enough, "ok").otherwise("insufficient_data"),
            "summary": F.when(enough, text).otherwise("Insufficient data for trend analysis"),
            "confidence_score": F.when(enough, score),
        }
    )


def climate_indicators(series: DataFrame) -> DataFrame:
    """Indicators by variable as rows (name, value); needs lat per row.

    Each variable's own branch is filtered first, so nothing is computed for
    series it does not apply to.
    """
    of = lambda v: series.filter(F.col("variable") == v)

    def melt(df: DataFrame) -> DataFrame:
        names = [c for c in df.columns if c not in KEY]
        rows = F.array(*[F.struct(F.lit(c).alias("indicator"), F.col(c).cast("double").alias("value")) for c in names])
        return df.select(*KEY, F.inline(rows))

    hot = events.zone_temperature_indicators(of("temperature")).select(
        *KEY, "hot_periods", "cold_periods", "heat_waves", "cold_spells"
    )
    wet = events.zone_precipitation_indicators(of("precipitation")).drop("zone")
    other = series.filter(~F.col("variable").isin("temperature", "precipitation"))
    return (
        melt(stats.temperature_indicators(of("temperature")).join(hot, KEY))
        .unionByName(melt(stats.precipitation_indicators(of("precipitation")).join(wet, KEY)))
        .unionByName(melt(stats.general_indicators(other)))
    )


def attach_trends(probabilities: DataFrame, trend: DataFrame) -> DataFrame:
    """Trend columns next to probabilities, with neutral defaults where absent."""
    joined = probabilities.join(
        trend.select(*KEY, "slope_per_year", "p_value", "trend_strength"), KEY, "left"
    )
    return joined.withColumns(
        {
            "slope_per_year": F.coalesce("slope_per_year", F.lit(0.0)),
            "p_value": F.coalesce("p_value", F.lit(1.0)),
            "trend_strength": F.coalesce("trend_strength", F.lit("unknown")),
        }
    )


def simple_summary(probability: DataFrame, skill: DataFrame, years_back: int, request_year: int) -> DataFrame:
    """Flat, worded result per series; accuracy is the skill score."""
    joined = probability.join(skill.select(*KEY, "accuracy", F.col("confidence").alias("_c")), KEY, "left")
    return joined.select(
        *KEY,
        F.bround("mean", 2).alias("prediction_value"),
        F.bround(F.coalesce("_c", F.lit(0.5)) * 100, 1).alias("confidence"),
        F.format_string("%.1f%%", F.coalesce("accuracy", F.lit(50.0))).alias("accuracy_text"),
        F.lit(f"{years_back * 12} months").alias("data_points"),
        F.lit(f"{request_year - years_back}-{request_year - 1}").alias("training_period"),
    )


def verify_report(series: DataFrame, start_year: int, end_year: int) -> DataFrame:
    """Completeness, statistics, decades and warming per location."""
    years = end_year - start_year + 1
    records = monthly_records(series, start_year)
    decades = stats.decade_stats(records)
    warming = stats.warming_between_decades(decades, years)
    t, p = F.col("temperature_c"), F.col("precipitation_mm")
    two = lambda c: F.bround(c, 2)
    facts = records.groupBy("location_id").agg(
        F.count(t).alias("points"),
        two(F.min(t)).alias("temp_min"),
        two(F.max(t)).alias("temp_max"),
        mean_to(t, 2).alias("temp_mean"),
        two(F.percentile(t, F.lit(0.5))).alias("temp_median"),
        two(F.stddev_pop(t)).alias("temp_std"),
        F.coalesce(two(F.sum(p)), F.lit(0.0)).alias("rain_total"),
    )
    percent = F.col("points") / (years * 12) * 100
    prints = fingerprint(
        series.filter(F.col("variable").isin("temperature", "precipitation")).withColumn(
            "t", F.col("t") * 2 + (F.col("variable") == "precipitation").cast("int")
        ),
        ("location_id",),
    )
    return (
        facts.join(warming, "location_id", "left")
        .join(prints, "location_id")
        .filter(F.col("points") > 0)
        .withColumns(
            {
                "completeness": percent,
                "quality_rating": stats.quality_rating(percent),
                "sufficient_for_ml": F.lit(years >= 20),
                "recommendation": F.lit(
                    "long enough to train on" if years >= 30 else f"{30 - years} more years wanted for training"
                ),
            }
        )
    )

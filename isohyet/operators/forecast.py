"""Deterministic forecasts, their blends and their uncertainty."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isohyet.functions.numeric import ratio
from isohyet.functions.ols import slope_agg
from isohyet.functions.zones import climate_zone, latitude_climatology
from isohyet.operators.stats import error_metrics
from isohyet.operators.trends import linear_trend
from isohyet.series import KEY, PERIOD, by_series, in_time_order, whole_years, with_length

Z95, Z80 = 1.96, 1.28


def _in_month(month: int, period: int) -> Column:
    whole = F.col("t") < F.floor(F.col("n") / period) * period
    return F.when(whole & (F.col("t") % period + 1 == month), F.col("value"))


def seasonal_mean_forecast(df: DataFrame, month: int, period: int = PERIOD) -> DataFrame:
    """Mean of the same month in whole years, else of everything."""
    m = _in_month(month, period)
    found = F.count(m) > 0
    return with_length(df).groupBy(*KEY).agg(
        F.when(found, F.avg(m)).otherwise(F.avg("value")).alias("prediction"),
        F.when(found, 0.65).otherwise(0.40).alias("confidence"),
        F.when(found, F.stddev_pop(m)).otherwise(F.stddev_pop("value")).alias("prediction_std"),
        F.when(found, "statistical_fallback").otherwise("overall_mean_fallback").alias("method"),
    )


def trend_adjusted_forecast(df: DataFrame, month: int, period: int = PERIOD) -> DataFrame:
    """Last same-month value plus its trend per year; the mean when there are few."""
    g = by_series()
    rows = with_length(df).withColumn("_m", _in_month(month, period))
    rows = rows.withColumn("_k", F.when(F.col("_m").isNotNull(), F.count("_m").over(
        in_time_order().rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("double"))
    m, k = F.col("_m"), F.col("_k")
    found, many = F.count(m) > 0, F.count(m) > 3
    return rows.groupBy(*KEY).agg(
        F.when(many, F.max_by(m, k) + slope_agg(m, k))
        .when(found, F.avg(m))
        .otherwise(F.avg("value"))
        .alias("prediction"),
        F.when(found, 0.6).otherwise(0.3).alias("confidence"),
        F.when(found, F.stddev_pop(m)).otherwise(F.stddev_pop("value")).alias("prediction_std"),
        F.when(found, "statistical").otherwise("fallback").alias("best_model"),
    )


def walk_forward(df: DataFrame, horizon: int = 12, period: int = PERIOD) -> DataFrame:
    """One-step forecasts of the last ``horizon`` points from everything before each.

    Frames that end just before the row replace refitting per cut-off.
    """
    phase = by_series(F.col("t") % period).orderBy("t")
    valid = with_length(df).filter(F.col("value").isNotNull() & (F.col("n") >= horizon + 24))
    ranked = valid.withColumn("_k", (F.row_number().over(phase) - 1).cast("double"))
    before = phase.rowsBetween(Window.unboundedPreceding, -1)
    v, k = F.col("value"), F.col("_k")
    slope = ratio(F.regr_sxy(v, k).over(before), F.regr_sxx(v, k).over(before))
    predicted = (
        F.when(F.count(v).over(before) > 3, F.lag(v).over(phase) + slope)
        .when(F.count(v).over(before) > 0, F.avg(v).over(before))
        .otherwise(F.avg(v).over(in_time_order().rowsBetween(Window.unboundedPreceding, -1)))
    )
    return (
        ranked.withColumn("prediction", predicted)
        .filter(F.col("t") >= F.col("n") - horizon)
        .select(*KEY, "t", "prediction", v.alias("actual"))
    )


def walk_forward_metrics(df: DataFrame, horizon: int = 12) -> DataFrame:
    return error_metrics(walk_forward(df, horizon))


def weighted_ensemble(predictions: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Combine ``prediction`` per ``model`` by inverse ``validation_mae``."""
    p, w = F.col("prediction"), 1.0 / (F.col("validation_mae") + 0.01)
    return predictions.groupBy(*keys).agg(
        ratio(F.sum(p * w), F.sum(w)).alias("ensemble_prediction"),
        F.stddev_pop(p).alias("prediction_std"),
        F.min_by("model", F.struct("validation_mae", "model")).alias("best_model"),
        F.count(F.lit(1)).alias("models"),
    )


def agreement_confidence(mean: Column, std: Column, floor: float = 0.5) -> Column:
    """How well members agree, relative to the size of their mean."""
    return F.greatest(F.lit(floor), F.coalesce(1.0 - ratio(std, F.abs(mean)), F.lit(floor)))


def uncertainty(seasonal: DataFrame, trend: DataFrame) -> DataFrame:
    """Combine seasonal spread, sampling error and ``trend_uncertainty``."""
    v = F.col("value")
    base = seasonal.groupBy(*KEY).agg(
        F.avg(v).alias("_mean"),
        F.stddev_pop(v).alias("historical_std"),
        (F.stddev_pop(v) / F.sqrt(F.count(v).cast("double"))).alias("seasonal_uncertainty"),
    )
    rows = base.join(trend.select(*KEY, "trend_uncertainty"), KEY)
    std = F.col("historical_std")
    square = lambda c: F.col(c) * F.col(c)
    total = F.sqrt(square("historical_std") + square("trend_uncertainty") + square("seasonal_uncertainty"))
    rows = rows.withColumn("total_uncertainty", total)
    mean, tot = F.col("_mean"), F.col("total_uncertainty")
    return rows.select(
        *KEY,
        "historical_std",
        F.coalesce(ratio(std, mean), F.lit(0.0)).alias("coefficient_of_variation"),
        "trend_uncertainty",
        "seasonal_uncertainty",
        "total_uncertainty",
        (mean - tot).alias("lower_68"),
        (mean + tot).alias("upper_68"),
        (mean - 2 * tot).alias("lower_95"),
        (mean + 2 * tot).alias("upper_95"),
        F.when(tot > std, "high").when(tot > std / 2, "medium").otherwise("low").alias("uncertainty_level"),
    )


def seasonal_adjusted(df: DataFrame, period: int = PERIOD) -> DataFrame:
    """Trend-adjusted same-month values for every phase at once."""
    phase = (F.col("t") % period).cast("int")
    valid = whole_years(df, period).filter(F.col("value").isNotNull()).withColumn("phase", phase)
    g, w = by_series("phase"), by_series("phase").orderBy("t")
    ranked = valid.withColumns(
        {"k": (F.row_number().over(w) - 1).cast("double"), "_n": F.count(F.lit(1)).over(g)}
    )
    v, k = F.col("value"), F.col("k")
    slope = ratio(F.regr_sxy(v, k).over(g), F.regr_sxx(v, k).over(g))
    moved = F.when((F.col("_n") > 5) & (F.abs(slope) > 0.01), v + slope * k).otherwise(v)
    return ranked.withColumn("value", moved).select(*KEY, "phase", "t", "value")


def seasonal_baselines(df: DataFrame, period: int = PERIOD) -> DataFrame:
    return seasonal_adjusted(df, period).groupBy(*KEY, "phase").agg(
        F.avg("value").alias("baseline"),
        F.stddev_pop("value").alias("baseline_std"),
        F.count(F.lit(1)).alias("baseline_points"),
    )


def lead_dates(as_of: dt.date, months_ahead: int) -> list[tuple[int, int, int]]:
    """(lead, month, year) of 30-day steps from ``as_of``."""
    days = [as_of + dt.timedelta(days=30 * k) for k in range(1, months_ahead + 1)]
    return [(k, d.month, d.year) for k, d in enumerate(days, 1)]


def expand_leads(phases: DataFrame, leads: Sequence[tuple[int, int, int]]) -> DataFrame:
    """Repeat each (series, phase) row for the leads that fall into its month."""
    all_leads = F.array(
        *[
            F.struct(F.lit(k).alias("lead"), F.lit(m).alias("month"), F.lit(y).alias("year"))
            for k, m, y in leads
        ]
    )
    mine = F.filter(all_leads, lambda l: l["month"] == F.col("phase") + 1)
    return phases.select("*", F.inline(mine))


def blend_forecast(baselines: DataFrame, predictions: DataFrame) -> DataFrame:
    """Confidence-weighted mix of a model prediction and the seasonal baseline.

    ``baselines`` are expanded to leads; ``predictions`` hold prediction,
    confidence and prediction_std per series and lead (or per series).
    """
    on = [*KEY, *(["lead"] if "lead" in predictions.columns else [])]
    rows = baselines.join(predictions.select(*on, "prediction", "confidence", "prediction_std"), on)
    c, s = F.col("confidence"), F.col("prediction_std")
    value = c * F.col("prediction") + (1 - c) * F.col("baseline")
    rows = rows.withColumn("predicted_value", value)
    p = F.col("predicted_value")
    return rows.select(
        *KEY,
        "lead",
        "month",
        "year",
        "predicted_value",
        (p - Z95 * s).alias("lower_95"),
        (p - Z80 * s).alias("lower_80"),
        (p + Z80 * s).alias("upper_80"),
        (p + Z95 * s).alias("upper_95"),
        "baseline",
        "confidence",
        F.when(c > 0.8, "low").when(c > 0.6, "medium").otherwise("high").alias("uncertainty_level"),
    )


def extended_forecast(
    df: DataFrame, as_of: dt.date, months_ahead: int = 6, mode: str = "live_training", period: int = PERIOD
) -> DataFrame:
    """Seasonal baseline plus a significant trend, one row per series and lead."""
    live = mode == "live_training"
    leads = expand_leads(seasonal_baselines(df, period), lead_dates(as_of, months_ahead))
    trend = linear_trend(df, period).select(*KEY, "slope_per_year", "p_value")
    # fixed values: significance level and share of the trend used, by mode
    alpha, share = (0.05, 1.0) if live else (0.1, 0.5)
    start, low = (0.9, 0.6) if live else (0.8, 0.5)
    shift = F.when(
        F.col("p_value") < alpha, F.col("slope_per_year") * F.col("lead") / 12.0 * share
    ).otherwise(0.0)
    rows = leads.join(trend, KEY).withColumn("predicted_value", F.col("baseline") + shift)
    p = F.col("predicted_value")
    margin = Z95 * F.col("baseline_std") / F.sqrt(F.col("baseline_points").cast("double"))
    return rows.select(
        *KEY,
        "lead",
        "month",
        "year",
        "predicted_value",
        (p - margin).alias("lower_95"),
        (p - 0.67 * margin).alias("lower_80"),
        (p + 0.67 * margin).alias("upper_80"),
        (p + margin).alias("upper_95"),
        F.lit(33.3).alias("above_normal"),
        F.lit(33.3).alias("normal"),
        F.lit(33.4).alias("below_normal"),
        F.lit(max(low, start - 0.1 * months_ahead)).alias("confidence_score"),
    )


def spatial_predict(
    points: DataFrame, sites: DataFrame, site_predictions: DataFrame, month: int, k: int = 5, within_km: float = 1000.0
) -> DataFrame:
    """Prediction anywhere: the exact site, else a mix of near, zone and latitude.

    ``site_predictions`` has site_id and prediction.
    """
    from isohyet.operators.spatial import exact_site, knn_haversine, zone_members

    known = site_predictions.select("site_id", "prediction")
    near = (
        knn_haversine(points, sites, k)
        .filter(F.col("distance_km") < within_km)
        .join(known, "site_id")
        .select("point_id", "prediction", (1.0 / (F.col("distance_km") + 1.0)).alias("weight"))
    )
    zones = zone_members(sites).join(known, "site_id").groupBy("zone").agg(F.avg("prediction").alias("prediction"))
    zoned = points.withColumn("zone", climate_zone(F.col("lat")))
    # five zones at most
    zonal = zoned.join(F.broadcast(zones), "zone").select("point_id", "prediction", F.lit(0.3).alias("weight"))
    climatic = points.select(
        "point_id",
        latitude_climatology(F.col("lat"), F.lit(month)).alias("prediction"),
        F.lit(0.2).alias("weight"),
    )
    members = near.unionByName(zonal).unionByName(climatic)
    p, w = F.col("prediction"), F.col("weight")
    mixed = members.groupBy("point_id").agg(
        (F.sum(p * w) / F.sum(w)).alias("_mixed"),
        F.stddev_pop(p).alias("prediction_std"),
        F.count(F.lit(1)).alias("members"),
    )
    exact = exact_site(points, sites).join(known, "site_id").select("point_id", F.col("prediction").alias("_exact"))
    out = mixed.join(exact, "point_id", "left")
    hit = F.col("_exact").isNotNull()
    return out.select(
        "point_id",
        F.coalesce("_exact", "_mixed").alias("ensemble_prediction"),
        F.when(hit, 0.65)
        .otherwise(agreement_confidence(F.col("_mixed"), F.col("prediction_std"), 0.4))
        .alias("prediction_confidence"),
        F.when(hit, "exact_site").otherwise("interpolated").alias("coverage"),
        "members",
    )

"""Reports in the trained mode: the models' predictions take the place of the seasonal forecast and join the trend texts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from isohyet.checkpoint import reliable
from isohyet.models.panel import DIRECTION_SIZES, FORECAST_SIZES, Sizes, train_forecast_ensemble, trend_direction_models
from isohyet.plans.base import materialise
from isohyet.plans.reports import climate_trends, weather_probability
from isohyet.series import KEY


def trained_weather_probability(series: DataFrame, month: int, sizes: Sizes = FORECAST_SIZES, replicates: int = 100) -> DataFrame:
    """The probability report around each series' validated ensemble; ``status`` says where the seasonal forecast stands in."""
    base = materialise(series, "lat", "lon")
    predictions = reliable(train_forecast_ensemble(base, month, sizes))
    report = weather_probability(base, month, predictions, replicates, shared=True)
    return report.join(predictions.select(*KEY, "best_model", "accuracy", "validation_mae", "validation_r2", "status"), KEY, "left")


def trained_climate_trends(series: DataFrame, mode: str = "full", sizes: Sizes = DIRECTION_SIZES, folds: int = 3) -> DataFrame:
    """The trend report with the learned direction and its confidence in columns, text and score."""
    base = materialise(series, "lat", "lon")
    learned = reliable(trend_direction_models(base, sizes, folds)[0])
    return climate_trends(base, mode, learned, shared=True)

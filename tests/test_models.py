import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohyet.models import panel
from isohyet.operators import features
from isohyet.series import KEY, in_time_order
from tests.conftest import rows

SMALL = panel.Sizes(5, 4, 5, 3)


@pytest.fixture(scope="module")
def series(make_series):
    rng = random.Random(11)
    values = {
        (i, "temperature"): [15 + i + 8 * math.sin(2 * math.pi * t / 12) + 0.02 * t + rng.gauss(0, 0.5) for t in range(84)]
        for i in range(1, 5)
    }
    values[(9, "temperature")] = [float(t) for t in range(20)]  # too short for the ensemble
    df = make_series(values)
    return df.withColumns({"lat": F.col("location_id") * 10.0, "lon": F.col("location_id") * -5.0}).cache()


@pytest.fixture(scope="module")
def trained(series):
    rows_ = features.panel_features(series).withColumnRenamed("value", "target")
    return panel.train_panel(rows_, SMALL)


def test_split_is_stable_and_whole(series):
    rows_ = features.panel_features(series)
    a, b = panel.hash_split(rows_)
    assert a.count() + b.count() == rows_.count()
    assert a.join(b, [*KEY, "t"], "left_semi").count() == 0
    assert 0.1 < b.count() / rows_.count() < 0.3


def test_panel_predictions(series, trained):
    models, scores = trained
    assert set(models) == {"random_forest", "gradient_boost", "linear"} and scores["linear"][1] > 0.8
    out = rows(panel.predict_panel(models, features.panel_predict_features(series, 6)))
    assert len(out) == 5
    for r in out:
        members = [r[f"p_{n}"] for n in models]
        assert min(members) - 1e-9 <= r["ensemble_prediction"] <= max(members) + 1e-9
        assert 0.5 <= r["prediction_confidence"] <= 1.0


def test_saved_models_predict_the_same(spark, series, trained, tmp_path):
    models, _ = trained
    panel.save_models(models, spark, str(tmp_path / "m"), features.PANEL_COLUMNS)
    loaded, columns = panel.load_models(spark, str(tmp_path / "m"))
    assert columns == features.PANEL_COLUMNS
    x = features.panel_predict_features(series, 6)
    a, b = rows(panel.predict_panel(models, x), *KEY), rows(panel.predict_panel(loaded, x), *KEY)
    assert a == b


def test_forecast_ensemble(series):
    out = {r["location_id"]: r for r in rows(panel.train_forecast_ensemble(series, 1, SMALL))}
    assert set(out) == {1, 2, 3, 4, 9}
    assert out[9]["best_model"] == "fallback" or out[9]["best_model"] == "statistical"
    for i in range(1, 5):
        assert 0.5 <= out[i]["confidence"] <= 0.98 and 20 <= out[i]["accuracy"] <= 98
        assert out[i]["best_model"] in ("random_forest", "gradient_boost", "extra_forest")
        assert abs(out[i]["prediction"] - (15 + i + 1.7)) < 6


def test_direction_models(series):
    out, info = panel.trend_direction_models(series, SMALL)
    got = rows(out)
    assert {r["location_id"] for r in got} == {1, 2, 3, 4, 9}
    assert {r["ensemble_direction"] for r in got} <= {"increasing", "decreasing", "stable"}
    assert set(info["cv_r2"]) == {"random_forest", "gradient_boost", "elastic_net"}
    assert all(len(w) == len(features.TREND_COLUMNS) for w in info["importance"].values())


def test_projection(series):
    out = panel.project_models(series, 24, SMALL)
    assert out.count() == 5 * 24
    assert out.filter("projection_uncertainty < 0").count() == 0


def test_tune(series):
    rows_ = features.panel_features(series).withColumnRenamed("value", "target")
    both = rows_.unionByName(rows_.withColumn("variable", F.lit("other")))
    found = panel.tune(both, "random_forest", features.PANEL_COLUMNS, {"trees": [2, 4], "depth": [1, 4]})
    assert len(found.candidates) == 4 and found.scores.count() == 8
    scores = {(r["variable"], r["candidate"]): r["mae"] for r in found.scores.collect()}
    for r in found.best.collect():
        assert scores[r["variable"], r["candidate"]] == min(scores[r["variable"], i] for i in range(4))
        assert found.candidates[r["candidate"]]["depth"] == 4
    whole = both.dropna()
    assert found.predict(whole).filter("prediction IS NOT NULL").count() == whole.count()
    boosted = panel.tune(rows_, "gradient_boost", features.PANEL_COLUMNS, {"trees": [2, 20], "depth": [2], "rate": [0.1]})
    assert [boosted.candidates[r["candidate"]]["trees"] for r in boosted.best.collect()] == [20]
    assert panel.tune(rows_, "nothing") is None


def test_tree_intervals_are_as_wide_as_with_redrawn_rows(make_series):
    from isohyet.models import trees

    rng = random.Random(5)
    df = make_series({(1, "a"): [10 + 3 * math.sin(t / 2) + rng.gauss(0, 2) for t in range(120)]}).withColumns({"lat": F.lit(1.0), "lon": F.lit(2.0)})
    got = rows(panel.tree_intervals(df, 4, 60, 5), "lead")
    assert [r["lead"] for r in got] == [1, 2, 3, 4]
    assert all(r["lower_95"] <= r["lower_80"] <= r["upper_80"] <= r["upper_95"] for r in got)
    frame = features.trend_features(df).withColumn("target", F.lead("value", 12).over(in_time_order())).dropna().toPandas()
    x, y = frame[features.TREND_COLUMNS].to_numpy(float), np.round(frame["target"].to_numpy() * 1e6).astype(np.int64)
    future = features.future_features(df, 4).orderBy("step").toPandas()[features.TREND_COLUMNS].to_numpy(float)
    draws, s = np.random.default_rng(1), trees.extra_trees(300, 60)
    found = np.zeros((60, 4))
    for b in range(60):
        w = np.bincount(draws.integers(0, len(y), len(y)), minlength=len(y))
        for tree in range(5 * b, 5 * b + 5):
            part = trees.grow_subtree(s, 7, tree, 1, x[w > 0], y[w > 0], w[w > 0])
            nodes = trees.Nodes(part[0], part[1], part[2], part[4] / part[3] / 1e6)
            found[b] += nodes.value[nodes.places(future, 1)] / 5
    width = np.percentile(found, 90, axis=0) - np.percentile(found, 10, axis=0)
    mine = np.array([r["upper_80"] - r["lower_80"] for r in got])
    assert 0.6 < mine.mean() / width.mean() < 1.6


def test_feature_counts():
    assert (len(features.FORECAST_COLUMNS), len(features.TREND_COLUMNS), len(features.PANEL_COLUMNS)) == (30, 15, 11)


@pytest.fixture(scope="module")
def two_scales(make_series):
    """Temperatures near 10, precipitation near 1000, and a series without its last value."""
    rng = random.Random(3)
    wave = lambda base, size: [base + size * math.sin(2 * math.pi * t / 12) + rng.gauss(0, size / 20) for t in range(72)]
    values = {(i, "temperature"): wave(10 + i, 5) for i in (1, 2)} | {(i, "precipitation"): wave(1000, 200) for i in (1, 2)}
    values[(3, "temperature")] = wave(13, 5)[:-1] + [None]
    values[(4, "temperature")] = wave(14, 5)[:-13] + [None] * 13
    df = make_series(values)
    return df.withColumns({"lat": F.col("location_id") * 10.0, "lon": F.col("location_id") * -5.0}).cache()


def test_each_variable_has_its_own_model(spark, two_scales, tmp_path):
    rows_ = features.panel_features(two_scales).withColumnRenamed("value", "target")
    models, scores = panel.train_panel(rows_, SMALL)
    assert all({r["variable"] for r in m.groups().collect()} == {"temperature", "precipitation"} for m in models.values())
    alone, _ = panel.train_panel(rows_.filter("variable = 'temperature'"), SMALL)
    x = features.panel_predict_features(two_scales, 6)
    both = rows(panel.predict_panel(models, x).filter("variable = 'temperature'"), *KEY)
    assert both == rows(panel.predict_panel(alone, x.filter("variable = 'temperature'")), *KEY)
    panel.save_models(models, spark, str(tmp_path / "m"), features.PANEL_COLUMNS)
    loaded, _ = panel.load_models(spark, str(tmp_path / "m"))
    assert rows(panel.predict_panel(loaded, x), *KEY) == rows(panel.predict_panel(models, x), *KEY)
    unseen = rows(panel.predict_panel(alone, x).filter("variable = 'precipitation'"))
    assert len(unseen) == 2 and {(r["status"], r["ensemble_prediction"]) for r in unseen} == {("no model", None)}


def test_no_series_vanishes(two_scales):
    series_ = {(r["location_id"], r["variable"]) for r in two_scales.select(*KEY).distinct().collect()}
    out = rows(panel.project_models(two_scales, 3, SMALL))
    assert len(out) == 3 * len(series_)
    status = {(r["location_id"], r["variable"]): r["status"] for r in out}
    assert set(status) == series_ and status[(3, "temperature")] == "filled" and status[(4, "temperature")] == "no recent values"
    assert status[(1, "temperature")] == "complete"
    assert all((r["ensemble_projection"] is None) == (r["status"] == "no recent values") for r in out)
    directions, _ = panel.trend_direction_models(two_scales, SMALL)
    assert {(r["location_id"], r["variable"]) for r in directions.collect()} == series_
    forecast = rows(panel.train_forecast_ensemble(two_scales, 1, SMALL))
    assert {(r["location_id"], r["variable"]) for r in forecast} == series_ and len(forecast) == len(series_)
    for r in forecast:
        assert (r["prediction"] > 500) == (r["variable"] == "precipitation")


def test_trained_reports(series):
    from isohyet.plans import reports, trained

    plain = {(r["location_id"], r["variable"]): r for r in rows(reports.weather_probability(series, 6, replicates=20))}
    predicted = {(r["location_id"], r["variable"]): r for r in rows(panel.train_forecast_ensemble(series, 6, SMALL))}
    out = rows(trained.trained_weather_probability(series, 6, SMALL, 20))
    assert len(out) == len(plain) == 5
    changed = {"prediction", "prediction_confidence", "extreme_probabilities", "best_model", "accuracy", "validation_mae", "validation_r2", "status"}
    for r in out:
        key = r["location_id"], r["variable"]
        assert {k: v for k, v in r.items() if k not in changed} == {k: v for k, v in plain[key].items() if k not in changed}
        assert r["prediction"] == pytest.approx(predicted[key]["prediction"]) and r["status"] == predicted[key]["status"]
        assert r["prediction_confidence"] == pytest.approx(predicted[key]["confidence"])
    assert {r["status"] for r in out if r["location_id"] == 9} == {"seasonal forecast"}

    learned = {r["location_id"]: r for r in rows(panel.trend_direction_models(series, SMALL, 2)[0])}
    plain = {r["location_id"]: r for r in rows(reports.climate_trends(series, "fast"))}
    out = rows(trained.trained_climate_trends(series, "fast", SMALL, 2))
    assert len(out) == 5
    for r in out:
        base, ml = plain[r["location_id"]], learned.get(r["location_id"])
        assert r["ml_ensemble_direction"] == (ml and ml["ensemble_direction"]) and r["mk_tau"] == base["mk_tau"]
        if r["status"] == "ok":
            parts = [1 - base["mk_p_value"]] * base["mk_is_significant"] + [base["lr_r_squared"]] + [ml["ensemble_confidence"]]
            assert r["confidence_score"] == pytest.approx(sum(parts) / len(parts))
            assert ("learned models expect it" in r["summary"]) == (ml["ensemble_confidence"] > 0.6)

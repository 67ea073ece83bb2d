"""Ensembles: one model per variable, over all series of that variable.

Location is part of the features, so a pooled model serves every series of a variable and
the training data stays distributed.  All kinds of models fit all variables in one pass (`models.linear`, `models.trees`); nothing is
listed or looped over on the driver.  An ensemble is {model name: fitted model}.  XGBoost has no counterpart
besides boosted trees.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isohyet.checkpoint import reliable
from isohyet.functions.numeric import clamp, ratio
from isohyet.models.grouped import GROUP
from isohyet.models.linear import Linear, LinearModels, at_cut, before_cuts, moments
from isohyet.models.trees import Forest, boosted_trees, extra_trees, random_forest
from isohyet.operators.features import FORECAST_COLUMNS, PANEL_COLUMNS, TREND_COLUMNS
from isohyet.operators.features import forecast_features, future_features, target_features, trend_features
from isohyet.operators.forecast import agreement_confidence, trend_adjusted_forecast
from isohyet.operators.rolling import gradient
from isohyet.series import KEY, by_series, in_time_order, with_length

SEED = 42
VERSION = "2.0"


# fits that run at the same time; each is a chain of small jobs
FITS = 4
# trees that grow until their nodes are pure; node numbers have 62 bits
DEEPEST = 60


@dataclass(frozen=True)
class Sizes:
    """Tree counts and depths."""

    forest_trees: int
    forest_depth: int
    boost_rounds: int
    boost_depth: int


FORECAST_SIZES = Sizes(500, 25, 400, 8)
PANEL_SIZES = Sizes(200, DEEPEST, 200, 3)
DIRECTION_SIZES = Sizes(100, DEEPEST, 100, 3)
PROJECTION_SIZES = Sizes(200, DEEPEST, 200, 3)


def regressors(sizes: Sizes = PANEL_SIZES, extra_forest: bool = False) -> dict:
    """Kinds of models by name."""
    if extra_forest:
        return {
            "random_forest": random_forest(sizes.forest_trees, sizes.forest_depth, None, SEED),
            "gradient_boost": boosted_trees(sizes.boost_rounds, sizes.boost_depth, 0.02, SEED, subsample=0.8, least=3),
            "extra_forest": extra_trees(sizes.forest_trees, sizes.forest_depth, SEED),
        }
    return {
        "random_forest": random_forest(sizes.forest_trees, sizes.forest_depth, 0, SEED),
        "gradient_boost": boosted_trees(sizes.boost_rounds, sizes.boost_depth, 0.1, SEED),
        "linear": Linear(),
    }


def hash_split(df: DataFrame, test_share: float = 0.2, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Train and test by a hash of the row's key: stable under retries."""
    side = F.pmod(F.xxhash64(*KEY, "t", F.lit(seed)), F.lit(1000)) < int(test_share * 1000)
    return df.filter(~side), df.filter(side)


Ensemble = dict[str, Forest | LinearModels]


def fit_ensemble(rows: DataFrame, columns: Sequence[str], kinds: dict) -> Ensemble:
    """Every kind of model fitted to each variable's rows by itself; rows have no missing features or targets."""
    with ThreadPoolExecutor(FITS) as pool:
        fitted = pool.map(lambda kind: kind.fit_groups(rows, columns), kinds.values())
        return dict(zip(kinds, fitted, strict=True))


def complete_features(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing features filled, with a ``status``; no row is dropped.

    A missing level (a lag or mean) becomes the first known one, a missing spread or slope 0.  Without any known
    level the status is ``no recent values`` and the row gets no prediction.
    """
    levels = [c for c in columns if c == "previous" or c.startswith(("lag_", "mean_"))]
    # recent values stand before the same months of a year ago
    known = F.coalesce(*sorted(levels, key=lambda c: c in ("lag_13", "lag_14", "lag_15", "mean_3ly")))
    gap = F.greatest(*[F.col(c).isNull() for c in columns])
    status = F.when(known.isNull(), "no recent values").when(gap, "filled").otherwise("complete")
    filled = {c: F.coalesce(F.col(c), known if c in levels else F.lit(0.0)) for c in columns}
    return features.withColumns({"status": status, **filled})


def apply_models(models: Ensemble, features: DataFrame, keep: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """One column per model next to ``keep`` and ``status``, one row per input row.

    Each row meets the models of its own variable.  A variable that was not trained gives NULL predictions and
    the status ``no model``.
    """
    if not models:
        return features.select(*keep, F.lit("no model").alias("status"))
    rows = complete_features(features, list(columns or next(iter(models.values())).columns))
    for name, model in models.items():
        rows = model.add(rows, f"p_{name}")
        known = model.groups().select(F.col("variable").alias("_known"))
        rows = rows.join(known, rows["variable"] == known["_known"], "left")
        rows = rows.withColumn("status", F.when(F.col("_known").isNotNull(), F.col("status")).otherwise("no model")).drop("_known")
    known = ~F.col("status").isin("no model", "no recent values")
    return rows.select(*keep, "status", *[F.when(known, F.col(f"p_{n}")).alias(f"p_{n}") for n in models])


def r2_by(scored: DataFrame, names: Sequence[str], keys: Sequence[str], label: str = "target") -> DataFrame:
    """R² of each model's predictions per group: keys, then one column per model name; NULL where the label does not vary."""
    y = F.col(label)
    return scored.groupBy(*keys).agg(
        *[(1.0 - ratio(F.avg((F.col(f"p_{n}") - y) * (F.col(f"p_{n}") - y)), F.var_pop(y))).alias(n) for n in names]
    )


def _mean_scores(table: DataFrame, names: Sequence[str]) -> dict[str, float]:
    """Mean of the groups' scores per model; the groups (variables, folds) are few."""
    row = table.agg(*[F.avg(n).alias(n) for n in names]).head()
    return {n: row[n] if row[n] is not None else 0.0 for n in names}


def train_panel(panel: DataFrame, sizes: Sizes = PANEL_SIZES, columns: Sequence[str] = PANEL_COLUMNS):
    """Fit the panel models per variable; returns (ensemble, {name: (train R², test R²)}), the scores as means over variables."""
    rows = reliable(panel.dropna(subset=[*columns, "target"]))
    train, test = hash_split(rows)
    models = fit_ensemble(train, columns, regressors(sizes))
    names = list(models)
    parts = [_mean_scores(r2_by(apply_models(models, part, ["variable", "target"]), names, ["variable"]), names) for part in (train, test)]
    return models, {n: tuple(p[n] for p in parts) for n in names}


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def _std(values: Column, mean: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(values))


def predict_panel(models: Ensemble, features: DataFrame) -> DataFrame:
    """Mean over models with the confidence their agreement gives; one row per input row, see ``status``."""
    wide = apply_models(models, features, KEY)
    members = F.array(*[F.col(f"p_{n}") for n in models])
    out = wide.withColumn("ensemble_prediction", _mean(members))
    out = out.withColumn("prediction_std", _std(members, F.col("ensemble_prediction")))
    return out.withColumn(
        "prediction_confidence",
        agreement_confidence(F.col("ensemble_prediction"), F.col("prediction_std"), 0.5),
    )


def save_models(models: Ensemble, spark: SparkSession, path: str, columns: Sequence[str]) -> None:
    """One folder per model, with all variables, and metadata that names them."""
    for name, model in models.items():
        model.save(f"{path}/{name}")
    meta = spark.range(1).select(
        F.current_timestamp().alias("trained_at"),
        F.array(*[F.lit(n) for n in models]).alias("model_names"),
        F.array(*[F.lit(type(m).__name__) for m in models.values()]).alias("model_kinds"),
        F.array(*[F.lit(c) for c in columns]).alias("feature_columns"),
        F.lit(VERSION).alias("version"),
    )
    meta.write.mode("overwrite").json(f"{path}/metadata")


def load_models(spark: SparkSession, path: str) -> tuple[Ensemble, list[str]]:
    meta = spark.read.json(f"{path}/metadata").head()
    kinds = {k.__name__: k for k in (Forest, LinearModels)}
    named = zip(meta["model_names"], meta["model_kinds"], strict=True)
    return {n: kinds[kind].load(spark, f"{path}/{n}") for n, kind in named}, list(meta["feature_columns"])


# --- forecasting ----------------------------------------------------------


def train_forecast_ensemble(series: DataFrame, month: int, sizes: Sizes = FORECAST_SIZES, holdout: int = 12) -> DataFrame:
    """Next-period forecast per series with validated model weights.

    Models see all series except their last ``holdout`` periods; those give
    each series its own weights, skill and confidence.  Series with fewer than
    24 feature rows get the trend-adjusted seasonal forecast instead.
    """
    rows = forecast_features(series).withColumnRenamed("value", "target").dropna(subset=FORECAST_COLUMNS + ["target"])
    last = F.max("t").over(by_series())
    rows = reliable(rows.withColumn("_late", F.col("t") > last - holdout))
    train = rows.filter(~F.col("_late"))
    simple = trend_adjusted_forecast(series, month)
    if train.isEmpty():  # every series is too short or has too many gaps
        none = {c: F.lit(None).cast("double") for c in ("accuracy", "validation_mae", "validation_r2")}
        return simple.withColumns({**none, "status": F.lit("seasonal forecast")})
    models = fit_ensemble(train, FORECAST_COLUMNS, regressors(sizes, extra_forest=True))
    names = list(models)
    held = apply_models(models, rows.filter("_late"), [*KEY, "t", "target"])
    baseline = train.groupBy(*KEY).agg(F.avg("target").alias("_base"), F.count(F.lit(1)).alias("_rows"))
    y = F.col("target")
    errors = held.groupBy(*KEY).agg(
        *[F.avg(F.abs(y - F.col(f"p_{n}"))).alias(f"mae_{n}") for n in names]
    )
    weight = {n: 1.0 / (F.col(f"mae_{n}") + 0.01) for n in names}

    def mixed() -> Column:
        num = sum((F.col(f"p_{n}") * weight[n] for n in names), F.lit(0.0))
        return num / sum(weight.values(), F.lit(0.0))

    scored = held.join(errors, KEY).join(baseline, KEY).withColumn("_mix", mixed())
    e = F.col("_mix") - y
    skill = scored.groupBy(*KEY).agg(
        F.avg(F.abs(e)).alias("validation_mae"),
        F.avg(F.abs(y - F.col("_base"))).alias("_naive"),
        (1.0 - ratio(F.avg(e * e), F.var_pop(y))).alias("validation_r2"),
        F.max("_rows").alias("_rows"),
    )
    target = apply_models(models, target_features(series, month), KEY).join(errors, KEY).join(skill, KEY)
    members = F.array(*[F.col(f"p_{n}") for n in names])
    best = F.array_min(F.array(*[F.struct(F.col(f"mae_{n}").alias("m"), F.lit(n).alias("n")) for n in names]))["n"]
    gain = F.coalesce(ratio(F.col("_naive") - F.col("validation_mae"), F.col("_naive")), F.lit(0.0))
    # without recent values the models have nothing to go by, and the seasonal forecast stands in
    fitted = target.filter((F.col("_rows") + holdout >= 24) & mixed().isNotNull()).select(
        *KEY,
        "status",
        mixed().alias("prediction"),
        clamp(F.col("validation_r2"), 0.50, 0.98).alias("confidence"),
        _std(members, _mean(members)).alias("prediction_std"),
        best.alias("best_model"),
        clamp(gain * 100, 20.0, 98.0).alias("accuracy"),
        "validation_mae",
        "validation_r2",
    )
    rest = simple.join(fitted.select(*KEY), KEY, "left_anti").withColumn("status", F.lit("seasonal forecast"))
    return fitted.unionByName(rest, allowMissingColumns=True)


def walk_forward_linear(
    series: DataFrame, horizon: int = 12, model: Linear = Linear(), columns: Sequence[str] = tuple(FORECAST_COLUMNS)
) -> DataFrame:
    """One-step forecasts of each series' last ``horizon`` periods by the model of its variable refitted before each.

    The model for the k-th of them knows the rows of every series of the variable up to its own k-th held period.  The rows
    are read once: every cut adds its matrix of products to the one before.  Where a feature is missing or nothing was
    learned, the mean of the series so far stands in.  Series shorter than ``horizon`` + 24 periods have no rows.
    """
    eligible = with_length(series).filter(F.col("n") >= horizon + 24)
    so_far = F.avg("value").over(in_time_order().rowsBetween(Window.unboundedPreceding, -1))
    held = F.col("t") >= F.col("n") - horizon
    last = eligible.withColumn("_mean", so_far).filter(held & F.col("value").isNotNull()).select(*KEY, "t", "_mean")
    rows = with_length(forecast_features(eligible.drop("n")))
    cut = F.greatest(F.col("t") - F.col("n") + horizon + 1, F.lit(0)).cast("int")
    rows = reliable(rows.select(*KEY, "t", "value", cut.alias("_cut"), *columns))
    parts = moments(rows.withColumn(GROUP, at_cut(F.col("_cut"))), columns, "value")
    models = model.from_moments(before_cuts(parts, horizon, len(columns)), columns)
    ahead = rows.filter("_cut > 0").withColumns({"_name": F.col(GROUP), GROUP: at_cut(F.col("_cut"))})
    ahead = models.add(ahead, "prediction").withColumn(GROUP, F.col("_name"))
    out = last.join(ahead, [*KEY, "t"])
    return out.select(*KEY, "t", F.coalesce("prediction", "_mean").alias("prediction"), F.col("value").alias("actual"))


# --- trend direction ------------------------------------------------------


def _direction(x: Column) -> Column:
    return F.when(x > 0.01, "increasing").when(x < -0.01, "decreasing").otherwise("stable")


def trend_direction_models(series: DataFrame, sizes: Sizes = DIRECTION_SIZES, folds: int = 3):
    """Predict the local rate of change; returns (per-series trend, model scores).

    Scores come from expanding windows over time: fold k trains on the first k
    parts of a series' feature rows and is judged on the next one.  Weights, confidence and best model are
    each series' own R² over its judged rows; the returned scores are means over variables and folds.  Series without a
    complete feature row in their last year keep a row, with the status of the models' output.
    """
    rate = gradient(series).select(*KEY, "t", F.col("gradient").alias("target"))
    rows = trend_features(series).join(rate, [*KEY, "t"], "left")
    last = F.max("t").over(by_series())
    rows = rows.withColumns(
        {
            "_block": F.least(F.floor((F.col("t") - 12) * (folds + 1) / (last - 11)), F.lit(folds)),
            "_recent": F.col("t") > last - 12,
            "_whole": ~F.greatest(*[F.col(c).isNull() for c in [*TREND_COLUMNS, "target"]]),
        }
    )
    rows = reliable(rows)
    whole = rows.filter("_whole")
    kinds = {
        **{n: k for n, k in regressors(sizes).items() if n != "linear"},
        "elastic_net": Linear(0.1, 0.5),
    }
    names = list(kinds)
    judged = None
    for k in range(1, folds + 1):  # a variable whose fold has no rows to learn from is not judged there
        early = fit_ensemble(whole.filter(F.col("_block") < k), TREND_COLUMNS, kinds)
        part = apply_models(early, whole.filter(F.col("_block") == k), [*KEY, "target"], TREND_COLUMNS)
        part = part.filter(F.col("status") != "no model").withColumn("fold", F.lit(k))
        judged = part if judged is None else judged.unionByName(part)
    judged = reliable(judged)
    models = fit_ensemble(whole, TREND_COLUMNS, kinds)
    importance = {n: m.importance() for n, m in models.items()}
    held = apply_models(models, rows.filter("_recent"), KEY, TREND_COLUMNS)
    means = held.groupBy(*KEY).agg(F.max("status").alias("status"), *[F.avg(f"p_{n}").alias(n) for n in names])
    own = r2_by(judged, names, KEY).withColumnsRenamed({n: f"r2_{n}" for n in names})
    out = means.join(own, KEY, "left")
    weight = {n: F.greatest(F.lit(0.0), F.coalesce(f"r2_{n}", F.lit(0.0))) for n in names}
    total = sum(weight.values(), F.lit(0.0))
    trend = sum((F.col(n) * weight[n] for n in names), F.lit(0.0)) / F.when(total > 0, total).otherwise(1.0)
    best = F.array_max(F.array(*[F.struct(F.col(f"r2_{n}").alias("r"), F.lit(n).alias("n")) for n in names]))["n"]
    out = out.withColumns({"ensemble_magnitude": trend, "ensemble_confidence": total / len(names), "best_model": best})
    out = out.withColumn("ensemble_direction", _direction(F.col("ensemble_magnitude")))
    return out, {"cv_r2": _mean_scores(r2_by(judged, names, ["variable", "fold"]), names), "importance": importance}


def project_models(series: DataFrame, horizon: int = 60, sizes: Sizes = PROJECTION_SIZES) -> DataFrame:
    """Mean and spread over models of the value ``step + 1`` periods after the end.

    Features at t are trained on the value twelve periods later.  Every series has all its steps; ``status`` says
    whether its features had to be filled.
    """
    rows = trend_features(series).withColumn("target", F.lead("value", 12).over(in_time_order()))
    rows = reliable(rows.dropna(subset=TREND_COLUMNS + ["target"]))
    models = fit_ensemble(rows, TREND_COLUMNS, regressors(sizes))
    wide = apply_models(models, future_features(series, horizon), [*KEY, "step"])
    members = F.array(*[F.col(f"p_{n}") for n in models])
    out = wide.withColumn("ensemble_projection", _mean(members))
    return out.withColumn("projection_uncertainty", _std(members, F.col("ensemble_projection")))


# --- intervals of refitted trees --------------------------------------------


def tree_intervals(series: DataFrame, horizon: int = 12, replicates: int = 100, trees: int = 10, depth: int = DEEPEST, seed: int = SEED) -> DataFrame:
    """Intervals of extremely randomised trees refitted on redrawn rows, per coming period.

    Rows are redrawn by hashed Poisson weights, ``trees`` trees for each of the replicates, and all replicates grow from one
    written frame.  Features at t are trained on the value twelve periods later, as in `project_models`.
    """
    rows = trend_features(series).withColumn("target", F.lead("value", 12).over(in_time_order()))
    rows = rows.dropna(subset=TREND_COLUMNS + ["target"])
    model = extra_trees(replicates * trees, depth, seed, share_weights=trees).fit_groups(rows, TREND_COLUMNS)
    future = complete_features(future_features(series, horizon), TREND_COLUMNS)
    future = reliable(future.withColumn("_id", F.monotonically_increasing_id()))
    each = model.members(future.filter("status <> 'no recent values'"), "_id")
    shares = {"lower_95": 0.025, "lower_80": 0.1, "upper_80": 0.9, "upper_95": 0.975}
    bounds = each.groupBy(F.col("id").alias("_row")).agg(F.percentile("prediction", F.array(*[F.lit(p) for p in shares.values()])).alias("_b"))
    out = future.join(bounds, future["_id"] == bounds["_row"], "left")
    return out.select(*KEY, (F.col("step") + 1).alias("lead"), "status", *[F.col("_b")[i].alias(n) for i, n in enumerate(shares)])


# --- search -----------------------------------------------------------------

# fixed values: search grids
GRIDS = {
    "random_forest": {"trees": [100, 150], "depth": [10, 15, 20], "least": [2, 5]},
    "gradient_boost": {"trees": [100, 150], "depth": [5, 7, 10], "rate": [0.05, 0.1]},
}


@dataclass(frozen=True)
class Tuned:
    """``scores``: variable, candidate, mae; ``best``: variable, candidate; models of each variable's best candidate."""

    candidates: list[dict]
    scores: DataFrame
    best: DataFrame
    models: dict[int, Forest]

    def predict(self, rows: DataFrame, out: str = "prediction") -> DataFrame:
        """Rows with the prediction of their variable's best candidate."""
        chosen = rows.join(self.best, "variable")
        parts = [m.add(chosen.filter(F.col("candidate") == i), out) for i, m in self.models.items()]
        total = parts[0]
        for p in parts[1:]:
            total = total.unionByName(p)
        return total


def tune(rows: DataFrame, model_type: str, columns: Sequence[str] = FORECAST_COLUMNS, grid: dict | None = None, folds: int = 3) -> Tuned | None:
    """Grid search by mean absolute error over hashed folds, for every variable by itself; None for unknown models.

    A candidate is fitted once: (variable, fold) is the group, and a row trains the models of the folds that it is not in.
    """
    makers = {"random_forest": lambda **k: random_forest(features=None, seed=SEED, **k), "gradient_boost": lambda **k: boosted_trees(seed=SEED, **k)}
    if model_type not in makers:
        return None
    chosen = grid or GRIDS[model_type]
    candidates = [dict(zip(chosen, values, strict=True)) for values in itertools.product(*chosen.values())]
    whole = rows.dropna(subset=[*columns, "target", "variable"])
    whole = reliable(whole.withColumns({"_fold": F.pmod(F.xxhash64(*KEY, "t"), F.lit(folds)).cast("int"), "_variable": F.col("variable")}))
    named = lambda fold: F.concat_ws("/", fold.cast("string"), F.col("_variable"))
    others = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("_out")
    train = whole.select("*", others).filter("_out <> _fold").withColumn("variable", named(F.col("_out")))
    train, held = reliable(train), whole.withColumn("variable", named(F.col("_fold")))

    def judge(i: int) -> DataFrame:
        scored = makers[model_type](**candidates[i]).fit_groups(train, columns).add(held, "_p")
        error = scored.groupBy(F.col("_variable").alias("variable"), "_fold").agg(F.avg(F.abs(F.col("_p") - F.col("target"))).alias("mae"))
        return reliable(error.groupBy("variable").agg(F.avg("mae").alias("mae")).withColumn("candidate", F.lit(i)))

    with ThreadPoolExecutor(FITS) as pool:
        judged = list(pool.map(judge, range(len(candidates))))
    scores = judged[0]
    for s in judged[1:]:
        scores = scores.unionByName(s)
    best = reliable(scores.groupBy("variable").agg(F.min_by("candidate", F.struct(F.bround("mae", 9), "candidate")).alias("candidate")))
    used = sorted(r["candidate"] for r in best.select("candidate").distinct().collect())
    models = {}
    for i in used:
        mine = whole.drop("_fold", "_variable").join(best.filter(F.col("candidate") == i).select("variable"), "variable", "left_semi")
        models[i] = makers[model_type](**candidates[i]).fit_groups(mine, columns)
    return Tuned(candidates, scores, best, models)

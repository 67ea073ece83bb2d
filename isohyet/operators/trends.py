"""Trend tests as aggregates over each series."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isohyet.functions.labels import (
    p_confidence,
    season_of,
    trend_strength,
    up_or_down,
)
from isohyet.functions.numeric import ratio
from isohyet.functions.ols import Line, fit
from isohyet.functions.pvalues import normal_two_sided, t_two_sided
from isohyet.series import KEY, PERIOD, by_series, in_time_order, whole_years, with_length

ALPHA = 0.05
Z_ALPHA = 1.959963984540054
SEN_BLOCK = 1 << 20  # pairwise slopes a task holds at a time


def linear_trend(df: DataFrame, period: int = PERIOD) -> DataFrame:
    aggs, line = fit(F.col("value"), F.col("t").cast("double"))
    out, line = line.stage(df.groupBy(*KEY).agg(*aggs, F.stddev_pop("value").alias("_std")), "_")
    slope = line.slope * period
    return out.select(
        *KEY,
        line.n.alias("points"),
        slope.alias("slope_per_year"),
        line.r2.alias("r_squared"),
        line.p_value.alias("p_value"),
        line.std_error.alias("standard_error"),
        trend_strength(slope, F.col("_std")).alias("trend_strength"),
    )


def poly_trend(df: DataFrame) -> DataFrame:
    """Polynomials of degree 1 to 3 by orthogonalising on the series' own moments.

    Time is centred and scaled first, so one pass of power sums is well
    conditioned and gaps in time need no special case.
    """
    g = by_series()
    valid = df.filter(F.col("value").isNotNull())
    centre, half = F.avg("t").over(g), F.greatest(F.lit(1.0), (F.max("t").over(g) - F.min("t").over(g)) / 2)
    scaled = valid.withColumns(
        {
            "_m": centre,
            "_s": half,
            "_u": (F.col("t") - centre) / half,
            "_c": F.col("value") - F.avg("value").over(g),
            "_y0": F.avg("value").over(g),
        }
    )
    u, c = F.col("_u"), F.col("_c")
    sums = scaled.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.pow(u, F.lit(k))).alias(f"s{k}") for k in range(2, 7)],
        *[F.sum(c * F.pow(u, F.lit(k))).alias(f"y{k}") for k in range(1, 4)],
        F.sum(c * c).alias("syy"),
        F.max("_m").alias("m"),
        F.max("_s").alias("s"),
        F.max("_y0").alias("d0"),
    )
    s = {k: F.col(f"s{k}") for k in range(2, 7)}
    y1, y2, y3, n = F.col("y1"), F.col("y2"), F.col("y3"), F.col("n")
    # P2 = u² - a u - b,  P3 = u³ - c2 P2 - c1 u - c0
    step = sums.withColumns({"a": ratio(s[3], s[2]), "b": s[2] / n}).withColumns(
        {
            "pp2": s[4] - F.col("a") * s[3] - F.col("b") * s[2],
            "u3p2": s[5] - F.col("a") * s[4] - F.col("b") * s[3],
        }
    )
    step = step.withColumns(
        {"c0": s[3] / n, "c1": ratio(s[4], s[2]), "c2": ratio(F.col("u3p2"), F.col("pp2"))}
    ).withColumns(
        {
            "pp3": s[6] - F.col("c2") * F.col("u3p2") - F.col("c1") * s[4] - F.col("c0") * s[3],
            "yp2": y2 - F.col("a") * y1,
        }
    )
    # too few distinct times for a degree: its term is 0, the lower fit stays
    known = lambda c: F.coalesce(c, F.lit(0.0))
    step = step.withColumns({"a": known(F.col("a")), "c1": known(F.col("c1")), "c2": known(F.col("c2"))})
    step = step.withColumn("yp3", y3 - F.col("c2") * F.col("yp2") - F.col("c1") * y1).withColumns(
        {
            "d1": known(ratio(y1, s[2])),
            "d2": known(ratio(F.col("yp2"), F.col("pp2"))),
            "d3": known(ratio(F.col("yp3"), F.col("pp3"))),
        }
    )
    rss = [F.col("syy") - F.col("d1") * y1]
    rss.append(rss[0] - F.col("d2") * F.col("yp2"))
    rss.append(rss[1] - F.col("d3") * F.col("yp3"))

    def raw(degree: int) -> list[Column]:
        """Coefficients of 1, t, t², t³."""
        zero = F.lit(0.0)
        d2 = F.col("d2") if degree >= 2 else zero
        d3 = F.col("d3") if degree >= 3 else zero
        a, b, c0, c1, c2 = (F.col(x) for x in ("a", "b", "c0", "c1", "c2"))
        e3 = d3 / F.pow(F.col("s"), F.lit(3))
        e2 = (d2 - d3 * c2) / F.pow(F.col("s"), F.lit(2))
        e1 = (F.col("d1") - d2 * a + d3 * (c2 * a - c1)) / F.col("s")
        e0 = F.col("d0") - d2 * b + d3 * (c2 * b - c0)
        m = F.col("m")
        return [
            e0 - e1 * m + e2 * m * m - e3 * m * m * m,
            e1 - 2 * e2 * m + 3 * e3 * m * m,
            e2 - 3 * e3 * m,
            e3,
        ]

    def row(degree: int) -> Column:
        left = F.greatest(F.lit(0.0), rss[degree - 1])
        coef = raw(degree)
        lead = coef[degree]
        direction = {
            1: up_or_down(lead),
            2: F.when(lead > 0, "accelerating").otherwise("decelerating"),
            3: F.lit("complex"),
        }[degree]
        return F.struct(
            F.lit(degree).alias("degree"),
            *[x.alias(f"c{i}") for i, x in enumerate(coef)],
            F.coalesce(1.0 - ratio(left, F.col("syy")), F.lit(0.0)).alias("r_squared"),
            direction.alias("trend_direction"),
            (n * F.ln(left / n) + 2 * (degree + 1)).alias("aic"),
        )

    return step.select(*KEY, F.inline(F.array(*[row(k) for k in (1, 2, 3)])))


def best_polynomial(fits: DataFrame) -> DataFrame:
    """Lowest AIC, lowest degree on ties."""
    best = F.min_by(
        F.struct("degree", "r_squared", "trend_direction", "aic"),
        F.struct(F.coalesce("aic", F.lit(float("-inf"))), "degree"),
    )
    return fits.groupBy(*KEY).agg(best.alias("_b")).select(
        *KEY,
        F.col("_b.degree").alias("best_degree"),
        F.col("_b.r_squared").alias("best_r_squared"),
        F.col("_b.aic").alias("best_aic"),
    )


def quadratic_label(df: DataFrame) -> DataFrame:
    quad = poly_trend(df).filter(F.col("degree") == 2).select(*KEY, F.col("c2").alias("_c"))
    sizes = df.groupBy(*KEY).agg(F.count("value").alias("points"))
    c, enough = F.col("_c"), F.col("points") > 36
    return sizes.join(quad, KEY, "left").select(
        *KEY,
        F.when(~enough, "insufficient_data")
        .when(c > 0, "accelerating")
        .when(c < 0, "decelerating")
        .otherwise("linear")
        .alias("trend_type"),
        F.when(enough, c).otherwise(0.0).alias("acceleration"),
        F.coalesce(enough & (F.abs(c) > 0.001), F.lit(False)).alias("curvature_significant"),
    )


def kendall_score(df: DataFrame) -> DataFrame:
    """Mann-Kendall S and its variance in O(n log n) rows, without forming pairs.

    Two ranks that differ do so first at exactly one bit.  Within each group of
    equal higher bits, in time order, a set bit adds one concordant pair per
    earlier clear bit and a clear bit one discordant pair per earlier set bit.
    The groups halve at every level, so the windows shrink as well.
    """
    valid = df.filter(F.col("value").isNotNull())
    rank = F.dense_rank().over(by_series().orderBy("value")) - 1
    ranked = valid.select(
        *KEY,
        "t",
        rank.alias("_rank"),
        F.count(F.lit(1)).over(by_series("value")).cast("double").alias("_ties"),
    ).withColumn("_top", F.max("_rank").over(by_series()))
    tied = ranked.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("points"),
        F.sum((F.col("_ties") - 1) * (2 * F.col("_ties") + 5)).alias("_tied"),
    )
    levels = F.when(F.col("_top") > 0, F.floor(F.log2(F.col("_top")))).otherwise(0).cast("int")
    bits = ranked.select(*KEY, "t", "_rank", F.explode(F.sequence(F.lit(0), levels)).alias("_level"))
    bits = bits.select(
        *KEY,
        "t",
        "_level",
        F.expr("_rank div cast(pow(2, _level + 1) as bigint)").alias("_block"),
        F.expr("(_rank div cast(pow(2, _level) as bigint)) % 2").alias("_bit"),
    )
    w = in_time_order("_level", "_block").rowsBetween(Window.unboundedPreceding, -1)
    earlier_set = F.coalesce(F.sum("_bit").over(w), F.lit(0))
    earlier_clear = F.count("_bit").over(w) - earlier_set
    score = F.when(F.col("_bit") == 1, earlier_clear).otherwise(-earlier_set)
    scores = bits.select(*KEY, score.alias("_d")).groupBy(*KEY).agg(F.sum("_d").alias("s"))
    n = F.col("points").cast("double")
    return tied.join(scores, KEY).select(
        *KEY,
        "points",
        "s",
        ((n * (n - 1) * (2 * n + 5) - F.col("_tied")) / 18.0).alias("var_s"),
    )


def _slope_keys(t: np.ndarray, x: np.ndarray, block: int) -> Iterator[np.ndarray]:
    """All pairwise slopes as unsigned integers of the same order, about ``block`` at a time."""
    first, n = 0, len(x)
    while first < n - 1:
        rows = min(n - 1 - first, max(1, block // (n - 1 - first)))
        own, later = slice(first, first + rows), slice(first + 1, n)
        once = ~np.tri(rows, n - 1 - first, -1, dtype=bool)  # a row begins at its own next point
        rise, run = (x[None, later] - x[own, None])[once], (t[None, later] - t[own, None])[once]
        bits = (rise / run + 0.0).view(np.int64)
        yield (bits ^ ((bits >> 63) | np.int64(-(2**63)))).view(np.uint64)
        first += rows


def _slope_of(key: int) -> float:
    bits = key ^ (2**63 if key >> 63 else 2**64 - 1)
    return float(np.array(bits, np.uint64).view(np.float64))


def _slopes_at(t: np.ndarray, x: np.ndarray, k: int, block: int) -> list[float]:
    """Pairwise slopes of the ranks k - 1 and k (from 0); only the k-th if the other is not at hand.

    Each pass counts the slopes by 16 more leading bits of their keys, until those that share all bits so far with
    the k-th fit into one block.
    """
    prefix = below = shift = 0
    inside, known = len(x) * (len(x) - 1) // 2, 0
    while inside > block and known < 64:
        shift = np.uint64(48 - known)
        counts = np.zeros(1 << 16, np.int64)
        for keys in _slope_keys(t, x, block):
            digits = keys >> shift
            if known:
                digits = digits[(digits >> np.uint64(16)) == prefix] & np.uint64(0xFFFF)
            counts += np.bincount(digits.astype(np.int64), minlength=1 << 16)
        upto = np.cumsum(counts)
        digit = int(np.searchsorted(upto, k - below, side="right"))
        below, inside = below + int(upto[digit] - counts[digit]), int(counts[digit])
        prefix, known = np.uint64((int(prefix) << 16) | digit), known + 16
    if known == 64:  # all that are left are equal
        return [_slope_of(int(prefix))] * (2 if k > below else 1)
    found = np.concatenate([keys[(keys >> shift) == prefix] if known else keys for keys in _slope_keys(t, x, block)])
    ranks = [r for r in (k - 1 - below, k - below) if r >= 0]
    found.partition(ranks)
    return [_slope_of(int(found[r])) for r in ranks]


def median_pair_slope(t: np.ndarray, x: np.ndarray, block: int = SEN_BLOCK) -> float:
    """Median over all pairs of (x_j - x_i) / (t_j - t_i), the same bits whatever the block; memory holds blocks only."""
    pairs = len(x) * (len(x) - 1) // 2
    if not pairs:
        return math.nan
    slopes = _slopes_at(t, x, pairs // 2, block)
    if pairs % 2:
        return slopes[-1]
    lower = slopes[0] if len(slopes) == 2 else _slopes_at(t, x, pairs // 2 - 1, block)[-1]
    return (lower + slopes[-1]) / 2


def sen_slope(df: DataFrame) -> DataFrame:
    """Median pairwise slope per series; one group is one series' cells."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        slope = median_pair_slope(pdf["t"].to_numpy("float64"), pdf["value"].to_numpy("float64"))
        out = pdf[KEY].head(1).copy()
        out["sen_slope"] = None if math.isnan(slope) else slope
        return out

    valid = df.filter(F.col("value").isNotNull()).select(*KEY, "t", "value")
    key_types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in KEY)
    return valid.groupBy(*KEY).applyInPandas(one, f"{key_types}, sen_slope double")


def mann_kendall(df: DataFrame, alpha_z: float = Z_ALPHA, slope: bool = True) -> DataFrame:
    """Mann-Kendall test, with Sen's slope unless ``slope=False``."""
    base = kendall_score(df)
    s, n = F.col("s"), F.col("points").cast("double")
    z = F.coalesce(
        ratio(s - F.signum(s.cast("double")), F.sqrt(F.col("var_s"))), F.lit(0.0)
    )
    out = base.withColumns({"z_statistic": z, "tau": ratio(s.cast("double"), n * (n - 1) / 2)})
    out = out.withColumn("_p", normal_two_sided(F.col("z_statistic")))
    z, p = F.col("z_statistic"), F.col("_p")
    significant = F.abs(z) > alpha_z
    out = out.select(
        *KEY,
        "points",
        "s",
        F.when(significant & (z > 0), "increasing")
        .when(significant, "decreasing")
        .otherwise("no trend")
        .alias("trend_direction"),
        significant.alias("is_significant"),
        p.alias("p_value"),
        "z_statistic",
        "tau",
        p_confidence(p).alias("confidence"),
    )
    return out.join(sen_slope(df), KEY, "left") if slope else out


def extremes_trend(df: DataFrame, hot: Column, cold: Column, period: int = PERIOD) -> DataFrame:
    """Trend of how often ``value`` is above ``hot`` and below ``cold``."""
    x, v = F.col("t").cast("double"), F.col("value")
    hot_aggs, hot_line = fit((v > hot).cast("double"), x, "_h")
    cold_aggs, cold_line = fit((v < cold).cast("double"), x, "_k")
    out, hot_line = hot_line.stage(df.groupBy(*KEY).agg(*hot_aggs, *cold_aggs), "_h")
    out, cold_line = cold_line.stage(out, "_k")
    out = out.withColumns({"_hp": hot_line.p_value, "_kp": cold_line.p_value})

    def cols(line: Line, name: str) -> list[Column]:
        return [
            (line.slope * period).alias(f"{name}_slope_per_year"),
            line.r2.alias(f"{name}_r_squared"),
            F.col(f"{line.staged}p").alias(f"{name}_p_value"),
            F.coalesce(F.col(f"{line.staged}p") < ALPHA, F.lit(False)).alias(f"{name}_significant"),
            up_or_down(line.slope).alias(f"{name}_direction"),
        ]

    return out.select(*KEY, *cols(hot_line, "hot"), *cols(cold_line, "cold"))


def seasonal_trends(df: DataFrame, min_years: int = 5, period: int = PERIOD) -> DataFrame:
    """Trend of season means; winter takes Jan, Feb and Dec of the same year row."""
    year = F.floor(F.col("t") / period).cast("int")
    means = (
        whole_years(df, period)
        .groupBy(*KEY, season_of(F.col("t") % period + 1).alias("season"), year.alias("year"))
        .agg(F.avg("value").alias("season_mean"))
    )
    aggs, line = fit(F.col("season_mean"), F.col("year").cast("double"))
    out = means.groupBy(*KEY, "season").agg(*aggs, F.stddev_pop("season_mean").alias("_std"))
    out, line = line.stage(out.filter(line.n >= min_years), "_")
    return out.withColumn("_p", line.p_value).select(
        *KEY,
        "season",
        line.n.alias("years"),
        line.slope.alias("slope_per_year"),
        line.r2.alias("r_squared"),
        F.col("_p").alias("p_value"),
        F.coalesce(F.col("_p") < ALPHA, F.lit(False)).alias("is_significant"),
        trend_strength(line.slope, F.col("_std")).alias("trend_strength"),
    )


def decadal_comparison(df: DataFrame, recent: int = 120, min_years: int = 20, period: int = PERIOD) -> DataFrame:
    """Last ``recent`` periods against all earlier ones, pooled-variance t test."""
    late = F.col("t") >= F.col("n") - recent
    v = F.col("value")
    a, b = F.when(late, v), F.when(~late, v)
    out = (
        with_length(df)
        .filter(F.floor(F.col("n") / period) >= min_years)
        .groupBy(*KEY)
        .agg(
            F.avg(a).alias("recent_mean"),
            F.avg(b).alias("historical_mean"),
            F.count(a).alias("_n1"),
            F.count(b).alias("_n2"),
            F.var_samp(a).alias("_v1"),
            F.var_samp(b).alias("_v2"),
        )
    )
    n1, n2 = F.col("_n1"), F.col("_n2")
    dof = n1 + n2 - 2
    pooled = ratio((n1 - 1) * F.col("_v1") + (n2 - 1) * F.col("_v2"), dof)
    diff = F.col("recent_mean") - F.col("historical_mean")
    t = ratio(diff, F.sqrt(pooled * (ratio(F.lit(1.0), n1) + ratio(F.lit(1.0), n2))))
    out = out.withColumn("_t", t).withColumn("_p", t_two_sided(F.col("_t"), dof.cast("int")))
    p = F.col("_p")
    return out.select(
        *KEY,
        "recent_mean",
        "historical_mean",
        diff.alias("difference"),
        (ratio(diff, F.col("historical_mean")) * 100).alias("percent_change"),
        p.alias("p_value"),
        F.coalesce(p < ALPHA, F.lit(False)).alias("is_significantly_different"),
    )


def project_linear(df: DataFrame, horizon: int = 120) -> DataFrame:
    """Extrapolate the fitted line; the mean over the horizon has a closed form."""
    x = F.col("t").cast("double")
    aggs, line = fit(F.col("value"), x)
    out = df.groupBy(*KEY).agg(
        *aggs, (F.max("t") + 1).alias("_n"), F.stddev_pop("value").alias("_std")
    )
    middle = F.col("_n") + (horizon - 1) / 2.0
    return out.select(
        *KEY,
        (line.slope * horizon).alias("projected_change"),
        (F.col("_my") + line.slope * (middle - F.col("_mx"))).alias("projected_mean"),
        (2 * F.col("_std")).alias("uncertainty_range"),
    )


def validate_trend(df: DataFrame, holdout: int = 24, min_length: int = 48) -> DataFrame:
    """Fit all but the last ``holdout`` periods, score the line on those."""
    g = by_series()
    rows = with_length(df).filter(F.col("n") >= min_length)
    x = F.col("t").cast("double")
    held = F.col("t") >= F.col("n") - holdout
    train = F.when(~held, F.col("value"))
    rows = rows.withColumns(
        {
            "_slope": ratio(F.regr_sxy(train, x).over(g), F.regr_sxx(train, x).over(g)),
            "_mx": F.regr_avgx(train, x).over(g),
            "_my": F.regr_avgy(train, x).over(g),
        }
    ).filter(held & F.col("value").isNotNull())
    v = F.col("value")
    e = F.col("_my") + F.col("_slope") * (x - F.col("_mx")) - v
    out = rows.groupBy(*KEY).agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(F.abs(ratio(e, v))) * 100).alias("mape"),
        F.max("_slope").alias("_slope"),
        F.regr_sxy(v, x).alias("_test"),
        F.stddev_pop(v).alias("_std"),
    )
    return out.select(
        *KEY,
        "mae",
        "rmse",
        "mape",
        ((F.col("_test") > 0) == (F.col("_slope") > 0)).alias("trend_direction_accuracy"),
        F.greatest(F.lit(0.0), 1.0 - ratio(F.col("rmse"), F.col("_std"))).alias("skill"),
    )


def validate_trend_last_value(df: DataFrame, years: int = 5, period: int = PERIOD) -> DataFrame:
    """Project from the last training value with the training slope."""
    g = by_series()
    x, v = F.col("t").cast("double"), F.col("value")
    held = F.col("t") >= F.col("n") - years * period
    train = F.when(~held, v)
    last = F.max_by(train, F.when(train.isNotNull(), F.col("t"))).over(g)
    rows = with_length(df).withColumns(
        {
            "_slope": ratio(F.regr_sxy(train, x).over(g), F.regr_sxx(train, x).over(g)),
            "_last": last,
            "_step": F.col("t") - (F.col("n") - years * period) + 1,
        }
    ).filter(held & v.isNotNull())
    e = F.col("_last") + F.col("_slope") * F.col("_step") - v
    out = rows.groupBy(*KEY).agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.stddev_pop(v).alias("_std"),
    )
    return out.select(
        *KEY,
        "mae",
        "rmse",
        F.greatest(F.lit(0.0), 1.0 - ratio(F.col("rmse"), F.col("_std"))).alias("accuracy_score"),
    )


def trend_confidence(
    mk_significant: Column, mk_p: Column, r2: Column, ml: Column | None = None, poly_r2: Column | None = None
) -> Column:
    """Mean of the confidence factors that are available."""
    parts = [F.when(mk_significant, 1.0 - mk_p), F.coalesce(r2, F.lit(0.0))]
    parts += [x for x in (ml, poly_r2) if x is not None]
    known = F.array_compact(F.array(*parts))
    total = F.aggregate(known, F.lit(0.0), lambda acc, x: acc + x)
    return F.coalesce(ratio(total, F.size(known)), F.lit(0.5))


def trend_summary_text(
    variable: Column,
    mk_significant: Column,
    mk_direction: Column,
    mk_confidence: Column,
    slope_per_year: Column,
    strength: Column,
    change_point: Column | None = None,
    ml_direction: Column | None = None,
    ml_confidence: Column | None = None,
) -> Column:
    """What each test found, if it passes its own threshold, as one line of text."""
    found = [
        F.when(
            F.abs(slope_per_year) > 0.01,
            F.format_string("fitted line moves by %.3f a year, %s", F.abs(slope_per_year), strength),
        ),
        F.when(
            mk_significant,
            F.format_string("rank test finds it %s (confidence %s)", mk_direction, mk_confidence),
        ),
    ]
    if change_point is not None:
        found.append(F.when(change_point, "its level breaks at some period"))
    if ml_direction is not None:
        found.append(
            F.when(
                ml_confidence > 0.6,
                F.format_string("learned models expect it %s (%.0f%%)", ml_direction, ml_confidence * 100),
            )
        )
    text = F.concat_ws(", ", *found)
    return F.concat(variable, F.lit(" - "), F.when(text == "", "nothing stands out").otherwise(text))


def trend_description(direction: Column, slope_per_year: Column, strength: Column) -> Column:
    """Rate and strength in a few words; a slope that agrees with the rank test is a rise or a fall."""
    rate = F.format_string("%.3f a year (%s)", F.abs(slope_per_year), strength)
    return (
        F.when(
            direction == "increasing",
            F.concat(F.when(slope_per_year > 0, "rises by ").otherwise("ranks go up, line falls by "), rate),
        )
        .when(
            direction == "decreasing",
            F.concat(F.when(slope_per_year < 0, "falls by ").otherwise("ranks go down, line rises by "), rate),
        )
        .otherwise(F.concat(F.lit("steady, spread "), strength))
    )

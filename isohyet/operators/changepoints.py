"""Change-point scans in linear time per series.

Window widths depend on the series length.  Running sums are fetched exactly
``w`` positions away by ordering on ``pos / w`` with a RANGE frame that holds a
single row, so no self join is needed and the series sort is shared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isohyet.functions.labels import slope_change
from isohyet.functions.numeric import pooled, ratio
from isohyet.functions.ols import Line, r_to_t
from isohyet.functions.pvalues import f2_tail, t_two_sided
from isohyet.series import KEY, by_series, in_time_order, with_position

EPS = "0.000001D"
FLAT = 1e-12


def cusum(df: DataFrame, factor: float = 2.0) -> DataFrame:
    """Largest excursion of the running sum of deviations; 2.5 is the strict variant."""
    g = by_series()
    valid = df.filter(F.col("value").isNotNull()).withColumn("_c", F.col("value") - F.avg("value").over(g))
    path = valid.withColumn("_sum", F.sum("_c").over(in_time_order().rowsBetween(Window.unboundedPreceding, 0)))
    size = F.abs("_sum")
    out = path.groupBy(*KEY).agg(
        F.max_by("t", F.struct(F.bround(size, 9), -F.col("t"))).alias("_at"),
        F.max(size).alias("change_magnitude"),
        (factor * F.stddev_pop("value") * F.sqrt(F.count("value"))).alias("significance_threshold"),
    )
    m, thr = F.col("change_magnitude"), F.col("significance_threshold")
    hit = m > thr
    return out.select(
        *KEY,
        hit.alias("change_point_detected"),
        F.when(hit, F.col("_at")).alias("change_point_index"),
        "change_magnitude",
        "significance_threshold",
        F.when(m > 1.5 * thr, "high").when(hit, "medium").otherwise("low").alias("confidence"),
    )


def rolling_zscore_change(df: DataFrame, limit: float = 2.5) -> DataFrame:
    """Strongest point by z against a centred window of min(24, n // 4) points."""
    rows = with_position(df).withColumn("window_size", F.least(F.lit(24), F.expr("n div 4")))
    sizes = rows.groupBy(*KEY).agg(F.max("window_size").alias("window_size"))
    wide = rows.filter(F.col("window_size") >= 12).withColumn("_z", F.col("pos") / F.col("window_size"))
    frame = (
        f"OVER (PARTITION BY {', '.join(KEY)} ORDER BY _z "
        f"RANGE BETWEEN 0.5D + {EPS} PRECEDING AND 0.5D - {EPS} FOLLOWING)"
    )
    scored = wide.select(
        *KEY,
        "t",
        "window_size",
        F.expr(f"count(value) {frame}").alias("_cnt"),
        F.expr(f"avg(value) {frame}").alias("_avg"),
        F.expr(f"stddev_samp(value) {frame}").alias("_std"),
        "value",
    ).filter(F.col("_cnt") == F.col("window_size"))
    score = F.abs(ratio(F.col("value") - F.col("_avg"), F.col("_std")))
    best = (
        scored.withColumn("_score", score)
        .filter(F.col("_score") > limit)
        .groupBy(*KEY)
        .agg(
            F.max_by("t", F.struct(F.bround("_score", 9), -F.col("t"))).alias("change_point_index"),
            F.max("_score").alias("max_zscore"),
        )
    )
    return sizes.join(best, KEY, "left").select(
        *KEY,
        F.col("change_point_index").isNotNull().alias("change_point_detected"),
        "change_point_index",
        "max_zscore",
        "window_size",
    )


def variance_halves(df: DataFrame) -> DataFrame:
    rows = with_position(df)
    first = F.col("pos") < F.expr("n div 2")
    out = rows.groupBy(*KEY).agg(
        F.var_pop(F.when(first, F.col("value"))).alias("first_half_variance"),
        F.var_pop(F.when(~first, F.col("value"))).alias("second_half_variance"),
    )
    r = F.coalesce(ratio(F.col("first_half_variance"), F.col("second_half_variance")), F.lit(1.0))
    return out.withColumn("variance_ratio", r).withColumns(
        {
            "variance_change_detected": F.abs(F.col("variance_ratio") - 1.0) > 0.5,
            "change_type": F.when(F.col("variance_ratio") < 1, "increased_volatility")
            .when(F.col("variance_ratio") > 1, "decreased_volatility")
            .otherwise("stable"),
        }
    )


def running_sums(df: DataFrame) -> DataFrame:
    """Exclusive running sums of centred values: e1 Σc, e2 Σc², ep Σpos·c."""
    rows = with_position(df).withColumn("_c", F.col("value") - F.avg("value").over(by_series()))
    before = in_time_order().rowsBetween(Window.unboundedPreceding, -1)
    c = F.col("_c")
    total = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0.0))
    return rows.withColumns({"e1": total(c), "e2": total(c * c), "ep": total(c * F.col("pos"))})


def _split_windows(df: DataFrame, width: Column) -> DataFrame:
    """Sums over the ``w`` positions before (b*) and from (a*) each scan point."""
    rows = running_sums(df).withColumn("w", width)
    rows = rows.withColumn("_z", F.col("pos") / F.col("w")).withColumn("_e", F.struct("e1", "e2", "ep"))
    over = f"OVER (PARTITION BY {', '.join(KEY)} ORDER BY _z RANGE BETWEEN "
    back = f"{over} 1.0D + {EPS} PRECEDING AND 1.0D - {EPS} PRECEDING)"
    ahead = f"{over} 1.0D - {EPS} FOLLOWING AND 1.0D + {EPS} FOLLOWING)"
    rows = rows.withColumns(
        {"_back": F.expr(f"max(_e) {back}"), "_ahead": F.expr(f"max(_e) {ahead}")}
    ).filter((F.col("pos") >= F.col("w")) & (F.col("pos") < F.col("n") - F.col("w")))
    return rows.select(
        *KEY,
        "t",
        "pos",
        "n",
        F.col("w").cast("double").alias("w"),
        *[(F.col(e) - F.col(f"_back.{e}")).alias(f"b{e[1:]}") for e in ("e1", "e2", "ep")],
        *[(F.col(f"_ahead.{e}") - F.col(e)).alias(f"a{e[1:]}") for e in ("e1", "e2", "ep")],
    )


def _quarter_windows(df: DataFrame, floor: int = 24) -> DataFrame:
    return _split_windows(df, F.greatest(F.lit(floor), F.expr("n div 4")))


def variance_scan(df: DataFrame, floor: int = 24) -> DataFrame:
    rows = _quarter_windows(df, floor)
    w = F.col("w")
    before, after = pooled(w, F.col("b1"), F.col("b2")), pooled(w, F.col("a1"), F.col("a2"))
    scale = ratio(F.col("b2") + F.col("a2"), 2 * w)
    flat = lambda v: F.when(v <= FLAT * scale, 0.0).otherwise(v)
    r = F.when(flat(before) > 0, ratio(flat(after), flat(before))).otherwise(1.0)
    size = F.when(F.col("_r") > 0, F.abs(F.ln("_r"))).otherwise(F.lit(float("inf")))
    best = (
        rows.withColumn("_r", r)
        .withColumn("_size", size)
        .groupBy(*KEY)
        .agg(
            F.max_by(F.struct("t", "_r", "_size"), F.struct(F.bround("_size", 9), -F.col("t"))).alias("_b")
        )
    )
    out = best.select(*KEY, F.col("_b.t").alias("_t"), F.col("_b._r").alias("variance_ratio"), F.col("_b._size").alias("_size"))
    return out.select(
        *KEY,
        (F.col("_size") > 0.5).alias("change_detected"),
        F.when(F.col("_size") > 0.5, F.col("_t")).alias("change_index"),
        "variance_ratio",
        F.when(F.col("variance_ratio") > 1.5, "increased_volatility")
        .when(F.col("variance_ratio") < 0.67, "decreased_volatility")
        .otherwise("stable_volatility")
        .alias("change_type"),
    )


def _keep_all(df: DataFrame, found: DataFrame, flag: str) -> DataFrame:
    """Every series, with ``flag`` false where nothing was found."""
    keys = df.groupBy(*KEY).agg(F.count("value").alias("points"))
    return keys.join(found.withColumn(flag, F.lit(True)), KEY, "left").withColumn(
        flag, F.coalesce(flag, F.lit(False))
    )


def mean_shift_scan(df: DataFrame, floor: int = 24, alpha: float = 0.05) -> DataFrame:
    rows = _quarter_windows(df, floor)
    w = F.col("w")
    diff = (F.col("a1") - F.col("b1")) / w
    var = pooled(w, F.col("b1"), F.col("b2")) + pooled(w, F.col("a1"), F.col("a2"))
    # equal sizes: pooled sample variance times 2 / w
    se = F.sqrt(var / (w - 1))
    tested = rows.select(
        *KEY, "t", (2 * w - 2).cast("int").alias("_dof"), diff.alias("_d"), ratio(F.abs(diff), se).alias("_t")
    )
    # no spread on either side: any difference is certain
    certain = F.when(F.col("_d") != 0, 0.0).otherwise(1.0)
    tested = tested.withColumn("_p", F.coalesce(t_two_sided(F.col("_t"), F.col("_dof")), certain))
    # a NULL order is skipped; a filter would be pushed down and repeat the tail
    order = F.when(F.col("_p") < alpha, F.struct(F.bround(F.abs("_d"), 9), -F.col("t")))
    best = tested.groupBy(*KEY).agg(F.max_by(F.struct("t", "_d", "_p"), order).alias("_b"))
    best = best.filter(F.col("_b").isNotNull())
    found = best.select(
        *KEY,
        F.col("_b.t").alias("shift_index"),
        F.col("_b._d").alias("shift_magnitude"),
        F.col("_b._p").alias("p_value"),
        F.when(F.col("_b._d") > 0, "upward").otherwise("downward").alias("shift_direction"),
    )
    return _keep_all(df, found, "shift_detected")


def _window_line(rows_w: Column, start: Column, s1: Column, s2: Column, sp: Column) -> Line:
    """Line through ``w`` consecutive positions from ``start``, from their sums."""
    middle = start + (rows_w - 1) / 2
    return Line(
        n=rows_w,
        sxx=rows_w * (rows_w * rows_w - 1) / 12,
        syy=F.greatest(F.lit(0.0), s2 - s1 * s1 / rows_w),
        sxy=sp - middle * s1,
    )


def trend_change_scan(df: DataFrame, floor: int = 36, alpha: float = 0.1, min_change: float = 0.01) -> DataFrame:
    rows = _split_windows(df, F.greatest(F.lit(floor), F.expr("n div 3")))
    w, pos = F.col("w"), F.col("pos")
    before = _window_line(w, pos - w, F.col("b1"), F.col("b2"), F.col("bp"))
    after = _window_line(w, pos, F.col("a1"), F.col("a2"), F.col("ap"))
    # slopes and correlations become columns first: the tail reads them often
    lines = rows.select(
        *KEY,
        "t",
        "w",
        before.slope.alias("_b"),
        after.slope.alias("_a"),
        F.sqrt(before.r2).alias("_rb"),
        F.sqrt(after.r2).alias("_ra"),
    )
    lines = lines.withColumns(
        {
            "_d": F.abs(F.col("_a") - F.col("_b")),
            "_tb": r_to_t(F.col("_rb"), F.col("w")),
            "_ta": r_to_t(F.col("_ra"), F.col("w")),
        }
    )
    dof = (F.col("w") - 2).cast("int")
    tested = lines.withColumns(
        {"_pb": t_two_sided(F.col("_tb"), dof), "_pa": t_two_sided(F.col("_ta"), dof)}
    )
    hit = (F.col("_d") > min_change) & (F.col("_pb") < alpha) & (F.col("_pa") < alpha)
    # a NULL order is skipped; a filter would be pushed down and repeat the tails
    order = F.when(hit, F.struct(F.bround("_d", 9), -F.col("t")))
    best = tested.groupBy(*KEY).agg(F.max_by(F.struct("t", "_b", "_a", "_d"), order).alias("_x"))
    best = best.filter(F.col("_x").isNotNull())
    found = best.select(
        *KEY,
        F.col("_x.t").alias("change_index"),
        F.col("_x._b").alias("slope_before"),
        F.col("_x._a").alias("slope_after"),
        F.col("_x._d").alias("slope_difference"),
        slope_change(F.col("_x._b"), F.col("_x._a")).alias("change_description"),
    )
    return _keep_all(df, found, "trend_change_detected")


def chow_tests(df: DataFrame, step: int = 6, min_segment: int = 24, min_length: int = 60, restricted: str = "mean") -> DataFrame:
    """F tests of two lines against the mean (default) or against one line."""
    g = by_series()
    rows = running_sums(df).filter(F.col("n") >= min_length)
    c, pos = F.col("_c"), F.col("pos")
    rows = rows.withColumns(
        {
            "_t1": F.sum(c).over(g),
            "_t2": F.sum(c * c).over(g),
            "_tp": F.sum(c * pos).over(g),
        }
    ).filter(
        (pos >= min_segment)
        & (pos < F.col("n") - min_segment)
        & ((pos - min_segment) % step == 0)
    )
    n = F.col("n").cast("double")
    at = pos.cast("double")
    left = _window_line(at, F.lit(0.0), F.col("e1"), F.col("e2"), F.col("ep"))
    right = _window_line(
        n - at, at, F.col("_t1") - F.col("e1"), F.col("_t2") - F.col("e2"), F.col("_tp") - F.col("ep")
    )
    whole = _window_line(n, F.lit(0.0), F.col("_t1"), F.col("_t2"), F.col("_tp"))
    free = left.rss + right.rss
    bound = whole.syy if restricted == "mean" else whole.rss
    f = ((bound - free) / 2) / (free / (n - 4))
    tests = rows.withColumn("_free", free).filter(F.col("_free") > 0)
    return tests.select(
        *KEY,
        F.col("pos").alias("break_point"),
        f.alias("f_statistic"),
        f2_tail(f, n - 4).alias("p_value"),
        left.slope.alias("slope_before"),
        right.slope.alias("slope_after"),
    ).withColumn("significant", F.col("p_value") < 0.05)


def chow_scan(df: DataFrame, **options) -> DataFrame:
    """Most significant break per series and how many were tested."""
    tests = chow_tests(df, **options)
    best = F.min_by(
        F.struct("break_point", "f_statistic", "p_value", "slope_before", "slope_after"),
        F.struct(-F.bround("f_statistic", 9), "break_point"),
    )
    hit = F.col("significant_breaks") > 0
    return (
        tests.groupBy(*KEY)
        .agg(
            F.count(F.lit(1)).alias("total_breaks_tested"),
            F.count_if("significant").alias("significant_breaks"),
            best.alias("_b"),
        )
        .select(
            *KEY,
            hit.alias("structural_break_detected"),
            "total_breaks_tested",
            "significant_breaks",
            *[
                F.when(hit, F.col(f"_b.{c}")).alias(c)
                for c in ("break_point", "f_statistic", "p_value", "slope_before", "slope_after")
            ],
        )
    )

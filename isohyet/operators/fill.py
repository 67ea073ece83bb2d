"""Gaps: finding, filling, interpolating in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isohyet.series import KEY, PERIOD, by_series, in_time_order, with_length


def find_gaps(df: DataFrame) -> DataFrame:
    """Runs of missing values with start, end and size."""
    missing = df.filter(F.col("value").isNull())
    return (
        missing.withColumn("_island", F.col("t") - F.row_number().over(in_time_order()))
        .groupBy(*KEY, "_island")
        .agg(
            F.min("t").alias("gap_start"),
            F.max("t").alias("gap_end"),
            F.count(F.lit(1)).alias("gap_size"),
        )
        .drop("_island")
    )


def _neighbours(df: DataFrame, curve: bool = False) -> DataFrame:
    """For each row the nearest valid points on both sides, two deep.

    Columns ``before``/``after`` are struct(t, v, t2, v2); the second pair is
    the valid point beyond the first, used to extrapolate at the ends.  With
    ``curve`` both points also carry that column, as c and c2.
    """
    past = in_time_order().rowsBetween(Window.unboundedPreceding, -1)
    ahead = in_time_order().rowsBetween(1, Window.unboundedFollowing)
    valid = F.col("value").isNotNull()
    fields = {"t": "t", "v": "value"} | ({"c": "curve"} if curve else {})
    point = F.when(valid, F.struct(*[F.col(c).alias(f) for f, c in fields.items()]))
    out = with_length(df).withColumn("_p", point)
    out = out.withColumns(
        {
            "_prev": F.last("_p", ignorenulls=True).over(past),
            "_next": F.first("_p", ignorenulls=True).over(ahead),
        }
    )

    def two(beyond: str) -> Column:
        return F.when(
            valid,
            F.struct(
                *[F.col(c).alias(f) for f, c in fields.items()],
                *[F.col(f"{beyond}.{f}").alias(f"{f}2") for f in fields],
            ),
        )

    out = out.withColumns({"_b": two("_prev"), "_a": two("_next")})
    return out.withColumns(
        {
            "before": F.last("_b", ignorenulls=True).over(past),
            "after": F.first("_a", ignorenulls=True).over(ahead),
        }
    ).drop("_p", "_prev", "_next", "_b", "_a")


def _through(t: Column, t1: Column, v1: Column, t2: Column, v2: Column) -> Column:
    return v1 + (v2 - v1) * F.try_divide(t - t1, t2 - t1)


def linear_estimate() -> Column:
    """Interpolation between neighbours, extrapolation at the ends."""
    t, b, a = F.col("t"), F.col("before"), F.col("after")
    return (
        F.when(b.isNull(), _through(t, a["t"], a["v"], a["t2"], a["v2"]))
        .when(a.isNull(), _through(t, b["t2"], b["v2"], b["t"], b["v"]))
        .otherwise(_through(t, b["t"], b["v"], a["t"], a["v"]))
    )


def _gap_size() -> Column:
    before = F.coalesce(F.col("before")["t"], F.lit(-1))
    after = F.coalesce(F.col("after")["t"], F.col("n"))
    return F.when(F.col("value").isNull(), after - before - 1)


def fill_linear(df: DataFrame, max_gap: int = 3) -> DataFrame:
    """Fill gaps of at most ``max_gap`` periods; adds ``filled`` and ``gap_size``."""
    rows = _neighbours(df).withColumn("gap_size", _gap_size())
    fillable = F.col("value").isNull() & (F.col("gap_size") <= max_gap)
    out = rows.withColumn("filled", F.when(fillable, linear_estimate()).otherwise(F.col("value")))
    return out.drop("before", "after", "n")


def fill_seasonal(df: DataFrame, max_gap: int = 3, period: int = PERIOD) -> DataFrame:
    """Fill short gaps with the mean of the same phase in other cycles."""
    rows = _neighbours(df).withColumn("gap_size", _gap_size())
    phase_mean = F.avg("value").over(by_series(F.col("t") % period))
    out = rows.withColumn(
        "filled", F.when(F.col("gap_size") <= max_gap, phase_mean).otherwise(F.col("value"))
    )
    return out.drop("before", "after", "n")


def _with_curvature(df: DataFrame) -> DataFrame:
    """(KEY, t, value, curve): second derivatives at the valid points of the spline with not-a-knot ends through them.

    The equations of the inner points are tridiagonal: one fold over a series' points eliminates downwards, one
    solves upwards.  ``curve`` is null in series of fewer than four valid points.
    """
    cell = F.struct(F.col("t").alias("t"), F.col("value").cast("double").alias("v"))
    series = df.groupBy(*KEY).agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    series = series.withColumn("p", F.filter("cells", lambda x: x["v"].isNotNull()))
    p, n = F.col("p"), F.size("p")
    enough = n >= 4
    between = lambda f: F.when(enough, F.transform(F.sequence(F.lit(0), n - 2), lambda i: f(F.get(p, i), F.get(p, i + 1))))
    series = series.withColumn("h", between(lambda a, b: (b["t"] - a["t"]).cast("double")))
    series = series.withColumn("s", between(lambda a, b: (b["v"] - a["v"]) / (b["t"] - a["t"])))
    h, s = lambda i: F.get("h", i), lambda i: F.get("s", i)

    def equation(k: Column) -> Column:
        a, b, first, last = h(k), h(k + 1), k == 0, k == n - 3
        return F.struct(
            F.when(last, a - b * b / a).otherwise(a).alias("below"),
            (2 * (a + b) + F.when(first, a * (a + b) / b).otherwise(0.0) + F.when(last, b * (a + b) / a).otherwise(0.0)).alias("middle"),
            F.when(first, b - a * a / b).otherwise(b).alias("above"),
            (6 * (s(k + 1) - s(k))).alias("right"),
        )

    series = series.withColumn("e", F.when(enough, F.transform(F.sequence(F.lit(0), n - 3), equation)))

    def down(done: Column, e: Column) -> Column:
        up = F.element_at(done, -1)
        factor = e["below"] / up["middle"]
        left = F.struct(
            (e["middle"] - factor * up["above"]).alias("middle"), e["above"].alias("above"), (e["right"] - factor * up["right"]).alias("right")
        )
        return F.concat(done, F.array(left))

    nothing = F.array(F.struct(F.lit(1.0).alias("middle"), F.lit(0.0).alias("above"), F.lit(0.0).alias("right")))
    series = series.withColumn("e", F.aggregate("e", nothing, down))
    solve = lambda done, e: F.concat(done, F.array((e["right"] - e["above"] * F.element_at(done, -1)) / e["middle"]))
    # upwards from the last inner point; the leading entries of both folds stand for no equation
    series = series.withColumn("c", F.aggregate(F.reverse(F.slice("e", 2, F.greatest(n - 2, F.lit(0)))), F.array(F.lit(0.0)), solve))
    inner = F.reverse(F.slice("c", 2, F.greatest(n - 2, F.lit(0))))
    series = series.withColumn("c", F.when(enough, inner))
    c = lambda i: F.get("c", i)
    ends = (
        ((h(F.lit(0)) + h(F.lit(1))) * c(F.lit(0)) - h(F.lit(0)) * c(F.lit(1))) / h(F.lit(1)),
        ((h(n - 3) + h(n - 2)) * c(n - 3) - h(n - 2) * c(n - 4)) / h(n - 3),
    )
    series = series.withColumn("c", F.concat(F.array(ends[0]), F.col("c"), F.array(ends[1])))
    point = lambda x, curve: F.struct(x["t"].alias("t"), x["v"].alias("value"), curve.cast("double").alias("curve"))
    return series.select(
        *KEY,
        F.inline(F.concat(
            F.transform("p", lambda x, i: point(x, F.get("c", i))),
            F.transform(F.filter("cells", lambda x: x["v"].isNull()), lambda x: point(x, F.lit(None))),
        )),
    )


def _spline_estimate() -> Column:
    """The cubic between the neighbours; beyond the ends that of the first or last two points."""
    b, a = F.col("before"), F.col("after")

    def cubic(t1, v1, c1, t2, v2, c2) -> Column:
        h, d = t2 - t1, F.col("t") - t1
        first = (v2 - v1) / h - h * (2 * c1 + c2) / 6
        return v1 + d * (first + d * (c1 / 2 + d * (c2 - c1) / (6 * h)))

    near, far = ("t", "v", "c"), ("t2", "v2", "c2")
    return (
        F.when(b.isNull(), cubic(*[a[x] for x in near], *[a[x] for x in far]))
        .when(a.isNull(), cubic(*[b[x] for x in far], *[b[x] for x in near]))
        .otherwise(cubic(*[b[x] for x in near], *[a[x] for x in near]))
    )


def fill_spline(df: DataFrame, max_gap: int = 3) -> DataFrame:
    """Fill short gaps with a cubic spline; linear where fewer than 4 points exist.

    One spline goes through all valid points of a series.  The windows that read its curvatures keep the exchange on
    the series key of the aggregate that finds them.
    """
    rows = _neighbours(_with_curvature(df), curve=True).withColumn("_gap", _gap_size())
    few = F.count("value").over(by_series()) < 4
    estimate = F.when(few, linear_estimate()).otherwise(_spline_estimate())
    out = rows.withColumn("filled", F.when(F.col("_gap") <= max_gap, estimate).otherwise(F.col("value")))
    return out.drop("before", "after", "n", "_gap", "curve")


def quality_fill(df: DataFrame, max_missing: int = 5, replace_flagged: bool = False) -> DataFrame:
    """Linear fill unless the longest missing or flagged run is too long.

    Flagged values (``quality_flag = 0``) count as missing for the decision but
    are replaced only with ``replace_flagged=True``.
    """
    g = by_series()
    flagged = F.coalesce(F.col("quality_flag") == 0, F.lit(False))
    bad = F.col("value").isNull() | flagged
    rows = df.withColumns({"_bad": bad, "_flagged": flagged})
    # rows since the last good one
    last_good = F.max(F.when(~F.col("_bad"), F.col("t"))).over(
        in_time_order().rowsBetween(Window.unboundedPreceding, 0)
    )
    rows = rows.withColumn("_run", F.when(F.col("_bad"), F.col("t") - F.coalesce(last_good, F.lit(-1))))
    rows = rows.withColumns(
        {
            "max_consecutive_missing": F.coalesce(F.max("_run").over(g), F.lit(0)),
            "missing_points": F.count_if("_bad").over(g),
            "bad_quality_points": F.count_if("_flagged").over(g),
            "original": F.col("value"),
        }
    )
    if replace_flagged:
        rows = rows.withColumn("value", F.when(~F.col("_flagged"), F.col("value")))
    filled = fill_linear(rows, max_missing)
    ok = F.col("max_consecutive_missing") <= max_missing
    return filled.select(
        *KEY,
        "t",
        F.col("original").alias("value"),
        F.when(ok, F.col("filled")).otherwise(F.col("original")).alias("filled"),
        F.when(ok, "ok").otherwise("too_many_missing").alias("status"),
        "missing_points",
        "bad_quality_points",
        "max_consecutive_missing",
    )


def asof_interpolate(points: DataFrame, series: DataFrame) -> DataFrame:
    """Value of each series at arbitrary times, between its bracketing rows.

    Each whole period knows its bracketing rows (a table bounded by the calendar), and a point looks up the period it
    falls in with an equi-join, so any number of points may ask one series.  ``points`` needs KEY, ``point_id`` and ``x``.
    """
    known = series.filter(F.col("value").isNotNull()).select(*KEY, "t", "value")
    here = F.struct(F.col("t").cast("double").alias("x"), "value")
    spans = known.withColumn("_b", here).withColumn("_a", F.lead("_b").over(in_time_order()))
    last = F.coalesce(F.col("_a.x").cast("bigint") - 1, F.col("t").cast("bigint"))
    periods = spans.select(*KEY, "_b", "_a", F.explode(F.sequence(F.col("t").cast("bigint"), last)).alias("_at"))
    asked = points.select(*KEY, F.col("point_id").cast("bigint"), F.col("x").cast("double"))
    both = asked.withColumn("_at", F.floor("x")).join(periods, [*KEY, "_at"], "left")
    b, a, x = F.col("_b"), F.col("_a"), F.col("x")
    exact = F.coalesce(b["x"] == x, F.lit(False))
    inside = exact | (b.isNotNull() & a.isNotNull())
    weight = (x - b["x"]) / (a["x"] - b["x"])
    return both.select(
        *KEY,
        "point_id",
        "x",
        F.when(exact, b["value"]).when(inside, b["value"] + weight * (a["value"] - b["value"])).alias(
            "interpolated_value"
        ),
        F.when(exact, "exact_match").when(inside, "linear_temporal").otherwise("outside_range").alias("method"),
        F.when(exact, 1.0).alias("confidence"),
        F.when(inside & ~exact, weight).alias("weight"),
    )

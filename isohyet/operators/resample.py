"""Reproducible bootstraps without multiplying rows.

A series is bounded by its calendar, so its values ride along as one array and
every replicate is a fold over that array inside the row.  Resampled positions
come from modular arithmetic on (seed, replicate, draw): the same on every
engine and every retry, which ``rand()`` is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.functions.numeric import ratio
from isohyet.series import KEY, PERIOD

# fixed values: a Mersenne prime and odd multipliers below it
PRIME = 2147483647
MIX = (48271, 69621, 16807)


def draw(seed: int, replicate: Column, position: Column, n: Column) -> Column:
    """Position in 0..n-1 of one draw; two squarings break the lattice."""
    p = F.lit(PRIME).cast("bigint")
    x = (
        (replicate.cast("bigint") + 1) * MIX[0]
        + (position.cast("bigint") + 1) * MIX[1]
        + F.lit(seed * MIX[2])
    ) % p
    x = (x * x + MIX[0]) % p
    x = (x * x + MIX[1]) % p
    return (x % n).cast("int")


def as_arrays(df: DataFrame) -> DataFrame:
    """One row per series with its valid (t, value) pairs in time order."""
    valid = df.filter(F.col("value").isNotNull())
    pairs = F.array_sort(F.collect_list(F.struct(F.col("t").cast("double").alias("t"), "value")))
    return valid.groupBy(*KEY).agg(pairs.alias("obs")).withColumn("points", F.size("obs"))


def bootstrap_trend(df: DataFrame, replicates: int = 100, seed: int = 42, period: int = PERIOD) -> DataFrame:
    """Spread of the yearly slope when values are redrawn; 0 for 24 points or fewer."""
    n = F.col("points")
    last = n - 1
    middle = last / 2.0

    def slope(b: Column) -> Column:
        sxy = F.aggregate(
            F.sequence(F.lit(0), last),
            F.lit(0.0),
            lambda acc, i: acc + (i - middle) * F.get(F.col("obs"), draw(seed, b, i, n))["value"],
        )
        return sxy / (n * (F.pow(n.cast("double"), F.lit(2)) - 1) / 12.0) * period

    rows = as_arrays(df).withColumn(
        "_s", F.when(n > 24, F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), slope))
    )
    add = lambda f: F.aggregate("_s", F.lit(0.0), lambda acc, x: acc + f(x))
    mean = add(lambda x: x) / replicates
    rows = rows.withColumn("_m", mean)
    spread = F.sqrt(add(lambda x: (x - F.col("_m")) * (x - F.col("_m"))) / replicates)
    return rows.select(*KEY, "points", F.coalesce(spread, F.lit(0.0)).alias("trend_uncertainty"))


def _sorted_percentile(values: Column, share: float, count: int) -> Column:
    """Linear interpolation in a sorted array of known size."""
    at = share * (count - 1)
    low = int(at)
    high = min(low + 1, count - 1)
    a, b = F.get(values, F.lit(low)), F.get(values, F.lit(high))
    return a + (b - a) * (at - low)


def bootstrap_intervals(
    df: DataFrame, horizon: int = 12, replicates: int = 100, seed: int = 42
) -> DataFrame:
    """Intervals of the line refitted on redrawn points, per coming period."""
    n = F.col("points")

    def refit(b: Column) -> Column:
        zero = F.struct(*[F.lit(0.0).alias(k) for k in ("x", "y", "xx", "xy")])

        def add(acc: Column, i: Column) -> Column:
            o = F.get(F.col("obs"), draw(seed, b, i, n))
            return F.struct(
                (acc["x"] + o["t"]).alias("x"),
                (acc["y"] + o["value"]).alias("y"),
                (acc["xx"] + o["t"] * o["t"]).alias("xx"),
                (acc["xy"] + o["t"] * o["value"]).alias("xy"),
            )

        def line(acc: Column) -> Column:
            slope = ratio(n * acc["xy"] - acc["x"] * acc["y"], n * acc["xx"] - acc["x"] * acc["x"])
            return F.struct(slope.alias("slope"), ((acc["y"] - slope * acc["x"]) / n).alias("base"))

        return F.aggregate(F.sequence(F.lit(0), n - 1), zero, add, line)

    ends = df.groupBy(*KEY).agg((F.max("t") + 1).alias("_from"))
    fits = as_arrays(df).filter(n >= 2).withColumn(
        "_fits", F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), refit)
    )
    leads = fits.join(ends, KEY).select(
        *KEY, "_fits", "_from", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("lead")
    )
    future = F.col("_from") + F.col("lead") - 1
    values = F.array_sort(F.transform("_fits", lambda f: f["base"] + f["slope"] * future))
    leads = leads.withColumn("_v", values)
    return leads.select(
        *KEY,
        "lead",
        *[
            _sorted_percentile(F.col("_v"), share, replicates).alias(name)
            for name, share in (("lower_95", 0.025), ("lower_80", 0.1), ("upper_80", 0.9), ("upper_95", 0.975))
        ],
    )

"""Small column helpers that stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL when den is zero (ANSI division would raise)."""
    return F.try_divide(num, den)


def clamp(x: Column, low: float, high: float) -> Column:
    # least and greatest skip NULLs, so an unknown value must be kept apart
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x.cast("double"), digits)


def mean_to(x: Column, digits: int) -> Column:
    """Mean rounded half-even; summation noise is cleared first, so that the
    result does not depend on how rows were spread over tasks."""
    return F.bround(F.bround(F.avg(x), 9), digits)


def pooled(n: Column, total: Column, squares: Column) -> Column:
    """Population variance from a count, a sum and a sum of squares."""
    var = ratio(squares, n) - ratio(total, n) * ratio(total, n)
    return F.when(var.isNotNull(), F.greatest(F.lit(0.0), var))


def hypot(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def percentile(col: Column | str, *ps: float) -> Column:
    """Exact percentiles with linear interpolation, as an array in ``ps`` order."""
    return F.percentile(col, F.array(*[F.lit(p / 100.0) for p in ps]))

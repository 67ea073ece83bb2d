"""The series table: keys, windows, building cells from facts, completing gaps.

A series is bounded by its calendar, never by the number of raw facts: facts
are reduced to one cell per ``(location_id, variable, t)`` with map-side
partial aggregation first, so a hot location only costs its own cells.  All
windows below share one hash exchange on :data:`KEY`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY = ["location_id", "variable"]
PERIOD = 12


def by_series(*extra: str | Column) -> WindowSpec:
    return Window.partitionBy(*KEY, *extra)


def in_time_order(*extra: str | Column) -> WindowSpec:
    return by_series(*extra).orderBy("t")


def months_since(ts: Column, year: int) -> Column:
    return (F.year(ts) - F.lit(year)) * 12 + F.month(ts) - 1


def build_cells(facts: DataFrame, value: Column) -> DataFrame:
    """One row per cell; ``value`` is an aggregate expression over the facts."""
    return facts.groupBy(*KEY, "t").agg(value.alias("value"))


def complete_periods(cells: DataFrame, periods: int) -> DataFrame:
    """Add a NULL row for every absent period 0..periods-1 of each series.

    Rows before 0 or after the last period stay, and the gaps up to them are filled too.

    Each row is stretched up to the next one, so there is no calendar join and
    the exchange on the series key is the one later windows need anyway.
    """
    w = in_time_order()
    first = F.row_number().over(w) == 1
    stretched = cells.select(
        *KEY,
        F.col("t").alias("_at"),
        "value",
        F.when(first, F.least(F.lit(0), F.col("t"))).otherwise(F.col("t")).cast("int").alias("_from"),
        F.coalesce(F.lead("t").over(w) - 1, F.greatest(F.lit(periods - 1), F.col("t"))).cast("int").alias("_to"),
    )
    return stretched.select(
        *KEY, F.explode(F.sequence("_from", "_to")).alias("t"), "value", "_at"
    ).select(*KEY, "t", F.when(F.col("t") == F.col("_at"), F.col("value")).alias("value"))


def with_calendar(series: DataFrame, origin_year: int = 0, period: int = PERIOD) -> DataFrame:
    """Calendar columns from the period index; ``month`` is the 1-based phase."""
    return series.withColumns(
        {
            "year": (F.floor(F.col("t") / period) + origin_year).cast("int"),
            "month": (F.col("t") % period + 1).cast("int"),
        }
    )


def with_length(series: DataFrame) -> DataFrame:
    """``n``: periods in the series, missing ones included."""
    return series.withColumn("n", (F.max("t").over(by_series()) + 1).cast("int"))


def whole_years(series: DataFrame, period: int = PERIOD) -> DataFrame:
    """Drop the rows of an unfinished last year."""
    return with_length(series).filter(
        F.col("t") < F.floor(F.col("n") / period) * period
    )


def with_position(series: DataFrame) -> DataFrame:
    """Valid rows only, with dense position ``pos`` and count ``n``."""
    valid = series.filter(F.col("value").isNotNull())
    return valid.withColumns(
        {
            "pos": F.row_number().over(in_time_order()) - 1,
            "n": F.count(F.lit(1)).over(by_series()).cast("int"),
        }
    )


def months_of(series: DataFrame, month: int, period: int = PERIOD) -> DataFrame:
    """Rows of one calendar month, whole years only."""
    return whole_years(series, period).filter(F.col("t") % period + 1 == month)

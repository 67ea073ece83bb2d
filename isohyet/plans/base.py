"""Sharing one materialised series between the branches of a composed report."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.checkpoint import reliable
from isohyet.series import KEY


def materialise(series: DataFrame, *extra: str) -> DataFrame:
    """Series rows kept in reliable storage for all branches of a report.

    Branches read this compact table instead of aggregating the facts again,
    and a lost executor re-reads files rather than the lineage.
    """
    return reliable(series.select(*KEY, "t", "value", *extra))


def one_row_per_series(*frames: DataFrame) -> DataFrame:
    """Left join frames that each hold one row per series."""
    return functools.reduce(lambda a, b: a.join(b, KEY, "left"), frames)


def prefixed(df: DataFrame, prefix: str, *columns: str) -> DataFrame:
    return df.select(*KEY, *[F.col(c).alias(f"{prefix}{c}") for c in columns])


def as_map(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """A handful of rows per series (conditions, seasons) as one map column."""
    return df.groupBy(*KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias(name))

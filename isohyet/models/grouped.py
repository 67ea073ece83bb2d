"""Rows of many groups as numbers: what models that fit all groups together share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUP = "variable"


def with_vector(rows: DataFrame, columns: Sequence[str], *keep: Column) -> DataFrame:
    """``x``: the columns as one array of doubles, next to ``keep``."""
    return rows.select(*keep, F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """(rows, width) doubles of an array column without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def runs(keys: list[np.ndarray], n: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of stretches with equal keys."""
    change = np.zeros(n, bool)
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    cuts = [0, *np.flatnonzero(change).tolist(), n] if n else [0]
    yield from zip(cuts[:-1], cuts[1:], strict=True)

from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from isohyet.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=8, partitions=4)
    yield session


@pytest.fixture(scope="session")
def make_series(spark):
    """Series frame from {(location_id, variable): values}; None is missing."""

    def make(values, **columns):
        rows = [
            (loc, var, t, None if v is None else float(v))
            for (loc, var), vs in values.items()
            for t, v in enumerate(vs)
        ]
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, "location_id bigint, variable string, t int, value double")
        return df.withColumns({k: F.lit(v) for k, v in columns.items()}) if columns else df

    return make


def rows(df, *order):
    return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]

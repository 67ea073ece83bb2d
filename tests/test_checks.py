"""Every registered query against its SQL on the smallest data."""

import os

import pytest

from checks.catalog import CHECKS
from checks.compare import compare, duck

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("check", [c for c in CHECKS if not c.heavy], ids=lambda c: c.name)
def test_query_equals_sql(spark, con, check):
    _, problem, _ = compare(spark, con, check, SF)
    assert not problem


def test_entry_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {c.name for c in CHECKS} <= set(entry.queries())


def test_series_without_a_prediction_keeps_its_probabilities(spark):
    from isohyet.operators import stats

    series = spark.createDataFrame(
        [(i, "temperature", t, float((t * 7 + i) % 23)) for i in (1, 2) for t in range(60)], "location_id bigint, variable string, t int, value double"
    )
    base = stats.exceedance_probabilities(series)
    some = spark.createDataFrame([(1, "temperature", 50.0, 0.6)], "location_id bigint, variable string, prediction double, confidence double")
    out = stats.adjust_probabilities(base, some, series)
    assert out.count() == base.count()
    assert out.filter("location_id = 2").count() == base.filter("location_id = 2").count() > 0

from pyspark.sql import functions as F

from isohyet import series as S
from tests.conftest import rows


def test_complete_periods_fills_every_hole(spark):
    cells = spark.createDataFrame(
        [(1, "a", 2, 5.0), (1, "a", 5, 6.0), (2, "a", 0, 1.0)],
        "location_id bigint, variable string, t int, value double",
    )
    out = rows(S.complete_periods(cells, 7), "location_id", "t")
    assert [(r["location_id"], r["t"], r["value"]) for r in out] == [
        *[(1, t, {2: 5.0, 5: 6.0}.get(t)) for t in range(7)],
        *[(2, t, {0: 1.0}.get(t)) for t in range(7)],
    ]


def test_build_cells_combines_a_hot_location_before_the_shuffle(spark):
    facts = spark.range(10_000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).cast("bigint").alias("location_id"),
        F.lit("a").alias("variable"),
        (F.col("id") % 5).cast("int").alias("t"),
        F.lit(2.0).alias("x"),
    )
    cells = S.build_cells(facts, F.avg("x"))
    assert "partial_avg" in cells._jdf.queryExecution().executedPlan().toString()
    assert cells.filter("location_id = 1").count() == 5


def test_whole_years_and_months(make_series):
    df = make_series({(1, "a"): range(30)})
    assert S.whole_years(df).count() == 24
    assert [r["t"] for r in rows(S.months_of(df, 4), "t")] == [3, 15]
    first = rows(S.with_calendar(df, 1990), "t")
    assert (first[13]["year"], first[13]["month"]) == (1991, 2)


def test_position_skips_missing(make_series):
    out = rows(S.with_position(make_series({(1, "a"): [None, 3, None, 4]})), "t")
    assert [(r["t"], r["pos"], r["n"]) for r in out] == [(1, 0, 2), (3, 1, 2)]


def test_rows_outside_the_calendar_stay(spark):
    df = spark.createDataFrame([(1, "temperature", t, float(t)) for t in (-2, 0, 2, 5, 7)], "location_id bigint, variable string, t int, value double")
    got = {r["t"]: r["value"] for r in S.complete_periods(df, 5).collect()}
    assert got == {t: (float(t) if t in (-2, 0, 2, 5, 7) else None) for t in range(-2, 8)}
    inside = S.complete_periods(df.filter("t between 0 and 2"), 5)
    assert sorted(r["t"] for r in inside.collect()) == [0, 1, 2, 3, 4]

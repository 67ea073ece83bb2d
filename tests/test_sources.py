import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from isohyet.operators import quality
from isohyet.sources import exports, readers, tables
from tests.conftest import rows


def test_monthly_json(spark, tmp_path):
    doc = {
        "location_id": 7, "lat": 1.0, "lon": 2.0,
        "properties": {"parameter": {
            "T2M": {"202001": 1.5, "202002": -999.0, "202013": 99.0, "2020": 5.0},
            "PRECTOTCORR": {"202012": 3.0}, "UNKNOWN": {"202001": 1.0}}},
    }
    (tmp_path / "a.json").write_text(json.dumps(doc))
    out = rows(readers.read_monthly_json(spark, str(tmp_path)), "variable", "month")
    assert [(r["variable"], r["year"], r["month"], r["value"]) for r in out] == [
        ("precipitation", 2020, 12, 3.0), ("temperature", 2020, 1, 1.5), ("temperature", 2020, 2, None)]


def test_outlook_grid_files(spark, tmp_path):
    text = "# LAT LON A N B\n\n 10.0 20.0 40 30 30\n10 20 1 2\nx 1 2 3 4\n12.5 20 33.3 33.3 33.4 extra\n"
    (tmp_path / "t.txt").write_text(text)
    (tmp_path / "p.txt").write_text("0 0 1 2 3\n")
    g = readers.read_outlook_grid(spark, {"temperature": str(tmp_path / "t.txt"), "precipitation": str(tmp_path / "p.txt")})
    out = rows(g, "variable", "line_no")
    assert [(r["variable"], r["lat"], r["above_normal"]) for r in out] == [
        ("precipitation", 0.0, 1.0), ("temperature", 10.0, 40.0), ("temperature", 12.5, 33.3)]
    from isohyet.operators import spatial

    p = spark.createDataFrame([(1, 10.2, 20.1)], "point_id bigint, lat double, lon double")
    assert rows(spatial.grid_lookup(p, g))[0]["above_normal"] == 40.0


def test_observations(spark, tmp_path):
    a = {"lat": 1.0, "lon": 2.0, "main": {"temp": 20.5, "feels_like": 19, "humidity": 40, "pressure": 1010}, "wind": {"speed": 3},
         "weather": [{"description": "clear"}], "name": "X", "sys": {"country": "NL"}}
    b = {"lat": 3.0, "lon": 4.0, "current_condition": [{"temp_C": "18", "FeelsLikeC": "17", "humidity": "50", "pressure": "1000",
         "windspeedKmph": "36", "winddirDegree": "90", "visibility": "10", "weatherDesc": [{"value": "Rain"}]}]}
    (tmp_path / "a.json").write_text(json.dumps(a))
    (tmp_path / "b.json").write_text(json.dumps(b))
    out = rows(readers.read_current_obs(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json")), "source")
    assert (out[0]["wind_direction"], out[0]["visibility"], out[0]["country"]) == (0.0, "Unknown", "NL")
    assert (out[1]["wind_speed"], out[1]["location"], out[1]["country"]) == (pytest.approx(10.0), "3.0, 4.0", None)


def test_places_and_elevation(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"display_name": "A", "lat": "1.5", "lon": "bad", "address": {"city": "C"}}))
    r = rows(readers.read_places_json(spark, str(tmp_path / "p.json")))[0]
    assert (r["lat"], r["lon"], r["city"], r["state"], r["importance"]) == (1.5, 0.0, "C", "", 0.0)
    (tmp_path / "e.json").write_text(json.dumps({"location_id": 1, "results": [{"elevation": 12.0}]}))
    assert rows(readers.read_elevation_json(spark, str(tmp_path / "e.json")))[0]["elevation"] == 12.0


def test_sinks(spark, make_series, tmp_path):
    df = make_series({(1, "temperature"): range(30), (1, "precipitation"): range(24)}, lat=1.0, lon=2.0)
    exports.write_series_csv(df, str(tmp_path / "csv"), 2000)
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == 48 and back.columns == ["location_id", "year", "month", "variable", "value", "latitude", "longitude"]
    analysis = df.groupBy("location_id", "variable").agg(F.avg("value").alias("mean"))
    exports.export_nested_json(df, str(tmp_path / "json"), 2000, {"source": F.lit("x")}, analysis)
    doc = [json.loads(x) for p in (tmp_path / "json").glob("*.json") for x in p.read_text().splitlines()][0]
    assert doc["raw_data"]["temperature"][1]["monthly_values"][0] == {"month": 1, "value": 12.0}
    assert doc["analysis"]["precipitation"]["mean"] == 11.5 and doc["metadata"]["source"] == "x"


def test_results_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "temperature", {"p5": 1.0})], "location_id bigint, variable string, percentiles map<string,double>")
    df = tables.with_expiry(df.withColumn("created_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")), "forecast")
    for _ in range(2):
        tables.write_results(df, str(tmp_path / "r"))
    back = spark.read.parquet(str(tmp_path / "r"))
    assert back.count() == 2 and back.first()["expires_at"] == dt.datetime(2024, 1, 1, 12)
    now = F.lit("2024-01-01 12:00:01").cast("timestamp_ntz")
    assert tables.drop_expired(back, now).count() == 0
    assert tables.expired_count(back, now).first()["deleted"] == 2


def test_stored_results_expire_in_place(spark, tmp_path):
    path = str(tmp_path / "s")
    kind = "request_id string, v double, detail map<string,double>, created_at timestamp_ntz"
    at = lambda day, hour=0: dt.datetime(2024, 1, day, hour)
    made = [("a", 1.0, {"x": 1.0}, at(1)), ("b", 2.0, None, at(2, 1)), ("c", None, {}, at(2, 23)), (None, 4.0, None, at(5)), ("e", 5.0, None, None)]
    new = tables.with_expiry(spark.createDataFrame([*made, made[0], ("b", 3.0, None, at(2, 1))], kind), "probability")
    read = lambda: sorted((r["request_id"] or "", r["v"]) for r in spark.read.parquet(path).collect())
    assert tables.expire_results(spark, path, F.lit("2024-01-03")) == 0
    for _ in range(2):  # the second time changes nothing
        tables.store_results(new, path)
        assert read() == [("", 4.0), ("a", 1.0), ("b", 2.0), ("c", None), ("e", 5.0)]
    now = F.lit("2024-01-03 12:00:00").cast("timestamp_ntz")
    assert [tables.expire_results(spark, path, now) for _ in range(2)] == [2, 0]
    assert read() == [("", 4.0), ("c", None), ("e", 5.0)]
    assert tables.expire_results(spark, path, F.lit("2024-01-03 23:30:00").cast("timestamp_ntz")) == 1  # the day's last row
    assert sorted(x.name for x in (tmp_path / "s").glob("expires_on=*")) == ["expires_on=2024-01-06", "expires_on=__HIVE_DEFAULT_PARTITION__"]
    tables.store_results(new.filter("request_id = 'a'"), path)
    assert read() == [("", 4.0), ("a", 1.0), ("e", 5.0)]
    assert tables.expire_results(spark, path, F.lit("2025-01-01").cast("timestamp_ntz")) == 2
    assert read() == [("e", 5.0)]
    tables.store_results(new.filter("v = 5"), path)
    tables.store_results(new.limit(0), path)
    assert read() == [("e", 5.0)]


def test_history_table_is_partitioned(spark, tmp_path):
    df = spark.range(100).select(
        (F.col("id") % 5).alias("location_id"), F.element_at(F.array(F.lit("a"), F.lit("b")), (F.col("id") % 2 + 1).cast("int")).alias("variable"),
        F.lit(2000).alias("year"), (F.col("id") % 12 + 1).cast("int").alias("month"), F.col("id").cast("double").alias("value"))
    tables.write_history(df, str(tmp_path / "h"))
    one = spark.read.parquet(str(tmp_path / "h")).filter("variable = 'a'")
    assert one.count() == 50 and "PartitionFilters: [isnotnull(variable" in one._jdf.queryExecution().executedPlan().toString()


def test_upsert_keeps_ids_and_adds_once(spark):
    old = spark.createDataFrame([(1, 10.0, 20.0, "a")], "id bigint, lat double, lon double, name string")
    old = old.select("id", *tables.place_key(F.col("lat"), F.col("lon")), "name")
    new = spark.createDataFrame([(10.0, 20.0, "b"), (11.0, 20.0, "c"), (11.0, 20.0, "d")], "lat double, lon double, name string")
    new = new.select(*tables.place_key(F.col("lat"), F.col("lon")), "name")
    all_ = tables.upsert_locations(new, old)
    assert all_.count() == 2
    ids = rows(tables.get_or_create(new, all_))
    assert len(ids) == 3 and len({r["id"] for r in ids}) == 2 and 1 in {r["id"] for r in ids}
    assert tables.upsert_locations(new, all_).count() == 2


def test_dedupe_latest_wins_with_many_copies(spark):
    df = spark.range(3000).select(
        F.lit(1).alias("location_id"), F.lit("a").alias("variable"), F.lit(2000).alias("year"), F.lit(1).alias("month"),
        F.col("id").cast("double").alias("value"), F.timestamp_seconds("id").alias("created_at"))
    out = tables.dedupe_history(df)
    assert "partial_max_by" in out._jdf.queryExecution().executedPlan().toString()
    assert [r["value"] for r in rows(out)] == [2999.0]


def test_windows_and_sentinels(spark):
    assert quality.verification_window(1970, 2030) == (1981, 2024)
    with pytest.raises(ValueError):
        quality.verification_window(2024, 2020)
    df = spark.createDataFrame([(-999.0,), (float("nan"),), (1.0,), (None,)], "value double")
    assert [r["value"] for r in rows(quality.null_sentinels(df))].count(None) == 3


def test_first_available(spark):
    a = spark.createDataFrame([(1, "x")], "id bigint, v string")
    b = spark.createDataFrame([(1, "y"), (2, "y")], "id bigint, v string")
    out = {r["id"]: (r["v"], r["source"]) for r in rows(quality.first_available(["id"], ("a", a), ("b", b)))}
    assert out == {1: ("x", "a"), 2: ("y", "b")}


def test_fingerprint_depends_on_order_and_missing(make_series):
    a, b, c = (rows(exports.fingerprint(make_series({(1, "a"): v})))[0]["fingerprint"] for v in ([1, 2, None], [2, 1, None], [1, None, 2]))
    assert len({a, b, c}) == 3 and all(len(x) == 16 for x in (a, b, c))

"""Readers for landed files; each parser also works on rows already loaded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.operators.quality import SENTINEL, variables

MONTHLY_SCHEMA = (
    "location_id bigint, lat double, lon double, "
    "properties struct<parameter: map<string, map<string, double>>>"
)
ELEVATION_SCHEMA = "location_id bigint, results array<struct<elevation: double>>"
OBS_A_SCHEMA = (
    "lat double, lon double, main struct<temp: double, feels_like: double, humidity: double, pressure: double>, "
    "wind struct<speed: double, deg: double>, weather array<struct<description: string>>, "
    "name string, sys struct<country: string>, visibility string"
)
OBS_B_SCHEMA = (
    "lat double, lon double, current_condition array<struct<temp_C: string, FeelsLikeC: string, "
    "humidity: string, pressure: string, windspeedKmph: string, winddirDegree: string, visibility: string, "
    "weatherDesc: array<struct<value: string>>>>"
)
PLACES_SCHEMA = (
    "display_name string, lat string, lon string, type string, importance double, "
    "address struct<country: string, state: string, city: string, county: string, postcode: string>"
)


def parse_monthly(responses: DataFrame) -> DataFrame:
    """Long rows from service responses: months 1 to 12 only, sentinel to NULL."""
    params = responses.select(
        "location_id", "lat", "lon", F.explode("properties.parameter").alias("source_parameter", "_months")
    )
    cells = params.select(
        "location_id", "lat", "lon", "source_parameter", F.explode("_months").alias("_period", "_value")
    )
    cells = cells.select(
        "*",
        F.substring("_period", 1, 4).try_cast("int").alias("year"),
        F.substring("_period", 5, 2).try_cast("int").alias("month"),
    ).filter((F.length("_period") == 6) & F.col("month").between(1, 12))
    known = F.broadcast(variables(responses.sparkSession).select("variable", "source_parameter"))
    return cells.join(known, "source_parameter").select(
        "location_id",
        "variable",
        "year",
        "month",
        F.when((F.col("_value") != SENTINEL) & ~F.isnan("_value"), F.col("_value")).alias("value"),
        "lat",
        "lon",
    )


def read_monthly_json(spark: SparkSession, path: str) -> DataFrame:
    return parse_monthly(spark.read.schema(MONTHLY_SCHEMA).json(path))


def read_elevation_json(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(ELEVATION_SCHEMA).json(path)
    return raw.select("location_id", F.get("results", F.lit(0))["elevation"].alias("elevation"))


def parse_outlook_lines(lines: DataFrame) -> DataFrame:
    """Grid rows from ``variable``, ``line_no`` and ``value`` (the text line)."""
    parts = F.split(F.trim(F.col("value")), r"\s+")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    rows = lines.filter(~F.startswith("value", F.lit("#")) & (F.size(parts) >= 5)).select(
        "variable",
        "line_no",
        number(0).alias("lat"),
        number(1).alias("lon"),
        number(2).alias("above_normal"),
        number(3).alias("normal"),
        number(4).alias("below_normal"),
    )
    return rows.dropna(subset=["lat", "lon", "above_normal", "normal", "below_normal"])


def read_outlook_grid(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """One file per variable; ``line_no`` orders lines as in the file."""
    frames = []
    for variable, path in paths.items():
        text = spark.read.text(path).select("value", "_metadata.file_block_start")
        frames.append(
            text.select(
                F.lit(variable).alias("variable"),
                F.struct("file_block_start", F.monotonically_increasing_id().alias("row")).alias("line_no"),
                "value",
            )
        )
    stacked = frames[0]
    for more in frames[1:]:
        stacked = stacked.unionByName(more)
    return parse_outlook_lines(stacked)


def _observation(source: str, **columns: Column) -> list[Column]:
    return [*[c.alias(name) for name, c in columns.items()], F.lit(source).alias("source")]


def parse_current_obs_a(raw: DataFrame) -> DataFrame:
    return raw.select(
        "lat",
        "lon",
        *_observation(
            "service_a",
            current_temperature=F.col("main.temp"),
            feels_like=F.col("main.feels_like"),
            humidity=F.col("main.humidity"),
            pressure=F.col("main.pressure"),
            wind_speed=F.col("wind.speed"),
            wind_direction=F.coalesce("wind.deg", F.lit(0.0)),
            description=F.get("weather", F.lit(0))["description"],
            visibility=F.coalesce("visibility", F.lit("Unknown")),
            location=F.coalesce("name", F.concat_ws(", ", F.col("lat").cast("string"), F.col("lon").cast("string"))),
            country=F.col("sys.country"),
        ),
    )


def parse_current_obs_b(raw: DataFrame) -> DataFrame:
    """Strings to numbers, km/h to m/s."""
    now = F.get("current_condition", F.lit(0))
    number = lambda name: now[name].try_cast("double")
    return raw.filter(F.size("current_condition") > 0).select(
        "lat",
        "lon",
        *_observation(
            "service_b",
            current_temperature=number("temp_C"),
            feels_like=number("FeelsLikeC"),
            humidity=number("humidity"),
            pressure=number("pressure"),
            wind_speed=number("windspeedKmph") / 3.6,
            wind_direction=F.coalesce(number("winddirDegree"), F.lit(0.0)),
            description=F.get(now["weatherDesc"], F.lit(0))["value"],
            visibility=now["visibility"],
            location=F.concat_ws(", ", F.col("lat").cast("string"), F.col("lon").cast("string")),
        ),
    )


def read_current_obs(spark: SparkSession, path_a: str, path_b: str) -> DataFrame:
    a = parse_current_obs_a(spark.read.schema(OBS_A_SCHEMA).json(path_a))
    b = parse_current_obs_b(spark.read.schema(OBS_B_SCHEMA).json(path_b))
    return a.unionByName(b, allowMissingColumns=True)


def parse_places(raw: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return raw.select(
        text("display_name").alias("display_name"),
        F.coalesce(F.col("lat").try_cast("double"), F.lit(0.0)).alias("lat"),
        F.coalesce(F.col("lon").try_cast("double"), F.lit(0.0)).alias("lon"),
        text("type").alias("type"),
        F.coalesce("importance", F.lit(0.0)).alias("importance"),
        *[text(f"address.{c}").alias(c) for c in ("country", "state", "city", "county", "postcode")],
    )


def read_places_json(spark: SparkSession, path: str) -> DataFrame:
    return parse_places(spark.read.schema(PLACES_SCHEMA).json(path))

"""Keeping tables: locations, history, results with expiry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isohyet.checkpoint import reliable

PLACE_KEY = ["latitude", "longitude"]
HISTORY_KEY = ["location_id", "variable", "year", "month"]
# fixed values: seconds a result stays valid
EXPIRY = {"probability": 86_400, "forecast": 43_200}


def place_key(lat: Column, lon: Column) -> list[Column]:
    return [
        lat.cast("decimal(10,8)").alias("latitude"),
        lon.cast("decimal(11,8)").alias("longitude"),
    ]


def location_id(lat: str = "latitude", lon: str = "longitude") -> Column:
    """Id derived from the key, so concurrent writers agree without a counter."""
    return F.xxhash64(lat, lon)


def upsert_locations(new: DataFrame, existing: DataFrame) -> DataFrame:
    """All locations after adding the unseen ones; existing ids are kept.

    Copies of one new coordinate are reduced before the anti join.
    """
    fresh = new.groupBy(*PLACE_KEY).agg(
        *[F.min(c).alias(c) for c in new.columns if c not in PLACE_KEY]
    )
    added = fresh.join(existing.select(*PLACE_KEY), PLACE_KEY, "left_anti")
    added = added.withColumn("id", location_id())
    return existing.unionByName(added.select(*existing.columns), allowMissingColumns=True)


def get_or_create(requests: DataFrame, locations: DataFrame) -> DataFrame:
    """The id of every requested coordinate, from the upserted table."""
    return requests.join(locations.select("id", *PLACE_KEY), PLACE_KEY)


def dedupe_history(df: DataFrame, order: Column | None = None) -> DataFrame:
    """Latest row per (location, variable, year, month).

    ``max_by`` combines map-side, so a month with countless copies is reduced
    before the shuffle; ties are settled by the whole row.
    """
    payload = [c for c in df.columns if c not in HISTORY_KEY]
    rank = F.struct(order if order is not None else F.col("created_at"), *payload)
    best = F.max_by(F.struct(*payload), rank)
    return df.groupBy(*HISTORY_KEY).agg(best.alias("_b")).select(*HISTORY_KEY, "_b.*")


def with_expiry(results: DataFrame, kind: str) -> DataFrame:
    seconds = F.make_interval(secs=F.lit(EXPIRY[kind]))
    return results.withColumn("expires_at", F.col("created_at") + seconds)


def split_expired(results: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(rows to keep, rows that expired before ``now``)."""
    gone = F.coalesce(F.col("expires_at") < now, F.lit(False))
    return results.filter(~gone), results.filter(gone)


def drop_expired(results: DataFrame, now: Column) -> DataFrame:
    return split_expired(results, now)[0]


def expired_count(results: DataFrame, now: Column) -> DataFrame:
    return split_expired(results, now)[1].agg(F.count(F.lit(1)).alias("deleted"))


def write_results(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("variable",)) -> None:
    """Append result rows (maps and structs included) as partitioned Parquet."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table below ``path``, or None while nothing has been stored there; its day is a date even if all are null."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder) or not any(f.getPath().getName().startswith("expires_on=") for f in files.listStatus(folder)):
        return None
    return spark.read.parquet(path).withColumn("expires_on", F.col("expires_on").cast("date"))


def store_results(new: DataFrame, path: str, request: Sequence[str] = ("request_id",)) -> None:
    """Append results to a table partitioned by the day they expire; a request that is stored already changes nothing.

    ``request`` names the columns that identify a result; ``new`` has ``expires_at`` too.  Of rows of one request in
    ``new`` the one with the smallest values stays; a null in the request is a value like any other.  Only the
    request columns of the days that ``new`` falls on are read.  One writer at a time; after a failure the same call
    again completes the work.
    """
    spark = new.sparkSession
    others = [c for c in new.columns if c not in request]
    maps = [c for c in others if isinstance(new.schema[c].dataType, T.MapType)]
    # maps have no order of their own
    rank = F.struct(*[F.to_json(c) if c in maps else F.col(c) for c in others])
    once = new.groupBy(*request).agg(F.min_by(F.struct(*others), rank).alias("_row")).select(*request, "_row.*")
    once = reliable(once.withColumn("expires_on", F.to_date("expires_at")))
    old = _stored(spark, path)
    if old is not None:
        days = F.broadcast(once.select(F.col("expires_on").alias("_day")).distinct())  # one row a day
        known = old.join(days, F.col("expires_on").eqNullSafe(F.col("_day")), "left_semi")
        known = known.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(request)])
        same = [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(request)]
        once = once.join(known, same, "left_anti")
    # a day with most of the rows is split over tasks
    once.select(*new.columns, "expires_on").hint("rebalance", "expires_on").write.mode("append").partitionBy("expires_on").parquet(path)


def expire_results(spark: SparkSession, path: str, now: Column) -> int:
    """Delete what expired before ``now`` from a table of ``store_results``; returns how many rows.

    Days that are over go as whole folders; of the day of ``now`` the rows that stay are written anew, in place of that
    partition alone.  Other days are not read.  Rows without an expiry stay.  The same call again deletes nothing more.
    """
    old = _stored(spark, path)
    if old is None:
        return 0
    moment = spark.range(1).select(now.cast(old.schema["expires_at"].dataType).alias("at"), F.to_date(now).alias("day")).first()
    at, day = F.lit(moment["at"]), F.lit(moment["day"])
    over = old.filter(F.col("expires_on") < day).groupBy("expires_on").count().collect()  # one row a day
    deleted, folders = sum(r["count"] for r in over), [r["expires_on"] for r in over]
    stay, gone = split_expired(old.filter(F.col("expires_on") == day), at)
    expired = gone.count()
    if expired:
        stay = reliable(stay)
        if stay.isEmpty():
            folders.append(moment["day"])
        else:
            columns = [c for c in stay.columns if c != "expires_on"]
            out = stay.select(*columns, "expires_on").hint("rebalance", "expires_on")
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("expires_on").parquet(path)
    for d in folders:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/expires_on={d.isoformat()}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return deleted + expired


def write_history(df: DataFrame, path: str, buckets: int | None = None) -> None:
    """History as Parquet by variable, clustered by location inside each file."""
    out = df.repartition(buckets, "variable", "location_id") if buckets else df.repartition("variable", "location_id")
    out.sortWithinPartitions("variable", "location_id", "year", "month").write.mode("overwrite").partitionBy(
        "variable"
    ).parquet(path)

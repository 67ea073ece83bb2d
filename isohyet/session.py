"""Sessions: settings this library is written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# AQE sizes shuffles, splits skewed joins and picks broadcasts by real sizes
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # call sites per column expression cost more than building the expression
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configure(builder):
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def local_session(cpus: str | int | None = None, partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        configure(SparkSession.builder.master(f"local[{cpus}]").appName("isohyet"))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark

"""Time the headline queries and print one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores.  Every query runs
once to warm up the JVM and once for the clock, all rows are produced.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.catalog import CHECKS  # noqa: E402
from isohyet.session import local_session  # noqa: E402

HEADLINE = [
    "describe_series",
    "exceedance_probabilities",
    "linear_trend",
    "mann_kendall",
    "seasonal_trends",
    "chow_tests",
    "trend_change_scan",
    "autocorrelation",
    "fill_linear",
    "forecast_features",
    "bootstrap_trend",
    "extended_forecast",
    "knn_haversine",
    "first_available",
    "weather_probability",
    "climate_trends",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session()
    by_name = {c.name: c for c in CHECKS}
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            started = time.perf_counter()
            by_name[name].frame(spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

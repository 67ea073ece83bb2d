"""Risk analytics over long periodic observation histories, as Spark DataFrames.

The canonical input is a *series* table with one row per
``(location_id, variable, t)``; ``t`` is the 0-based period index.  Every
operator takes and returns DataFrames and runs on all series at once.
"""

from isohyet.series import KEY, by_series, in_time_order

__all__ = ["KEY", "by_series", "in_time_order"]

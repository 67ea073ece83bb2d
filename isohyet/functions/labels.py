"""Words for numbers: strength, direction and change labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from isohyet.functions.numeric import ratio


def trend_strength(slope: Column, std: Column) -> Column:
    rel = ratio(F.abs(slope), std)
    return (
        F.when(std == 0, "undefined")
        .when(rel > 0.2, "very_strong")
        .when(rel > 0.1, "strong")
        .when(rel > 0.05, "moderate")
        .when(rel > 0.01, "weak")
        .otherwise("negligible")
    )


def up_or_down(slope: Column) -> Column:
    return F.when(slope > 0, "increasing").otherwise("decreasing")


def p_confidence(p: Column) -> Column:
    return F.when(p < 0.01, "high").when(p < 0.05, "medium").otherwise("low")


def slope_change(before: Column, after: Column) -> Column:
    """How one slope turns into another: same sign by steepness, else a reversal."""

    def word(x: Column) -> Column:
        return F.when(x > 0, "positive").otherwise("negative")

    pace = F.when(F.abs(after) > F.abs(before), "accelerating").otherwise("decelerating")
    return (
        F.when(before * after > 0, F.concat_ws("_", pace, word(before), F.lit("trend")))
        .when(
            before * after < 0,
            F.concat_ws("_", F.lit("trend_reversal"), word(before), F.lit("to"), word(after)),
        )
        .otherwise("trend_stabilization")
    )


def season_of(month: Column) -> Column:
    return (
        F.when(month.isin(12, 1, 2), "winter")
        .when(month.isin(3, 4, 5), "spring")
        .when(month.isin(6, 7, 8), "summer")
        .otherwise("autumn")
    )

"""Least squares of y on x as plain aggregates, safe for constant inputs."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.functions.numeric import ratio
from isohyet.functions.pvalues import t_two_sided

TINY = 1e-20


def r_to_t(r: Column, n: Column) -> Column:
    """t statistic of a correlation over n points."""
    return r * F.sqrt((n - 2) / ((1.0 - r + TINY) * (1.0 + r + TINY)))


@dataclass(frozen=True)
class Line:
    """Fit expressions over centred sums of products."""

    n: Column
    sxx: Column
    syy: Column
    sxy: Column
    staged: str | None = None

    def stage(self, df: DataFrame, prefix: str) -> tuple[DataFrame, Line]:
        """Put R² and t into columns: the tail reads them often, and a column is
        read where an expression would be repeated."""
        line = replace(self, staged=prefix)
        out = df.withColumn(f"{prefix}r2", self.r2)
        t = r_to_t(F.sqrt(F.col(f"{prefix}r2")), self.n)
        return out.withColumn(f"{prefix}t", F.when((self.n > 2) & (self.sxx > 0), t)), line

    @property
    def slope(self) -> Column:
        return ratio(self.sxy, self.sxx)

    @property
    def r2(self) -> Column:
        if self.staged:
            return F.col(f"{self.staged}r2")
        explained = ratio(self.sxy * self.sxy, self.sxx * self.syy)
        return F.when(self.sxx > 0, F.least(F.lit(1.0), F.coalesce(explained, F.lit(0.0))))

    @property
    def rss(self) -> Column:
        return F.greatest(F.lit(0.0), self.syy - F.coalesce(ratio(self.sxy * self.sxy, self.sxx), F.lit(0.0)))

    @property
    def std_error(self) -> Column:
        return F.when(
            self.n > 2,
            F.sqrt(ratio((1.0 - self.r2) * self.syy, self.sxx * (self.n - 2))),
        )

    @property
    def p_value(self) -> Column:
        """Two-sided tail of the slope; call :meth:`stage` first."""
        return t_two_sided(F.col(f"{self.staged}t"), (self.n - 2).cast("int"))


def fit(y: Column, x: Column, prefix: str = "_") -> tuple[list[Column], Line]:
    """Aggregate columns to put in ``agg`` and the line to read from them."""
    names = {k: f"{prefix}{k}" for k in ("cnt", "sxx", "syy", "sxy", "mx", "my")}
    aggs = [
        F.regr_count(y, x).alias(names["cnt"]),
        F.regr_sxx(y, x).alias(names["sxx"]),
        F.regr_syy(y, x).alias(names["syy"]),
        F.regr_sxy(y, x).alias(names["sxy"]),
        F.regr_avgx(y, x).alias(names["mx"]),
        F.regr_avgy(y, x).alias(names["my"]),
    ]
    line = Line(*[F.col(names[k]) for k in ("cnt", "sxx", "syy", "sxy")])
    return aggs, line


def slope_agg(y: Column, x: Column) -> Column:
    """Slope in a single aggregate expression; NULL without spread in x."""
    return ratio(F.regr_sxy(y, x), F.regr_sxx(y, x))

"""How a query result is compared with its SQL: typed, rounded columns on both sides."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS = 4
SPARK_TYPES = {"i": "bigint", "s": "string", "b": "boolean"}
SQL_TYPES = {"i": "BIGINT", "s": "VARCHAR", "b": "BOOLEAN"}


@dataclass(frozen=True)
class Check:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    columns: str
    sql: str | None = None
    # takes minutes whatever the data; its parts have unit tests at small sizes
    heavy: bool = False

    @property
    def typed(self) -> list[tuple[str, str]]:
        return [tuple(c.split(":")) for c in self.columns.split()]

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.run(spark, sf_dir)

        def col(name: str, kind: str):
            if kind == "d":
                return (F.round(F.col(name).cast("double"), DIGITS) + F.lit(0.0)).alias(name)
            return F.col(name).cast(SPARK_TYPES[kind]).alias(name)

        return df.select(*[col(n, k) for n, k in self.typed])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None

        def col(name: str, kind: str) -> str:
            if kind == "d":
                return f"CAST(round(CAST({name} AS DOUBLE), {DIGITS}) + 0.0 AS DOUBLE) AS {name}"
            return f"CAST({name} AS {SQL_TYPES[kind]}) AS {name}"

        cols = ", ".join(col(n, k) for n, k in self.typed)
        return f"SELECT {cols} FROM (\n{self.sql.strip()}\n) AS result"

"""Least squares and elastic nets of all groups in one pass.

Tasks add up one matrix of products per group, Spark adds the tasks' matrices, and every group is solved from its own
matrix where it lies.  Nothing is listed on the driver, so a thousand variables are one job like a single one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.checkpoint import reliable
from isohyet.models.grouped import GROUP, matrix, with_vector

STEPS = 10_000
TOLERANCE = 1e-12
# directions with less than this share of the largest variance count as collinear
FLAT = 1e-12

COEFFICIENTS = f"{GROUP} string, n long, intercept double, weights array<double>, scales array<double>"


def _products(width: int):
    """Per task and group: number, shift, and upper triangle of products of (1, x, y) less the shift of the task's first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = {}
        for b in batches:
            data = np.column_stack([np.ones(b.num_rows), matrix(b.column("x"), width), b.column("y").to_numpy(zero_copy_only=False)])
            codes = b.column(GROUP).dictionary_encode()
            names, index = codes.dictionary.to_pylist(), codes.indices.to_numpy()
            for i, name in enumerate(names):
                mine = data[index == i]
                if name not in totals:
                    totals[name] = (mine[0, 1:].copy(), np.zeros((width + 2, width + 2)))
                shift, total = totals[name]
                mine[:, 1:] -= shift
                total += mine.T @ mine
        for name, (shift, total) in totals.items():
            # about the task's own mean: parts add up without losing digits
            n, mean = total[0, 0], total[0, 1:] / total[0, 0]
            scatter = total[1:, 1:] - n * np.outer(mean, mean)
            flat = np.concatenate([mean + shift, scatter[np.triu_indices(width + 1)]])
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([int(n)]), pa.array([flat.tolist()], pa.list_(pa.float64()))], [GROUP, "n", "sums"])

    return run


def _part(n: int, sums: pa.ListScalar, width: int) -> tuple:
    """(n, mean, scatter) from a row of sums."""
    flat = np.array(sums.values)
    mean, scatter = flat[: width + 1], np.zeros((width + 1, width + 1))
    scatter[np.triu_indices(width + 1)] = flat[width + 1 :]
    return n, mean, scatter + np.triu(scatter, 1).T


def _together(a: tuple | None, b: tuple) -> tuple:
    if a is None:
        return b
    both, off = a[0] + b[0], b[1] - a[1]
    return both, a[1] + off * (b[0] / both), a[2] + b[2] + np.outer(off, off) * (a[0] * b[0] / both)


def _row(name: str, part: tuple) -> pa.RecordBatch:
    n, mean, scatter = part
    flat = np.concatenate([mean, scatter[np.triu_indices(len(mean))]])
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n]), pa.array([flat.tolist()], pa.list_(pa.float64()))], [GROUP, "n", "sums"])


def moments(rows: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """(group, n, mean of (x, y), scatter as an upper triangle): one exchange of one matrix per task and group.

    The scatter of all is the scatters of the parts plus n_part (mean_part - mean)(mean_part - mean)', so nothing large cancels.
    """
    width = len(columns)
    known = with_vector(rows, columns, F.col(GROUP), F.col(label).cast("double").alias("y"))
    known = known.filter(f"{GROUP} IS NOT NULL AND y IS NOT NULL AND NOT exists(x, c -> c IS NULL)")
    parts = known.mapInArrow(_products(width), f"{GROUP} string, n long, sums array<double>")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts come sorted by group; memory holds one matrix."""
        group, now = None, None
        for b in batches:
            for name, n, sums in zip(b.column(GROUP).to_pylist(), b.column("n").to_pylist(), b.column("sums"), strict=True):
                if now is not None and group != name:
                    yield _row(group, now)
                    now = None
                group, now = name, _together(now, _part(n, sums, width))
        if now is not None:
            yield _row(group, now)

    dealt = parts.repartition(GROUP).sortWithinPartitions(GROUP, "n", F.col("sums")[0])
    return dealt.mapInArrow(add, f"{GROUP} string, n long, sums array<double>")


def at_cut(cut: Column) -> Column:
    """Group of a variable's rows that lie between two cuts; 0 stands for all before the first."""
    return F.when(F.col(GROUP).isNotNull(), F.format_string("%06d:%s", cut, F.col(GROUP)))


def before_cuts(parts: DataFrame, cuts: int, width: int) -> DataFrame:
    """Moments of all rows before each cut 1..cuts, from the moments of the rows between them.

    Each cut adds its rows' matrix to the one before, so no row is read again; a task holds one matrix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, now, due = None, None, 1

        def upto(last: int) -> Iterator[pa.RecordBatch]:
            for k in range(due, last + 1):
                if now is not None:
                    yield _row(f"{k:06d}:{group}", now)

        for b in batches:
            for name, cut, n, sums in zip(b.column("name").to_pylist(), b.column("cut").to_pylist(), b.column("n").to_pylist(), b.column("sums"), strict=True):
                if name != group:
                    yield from upto(cuts)
                    group, now, due = name, None, 1
                yield from upto(cut)
                now, due = _together(now, _part(n, sums, width)), max(due, cut + 1)
        yield from upto(cuts)

    each = parts.select(F.expr(f"substring({GROUP}, 8)").alias("name"), F.expr(f"cast(substring({GROUP}, 1, 6) AS int)").alias("cut"), "n", "sums")
    return each.repartition("name").sortWithinPartitions("name", "cut").mapInArrow(run, f"{GROUP} string, n long, sums array<double>")


def least_squares(gram: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Weights of least norm for standardised features."""
    values, basis = np.linalg.eigh(gram)
    inverse = np.where(values > FLAT * max(values.max(initial=0.0), 1e-300), 1 / np.where(values > 0, values, 1.0), 0.0)
    return basis @ (inverse * (basis.T @ cross))


def elastic_net(gram: np.ndarray, cross: np.ndarray, penalty: float, share: float) -> np.ndarray:
    """Coordinate steps to the least |y - x w|^2 / 2n + penalty (share |w|_1 + (1 - share) |w|^2 / 2)."""
    w = np.zeros(len(cross))
    for _ in range(STEPS):
        largest = 0.0
        for j in range(len(w)):
            rest = cross[j] - gram[j] @ w + gram[j, j] * w[j]
            new = np.sign(rest) * max(abs(rest) - penalty * share, 0.0) / (gram[j, j] + penalty * (1 - share) or 1.0)
            largest, w[j] = max(largest, abs(new - w[j])), new
        if largest <= TOLERANCE * max(1.0, np.abs(w).max(initial=0.0)):
            break
    return w


@dataclass(frozen=True)
class Linear:
    """A line per group on standardised features; ``penalty`` above 0 makes it an elastic net."""

    penalty: float = 0.0
    share: float = 0.5

    def fit_groups(self, rows: DataFrame, columns: Sequence[str], label: str = "target") -> LinearModels:
        return self.from_moments(moments(rows, columns, label), columns)

    def from_moments(self, sums: DataFrame, columns: Sequence[str]) -> LinearModels:
        width, penalty, share = len(columns), self.penalty, self.share

        def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for name, n, flat in zip(b.column(GROUP).to_pylist(), b.column("n").to_pylist(), b.column("sums"), strict=True):
                    flat = np.array(flat.values)
                    mean, scatter = flat[: width + 1], np.zeros((width + 1, width + 1))
                    scatter[np.triu_indices(width + 1)] = flat[width + 1 :] / n
                    scatter = scatter + np.triu(scatter, 1).T
                    spread = np.sqrt(np.maximum(np.diag(scatter)[:width], 0.0))
                    # a feature that does not vary has no weight
                    live = spread > 1e-12 * (1 + np.abs(mean[:width]))
                    scale = np.where(live, spread, 1.0)
                    gram = scatter[:width, :width] / np.outer(scale, scale) * np.outer(live, live)
                    cross = scatter[:width, width] / scale * live
                    w = elastic_net(gram, cross, penalty, share) if penalty else least_squares(gram, cross)
                    w = w * live / scale
                    out.append((name, n, float(mean[width] - mean[:width] @ w), w.tolist(), np.where(live, spread, 0.0).tolist()))
                if out:
                    kinds = (pa.string(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
                    names = [x.split()[0] for x in COEFFICIENTS.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        return LinearModels(reliable(sums.mapInArrow(solve, COEFFICIENTS)), tuple(columns))


@dataclass(frozen=True)
class LinearModels:
    """One row of coefficients per group, in the units of the features."""

    table: DataFrame
    columns: tuple[str, ...]

    def add(self, rows: DataFrame, out: str) -> DataFrame:
        """Rows with a prediction, NULL for groups without a model; the table meets the rows by group."""
        t = self.table.select(F.col(GROUP).alias("_lg"), F.col("intercept").alias("_li"), F.col("weights").alias("_lw"))
        value = F.col("_li")
        for i, c in enumerate(self.columns):
            value = value + F.col("_lw")[i] * F.col(c)
        return rows.join(t, rows[GROUP] == t["_lg"], "left").withColumn(out, value).drop("_lg", "_li", "_lw")

    def groups(self) -> DataFrame:
        return self.table.select(GROUP)

    def importance(self) -> list[float]:
        """Mean over groups of each feature's weight per standard deviation, without its sign."""
        row = self.table.agg(*[F.avg(F.abs(F.col("weights")[i] * F.col("scales")[i])).alias(f"w{i}") for i in range(len(self.columns))]).first()
        return [x or 0.0 for x in row]

    def save(self, path: str) -> None:
        self.table.withColumn("columns", F.array(*[F.lit(c) for c in self.columns])).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark, path: str) -> LinearModels:
        table = spark.read.parquet(path)
        first = table.select("columns").first()
        return LinearModels(table.drop("columns"), tuple(first["columns"]) if first else ())

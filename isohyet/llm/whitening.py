"""Operator 11: whitening of embeddings by an incremental eigendecomposition.

Every partition of the distinct vectors keeps the spectrum of its centred scatter and updates it with each vector: the step of a
running mean is a rank-one update, whose eigenvalues solve a secular equation between the old ones and whose
eigenvectors follow from Loewner's formula.  Parts of the update that meet no eigenvector or an equal eigenvalue are deflated.  The
spectra of partitions are combined the same way, one rank-one update per eigenvector of the smaller one and one for
the distance of the means, in groups of FAN at a time.  The basis so found is refined by a distributed Rayleigh-Ritz step: the covariance
in that basis is summed over all vectors, centred before multiplying, and its small eigenproblem is solved.

Whatever the table's size, a task holds d x d numbers for d dimensions, and the driver gets one such matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import materialised

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
FAN = 8
EPS = np.finfo(np.float64).eps

# entries beyond this are taken as it, so that sums stay exact in 64-bit halves
LIMIT = 1 << 40


# --- rank-one updates of a spectrum -----------------------------------------


class Spectrum(NamedTuple):
    """Scatter of n vectors about their mean: ascending eigenvalues and the columns that belong to them."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    basis: np.ndarray


def nothing(d: int) -> Spectrum:
    return Spectrum(0, np.zeros(d), np.zeros(d), np.eye(d))


def secular_roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(weights / (poles - x)) for ascending distinct poles and positive weights.

    Each root is returned as the index of its nearest pole and its distance from it, so that differences to poles keep their
    digits.  All roots are found at once: a two-pole interpolation, by halving where that leaves the bracket.
    """
    m = len(poles)
    upper = np.append(poles[1:], poles[-1] + weights.sum())
    rows = np.arange(m)
    middle = (upper - poles) / 2
    at_middle = 1 + (weights / ((poles[None, :] - poles[:, None]) - middle[:, None])).sum(1)
    right = (at_middle < 0) & (rows < m - 1)
    origin = np.where(right, rows + 1, rows)
    low = np.where(right, -middle, 0.0)
    high = np.where(right, 0.0, middle)
    last_right = at_middle[-1] < 0
    if last_right:
        low[-1], high[-1] = middle[-1], upper[-1] - poles[-1]
    gaps = poles[None, :] - poles[origin][:, None]
    left_gap = gaps[rows, rows]
    right_gap = np.append(gaps[rows[:-1], rows[1:]], upper[-1] - poles[-1])
    below = np.tri(m)
    x = (low + high) / 2
    for _ in range(80):
        inverse = 1 / (gaps - x[:, None])
        terms = weights * inverse
        f = 1 + terms.sum(1)
        slopes = terms * inverse
        slope = slopes.sum(1)
        slope_below = np.einsum("ij,ij->i", slopes, below)
        # a value below what the sum's rounding leaves is a root
        done = np.abs(f) <= 16 * EPS * (1 + np.abs(terms).sum(1))
        if done.all():
            break
        low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
        a, b = left_gap - x, right_gap - x
        p = (a + b) * f - a * b * slope
        q = a * b * f
        c = f - a * slope_below - b * (slope - slope_below)
        root = np.sqrt(np.abs(p * p - 4 * q * c))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(p <= 0, (p - root) / (2 * c), 2 * q / (p + root))
        moved = x + step
        inside = (moved > low) & (moved < high)
        moved = np.where(inside, moved, (low + high) / 2)
        still = ~done & (np.abs(moved - x) > EPS * np.abs(x)) & (high - low > EPS * np.maximum(np.abs(low), np.abs(high)))
        if not still.any():
            break
        x = np.where(still, moved, x)
    return origin, x


def rank_one(values: np.ndarray, basis: np.ndarray, rho: float, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of basis diag(values) basis' + rho v v' for rho > 0 and ascending values."""
    z = basis.T @ v
    size = float(z @ z)
    if rho * size <= 0:
        return values, basis
    scale = max(abs(values[-1]), abs(values[0]), rho * size)
    # deflation: directions the update does not meet keep their pair
    z = np.where(rho * np.abs(z) * np.sqrt(size) <= 8 * EPS * scale, 0.0, z)
    # deflation: of equal eigenvalues one rotated direction meets the update, the others do not
    active = np.flatnonzero(z)
    if len(active) > 1 and (np.diff(values[active]) <= 8 * EPS * scale).any():
        basis = basis.copy()
        for i, j in zip(active[:-1], active[1:], strict=True):
            if values[j] - values[i] <= 8 * EPS * scale:
                r = np.hypot(z[i], z[j])
                c, s = z[j] / r, z[i] / r
                basis[:, i], basis[:, j] = c * basis[:, i] - s * basis[:, j], s * basis[:, i] + c * basis[:, j]
                z[i], z[j] = 0.0, r
        active = np.flatnonzero(z)
    if not len(active):
        return values, basis
    poles = values[active]
    origin, x = secular_roots(poles, rho * z[active] ** 2)
    # differences pole j - root i without cancellation
    away = (poles[:, None] - poles[origin][None, :]) - x[None, :]
    if len(active) > 1:
        # the update whose exact roots these are: eigenvectors of it are orthogonal to working precision
        apart = poles[:, None] - poles[None, :]
        np.fill_diagonal(apart, 1.0)
        ratio = away / np.where(np.eye(len(poles), dtype=bool), 1.0, apart)
        z_exact = np.sqrt(np.abs(ratio.prod(1))) * np.sign(z[active])
    else:
        z_exact = np.ones(1)
    u = z_exact[:, None] / away
    u /= np.sqrt((u * u).sum(0))
    out_values, out_basis = values.copy(), basis.copy()
    out_values[active] = poles[origin] + x
    out_basis[:, active] = basis[:, active] @ u
    order = np.argsort(out_values, kind="stable")
    return out_values[order], out_basis[:, order]


def add(s: Spectrum, x: np.ndarray) -> Spectrum:
    """One more vector: the scatter about the moving mean grows by a centred rank-one term."""
    off = x - s.mean
    n = s.n + 1
    values, basis = rank_one(s.values, s.basis, s.n / n, off) if s.n else (s.values, s.basis)
    return Spectrum(n, s.mean + off / n, values, basis)


def combine(a: Spectrum, b: Spectrum) -> Spectrum:
    """Spectrum of the union: one update per eigenvector of b and one for the distance of the means."""
    if not a.n or not b.n:
        return a if a.n else b
    n = a.n + b.n
    values, basis = a.values, a.basis
    for k in np.flatnonzero(b.values > 8 * EPS * b.values[-1]):
        values, basis = rank_one(values, basis, float(b.values[k]), b.basis[:, k])
    off = b.mean - a.mean
    values, basis = rank_one(values, basis, a.n * b.n / n, off)
    return Spectrum(n, a.mean + off * (b.n / n), values, basis)


# --- vectors ----------------------------------------------------------------


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows whose vector is there and has finite entries only; x holds floor(64 * entry) + 1000000.

    Shorter vectors get zero entries at their end, so all x have the length of the longest.
    """
    entry = F.col("embedding").cast("array<double>")
    fine = F.col("embedding").isNotNull() & F.forall(entry, lambda c: F.coalesce((c > F.lit(float("-inf"))) & (c < F.lit(float("inf"))), F.lit(False)))
    rows = embeddings.filter(fine)
    d = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    most = F.lit(float(LIMIT))
    x = F.transform(entry, lambda c: F.floor(F.greatest(F.least(c * SCALE, most), -most)).cast("long") + SHIFT)
    padded = F.concat(x, F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(d) - F.size("embedding")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), padded.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows of integers."""
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0), np.int64)


class Moments(NamedTuple):
    """Exact number and sums of the fit list."""

    n: int
    sums: list[int]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: as 64-bit integers where they fit, else as Python's."""
        if self.n * (LIMIT + SHIFT) * 2 < 1 << 63:
            return self.n * x - np.array(self.sums, np.int64)
        near = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], object)
        return (x - near).astype(object) * self.n - rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of squares of n * x - sums; None beyond 64 bits."""
        c = self.centred(x)
        if c.dtype != object and (not c.size or float(np.abs(c).max()) ** 2 * c.shape[1] < 2.0**62):
            return (c * c).sum(1).tolist()
        exact = [sum(int(v) * int(v) for v in row) for row in c]
        return [v if v < 1 << 63 else None for v in exact]

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n with one rounding."""
        return self.centred(x).astype(np.float64) / self.n


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number and sums of the vectors of a partition, in halves that cannot overflow."""
    n, high, low = 0, 0, 0
    for b in batches:
        x = _matrix(b.column("x"))
        n, high, low = n + len(x), high + (x >> 20).sum(0), low + (x & 0xFFFFF).sum(0)
    if n:
        halves = [pa.array([h.tolist()], pa.list_(pa.int64())) for h in (high, low)]
        yield pa.RecordBatch.from_arrays([pa.array([n]), *halves], ["n", "high", "low"])


def moments(fit: DataFrame) -> Moments:
    """Exact moments of the fit list; one row per dimension reaches the driver."""
    parts = fit.mapInArrow(_sums, "n long, high array<long>, low array<long>")
    each = parts.select("n", F.posexplode(F.arrays_zip("high", "low")).alias("i", "s"))
    wide = "decimal(38,0)"
    total = each.groupBy("i").agg(
        F.sum("n").alias("n"), F.sum(F.col("s.high").cast(wide)).alias("high"), F.sum(F.col("s.low").cast(wide)).alias("low")
    )
    rows = sorted(total.collect())
    return Moments(rows[0]["n"] if rows else 0, [(int(r["high"]) << 20) + int(r["low"]) for r in rows])


# --- distributed steps ------------------------------------------------------

_SPECTRUM = "part int, n long, mean array<double>, lengths array<double>, basis array<double>"


def _row(part: int, s: Spectrum) -> pa.RecordBatch:
    lists = [pa.array([a.ravel()], pa.list_(pa.float64())) for a in (s.mean, s.values, s.basis)]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([s.n]), *lists], [x.split()[0] for x in _SPECTRUM.split(", ")])


def _partition_spectra(d: int, m: Moments):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        s = nothing(d)
        for b in batches:
            # about the common mean the numbers stay small; each partition still follows its own mean
            for x in m.offsets(_matrix(b.column("x"))):
                s = add(s, x)
        if s.n:
            yield _row(TaskContext.get().partitionId(), s)

    return run


def _combine_spectra(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, s = None, nothing(d)
        for b in batches:
            for i in range(b.num_rows):
                key = b.column("part")[i].as_py()
                if part is not None and key != part:
                    yield _row(part, s)
                    s = nothing(d)
                mean, values, basis = (np.array(b.column(c)[i].values) for c in ("mean", "lengths", "basis"))
                part, s = key, combine(s, Spectrum(b.column("n")[i].as_py(), mean, values, basis.reshape(d, d)))
        if part is not None:
            yield _row(part, s)

    return run


def spectrum(fit: DataFrame, m: Moments) -> Spectrum:
    """Spectrum of the whole fit list: by partition, then FAN spectra at a time."""
    d, parts = len(m.sums), _parts(fit)
    now = materialised(fit.mapInArrow(_partition_spectra(d, m), _SPECTRUM))
    while parts > 1:
        parts = -(-parts // FAN)
        dealt = now.withColumn("part", (F.col("part") / FAN).cast("int"))
        now = dealt.repartition(parts, "part").sortWithinPartitions("part", "n").mapInArrow(_combine_spectra(d), _SPECTRUM)
        now = materialised(now)
    r = now.first()
    return Spectrum(r["n"], np.array(r["mean"]), np.array(r["lengths"]), np.array(r["basis"]).reshape(d, d))


def _second_moments(m: Moments, basis: np.ndarray):
    """Sums of products of the centred vectors in a basis, as one row per row of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = basis.shape[1]
        total = np.zeros((k, k))
        for b in batches:
            y = m.offsets(_matrix(b.column("x"))) @ basis
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "products"])

    return run


def second_moments(fit: DataFrame, m: Moments, basis: np.ndarray) -> np.ndarray:
    """Covariance of the fit list in a basis: k x k sums per partition, added by Spark, then one k x k matrix on the driver."""
    k = basis.shape[1]
    rows = fit.mapInArrow(_second_moments(m, basis), "i int, products array<double>")
    total = rows.select("i", F.posexplode("products").alias("j", "p")).groupBy("i", "j").agg(F.sum("p").alias("p"))
    out = np.zeros((k, k))
    packed = total.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "p"))).alias("row"))
    for r in packed.collect():
        out[r["i"]] = [x["p"] for x in r["row"]]
    return (out + out.T) / 2 / m.n


class Whitener(NamedTuple):
    """What whitens a vector: offsets from the mean times `weights`, one column per component."""

    moments: Moments
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float

    @property
    def weights(self) -> np.ndarray:
        return self.components / np.sqrt(self.values)


def _parts(frame: DataFrame) -> int:
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def fit_list(rows: DataFrame) -> DataFrame:
    """Each distinct vector once, spread evenly and written once; copies meet in partial aggregates first."""
    return materialised(rows.select("x").distinct().repartition(_parts(rows), "x"))


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitener:
    """The whitener of rows (vec_id, x): up to `components` directions with a positive variance."""
    vectors = fit_list(rows)
    m = moments(vectors)
    d = len(m.sums)
    if m.n < 2:
        return Whitener(m, np.zeros(0), np.zeros((d, 0)), 0.0, 0.0)
    basis = spectrum(vectors, m).basis
    v = second_moments(vectors, m, basis)
    values, turn = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")
    trace = float(np.trace(v))
    order = order[values[order] > trace * d * 8 * EPS][:components]
    directions = basis @ turn[:, order]
    directions /= np.sqrt((directions**2).sum(0))
    w = Whitener(m, values[order], directions, trace, 0.0)
    if not len(order):
        return w
    error = np.abs(second_moments(vectors, m, w.weights) - np.eye(len(order))).max()
    return w._replace(identity_error=float(error))


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_WHITENED = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[k]) for n, k in (x.split() for x in WHITENED.split(", "))])


def transform(rows: DataFrame, w: Whitener) -> DataFrame:
    """Rows (vec_id, x) in the whitened components, one row each: see WHITENED."""
    weights, explained, k = w.weights, w.values / (w.trace or 1.0), len(w.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not k:
                continue
            x = _matrix(b.column("x"))
            n = len(x)
            deviation = pa.array(w.moments.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(n), k)))
            columns = (
                b.column("vec_id").take(pa.array(np.repeat(np.arange(n), k))), np.tile(np.arange(1, k + 1), n), np.full(n * k, w.moments.n), deviation,
                (w.moments.offsets(x) @ weights).ravel(), np.tile(explained, n), np.full(n * k, w.identity_error),
            )
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, np.ndarray) else c for c, f in zip(columns, _WHITENED, strict=True)], schema=_WHITENED)

    return rows.mapInArrow(run, WHITENED)


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows without a vector or with a null or non-finite entry are dropped; repeated rows and null vec_ids stay, and every
    distinct vector counts once in the fit.  Vectors shorter than the longest have zeros at their end; entries beyond 2^40 / 64 count
    as that.  Only components with a positive variance exist: a table without two different vectors, or an empty
    one, gives no rows.  A deviation beyond 64 bits is null.  Other columns are ignored.
    """
    rows = usable(embeddings)
    return transform(rows, fit(rows, components))

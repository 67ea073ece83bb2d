"""Sums of inverse squared distances between tiles, inside a task.

A tile is a run of places that lie close together.  Two tiles whose boxes overlap or almost touch are summed pair by pair.
Between boxes further apart the weight 1 / d^2 is so smooth that its values at a few Chebyshev nodes of each box give it
everywhere to the rounding of doubles; nodes are added until they do, or else the pairs are summed.  No place is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 37.0  # the error of interpolation falls to exp(-DIGITS)
STEP, MOST = 4, 32  # nodes on an axis: multiples of STEP, at most MOST
STRIPE = 64  # points weighed against a tile of samples at once, so that the block stays in the cache


# --- rows to tiles ----------------------------------------------------------


def z_order(lat: Column, lon: Column) -> Column:
    """Bits of both coordinates in turn, millionths of a degree apart; only the order of rows rests on it."""

    def spread(x: Column) -> Column:
        at = F.least(F.greatest(F.nanvl(x, F.lit(0.0)), F.lit(-511.0)), F.lit(511.0))
        bits = F.floor((at + 512) * 2**20).cast("bigint")
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            bits = bits.bitwiseOR(F.shiftleft(bits, shift)).bitwiseAND(F.lit(mask))
        return bits

    return F.shiftleft(spread(lat), 1).bitwiseOR(spread(lon))


def _changes(column: pa.Array) -> list[int]:
    """Where a value differs from the one before."""
    if pa.types.is_nested(column.type):
        values = column.to_pylist()
        return [i for i in range(1, len(values)) if values[i] != values[i - 1]]
    return pc.run_end_encode(column).run_ends.to_pylist()


def _cut(by: list[str], size: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cuts = {*range(0, b.num_rows, size), b.num_rows}
            for k in by:
                cuts.update(_changes(b.column(k)))
            borders = pa.array(sorted(cuts), pa.int32())
            firsts = borders.slice(0, len(borders) - 1)
            yield pa.RecordBatch.from_arrays(
                [b.column(n).take(firsts) if n in by else pa.ListArray.from_arrays(borders, b.column(n)) for n in b.schema.names], b.schema.names
            )

    return cut


def tiles(rows: DataFrame, by: list[str], payload: list[str], size: int) -> DataFrame:
    """Rows of at most ``size`` neighbours of one group, as arrays; Spark sorts them, so no group is gathered."""
    rows = rows.select(*by, *payload)
    for k in by:
        rows = rows.filter(F.col(k).isNotNull())  # meets no group
    at = z_order(F.col("lat"), F.col("lon"))
    laid = rows.withColumn("_z", at).repartitionByRange(*by, "_z", payload[0]).sortWithinPartitions(*by, "_z")
    array = lambda f: T.StructField(f.name, T.ArrayType(f.dataType))
    schema = T.StructType([f if f.name in by else array(f) for f in rows.schema])
    return laid.drop("_z").mapInArrow(_cut(by, size), schema)


# --- tiles against tiles ----------------------------------------------------


class Tile:
    """Places of one tile, with the box around them; ``plain`` tiles have no usable box or value and are summed by pairs."""

    def __init__(self, lat: pa.Array, lon: pa.Array, value: pa.Array | None = None):
        number = lambda x: x.to_numpy(zero_copy_only=False).astype(np.float64)
        self.at = np.stack([number(lat), number(lon)])
        self.unknown = pc.or_(lat.is_null(), lon.is_null()).to_numpy(zero_copy_only=False)
        self.plain = not np.isfinite(self.at).all()
        if value is not None:
            self.terms = np.stack([number(value), np.ones(len(value))], axis=1)
            self.plain |= not np.isfinite(self.terms).all()
        low, high = self.at.min(axis=1), self.at.max(axis=1)
        self.centre, self.half = (low + high) / 2, (high - low) / 2
        self._bases: dict[int, list[np.ndarray]] = {}
        self._moments: dict[int, np.ndarray] = {}
        self.fields: dict[int, np.ndarray] = {}

    def __len__(self) -> int:
        return self.at.shape[1]

    def nodes(self, n: int) -> np.ndarray:
        return self.centre[:, None] + self.half[:, None] * _chebyshev(n)[0]

    def bases(self, n: int) -> list[np.ndarray]:
        """Per axis: the share of each node in each place."""
        if n not in self._bases:
            unit = np.divide(self.at - self.centre[:, None], self.half[:, None], out=np.zeros_like(self.at), where=self.half[:, None] > 0)
            angles = np.arccos(np.clip(unit, -1, 1))
            self._bases[n] = [np.cos(a[:, None] * np.arange(n)) @ _chebyshev(n)[1] for a in angles]
        return self._bases[n]

    def moments(self, n: int) -> np.ndarray:
        """What the samples amount to at the nodes: (n * n, terms)."""
        if n not in self._moments:
            lat, lon = self.bases(n)
            self._moments[n] = np.stack([(lat.T @ (t[:, None] * lon)).ravel() for t in self.terms.T], axis=1)
        return self._moments[n]

    def from_fields(self) -> np.ndarray:
        """Sums at the places from the sums at the nodes."""
        out = np.zeros((len(self), 2))
        for n, field in self.fields.items():
            lat, lon = self.bases(n)
            for k in range(2):
                out[:, k] += ((lat @ field[:, k].reshape(n, n)) * lon).sum(axis=1)
        return out


_nodes: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _chebyshev(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes in [-1, 1], and the matrix from Chebyshev polynomials to the polynomials that are one at one node."""
    if n not in _nodes:
        angles = (2 * np.arange(n) + 1) * np.pi / (2 * n)
        turn = np.cos(np.arange(n)[:, None] * angles) * (2.0 / n)
        turn[0] /= 2
        _nodes[n] = np.cos(angles), turn
    return _nodes[n]


def order(points: Tile, samples: Tile, floor: float) -> int:
    """Nodes on an axis that give the weights between two boxes to rounding; 0 if pairs are cheaper or the floor may matter.

    The weight has its poles at least the gap away from either box, so the interpolation error falls by ``rate`` a node.
    """
    if points.plain or samples.plain:
        return 0
    gap = float(np.hypot(*np.maximum(np.abs(points.centre - samples.centre) - points.half - samples.half, 0.0)))
    half = max(points.half.max(), samples.half.max())
    if gap <= floor or gap <= half:
        return 0
    rate = np.arcsinh(gap / half) if half > 0 else DIGITS
    n = STEP * int(np.ceil((DIGITS / rate + 2) / STEP))
    return n if n <= MOST and n**4 + 20_000 < len(points) * len(samples) else 0


def by_nodes(points: Tile, samples: Tile, n: int) -> None:
    (a, b), (c, d) = points.nodes(n), samples.nodes(n)
    lat, lon = np.square(a[:, None] - c), np.square(b[:, None] - d)
    weights = np.reciprocal(lat[:, None, :, None] + lon[None, :, None, :]).reshape(n * n, n * n)
    points.fields[n] = points.fields.get(n, 0.0) + weights @ samples.moments(n)


def by_pairs(points: Tile, samples: Tile, floor: float, out: np.ndarray) -> None:
    """Adds each point's sums of value / d^2 and 1 / d^2; an unknown place is at the smallest distance, as in SQL's greatest()."""
    block, other = np.empty((STRIPE, len(samples))), np.empty((STRIPE, len(samples)))
    for i in range(0, len(points), STRIPE):
        lat, lon = points.at[:, i : i + STRIPE]
        w, v = block[: len(lat)], other[: len(lat)]
        np.subtract(lat[:, None], samples.at[0], out=w)
        np.subtract(lon[:, None], samples.at[1], out=v)
        np.multiply(w, w, out=w)
        np.multiply(v, v, out=v)
        np.add(w, v, out=w)
        w[points.unknown[i : i + STRIPE]] = 0.0
        w[:, samples.unknown] = 0.0
        np.maximum(w, floor * floor, out=w)
        np.reciprocal(w, out=w)
        out[i : i + STRIPE] += w @ samples.terms


def _tiles_of(table: pa.Table, names: list[str]) -> Iterator[list[pa.Array]]:
    columns = [table.column(n).combine_chunks() for n in names]
    for i in range(table.num_rows):
        yield [c[i].values for c in columns]


def partial_sums(floor: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For the tiles of points and of samples that meet under one key: point_id, num, den and cnt of every point."""

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        sources = [Tile(*x) for x in _tiles_of(right, ["lat", "lon", "value"])]
        count = sum(map(len, sources))
        ids, parts = [], []
        for own, lat, lon in _tiles_of(left, ["point_id", "lat", "lon"]) if sources else ():
            tile = Tile(lat, lon)
            out = np.zeros((len(tile), 2))
            for s in sources:
                if n := order(tile, s, floor):
                    by_nodes(tile, s, n)
                else:
                    by_pairs(tile, s, floor, out)
            ids.append(own)
            parts.append(out + tile.from_fields())
        total = np.concatenate(parts) if parts else np.zeros((0, 2))
        own_type = left.schema.field("point_id").type.value_type
        counts = np.full(len(total), count, np.int64)
        return pa.table([pa.chunked_array(ids, own_type), *map(pa.array, (total[:, 0], total[:, 1], counts))], ["point_id", "num", "den", "cnt"])

    return sums

"""Helpers shared by the operators: tables, materialised rows, hashed words, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.checkpoint import reliable

materialised = reliable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- memory of Python workers -----------------------------------------------

SLICE = 1 << 20  # bytes of texts that a task turns into Python objects at once; a longer text is a slice of its own
_kept: dict = {}


def sliced(batches: Iterator[pa.RecordBatch], column: int | str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about SLICE bytes in that column.

    Spark's batches are cut by rows, so with long texts a batch, its strings and its result are many times what a task needs at once.
    """
    for b in batches:
        if b.num_rows < 2:
            yield b
            continue
        ends = np.cumsum(pc.binary_length(b.column(column)).fill_null(0).to_numpy().astype(np.int64))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, side="right")))
            yield b.slice(at, end - at)
            at = end


def kept_in_worker(key, build):
    """What build() gives, once per worker for all its tasks; only the last is kept, as workers go on to other operators."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = build()
    return _kept[key]


# --- hashed words -----------------------------------------------------------

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers = {"base": np.ones(1, np.uint64), "inverse": np.ones(1, np.uint64)}


def _power(kind: str, factor: np.uint64, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        more = np.full(max(n, 2 * len(have)), factor, np.uint64)
        more[0] = 1
        have = _powers[kind] = np.multiply.accumulate(more)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for many ranges, from one prefix sum over the bytes."""
    n = len(data)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("base", BASE, n), out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * _power("inverse", BASE_INVERSE, n + 1)[starts])


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a text.

    A-Z is lower-cased; words are runs without ASCII white space.  With fewer than
    k words the whole sequence is one shingle; without words the set is empty.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(b" ".join(words), np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(k, len(words))
    return np.unique(hash_ranges(data, starts[: len(words) - k + 1], ends[k - 1 :]))


# --- rows that arrive sorted by a group -------------------------------------


def sorted_groups(batches: Iterator, keys: list[str]) -> Iterator[list]:
    """Arrow tables, one per group of equal keys, from batches sorted by these keys.

    Memory holds one batch and one group; callers bound the groups.
    """
    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = np.concatenate([[0], np.flatnonzero(change), [batch.num_rows]])
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            part = batch.slice(a, b - a)
            if i == 0 and held and any(held[0].column(k)[0] != part.column(k)[0] for k in keys) or i and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


# --- connected components ---------------------------------------------------


class Forest:
    """Union-find over small local indexes."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of edges (a, b); component is the smallest id reachable.

    Alternates large-star and small-star steps until nothing changes.  Each step is a
    minimum per node and a join back, so a node with very many neighbours is never
    gathered; rounds grow with the logarithm of the paths.  Every round is cut with
    a reliable checkpoint, and only a count and a checksum reach the driver.
    """
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    now = materialised(pairs.filter("a < b").distinct())
    seen = _checksum(now)
    while True:
        now = materialised(_small_star(_large_star(now)))
        check = _checksum(now)
        if check == seen:
            break
        seen = check
    members = now.select(F.col("b").alias("id"), F.col("a").alias("component"))
    roots = now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    return members.unionByName(roots)


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
    own = least.select(F.col("m").alias("a"), F.col("u").alias("b"))
    return moved.unionByName(own).distinct()

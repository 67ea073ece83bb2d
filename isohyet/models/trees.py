"""Forests and boosted trees of all groups, grown together.

Three kinds of trees share one way of growing.  Extremely randomised trees draw a random threshold for each of a few random
features of a node and take the best of them.  Forests and boosted trees (``bins``) take the best of all
borders between bins, which hold equal shares of a group's rows.  All draws are hashes of (seed, group, tree, node, feature),
and rows get their weights from hashes of their keys, so a tree does not depend on how rows are spread or on retries.
Targets are whole millionths of their group's spread while trees grow, which makes all sums exact.

Nodes with more than LOCAL_ROWS rows are split level by level: tasks send ranges, then sums beside the thresholds, per
(group, tree, node), and Spark adds them.  A smaller node's rows go to one task, which grows the whole subtree.  The tops above such
subtrees are the only part that the driver and all tasks hold: at most two nodes per LOCAL_ROWS rows and tree.  The subtrees
("pieces") are a table, and rows meet the pieces they fall into there.  Boosting rounds follow one another: inside
one task for a small group, as one job after another for groups with more than LOCAL_ROWS rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.checkpoint import reliable
from isohyet.models.grouped import GROUP, matrix, runs, with_vector

# rows that one task takes to grow a subtree, and rows that meet one piece in a task
LOCAL_ROWS = 1 << 13
# trees of a small group that are grown from one copy of its rows
BLOCK = 25
UNITS = 1_000_000
BINS = 64
ROOT = 1


@dataclass(frozen=True)
class Trees:
    """``features`` per split: 0 for all, None for the square root of their number; ``share_weights`` trees in a row share one
    bootstrap.  ``bins`` above 0 means best borders instead of random thresholds, ``rate`` above 0 boosting with a ``subsample``
    of the rows in each round.  Nodes of less weight than ``least`` are not split; ``first`` is the number of the first tree."""

    trees: int = 500
    depth: int = 25
    features: int | None = None
    bootstrap: bool = True
    share_weights: int = 1
    seed: int = 42
    bins: int = 0
    rate: float = 0.0
    subsample: float = 1.0
    least: int = 2
    first: int = 0

    @property
    def numbers(self) -> range:
        return range(self.first, self.first + self.trees)

    def fit_groups(self, rows: DataFrame, columns: Sequence[str], label: str = "target", keys: Sequence[str] = ("location_id", "t")) -> Forest:
        return grow(self, rows, columns, label, keys)


def extra_trees(trees: int = 500, depth: int = 25, seed: int = 42, **more) -> Trees:
    return Trees(trees=trees, depth=depth, seed=seed, **more)


def random_forest(trees: int = 500, depth: int = 25, features: int | None = 0, seed: int = 42, **more) -> Trees:
    return Trees(trees=trees, depth=depth, features=features, seed=seed, bins=BINS, **more)


def boosted_trees(trees: int = 400, depth: int = 8, rate: float = 0.1, seed: int = 42, **more) -> Trees:
    return Trees(trees=trees, depth=depth, features=0, bootstrap=False, seed=seed, bins=BINS, rate=rate, **more)


# --- draws ------------------------------------------------------------------


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def uniform(seed: int, group: int, *keys) -> np.ndarray:
    """Numbers in [0, 1) from integers that broadcast against each other."""
    with np.errstate(over="ignore"):
        h = _mix(np.array([seed, group & (1 << 64) - 1], np.uint64))
        h = _mix(h[:1] * np.uint64(3) + h[1:])
        for k in keys:
            h = _mix(h * np.uint64(5) + np.asarray(k).astype(np.int64).view(np.uint64))
    return (h >> np.uint64(11)) * 2.0**-53


# chances of 0, 1, 2, ... draws of a row among as many draws as there are rows
_POISSON = np.cumsum([np.exp(-1.0) / f for f in np.cumprod([1, 1, 2, 3, 4, 5, 6, 7, 8, 9])])


def weights_of(s: Trees, group: int, tree: int, row: np.ndarray) -> np.ndarray:
    """How often each row counts in a tree."""
    if s.rate and s.subsample < 1:
        return (uniform(s.seed + 1, group, np.int64(tree), row) < s.subsample).astype(np.int64)
    if not s.bootstrap:
        return np.ones(len(row), np.int64)
    return np.searchsorted(_POISSON, uniform(s.seed + 1, group, np.int64(tree // s.share_weights), row), side="right")


def thresholds(s: Trees, group: int, tree: int, nodes: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(thresholds, whether the feature takes part) per node and feature; constant features never do."""
    d = low.shape[1]
    at = np.arange(d)[None, :]
    u = uniform(s.seed + 2, group, np.int64(tree), nodes[:, None], at)
    cut = low + u * (high - low)
    cut = np.where(cut >= high, low, cut)
    order = np.where(low < high, uniform(s.seed + 3, group, np.int64(tree), nodes[:, None], at), 2.0)
    k = min(d, max(1, int(np.sqrt(d))) if s.features is None else s.features or d)
    least = np.partition(order, k - 1, axis=1)[:, k - 1 : k]
    return cut, (order <= least) & (order < 1.5)


# --- one level --------------------------------------------------------------


def spans(x: np.ndarray, y: np.ndarray, w: np.ndarray, node: np.ndarray):
    """Nodes, their first rows in node order, and per node: ranges of the features, weight, sum, least and largest target."""
    nodes, first = np.unique(node, return_index=True)
    return (
        nodes, first, np.minimum.reduceat(x, first), np.maximum.reduceat(x, first), np.add.reduceat(w, first),
        np.add.reduceat(w * y, first), np.minimum.reduceat(y, first), np.maximum.reduceat(y, first),
    )


def beside(s: Trees, x: np.ndarray, y: np.ndarray, w: np.ndarray, first: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight and sum of targets at or below each candidate threshold, one column per candidate; rows in node order.

    Candidates are the drawn thresholds, or all borders of all features' bins in order.
    """
    where = np.zeros(len(x), np.int64)
    where[first[1:]] = 1
    where = np.cumsum(where)
    if not s.bins:
        left = x <= cut[where]
        return np.add.reduceat(left * w[:, None], first), np.add.reduceat(left * (w * y)[:, None], first)
    n, d = len(first), x.shape[1]
    at = ((where[:, None] * d + np.arange(d)) * s.bins + x.astype(np.int64)).ravel()
    out = []
    for v in (w, w * y):
        sums = np.bincount(at, np.repeat(v, d), n * d * s.bins).reshape(n, d, s.bins)
        out.append(np.rint(sums.cumsum(2)[:, :, :-1]).astype(np.int64).reshape(n, -1))
    return out[0], out[1]


def choose(s: Trees, n: np.ndarray, total: np.ndarray, left_n: np.ndarray, left_total: np.ndarray, takes_part: np.ndarray, cut: np.ndarray):
    """(feature, threshold, weight on the left) of the candidate whose sides differ most, the first of equal ones; feature -1 without any."""
    each = max(1, s.bins - 1)
    score = _score(n[:, None], total[:, None], left_n, left_total, np.repeat(takes_part, each, axis=1))
    best, at = score.argmax(1), np.arange(len(score))
    feature = np.where(score[at, best] >= 0, best // each, -1)
    return feature, (best % each).astype(float) if s.bins else cut[at, best], left_n[at, best]


def best_splits(s: Trees, x: np.ndarray, y: np.ndarray, w: np.ndarray, first: np.ndarray, where: np.ndarray, n: np.ndarray, total: np.ndarray, takes_part: np.ndarray, cut: np.ndarray):
    """(feature, threshold) per node as `choose` gives them, from the features that take part alone; rows in node order.

    Bins are not laid out: rows are sorted by bin inside their node, and a border lies where the bin changes.
    """
    k = max(1, int(takes_part.sum(1).max()))
    picked = np.argsort(~takes_part, axis=1, kind="stable")[:, :k]
    valid = np.take_along_axis(takes_part, picked, 1)
    mine = np.take_along_axis(x, picked[where], 1)
    at = np.arange(len(n))
    if not s.bins:
        border = np.take_along_axis(cut, picked, 1)
        left = mine <= border[where]
        left_n, left_total = np.add.reduceat(left * w[:, None], first), np.add.reduceat(left * (w * y)[:, None], first)
        score = _score(n[:, None], total[:, None], left_n, left_total, valid)
        best = score.argmax(1)
        return np.where(score[at, best] >= 0, picked[at, best], -1), border[at, best]
    order = np.argsort(where[:, None] * s.bins + mine.astype(np.int64), axis=0, kind="stable")
    bins = np.take_along_axis(mine, order, 0)
    last = np.append(first[1:], len(x)) - 1
    inner = np.vstack([bins[1:] != bins[:-1], np.zeros((1, k), bool)])
    inner[last] = False
    sums = []
    for v in (w, w * y):
        running = np.cumsum(v[order], axis=0)
        before = np.vstack([np.zeros((1, k), np.int64), running[last[:-1]]])
        sums.append(running - before[where])
    score = _score(n[where][:, None], total[where][:, None], *sums, inner & valid[where])
    top = np.maximum.reduceat(score, first)
    best = top.argmax(1)
    column = best[where]
    rows = np.arange(len(x))
    place = np.minimum.reduceat(np.where(score[rows, column] == top[at, best][where], rows, len(x)), first)
    return np.where(top[at, best] >= 0, picked[at, best], -1), bins[place, best]


def _score(n, total, left_n, left_total, fine) -> np.ndarray:
    right_n, right_total = n - left_n, total - left_total
    score = left_total.astype(float) ** 2 / np.maximum(left_n, 1) + right_total.astype(float) ** 2 / np.maximum(right_n, 1)
    return np.where(fine & (left_n > 0) & (right_n > 0), score, -1.0)


def grow_subtree(s: Trees, group: int, tree: int, root: int, x: np.ndarray, y: np.ndarray, w: np.ndarray):
    """Nodes below and with ``root``: (node, feature or -1, threshold, weight, sum of targets)."""
    node, out = np.full(len(x), root, np.int64), []
    while len(node):
        order = np.argsort(node, kind="stable")
        x, y, w, node = x[order], y[order], w[order], node[order]
        nodes, first, low, high, n, total, y_low, y_high = spans(x, y, w, node)
        where = np.repeat(np.arange(len(nodes)), np.diff(np.append(first, len(x))))
        cut, takes_part = thresholds(s, group, tree, nodes, low, high)
        feature, threshold = best_splits(s, x, y, w, first, where, n, total, takes_part, cut)
        feature[(y_low == y_high) | (n < s.least) | (nodes >= 1 << s.depth)] = -1
        out.append((nodes, feature, np.where(feature >= 0, threshold, 0.0), n, total))
        live = feature[where] >= 0
        x, y, w, node, where = x[live], y[live], w[live], node[live], where[live]
        node = 2 * node + (x[np.arange(len(x)), feature[where]] > threshold[where])
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5


# --- descending -------------------------------------------------------------


class Nodes:
    """Nodes of one tree (or subtree) that rows descend."""

    def __init__(self, node: np.ndarray, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        order = np.argsort(node)
        self.node, self.feature, self.threshold, self.value = node[order], feature[order], threshold[order], value[order]
        self.children = np.stack([self._find(2 * self.node), self._find(2 * self.node + 1)])

    def _find(self, node: np.ndarray) -> np.ndarray:
        """Indexes of nodes, -1 for those that are elsewhere."""
        if not len(self.node):
            return np.full(len(node), -1)
        at = np.minimum(np.searchsorted(self.node, node), len(self.node) - 1)
        return np.where(self.node[at] == node, at, -1)

    def places(self, x: np.ndarray, root: int) -> np.ndarray:
        """Index of the leaf of each row; rows that leave these nodes are -1 minus the node they go to."""
        start = int(self._find(np.array([root]))[0])
        if start < 0:
            return np.full(len(x), -1 - root, np.int64)
        at, inside = np.full(len(x), start, np.int64), np.arange(len(x))
        while len(inside):
            inside = inside[self.feature[at[inside]] >= 0]
            i = at[inside]
            right = (x[inside, self.feature[i]] > self.threshold[i]).astype(np.int64)
            there = self.children[right, i]
            at[inside] = np.where(there >= 0, there, -1 - (2 * self.node[i] + right))
            inside = inside[there >= 0]
        return at


Tops = dict[int, dict[int, Nodes]]


# --- fitting ----------------------------------------------------------------

_PIECE = f"{GROUP} string, g long, tree int, node long, trees array<int>, nodes array<long>, features array<int>, thresholds array<double>, leaves array<double>"
_FIT_ROW = f"{GROUP} string, g long, row long, y long, f double, center double, scale double, x array<double>"
_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), **{f"array<{k}>": pa.list_(t) for k, t in (("int", pa.int32()), ("long", pa.int64()), ("double", pa.float64()))}}


def _schema(text: str) -> pa.Schema:
    return pa.schema([(n, _TYPES[k]) for n, k in (x.split() for x in text.split(", "))])


def _in_bins(x: F.Column, edges: F.Column) -> F.Column:
    """Numbers of the bins, as doubles: how many edges of its feature lie below each value."""
    return F.transform(F.arrays_zip(x.alias("v"), edges.alias("e")), lambda p: F.size(F.filter(p["e"], lambda e: e < p["v"])).cast("double"))


def _prepared(s: Trees, rows: DataFrame, columns: Sequence[str], label: str, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with their vector, key hash and target in whole units about their group's centre; and what is known of each group."""
    known = with_vector(rows, columns, F.col(GROUP), F.xxhash64(F.col(GROUP)).alias("g"), F.xxhash64(*keys).alias("row"), F.col(label).cast("double").alias("_y"))
    known = known.filter(f"{GROUP} IS NOT NULL AND _y IS NOT NULL AND NOT isnan(_y) AND NOT exists(x, c -> c IS NULL OR isnan(c))")
    known = reliable(known)
    shares = F.array(*[F.lit(i / s.bins) for i in range(1, s.bins)]) if s.bins else None
    edges = [F.array_distinct(F.percentile_approx(F.col("x")[j], shares)) for j in range(len(columns))] if s.bins else []
    groups = known.groupBy(GROUP, "g").agg(
        ((F.max("_y") + F.min("_y")) / 2).alias("center"), F.greatest((F.max("_y") - F.min("_y")) / 2, F.lit(1e-300)).alias("scale"),
        (F.array(*edges) if s.bins else F.lit(None).cast("array<array<double>>")).alias("edges"),
    )
    groups = reliable(groups)
    by_g = groups.select(F.col("g").alias("_g"), "center", "scale", "edges")
    both = known.join(by_g, known["g"] == by_g["_g"])
    y = F.round((F.col("_y") - F.col("center")) / F.col("scale") * UNITS).cast("long")
    x = _in_bins(F.col("x"), F.col("edges")) if s.bins else F.col("x")
    return reliable(both.select(GROUP, "g", "row", y.alias("y"), "center", "scale", x.alias("x"))), groups


def _each_tree(b: pa.RecordBatch, s: Trees, tops: Tops, width: int):
    """(group, tree, row indexes, vectors, leaf places) of a batch's rows in the trees of large groups."""
    g = b.column("g").to_numpy()
    x = matrix(b.column("x"), width)
    for group in np.unique(g):
        if int(group) in tops:
            at = np.flatnonzero(g == group)
            for tree in s.numbers:
                top = tops[int(group)][tree]
                yield int(group), tree, at, x[at], top.places(x[at], ROOT)


def _target_of(b: pa.RecordBatch) -> np.ndarray:
    """What is still to be explained, in whole units."""
    y = b.column("y").to_numpy()
    return np.rint(y - b.column("f").to_numpy()).astype(np.int64)


def _level(s: Trees, tops: Tops, open_nodes: dict, width: int, cuts: dict | None):
    """Partial ranges of the open nodes, or partial sums beside their thresholds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y_all, row = _target_of(b), b.column("row").to_numpy()
            out = []
            for group, tree, at, x, place in _each_tree(b, s, tops, width):
                node = -1 - place
                w = weights_of(s, group, tree, row[at])
                live = np.flatnonzero((place < 0) & (w > 0) & np.isin(node, open_nodes.get((group, tree), [])))
                live = live[np.argsort(node[live], kind="stable")]
                if not len(live):
                    continue
                part = x[live], y_all[at[live]], w[live], node[live]
                if cuts is None:
                    nodes, _, low, high, n, total, y_low, y_high = spans(*part)
                    out += [(group, tree, *v) for v in zip(nodes.tolist(), n.tolist(), total.tolist(), y_low.tolist(), y_high.tolist(), low.tolist(), high.tolist(), strict=True)]
                else:
                    nodes, first = np.unique(part[3], return_index=True)
                    known = cuts[group, tree]
                    sides = beside(s, *part[:3], first, known["cut"][np.searchsorted(known["nodes"], nodes)])
                    out += [(group, tree, *v) for v in zip(nodes.tolist(), *(side.tolist() for side in sides), strict=True)]
            if out:
                schema = _schema(_RANGES if cuts is None else _SIDES)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


_RANGES = "g long, tree int, node long, n long, total long, y_low long, y_high long, low array<double>, high array<double>"
_SIDES = "g long, tree int, node long, left_n array<long>, left_total array<long>"
_SPLITS = "g long, tree int, node long, feature int, threshold double, left_n long"
_NODE = ["g", "tree", "node"]


def _choose_splits(s: Trees, cuts: dict):
    """The split of each open node from its sums beside all thresholds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for g, tree, node, sides in zip(*(b.column(c).to_pylist() for c in _NODE), b.column("sides").to_pylist(), strict=True):
                known = cuts[g, tree]
                i = int(np.searchsorted(known["nodes"], node))
                one = {k: v[i : i + 1] for k, v in known.items()}
                left = [np.array([[x[k] for x in sides]]) for k in ("left_n", "left_total")]
                feature, threshold, n = choose(s, one["n"], one["total"], *left, one["takes_part"], one["cut"])
                out.append((g, tree, node, -1 if one["done"][0] else int(feature[0]), float(threshold[0]), int(n[0])))
            if out:
                schema = _schema(_SPLITS)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _grow_tops(s: Trees, rows: DataFrame, width: int, large: list[int]) -> Tops:
    """Splits of all nodes with more than LOCAL_ROWS rows, level by level over all groups and trees.

    A level is two passes over the rows: the ranges of the open nodes, then the sums beside their thresholds.
    """
    found: dict = {(g, t): [] for g in large for t in s.numbers}
    open_nodes: dict = {k: np.array([ROOT]) for k in found}
    pack = lambda v: Nodes(*(np.array([r[i] for r in v], k) for i, k in enumerate((np.int64, np.int64, float, float))))
    tops = lambda: {g: {t: pack(found[g, t]) for t in s.numbers} for g in large}
    while open_nodes:
        now = tops()
        ranges = rows.mapInArrow(_level(s, now, open_nodes, width, None), _RANGES)
        each = lambda kind, c: F.array(*[kind(F.col(c)[j]) for j in range(width)]).alias(c)
        ranges = ranges.groupBy(*_NODE).agg(
            F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("y_low").alias("y_low"), F.max("y_high").alias("y_high"), each(F.min, "low"), each(F.max, "high")
        )
        by_tree: dict = {}
        for r in ranges.orderBy(*_NODE).collect():
            by_tree.setdefault((r["g"], r["tree"]), []).append(r)
        cuts = {}
        for k, v in by_tree.items():
            nodes, n = (np.array([r[c] for r in v]) for c in ("node", "n"))
            cut, takes_part = thresholds(s, *k, nodes, np.array([r["low"] for r in v]), np.array([r["high"] for r in v]))
            done = np.array([r["y_low"] == r["y_high"] for r in v]) | (n < s.least) | (nodes >= 1 << s.depth)
            cuts[k] = {"nodes": nodes, "n": n, "total": np.array([r["total"] for r in v]), "cut": cut, "takes_part": takes_part, "done": done}
        sides = rows.mapInArrow(_level(s, now, open_nodes, width, cuts), _SIDES)
        one = sides.select(*_NODE, F.posexplode(F.arrays_zip("left_n", "left_total")).alias("i", "v")).groupBy(*_NODE, "i")
        one = one.agg(F.sum("v.left_n").alias("left_n"), F.sum("v.left_total").alias("left_total"))
        packed = one.groupBy(*_NODE).agg(F.array_sort(F.collect_list(F.struct("i", "left_n", "left_total"))).alias("sides"))
        splits = {(r["g"], r["tree"], r["node"]): r for r in packed.mapInArrow(_choose_splits(s, cuts), _SPLITS).collect()}
        open_nodes = {}
        for k, known in cuts.items():
            for node, n, total in zip(known["nodes"].tolist(), known["n"].tolist(), known["total"].tolist(), strict=True):
                split = splits[*k, node]
                j = split["feature"]
                found[k].append((node, j, split["threshold"] if j >= 0 else 0.0, total / n))
                for child, size in ((2 * node, split["left_n"]), (2 * node + 1, n - split["left_n"])) if j >= 0 else ():
                    if size > LOCAL_ROWS:
                        open_nodes.setdefault(k, []).append(child)
        open_nodes = {k: np.array(v) for k, v in open_nodes.items()}
    return tops()


def _to_pieces(s: Trees, tops: Tops, width: int):
    """Rows of large groups once per tree, with the small node they fall into; rows in leaves of the tops are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, tree, at, _, place in _each_tree(b, s, tops, width):
                small = np.flatnonzero(place < 0)
                part = b.take(pa.array(at[small]))
                columns = {n: part.column(n) for n in part.schema.names}
                columns |= {"tree": pa.array(np.full(len(small), tree, np.int32)), "node": pa.array(-1 - place[small])}
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _in_large(s: Trees, rows: DataFrame, tops: Tops, width: int) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", tree int, node long"
    return rows.filter(F.col("g").isin(list(tops))).mapInArrow(_to_pieces(s, tops, width), schema)


def _dealt(s: Trees, rows: DataFrame, tops: Tops, width: int) -> DataFrame:
    """Rows with the (tree, node) of the pieces they belong to: a block of whole trees in small groups."""
    tree = F.explode(F.sequence(F.lit(s.first), F.lit(s.first + s.trees - 1), F.lit(BLOCK))).alias("tree")
    out = rows.filter(~F.col("g").isin(list(tops))).select("*", tree).withColumn("node", F.lit(ROOT).cast("long"))
    return out.unionByName(_in_large(s, rows, tops, width)) if tops else out


class _Rows:
    """The rows of one piece, in an order that does not depend on how they came."""

    def __init__(self, table: pa.Table, width: int):
        self.name, self.group, self.tree, self.root = (table.column(c)[0].as_py() for c in (GROUP, "g", "tree", "node"))
        self.center, self.scale = table.column("center")[0].as_py(), table.column("scale")[0].as_py()
        order = np.argsort(table.column("row").to_numpy(), kind="stable")
        self.x = matrix(table.column("x"), width)[order]
        self.y, self.row, self.f = (table.column(c).to_numpy()[order] for c in ("y", "row", "f"))

    def grow(self, s: Trees, tree: int):
        w = weights_of(s, self.group, tree, self.row)
        drawn = w > 0 if (w > 0).any() else np.ones(len(w), bool)
        y = np.rint(self.y - self.f).astype(np.int64)
        return grow_subtree(s, self.group, tree, self.root, self.x[drawn], y[drawn], np.maximum(w[drawn], 1))

    def boost(self, s: Trees, part) -> None:
        nodes = Nodes(part[0], part[1], part[2], s.rate * (part[4] / part[3]))
        self.f = self.f + nodes.value[nodes.places(self.x, self.root)]

    def piece(self, s: Trees, first: int, parts: list) -> tuple:
        node, feature, threshold, n, total = (np.concatenate(c) for c in zip(*parts, strict=True))
        value = s.rate * self.scale / UNITS * (total / n) if s.rate else self.center + self.scale / UNITS * (total / n)
        trees = np.repeat(np.arange(first, first + len(parts)), [len(p[0]) for p in parts])
        return (self.name, self.group, first, self.root, *(v.tolist() for v in (trees, node, feature, threshold, value)))

    def left(self) -> list[tuple]:
        """The rows again, with what is explained so far."""
        return [
            (self.name, self.group, r, y, f, self.center, self.scale, x)
            for r, y, f, x in zip(self.row.tolist(), self.y.tolist(), self.f.tolist(), self.x.tolist(), strict=True)
        ]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _grow_pieces(s: Trees, width: int, large: frozenset):
    """Subtrees of large groups one at a time; small groups a block of trees at a time, or all rounds of their boosting."""

    def run(table: pa.Table) -> pa.Table:
        rows, out = _Rows(table, width), []
        if rows.group in large:
            out.append(rows.piece(s, rows.tree, [rows.grow(s, rows.tree)]))
        else:
            last = s.first + s.trees
            for first in range(rows.tree, last, BLOCK) if s.rate else [rows.tree]:
                parts = []
                for tree in range(first, min(first + BLOCK, last)):
                    parts.append(rows.grow(s, tree))
                    if s.rate:
                        rows.boost(s, parts[-1])
                out.append(rows.piece(s, first, parts))
        return _table(out, _schema(_PIECE))

    return run


def _one_round(s: Trees, width: int):
    """A piece of one round of a large group, and its rows with what is explained by now."""
    schema = pa.schema([*_schema(_PIECE), *(f for f in _schema(_FIT_ROW) if f.name not in (GROUP, "g"))])

    def run(table: pa.Table) -> pa.Table:
        rows = _Rows(table, width)
        part = rows.grow(s, rows.tree)
        rows.boost(s, part)
        piece = (*rows.piece(s, rows.tree, [part]), *[None] * 6)
        return _table([piece, *((r[0], r[1], *[None] * 7, *r[2:]) for r in rows.left())], schema)

    return run


def _boost_tops(s: Trees, tops: Tops, width: int):
    """Rows of large groups that end in a leaf of a top, with what is explained by now."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for group, tree, at, _, place in _each_tree(b, s, tops, width):
                leaf = np.flatnonzero(place >= 0)
                part = b.take(pa.array(at[leaf]))
                f = part.column("f").to_numpy() + s.rate * tops[group][tree].value[place[leaf]]
                yield part.set_column(part.schema.get_field_index("f"), "f", pa.array(f))

    return run


def _boost_large(s: Trees, rows: DataFrame, width: int, large: list[int]) -> tuple[Tops, list[DataFrame]]:
    """Round after round over the large groups; each is a few jobs and its rows are written once."""
    names = [x.split()[0] for x in _FIT_ROW.split(", ")]
    both = f"{_PIECE}, " + ", ".join(x for x in _FIT_ROW.split(", ") if x.split()[0] not in (GROUP, "g"))
    tops: Tops = {g: {} for g in large}
    pieces, now = [], reliable(rows)
    for tree in s.numbers:
        one = replace(s, trees=1, first=tree)
        top = _grow_tops(one, now, width, large)
        grown = reliable(_in_large(one, now, top, width).groupBy(*_NODE).applyInArrow(_one_round(one, width), both))
        pieces.append(grown.filter("trees IS NOT NULL").select(*[x.split()[0] for x in _PIECE.split(", ")]))
        now = reliable(grown.filter("trees IS NULL").select(*names).unionByName(now.mapInArrow(_boost_tops(one, top, width), _FIT_ROW).select(*names)))
        for g in large:
            tops[g] |= top[g]
    return tops, pieces


def grow(s: Trees, rows: DataFrame, columns: Sequence[str], label: str = "target", keys: Sequence[str] = ("location_id", "t")) -> Forest:
    """Fit the trees of every group; ``keys`` name a row inside its group.  Rows with a missing feature or target are left out."""
    width = len(columns)
    ready, groups = _prepared(s, rows, columns, label, keys)
    # a boosted sum starts from the mean, everything else from nothing
    start = ready.groupBy(F.col("g").alias("_g")).agg(F.count("*").alias("n"), (F.sum("y") / F.count("*")).alias("mean"))
    known = reliable(groups.join(start, groups["g"] == start["_g"]).drop("_g"))
    by_g = known.select(F.col("g").alias("_g"), F.col("mean").alias("f") if s.rate else F.lit(0.0).alias("f"))
    ready = ready.join(by_g, ready["g"] == by_g["_g"]).select(*[x.split()[0] for x in _FIT_ROW.split(", ")])
    # only groups of more than LOCAL_ROWS rows are listed
    big = {r["g"]: (r["center"], r["scale"]) for r in known.filter(F.col("n") > LOCAL_ROWS).collect()}
    large = ready.filter(F.col("g").isin(list(big)))
    small = ready.filter(~F.col("g").isin(list(big)))
    tops: Tops = {}
    if s.rate:
        tops, pieces = _boost_large(s, large, width, sorted(big)) if big else ({}, [])
        whole = small.withColumns({"tree": F.lit(s.first), "node": F.lit(ROOT).cast("long")})
    else:
        tops = _grow_tops(s, large, width, sorted(big)) if big else {}
        whole, pieces = _dealt(s, ready, tops, width), []
    pieces.append(whole.groupBy(*_NODE).applyInArrow(_grow_pieces(s, width, frozenset(big)), _PIECE))
    for g, (center, scale) in big.items():
        for top in tops[g].values():
            top.value = s.rate * scale / UNITS * top.value if s.rate else center + scale / UNITS * top.value
    joined = pieces[0]
    for p in pieces[1:]:
        joined = joined.unionByName(p)
    base = F.col("center") + F.col("scale") / UNITS * F.col("mean") if s.rate else F.lit(0.0)
    return Forest(s, tuple(columns), tops, reliable(joined), reliable(known.select(GROUP, "g", base.alias("base"), "edges")))


# --- the model --------------------------------------------------------------

_IN_BAG = "id long, member int, total double"


def _predict_pieces(s: Trees, width: int):
    """Sums of the trees' values per row and member; pieces stand before the rows that fall into them.

    Memory holds one piece and one batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, piece, root = None, {}, ROOT
        for b in batches:
            keys = [b.column(c).to_numpy() for c in ("g", "tree", "node", "salt")]
            for begin, end in runs(keys, b.num_rows):
                part, key = b.slice(begin, end - begin), tuple(int(k[begin]) for k in keys)
                if key != held:
                    held, piece, root = key, {}, key[2]
                    if part.column("trees")[0].is_valid:
                        p = part.slice(0, 1)
                        tree, node, feature, threshold, value = (np.array(p.column(c)[0].values) for c in ("trees", "nodes", "features", "thresholds", "leaves"))
                        piece = {int(t): Nodes(*(v[tree == t] for v in (node, feature, threshold, value))) for t in np.unique(tree)}
                        part = part.slice(1)
                if not part.num_rows or not piece:
                    continue
                x, ids = matrix(part.column("x"), width), part.column("id").to_numpy()
                members: dict = {}
                for t, nodes in piece.items():
                    member = t // s.share_weights
                    members[member] = members.get(member, 0.0) + nodes.value[nodes.places(x, root)]
                for member, total in members.items():
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), member, np.int32)), pa.array(total)], ["id", "member", "total"])

    return run


def _predict_tops(s: Trees, tops: Tops, width: int):
    """Values of rows that end in a leaf of a top."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id").to_numpy()
            for group, tree, at, _, place in _each_tree(b, s, tops, width):
                leaf = np.flatnonzero(place >= 0)
                if len(leaf):
                    member = pa.array(np.full(len(leaf), tree // s.share_weights, np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at[leaf]]), member, pa.array(tops[group][tree].value[place[leaf]])], ["id", "member", "total"])

    return run


@dataclass(frozen=True)
class Forest:
    """Trees of every group: the tops of large groups here, everything below them as rows of ``pieces``."""

    settings: Trees
    columns: tuple[str, ...]
    tops: Tops
    pieces: DataFrame
    names: DataFrame

    def groups(self) -> DataFrame:
        return self.names.select(GROUP)

    def members(self, rows: DataFrame, row_id: str) -> DataFrame:
        """(id, member, prediction): mean over the trees that share a bootstrap, for rows of known groups.

        Rows are dealt by the piece they fall into; a piece that many rows meet is dealt several times, LOCAL_ROWS rows each.
        """
        s, width = self.settings, len(self.columns)
        x = with_vector(rows, self.columns, F.xxhash64(F.col(GROUP)).alias("g"), F.col(row_id).cast("long").alias("id"))
        x = x.filter("NOT exists(x, c -> c IS NULL OR isnan(c))")
        known = self.names.select(F.col("g").alias("_g"), "edges")
        x = x.join(known, x["g"] == known["_g"]).withColumn("x", _in_bins(F.col("x"), F.col("edges")) if s.bins else F.col("x"))
        x = reliable(x.select("g", "id", "x"))
        counts = x.groupBy(F.col("g").alias("_g")).agg(F.ceil(F.count("*") / LOCAL_ROWS).cast("int").alias("salts"))
        salted = _dealt(s, x, self.tops, width)
        salted = salted.join(counts, salted["g"] == counts["_g"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).drop("_g", "salts")
        pieces = self.pieces.drop(GROUP).join(counts, self.pieces["g"] == counts["_g"])
        pieces = pieces.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("_g", "salts")
        both = pieces.unionByName(salted, allowMissingColumns=True)
        keys = ["g", "tree", "node", "salt"]
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        both = both.repartition(parts, *keys).sortWithinPartitions(*keys, F.col("trees").isNull())
        sums = both.mapInArrow(_predict_pieces(s, width), _IN_BAG)
        if self.tops:
            sums = sums.unionByName(x.filter(F.col("g").isin(list(self.tops))).mapInArrow(_predict_tops(s, self.tops, width), _IN_BAG))
        # sums of whole billionths do not depend on their order
        mean = F.sum(F.col("total").cast("decimal(38,9)")).cast("double") / F.lit(float(s.share_weights))
        return sums.groupBy("id", "member").agg(mean.alias("prediction"))

    def add(self, rows: DataFrame, out: str) -> DataFrame:
        """Rows with the mean over all trees as ``out``, NULL for groups without trees or rows with missing features."""
        numbered = reliable(rows.withColumn("_row_id", F.monotonically_increasing_id()))
        each = self.members(numbered, "_row_id")
        s = self.settings
        share = F.lit(float(s.share_weights) if s.rate else s.share_weights / s.trees)
        total = each.groupBy(F.col("id").alias("_id")).agg((F.sum(F.col("prediction").cast("decimal(38,9)")).cast("double") * share).alias("_total"))
        base = self.names.select(F.col(GROUP).alias("_g"), F.col("base").alias("_base"))
        met = numbered.join(total, numbered["_row_id"] == total["_id"], "left")
        met = met.join(base, met[GROUP] == base["_g"], "left").withColumn(out, F.col("_base") + F.col("_total"))
        return met.drop("_row_id", "_id", "_total", "_g", "_base")

    def importance(self) -> list[float]:
        """Share of the splits that use each feature, over all groups."""
        used = self.pieces.select(F.explode("features").alias("f")).filter("f >= 0").groupBy("f").count().collect()
        out = np.zeros(len(self.columns))
        for r in used:
            out[r["f"]] += r["count"]
        for trees in self.tops.values():
            for top in trees.values():
                out += np.bincount(top.feature[top.feature >= 0], minlength=len(out))
        return (out / max(out.sum(), 1.0)).tolist()

    def save(self, path: str) -> None:
        """The pieces and names as Parquet, the settings and tops as JSON rows."""
        spark = self.pieces.sparkSession
        self.pieces.write.mode("overwrite").parquet(f"{path}/pieces")
        self.names.write.mode("overwrite").parquet(f"{path}/names")
        tops = [
            (g, t, top.node.tolist(), top.feature.tolist(), top.threshold.tolist(), top.value.tolist()) for g, trees in self.tops.items() for t, top in trees.items()
        ]
        kinds = "g long, tree int, node array<long>, feature array<long>, threshold array<double>, value array<double>"
        spark.createDataFrame(tops, kinds).write.mode("overwrite").parquet(f"{path}/tops")
        spark.createDataFrame([(json.dumps({"settings": asdict(self.settings), "columns": self.columns}),)], "value string").write.mode("overwrite").text(f"{path}/settings")

    @staticmethod
    def load(spark, path: str) -> Forest:
        meta = json.loads(spark.read.text(f"{path}/settings").first()["value"])
        tops: Tops = {}
        for r in spark.read.parquet(f"{path}/tops").collect():
            arrays = (np.array(r["node"], np.int64), np.array(r["feature"], np.int64), np.array(r["threshold"], float), np.array(r["value"], float))
            tops.setdefault(r["g"], {})[r["tree"]] = Nodes(*arrays)
        return Forest(Trees(**meta["settings"]), tuple(meta["columns"]), tops, spark.read.parquet(f"{path}/pieces"), spark.read.parquet(f"{path}/names"))

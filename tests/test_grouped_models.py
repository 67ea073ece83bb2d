"""Models that fit all groups at once, against brute force on small frames."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohyet.models import linear, trees
from isohyet.models.trees import Trees

COLUMNS = ["a", "b", "c", "flat"]


def rows_of(seed, groups=3, n=90):
    r = random.Random(seed)
    out = []
    for g in range(groups):
        for t in range(n + 10 * g):
            a, b, c = r.gauss(0, 1), float(r.randrange(4)), r.random()
            out.append((f"v{g}", g, t, a, b, c, 2.0, 100 * g + 3 * a - b * c + (5 if c > 0.5 else 0) + r.gauss(0, 0.1)))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "variable string, location_id long, t int, a double, b double, c double, flat double, target double").repartition(5)


# --- lines ---------------------------------------------------------------------


def test_lines_of_all_groups_equal_least_squares(spark):
    rows = rows_of(1, 40, 30)
    odd = [(*rows[0][:3], None, *rows[0][4:]), (None, *rows[0][1:]), (*rows[0][:7], None)]
    got = {r["variable"]: r for r in linear.Linear().fit_groups(frame(spark, rows + odd), COLUMNS).table.collect()}
    assert set(got) == {r[0] for r in rows}
    for v, m in got.items():
        x = np.array([[1.0, *r[3:6]] for r in rows if r[0] == v])
        y = np.array([r[7] for r in rows if r[0] == v])
        want = np.linalg.lstsq(x, y, rcond=None)[0]
        assert m["n"] == len(y) and m["weights"][3] == 0.0
        assert np.allclose([m["intercept"], *m["weights"][:3]], want, rtol=1e-9, atol=1e-9)


def test_elastic_nets_are_at_their_minimum(spark):
    rows = rows_of(2)
    model = linear.Linear(0.1, 0.5).fit_groups(frame(spark, rows), COLUMNS)
    for m in model.table.collect():
        x = np.array([r[3:6] for r in rows if r[0] == m["variable"]])
        y = np.array([r[7] for r in rows if r[0] == m["variable"]])
        x, y = (x - x.mean(0)) / x.std(0), y - y.mean()
        w = np.array(m["weights"][:3]) * np.array(m["scales"][:3])
        cost = lambda w: ((y - x @ w) ** 2).mean() / 2 + 0.05 * np.abs(w).sum() + 0.025 * (w**2).sum()  # noqa: B023, E731
        assert all(cost(w) <= cost(w + d) for d in np.vstack([np.eye(3), -np.eye(3)]) * 1e-4)


def test_collinear_features_and_predictions(spark):
    rows = [(*r[:5], r[3], *r[6:]) for r in rows_of(3)]  # c repeats a
    data = frame(spark, rows)
    model = linear.Linear().fit_groups(data, COLUMNS)
    out = model.add(data.unionByName(data.limit(1).withColumn("variable", F.lit("new"))), "p").collect()
    assert len(out) == len(rows) + 1 and [r["p"] for r in out if r["variable"] == "new"] == [None]
    errors = [(r["p"] - r["target"]) ** 2 for r in out if r["p"] is not None]
    assert sum(errors) / len(errors) < 12


def test_a_thousand_groups(spark):
    data = spark.range(20_000).select(
        F.concat(F.lit("v"), (F.col("id") % 1000).cast("string")).alias("variable"), F.col("id").alias("location_id"), F.lit(0).alias("t"),
        (F.col("id") / 1000).cast("int").cast("double").alias("a"), (F.col("id") * 7 % 13).cast("double").alias("b"),
    ).withColumn("target", 2 * F.col("a") - F.col("b") + F.col("location_id") % 1000)
    got = linear.Linear().fit_groups(data, ["a", "b"]).table.collect()
    assert len(got) == 1000
    for r in got:
        assert r["weights"] == pytest.approx([2, -1]) and r["intercept"] == pytest.approx(int(r["variable"][1:]), abs=1e-7)


# --- trees ---------------------------------------------------------------------


def brute_tree(s, g, tree, x, y, w, node=1):
    """One node at a time: {node: (feature, threshold, value)}."""
    n, total = int(w.sum()), int((w * y).sum())
    low, high = x.min(0), x.max(0)
    cut, takes_part = trees.thresholds(s, g, tree, np.array([node]), low[None], high[None])
    best = None
    if y.min() < y.max() and n >= 2 and node < 1 << s.depth:
        for j in range(x.shape[1]):
            for c in range(s.bins - 1) if s.bins else [cut[0, j]]:
                left = x[:, j] <= c
                if takes_part[0, j] and left.any() and not left.all():
                    a, b = w[left].sum(), w[~left].sum()
                    score = float((w * y)[left].sum()) ** 2 / a + float((w * y)[~left].sum()) ** 2 / b
                    if best is None or score > best[0]:
                        best = (score, j, left, float(c))
    if best is None:
        return {node: (-1, 0.0, total / n)}
    _, j, left, c = best
    out = {node: (j, c, total / n)}
    out |= brute_tree(s, g, tree, x[left], y[left], w[left], 2 * node)
    return out | brute_tree(s, g, tree, x[~left], y[~left], w[~left], 2 * node + 1)


def leaf(nodes, row):
    at = 1
    while nodes[at][0] >= 0:
        at = 2 * at + int(row[nodes[at][0]] > nodes[at][1])
    return nodes[at][2]


def brute_forest(spark, s, rows, data):
    """Predictions {(variable, location_id, t): [value per tree]}; a boosted sum has its start as first value."""
    hashes = {(r["variable"], r["location_id"], r["t"]): (r["g"], r["h"]) for r in data.select("variable", "location_id", "t", F.xxhash64("variable").alias("g"), F.xxhash64("location_id", "t").alias("h")).collect()}
    out = {}
    for v in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == v), key=lambda r: hashes[r[:3]][1])
        x, t = np.array([r[3:7] for r in mine]), np.array([r[7] for r in mine])
        if s.bins:
            # an edge is the smallest value with at least its share of the rows at or below
            edges = [sorted({float(np.sort(c)[max(math.ceil(i / s.bins * len(c)), 1) - 1]) for i in range(1, s.bins)}) for c in x.T]
            x = np.array([[float(sum(e < a for e in edges[j])) for j, a in enumerate(row)] for row in x])
        center, scale = (t.max() + t.min()) / 2, (t.max() - t.min()) / 2
        y = np.floor((t - center) / scale * trees.UNITS + 0.5).astype(np.int64)
        g, key = hashes[mine[0][:3]][0], np.array([hashes[r[:3]][1] for r in mine])
        f = np.full(len(mine), y.sum() / len(y)) if s.rate else np.zeros(len(mine))
        values = [center + scale / trees.UNITS * f] if s.rate else []
        for tree in range(s.trees):
            w = trees.weights_of(s, g, tree, key)
            nodes = brute_tree(s, g, tree, x[w > 0], np.rint(y - f).astype(np.int64)[w > 0], w[w > 0])
            found = np.array([leaf(nodes, row) for row in x])
            if s.rate:
                f = f + s.rate * found
            values.append(scale / trees.UNITS * (s.rate * found) if s.rate else center + scale / trees.UNITS * found)
        out |= {r[:3]: np.array([c[i] for c in values]) for i, r in enumerate(mine)}
    return out


KINDS = {
    "extra": Trees(trees=7, depth=6, seed=5),
    "forest": Trees(trees=7, depth=6, features=0, seed=5, bins=8),
    "boosted": Trees(trees=5, depth=3, features=0, bootstrap=False, seed=5, bins=8, rate=0.3, subsample=0.8),
}


@pytest.mark.parametrize("local", [1 << 15, 40])
@pytest.mark.parametrize("kind", KINDS)
def test_trees_equal_one_node_at_a_time(spark, monkeypatch, tmp_path, kind, local):
    monkeypatch.setattr(trees, "LOCAL_ROWS", local)
    monkeypatch.setattr(trees, "BLOCK", 3)
    s = KINDS[kind]
    rows = rows_of(4)
    data = frame(spark, rows)
    forest = s.fit_groups(data, COLUMNS)
    assert bool(forest.tops) == (local == 40)
    want = brute_forest(spark, s, rows, data)
    forest.save(str(tmp_path / "f"))
    for model in (forest, trees.Forest.load(spark, str(tmp_path / "f"))):
        got = {tuple(r)[:3]: r["p"] for r in model.add(data, "p").select("variable", "location_id", "t", "p").collect()}
        assert set(got) == set(want)
        assert max(abs(got[k] - (want[k].sum() if s.rate else want[k].mean())) for k in want) < 1e-7
    if not s.rate:
        each = forest.members(data.withColumn("id", F.col("location_id") * 1000 + F.col("t")), "id").collect()
        assert len(each) == 7 * len(rows)
        for r in each:
            key = (f"v{r['id'] // 1000}", r["id"] // 1000, r["id"] % 1000)
            assert abs(r["prediction"] - want[key][r["member"]]) < 1e-7


def test_forest_learns_and_leaves_gaps(spark):
    rows = rows_of(6, 2, 300)
    data = frame(spark, rows)
    forest = Trees(trees=40, depth=25).fit_groups(data.filter("t % 5 > 0").unionByName(data.limit(1).withColumn("a", F.lit(None).cast("double"))), COLUMNS)
    held = data.filter("t % 5 = 0")
    odd = held.limit(1).withColumn("variable", F.lit("new")).unionByName(held.limit(1).withColumn("a", F.lit(None).cast("double")))
    out = forest.add(held.unionByName(odd), "p").collect()
    assert sum(r["p"] is None for r in out) == 2 and len(out) == held.count() + 2
    known = [r for r in out if r["p"] is not None]
    spread = {v: np.var([r["target"] for r in known if r["variable"] == v]) for v in ("v0", "v1")}
    for v in spread:
        assert np.mean([(r["p"] - r["target"]) ** 2 for r in known if r["variable"] == v]) < 0.35 * spread[v]
    assert sum(forest.importance()) == pytest.approx(1) and forest.importance()[3] == 0


def test_bootstrap_weights_are_poisson(spark):
    w = trees.weights_of(Trees(), 1, 3, np.arange(200_000))
    for k in range(4):
        assert (w == k).mean() == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.005)
    assert (trees.weights_of(Trees(share_weights=5), 1, 3, np.arange(100)) == trees.weights_of(Trees(share_weights=5), 1, 0, np.arange(100))).all()


# --- refitted before each held period ---------------------------------------


def test_walk_forward_equals_refitting_before_each_period(spark):
    from isohyet.models.panel import walk_forward_linear
    from isohyet.operators.features import forecast_features

    r = random.Random(5)
    lengths = {(1, "a"): 60, (2, "a"): 48, (3, "a"): 90, (1, "b"): 40, (2, "b"): 15, (4, None): 50}
    data = [(i, v, t, None if (i, t) in ((1, 57), (3, 88)) else 10 * math.sin(t / 2) + i + r.gauss(0, 1), float(i), 2.0) for (i, v), n in lengths.items() for t in range(n)]
    df = spark.createDataFrame(data, "location_id long, variable string, t int, value double, lat double, lon double").repartition(3)
    columns, horizon = ["lag_1", "lag_2", "month_sin", "std_12"], 6
    got = {(g["location_id"], g["variable"], g["t"]): g["prediction"] for g in walk_forward_linear(df, horizon, columns=columns).collect()}
    known = [f for f in forecast_features(df).collect() if (f["location_id"], f["variable"]) in lengths]
    end = lambda f: lengths[f["location_id"], f["variable"]]
    held = [f for f in known if f["t"] >= end(f) - horizon and f["value"] is not None and end(f) >= horizon + 24 and f["variable"]]
    assert set(got) == {(f["location_id"], f["variable"], f["t"]) for f in held}
    for f in held:
        step = f["t"] - end(f)
        old = [g for g in known if g["variable"] == f["variable"] and end(g) >= horizon + 24 and g["t"] - end(g) < step and None not in [g["value"], *[g[c] for c in columns]]]
        x = np.array([[1.0, *[g[c] for c in columns]] for g in old])
        w = np.linalg.lstsq(x, np.array([g["value"] for g in old]), rcond=None)[0]
        now = [f[c] for c in columns]
        past = [d[3] for d in data if d[:2] == (f["location_id"], f["variable"]) and d[2] < f["t"] and d[3] is not None]
        want = np.mean(past) if None in now else w[0] + np.dot(w[1:], now)
        assert got[f["location_id"], f["variable"], f["t"]] == pytest.approx(want, abs=1e-8)

"""Forests: a single tree against a plain one, draws, odd tables."""

import numpy as np
import pytest

from tickloom.operators import trees


def sample(n=600, seed=5):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)) * [1.0, 5.0, 0.1] + [0.0, 2.0, 1.0], 2)
    signal = x[:, 0] + (x[:, 1] - 2) / 10 + rng.normal(size=n) * 0.2
    return x, np.digitize(signal, [-0.5, 0.5]).astype(float)


def frame(spark, x, y):
    return spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "i long, a double, b double, c double, label double").repartition(5)


def grown(x, y, node, level, bounds, weights, depth, least, out):
    count = lambda m: np.array([(y[m] == c).sum() for c in range(3)])
    purity = lambda c: ((c * weights) ** 2).sum() / (c * weights).sum()
    whole = count(np.ones(len(y), bool))
    out[node] = (tuple(whole), None)
    if level == depth or len(y) < 2 * least or np.count_nonzero(whole) < 2:
        return
    options = []
    for f in range(3):
        for t in bounds[f]:
            left = x[:, f] <= t
            if left.sum() >= least and (~left).sum() >= least:
                gain = purity(count(left)) + purity(count(~left)) - purity(whole)
                if gain > 1e-9:
                    options.append((-round(gain, 9), f, t))
    if options:
        gain, f, t = min(options)
        out[node] = (tuple(whole), (f, float(t)))
        left = x[:, f] <= t
        grown(x[left], y[left], 2 * node, level + 1, bounds, weights, depth, least, out)
        grown(x[~left], y[~left], 2 * node + 1, level + 1, bounds, weights, depth, least, out)


@pytest.mark.parametrize("balanced", [False, True])
def test_one_tree_equals_a_plain_one(spark, balanced):
    x, y = sample()
    model = trees.fit(frame(spark, x, y), ["a", "b", "c"], trees=1, depth=4, draw=False, bins=16, balanced=balanced)
    bounds = [np.unique(np.percentile(x[:, f], [100 * i / 16 for i in range(1, 16)])) for f in range(3)]
    n = np.bincount(y.astype(int))
    want = {}
    grown(x, y, 1, 0, bounds, len(y) / (3 * n) if balanced else np.ones(3), 4, 20, want)
    got = {r["node"]: (tuple(r["counts"]), None if r["feature"] is None else ("abc".index(r["feature"]), r["threshold"])) for r in model.table(spark).collect()}
    assert got.keys() == want.keys()
    for node, (counts, split) in want.items():
        assert got[node][0] == counts and (got[node][1] == pytest.approx(split) if split else got[node][1] is None)


def test_a_forest_finds_the_rule(spark, monkeypatch):
    monkeypatch.setattr(trees, "TREES_AT_ONCE", 8)
    x, y = sample(1500)
    train, rest = frame(spark, x[:1000], y[:1000]), frame(spark, x[1000:], y[1000:])
    model = trees.fit(train, ["a", "b", "c"], keys=["i"], trees=20, depth=6, least_leaf=5)
    again = trees.fit(train.repartition(2), ["a", "b", "c"], keys=["i"], trees=20, depth=6, least_leaf=5)
    assert again.splits == model.splits and len({str(s) for s in model.splits}) == 20
    out = trees.predict(model, rest, ["i"]).collect()
    assert np.mean([r["prediction"] == r["label"] for r in out]) > 0.8
    assert all(sum(r["probability"]) == pytest.approx(1) for r in out)
    drawn = [model.counts[t][1].sum() for t in range(20)]
    assert 900 < np.mean(drawn) < 1100 and len(set(drawn)) > 5
    top = model.importances(spark).orderBy("rank").collect()
    assert top[0]["feature"] == "a" and sum(r["importance"] for r in top) == pytest.approx(1)


def test_odd_tables(spark):
    rows = [(float(i % 3), None if i % 10 == 0 else float(i), 4.0, float(i % 2)) for i in range(100)]
    table = spark.createDataFrame(rows, "a double, b double, c double, label double")
    model = trees.fit(table, ["a", "b", "c"], trees=3, depth=3, least_leaf=5)
    out = trees.predict(model, table, ["b"]).collect()
    assert len(out) == 100 and sum(r["prediction"] is None for r in out) == 10
    one = trees.fit(table.filter("label = 1"), ["a"], trees=2, depth=3)
    assert one.splits == [{}, {}] and {r["prediction"] for r in trees.predict(one, table, []).collect()} == {1.0}
    assert trees.fit(table.limit(0), ["a"]).counts == []

"""Newton fits against NumPy: classes, weights, folds in one pass, saved models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import linear


def sample(n=600, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1.0, 5.0, 0.1] + [0.0, 2.0, 1e6]
    signal = x[:, 0] + (x[:, 1] - 2) / 10 + rng.normal(size=n) * 0.4
    return x, np.digitize(signal, [-0.5, 0.5]).astype(float)


def plain(x, y, balanced=False, c=1.0):
    """Newton steps on the whole matrix, in other parameters: the last class's intercept is free, the mean is taken at the end."""
    z = np.column_stack([np.ones(len(y)), (x - x.mean(0)) / x.std(0)])
    k, d = int(y.max()) + 1, z.shape[1]
    hot = np.eye(k)[y.astype(int)]
    w = (len(y) / (k * hot.sum(0)))[y.astype(int)] if balanced else np.ones(len(y))
    t = np.zeros((k, d))
    pen = np.tile([0.0] + [1 / c] * (d - 1), k)
    for _ in range(60):
        s = z @ t.T
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = ((p - hot) * w[:, None]).T.dot(z).ravel() + pen * t.ravel()
        h = np.einsum("n,na,nab,ni,nj->aibj", w, p, np.eye(k)[None] - p[:, None, :], z, z).reshape(k * d, k * d) + np.diag(pen) + 1e-9 * np.eye(k * d)
        t = t - np.linalg.solve(h, g).reshape(k, d)
    t[:, 0] -= t[:, 0].mean()
    return t[:, 1:], t[:, 0]


def frame(spark, x, y):
    return spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "i long, a double, b double, c double, label double").repartition(5)


@pytest.mark.parametrize("balanced", [False, True])
def test_equals_a_plain_fit(spark, balanced, monkeypatch):
    monkeypatch.setattr(linear, "DRIVER_BYTES", 0 if balanced else 1 << 20)
    x, y = sample()
    model = linear.fit(frame(spark, x, y), ["a", "b", "c"], balanced=balanced)
    coef, intercept = plain(x, y, balanced)
    assert model.coef == pytest.approx(coef, abs=1e-6) and model.intercept - model.intercept.mean() == pytest.approx(intercept, abs=1e-6) and model.steps < 15
    ranks = {r["feature"]: r["rank"] for r in linear.importances(model, spark).collect()}
    assert [ranks[n] for n in "abc"] == [1, 2, 3]


def test_folds_in_one_pass_equal_fits_of_their_own(spark):
    x, y = sample(900)
    table = frame(spark, x, y)
    folds = F.filter(F.array(*map(F.lit, range(3))), lambda k: F.col("i") < (k + 1) * 250)
    models = linear.fit_folds(table, ["a", "b", "c"], folds=folds, n_folds=3)
    for k, m in models.items():
        n = (k + 1) * 250
        assert m.coef == pytest.approx(plain(x[:n], y[:n])[0], abs=1e-6)
    tail = table.filter("i >= 250").withColumn("fold", F.least(F.floor(F.col("i") / 250) - 1, F.lit(2)))
    got = {r["i"]: r for r in linear.predict_folds(models, tail, "fold", ["i"]).collect()}
    assert len(got) == 650
    for k, m in models.items():
        for r in linear.predict(m, tail.filter(F.col("fold") == k), ["i"]).collect():
            assert got[r["i"]]["prediction"] == r["prediction"] and got[r["i"]]["probability"] == pytest.approx(r["probability"])


def test_odd_tables(spark, tmp_path):
    x, y = sample(60)
    rows = [(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)] + [(None, 1.0, 1.0, 1.0), (1.0, 1.0, 1.0, None)]
    table = spark.createDataFrame(rows, "a double, b double, c double, label double").withColumn("same", F.lit(4.0))
    model = linear.fit(table, ["a", "b", "same"])
    assert model.coef[:, :2] == pytest.approx(plain(x[:, :2], y)[0], abs=1e-6) and model.coef[:, 2] == pytest.approx(0)
    linear.save(model, spark, str(tmp_path), "v1")
    other = linear.load(spark, str(tmp_path), "v1")
    assert other.features == model.features and other.coef == pytest.approx(model.coef, abs=0) and other.mean == pytest.approx(model.mean, abs=0)
    assert linear.fit_folds(table.limit(0), ["a"]) == {}
    split = spark.createDataFrame([(float(i), float(i > 5)) for i in range(12)], "a double, label double")  # classes that a line parts
    far = linear.fit(split, ["a"], c=1e6)
    assert np.isfinite(far.coef).all() and far.coef[1, 0] > 5

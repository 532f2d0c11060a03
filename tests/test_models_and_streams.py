"""Model fits against NumPy, p-values against tables, resamples against a plain loop, and live work over many micro-batches."""

import hashlib
import math
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tickloom import plans, streaming
from tickloom.sources import readers
from tickloom.operators import models, splits, stats
from tickloom.plans.live_queries import _LIVE, _by_drift, _vectors

SF = "/root/testdata/sf0.001"


def sample(n=600, seed=5):
    """Three classes by a noisy rule on a and b; c is noise."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1.0, 5.0, 0.1] + [0.0, 2.0, 1.0]
    signal = x[:, 0] + (x[:, 1] - 2) / 10 + rng.normal(size=n) * 0.2
    return x, np.digitize(signal, [-0.5, 0.5]).astype(float)


def frame(spark, x, y):
    return spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, label double")


@pytest.mark.parametrize("balanced", [False, True])
def test_logistic_equals_a_plain_fit(spark, balanced):
    x, y = sample()
    model = models.logistic(frame(spark, x, y), ["a", "b", "c"], balanced=balanced, iterations=200)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    hot = np.eye(3)[y.astype(int)]
    weight = (len(y) / (3 * hot.sum(0)))[y.astype(int)] if balanced else np.ones(len(y))
    coef, intercept, penalty = np.zeros((3, 3)), np.zeros(3), 1.0 / len(y)
    for _ in range(20_000):  # plain gradient descent on the same loss
        s = z @ coef.T + intercept
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = weight[:, None] * (p - hot) / weight.sum()
        coef -= 0.5 * (g.T @ z + penalty * coef)
        intercept -= 0.5 * g.sum(0)
    assert model.stages[-1].coefficientMatrix.toArray() == pytest.approx(coef, abs=0.02)
    ranks = {r["feature"]: r["rank"] for r in models.importances(model, ["a", "b", "c"]).collect()}
    assert [ranks[n] for n in "abc"] == [1, 2, 3]


def test_forest_finds_the_rule(spark):
    x, y = sample(1500)
    model = models.forest(frame(spark, x[:1000], y[:1000]), ["a", "b", "c"], trees=20, depth=6, least_leaf=5)
    out = models.predict(model, frame(spark, x[1000:], y[1000:]), ["a"]).collect()
    assert np.mean([r["prediction"] == r["label"] for r in out]) > 0.8
    assert all(sum(r["probability"]) == pytest.approx(1) for r in out)
    top = models.importances(model, ["a", "b", "c"]).orderBy("rank").collect()
    assert top[0]["feature"] == "a" and sum(r["importance"] for r in top) == pytest.approx(1)


def test_walk_forward_learns_from_the_train_rows_of_its_fold(spark):
    table = spark.range(400).select(F.lit("s").alias("symbol"), F.col("id").alias("time"), F.col("id").alias("usable_idx"), F.lit(400).alias("n_usable"), F.col("id").cast("double").alias("a"), F.pmod(F.col("id"), F.lit(3)).cast("double").alias("label"))
    folded = splits.folds(table, 100, 3, 4)
    seen = []

    def fit(train, names):
        seen.append(train.agg(F.max("time")).first()[0])
        return models.forest(train, names, trees=2, depth=2)

    oof = models.walk_forward(folded, ["a"], 3, {"m": fit})
    first = {r["fold_idx"]: r["t"] for r in oof.groupBy("fold_idx").agg(F.min("time").alias("t")).collect()}
    assert all(seen[k] == first[k] - 5 for k in range(3))
    got = {r["fold_idx"]: r for r in models.fold_metrics(oof).collect()}
    rows = oof.collect()
    before = None
    for k in range(3):
        mine = [r for r in rows if r["fold_idx"] == k]
        recall = [np.mean([r["prediction"] == c for r in mine if r["label"] == c]) for c in (0, 1, 2)]
        assert got[k]["n_rows"] == len(mine) and got[k]["balanced_accuracy"] == pytest.approx(np.mean(recall))
        assert got[k]["accuracy"] == pytest.approx(np.mean([r["prediction"] == r["label"] for r in mine]))
        assert got[k]["fall"] is None if k == 0 else got[k]["fall"] == pytest.approx(before - np.mean(recall))
        before = np.mean(recall)


def test_p_values(spark):
    """Critical values of t from tables, and of the binomial by counting."""
    cases = [(2.262, 10, 8, 10), (12.706, 2, 1, 2), (2.042, 31, 20, 30), (0.0, 5, 0, 0)]
    df = spark.createDataFrame([(i, t, n, up, moved) for i, (t, n, up, moved) in enumerate(cases)], "i int, t_statistic double, n long, n_positive long, n_moved long")
    out = {r["i"]: r for r in stats.with_p_values(df).collect()}
    assert [out[i]["p_value"] for i in range(3)] == pytest.approx([0.05] * 3, abs=2e-4) and out[3]["p_value"] == pytest.approx(1)
    for i, (_, _, up, moved) in enumerate(cases):
        tail = sum(math.comb(moved, k) for k in range(max(up, moved - up), moved + 1)) / 2**moved
        assert out[i]["sign_p_value"] == pytest.approx(min(1.0, 2 * tail))


def test_bootstrap_equals_a_plain_loop(spark, monkeypatch):
    values = [(k, float(k % 37 - 12) / 4) for k in range(150)] + [(900, None), (901, float("nan")), (902, -0.0)]
    monkeypatch.setattr(stats, "MEDIAN_RANGES", 8)
    got = {r["iteration"]: r for r in stats.bootstrap(spark.createDataFrame(values, "trade_id long, v double").repartition(3), "v", 200, 9).collect()}
    known = [v + 0.0 for _, v in values if v is not None and v == v]
    draws = {v: stats._poisson(9, v, known.count(v), 200) for v in set(known)}
    assert len(got) == 200
    for i, r in got.items():
        drawn = [v for v, d in draws.items() for _ in range(d[i])]
        assert (r["n_drawn"], r["total"], r["mean_value"], r["median_value"]) == pytest.approx((len(drawn), sum(drawn), np.mean(drawn), np.median(drawn)))


def test_bootstrap_spread_is_that_of_the_theory(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(2.0, 5.0, 800), 2)
    out = stats.bootstrap(spark.createDataFrame([(float(x),) for x in v], "v double"), "v", 4000).toPandas()
    assert out["mean_value"].std() == pytest.approx(v.std() / np.sqrt(800), rel=0.06) and out["mean_value"].mean() == pytest.approx(v.mean(), abs=0.02)
    assert out["n_drawn"].mean() == pytest.approx(800, abs=3) and out["n_drawn"].var() == pytest.approx(800, rel=0.12)
    summary = stats.bootstrap_summary(spark.createDataFrame(out)).first()
    low, high = v.mean() - 1.96 * v.std() / np.sqrt(800), v.mean() + 1.96 * v.std() / np.sqrt(800)
    assert (summary["mean_value_low"], summary["mean_value_high"]) == pytest.approx((low, high), abs=0.03) and summary["median_value_low"] < np.median(v) < summary["median_value_high"]
    none = stats.bootstrap(spark.createDataFrame([], "v double"), "v", 5).collect()
    assert len(none) == 5 and all(r["n_drawn"] == 0 and r["median_value"] is None for r in none)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The events in six files of growing time."""
    path = str(tmp_path_factory.mktemp("events") / "in")
    events = spark.read.parquet(f"{SF}/events.parquet")
    for k in range(6):
        events.filter(F.least(F.floor((F.dayofmonth("ts") - 1) / 5), F.lit(5)) == k).coalesce(1).write.mode("append").parquet(path)
    return path


def closed(spark, folder):
    return streaming.completed_bars(streaming.read_quotes(spark, folder, 1), "1 hour")


def test_live_features_over_batches_equal_one_batch(spark, folder):
    want = {(r["symbol"], r["time"]): r for r in plans.QUERIES["R03_live_features"](spark, SF).collect()}
    for history in (streaming.HISTORY, 120):
        got = streaming.live(closed(spark, folder), _vectors, history).collect()
        assert len(got) == len(want) and {r["status"] for r in got} == {"WARMUP", "OK"}
        for r in got:
            other = want[r["symbol"], r["time"]]
            assert r["status"] == other["status"]
            assert all(r[c] is other[c] or r[c] == pytest.approx(other[c], abs=1e-7) for c in _LIVE)


def test_calls(spark):
    rows = [("a", 0, "OK", 0.6, 0.3, 0.1), ("b", 0, "OK", 0.4, 0.4, 0.2), ("c", 0, "OK", 0.1, 0.3, 0.6), ("d", 0, "OK", 0.2, 0.5, 0.3), ("e", 0, "WARMUP", 0.9, 0.1, 0.0), ("f", 1000, "OK", 0.9, 0.1, 0.0)]
    df = spark.createDataFrame(rows, "symbol string, time long, status string, a double, b double, c double")
    out = streaming.with_calls(df, lambda x: x.withColumns({"p_short": F.col("a"), "p_neutral": F.col("b"), "p_long": F.col("c")}), 900, 900)
    got = {r["symbol"]: (r["action"], r["reason"]) for r in out.collect()}
    met, below = "CONFIDENCE_THRESHOLD_MET", "CONFIDENCE_BELOW_THRESHOLD"
    assert got == {"a": ("SELL", met), "b": ("NONE", below), "c": ("BUY", met), "d": ("NONE", "PREDICTED_NEUTRAL_HOLD"), "e": ("NONE", "WARMUP"), "f": ("NONE", "LOOKAHEAD")}
    assert streaming.with_calls(df.limit(0), _by_drift_like, 900, 900).count() == 0


def _by_drift_like(rows):
    return _by_drift(rows.withColumns({"return_mean_20": F.col("a"), "vol_std_20": F.col("b")})).drop("return_mean_20", "vol_std_20")


def test_vectors_with_missing_and_infinite_values(spark):
    bars = spark.createDataFrame([("s", 3600 * k, 1.0, 1.0, 1.0, 0.0 if k == 90 else 1.0 + (k % 3) / 10) for k in range(200)], "symbol string, time long, open double, high double, low double, close double")
    status = {r["time"] // 3600: r["status"] for r in _vectors(bars).collect()}
    assert {status[k] for k in range(80)} == {"WARMUP"} and status[80] == "OK" and status[91] in ("MISSING", "INFINITE") and status[199] == "OK"


def test_resumed_replay_over_files(spark, folder):
    want = sorted(map(tuple, streaming.replay(closed(spark, folder)).collect()))
    events = spark.read.parquet(folder)
    parts = [events.filter((F.dayofmonth("ts") > a) & (F.dayofmonth("ts") <= b)) for a, b in ((0, 9), (9, 20), (20, 31))]
    got = sorted(map(tuple, streaming.replay_in_parts(parts, lambda quotes: streaming.completed_bars(quotes, "1 hour")).collect()))
    assert got == want and len(got) > 0


def test_manifest(spark):
    for r in plans.QUERIES["S08_manifest"](spark, SF).collect():
        with open(f"{SF}/{r['name']}", "rb") as f:
            raw = f.read()
        assert (r["n_bytes"], r["sha256"]) == (len(raw), hashlib.sha256(raw).hexdigest())


def test_manifest_of_a_file_larger_than_an_array(spark, tmp_path):
    """A sparse file of 2 GB and 5 bytes takes no disk; names with blanks and escapes stay as they are."""
    for name, size in (("a b%20c.bin", (1 << 31) + 5), ("small.bin", 300)):
        with open(tmp_path / name, "wb") as f:
            f.truncate(size)
    got = {r["path"].rsplit("/", 1)[-1]: (r["n_bytes"], r["sha256"]) for r in readers.manifest(spark, str(tmp_path / "*.bin")).collect()}
    for name, size in (("a b%20c.bin", (1 << 31) + 5), ("small.bin", 300)):
        with open(tmp_path / name, "rb") as f:
            assert got.pop(name) == (size, hashlib.file_digest(f, "sha256").hexdigest())
    assert not got

"""Windows over points without pairs: against plain loops, with crowded cells, ties, missing values and long windows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import explore, frames, windows

POINT = "symbol string, time_msc long, event_id long, bid double"


def crowded(n, seed=1):
    """Points of two symbols, many at one instant, some without a value, a key or a time."""
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), rng.choice([7, rng.randrange(4000)]), i, rng.choice([None, *(1.0 + rng.randrange(60) / 100 for _ in range(9))])) for i in range(n)]
    return rows + [(None, 5, n, 1.2), ("a", None, n + 1, 1.3)]


def cut_small(monkeypatch, spark):
    """Several answers a task and Arrow batches smaller than a cell."""
    monkeypatch.setattr(windows, "BUFFER", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)


@pytest.fixture
def small(monkeypatch, spark):
    cut_small(monkeypatch, spark)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_first_touch_equals_a_plain_loop(spark, small):
    ticks = crowded(600)
    trades = [(s, i, t, None if v is None or i % 19 == 0 else v * 1.03, None if v is None else v * (1.04 if i % 11 == 0 else 0.97)) for s, t, i, v in ticks]
    got = explore.first_touch(spark.createDataFrame(trades, "symbol string, trade_id long, exit_msc long, target double, stop double"), spark.createDataFrame(ticks, POINT), 0.02, 300)
    want = {}
    for s, i, t, up, down in trades:
        want[i] = "NONE"
        for _, _, _, v in sorted((x for x in ticks if s is not None and t is not None and x[0] == s and x[1] is not None and t <= x[1] <= t + 1200), key=lambda x: (x[1], x[2])):
            if v is not None and up is not None and v >= up:
                want[i] = "TAKE_PROFIT"
            elif v is not None and down is not None and v <= down:
                want[i] = "STOP_LOSS"
            if want[i] != "NONE":
                break
    assert {r["trade_id"]: r["touch"] for r in got.collect()} == want and set(want.values()) == {"NONE", "TAKE_PROFIT", "STOP_LOSS"}


def test_first_outside_equals_a_plain_loop():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 64, 100):
        v = rng.integers(0, 50, n).astype(float)
        low, above, below = rng.integers(0, n + 1, 200), rng.integers(30, 60, 200).astype(float), rng.integers(-10, 20, 200).astype(float)
        got = windows.first_outside(windows.tree(v, np.maximum, -np.inf), windows.tree(v, np.minimum, np.inf), low, above, below)
        for i, a, b, place in zip(low, above, below, got, strict=True):
            want = [k for k in range(i, n) if v[k] >= a or v[k] <= b]
            assert place == want[0] if want else place >= n


def test_later_paths_make_no_pair_of_a_trade_and_a_tick(spark):
    """Ticks and trades of one instant: 20,000 each, with 400 million pairs."""
    ticks = spark.range(20_000).select(F.lit("a").alias("symbol"), F.lit(5).cast("long").alias("time_msc"), F.col("id").alias("event_id"), F.lit(1.0).alias("bid"))
    trades = ticks.select("symbol", F.col("event_id").alias("trade_id"), F.col("time_msc").alias("exit_msc"), F.lit(1.1).alias("target"), F.lit(0.9).alias("stop"))
    plan = explore.first_touch(trades, ticks, 60, 900_000)
    assert plan.groupBy("touch").count().collect() == [("NONE", 20_000)]
    assert "MapInArrow" in plan._jdf.queryExecution().toString()


def test_summed_windows_equal_a_plain_loop(spark, small):
    nan = float("nan")
    points = [(s, t, nan if i % 41 == 0 else v) for s, t, i, v in crowded(500, 2)]
    rng = random.Random(5)
    spans = [(rng.choice(["a", "b", "c", None]), i, a, a + rng.choice([-5, 0, 3, 300, 2500])) for i, a in enumerate(rng.randrange(-50, 4000) for _ in range(300))] + [("a", 300, None, 5)]
    made = windows.summed(spark.createDataFrame(points, "symbol string, at long, v double"), spark.createDataFrame(spans, "symbol string, id long, a long, b long"), ["symbol"], "at", "a", "b", 300, "v", ["symbol", "id"])
    assert "MapInArrow" in made._jdf.queryExecution().toString()
    got = {r["id"]: (r["n_points"], str(r["max_value"]), str(r["min_value"])) for r in made.collect()}
    want, place = {}, lambda v: (v != v, v)
    for s, i, a, b in spans:
        inside = [v for k, t, v in points if a is not None and s is not None and k == s and t is not None and a <= t <= b]
        if inside:
            some = [v for v in inside if v is not None]
            want[i] = (len(inside), str(max(some, key=place, default=None)), str(min(some, key=place, default=None)))
    assert got == want and any(w[1] == "nan" for w in want.values())


def test_end_ticks_equal_a_plain_loop(spark, small):
    points = [(s, t) for s, t, _, _ in crowded(500, 6)]
    rng = random.Random(7)
    spans = [(rng.choice(["a", "b", None]), i, a, a + rng.choice([-5, 0, 40, 300, 2500])) for i, a in enumerate(rng.randrange(-50, 4000) for _ in range(200))]
    made = windows.end_ticks(spark.createDataFrame(points, "symbol string, time_msc long"), spark.createDataFrame(spans, "symbol string, window_id long, window_start long, window_end long"), 60, 300)
    got = {r["window_id"]: (r["entry_ticks"], r["exit_ticks"]) for r in made.collect()}
    want = {}
    for s, i, a, b in spans:
        inside = [t for k, t in points if s is not None and k == s and t is not None and a <= t <= b]
        ends = (sum(t <= a + 60 for t in inside), sum(t >= b - 60 for t in inside))
        if any(ends):
            want[i] = ends
    assert got == want and len(want) > 60


def test_coverage_classes_make_no_pair_of_a_window_and_a_tick(spark):
    from tickloom import plans

    plan = plans.QUERIES["J11_coverage_class"](spark, "/root/testdata/sf0.001")
    assert "MapInArrow" in plan._jdf.queryExecution().toString()


def test_runs_of_ticks_do_not_depend_on_the_order_of_one_instant(spark):
    """The first tick after a gap may come after its twins: all of them belong to the new run."""
    rows = spark.createDataFrame([("a", 1, 0, 1), ("a", 9, 0, 2), ("a", 9, 1, 3), ("a", 9, 0, 4)], "symbol string, time_msc long, cut long, event_id long")
    made = frames.running_sum(rows.coalesce(1), ["symbol"], "time_msc", "cut", "island", 100)
    assert sorted((r["time_msc"], r["island"]) for r in made.collect()) == [(1, 0), (9, 1), (9, 1), (9, 1)]

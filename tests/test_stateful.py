"""Streams with keyed state: the machine's clock, restarts at any place, calls of a saved model, odd rows."""

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom import streaming
from tickloom.operators import features, linear
from tickloom.plans import stateful_queries
from tickloom.sources.adapters import bars
from tickloom.streaming import stateful

SF = "/root/testdata/sf0.001"
COLUMNS = ["ema_10", "ema_80", "rsi_14", "vol_std_20", "bars_since_last_gap", "ema_slope_10"]
BAR = stateful.BAR + ", arrival bigint, seen_at bigint"


def walk(n, seed=1):
    """Bars of two symbols with gaps, a price of zero and a missing spread."""
    import random

    rng = random.Random(seed)
    rows = []
    for s in "ab":
        p, t = 1.0, 0
        for k in range(n):
            t += 900 * rng.choice([1, 1, 1, 3])
            o, c = p, p + rng.gauss(0, 0.01)
            p = c
            if k == 120:
                o = c = 0.0
            rows.append((s, t, o, max(o, c), min(o, c), c, rng.randrange(1, 50), None if k == 50 else 2.0, t, t + 900))
    return rows


def as_map(rows):
    return {(r["symbol"], r["time"]): [r[c] for c in COLUMNS] for r in rows}


def same(a, b):
    return a.keys() == b.keys() and all(x == y or (x is not None and y is not None and abs(x - y) < 1e-9) for k in a for x, y in zip(a[k], b[k], strict=True))


def test_state_goes_on_wherever_the_stream_stopped(spark):
    table = spark.createDataFrame(walk(160), BAR)
    blocks = ["trend", "momentum", "volatility", "gaps"]
    want = as_map(features.build(table, blocks).select("symbol", "time", *COLUMNS).collect())
    for cuts in ((), (3_000, 100_000, 101_000)):
        parts = stateful_queries.dealt(table, F.col("time"), cuts) if cuts else [table]
        folder = stateful.in_parts(parts, lambda stream, folder: stateful.live_features(stream, folder, blocks, COLUMNS, 900))
        got = spark.read.parquet(f"{folder}/out/*").collect()
        assert same(as_map(got), want) and len(got) == len(want) == 320
        assert stateful.read(spark, f"{folder}/refused/*", "symbol string, reason string").count() == 0


def test_refusals_follow_the_order_of_arrival(spark):
    rows = [("a", 900 * t, 1.0, 2.0, 0.5, 1.5, 1, 1.0, n, at) for n, (t, at) in enumerate([(1, 1800), (2, 2699), (2, 2700), (1, 9000), (4, 9000), (3, 9000), (4, 9000)])]
    rows += [("a", 900 * 9, 1.0, 0.9, 0.5, 0.8, 1, 1.0, 50, 90_000), ("b", 900, 1.0, 2.0, 0.5, 1.5, 1, 1.0, 0, 1800)]
    table = spark.createDataFrame(rows, BAR)
    for cut in (100, 4):
        parts = [table.filter(F.col("arrival") < cut), table.filter(F.col("arrival") >= cut)]
        folder = stateful.in_parts(parts, lambda stream, folder: stateful.live_features(stream, folder, ["price"], ["return_1"], 900))
        refused = sorted((r["symbol"], r["time"] // 900, r["reason"]) for r in spark.read.parquet(f"{folder}/refused/*").collect())
        assert refused == [("a", 1, "DUPLICATE"), ("a", 2, "INCOMPLETE"), ("a", 3, "REGRESSION"), ("a", 4, "DUPLICATE"), ("a", 9, "BAD_OHLC")]
        assert sorted((r["symbol"], r["time"] // 900) for r in spark.read.parquet(f"{folder}/out/*").collect()) == [("a", 1), ("a", 2), ("a", 4), ("b", 1)]


def test_a_feed_that_stops_is_told_by_the_machines_clock(spark):
    folder = streaming.shared_folder(spark)
    quotes = "symbol string, ts timestamp, time_msc bigint"
    spark.createDataFrame([("a", None, 1000), ("a", None, 2000), ("b", None, 5000)], quotes).write.parquet(f"{folder}/in")
    events = stateful.silent_feeds(spark.readStream.schema(quotes).parquet(f"{folder}/in"), 3000, watermark=None)
    query = events.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime="500 milliseconds").start()
    found = lambda: sorted((r["symbol"], r["kind"], r["last_msc"]) for r in stateful.read(spark, f"{folder}/out/*.parquet", stateful.FEED).collect())
    try:
        until = time.time() + 60
        while len(found()) < 2 and time.time() < until:
            time.sleep(1)
        assert found() == [("a", "STALE", 2000), ("b", "STALE", 5000)]
        spark.createDataFrame([("a", None, 9000)], quotes).write.mode("append").parquet(f"{folder}/in")
        while len(found()) < 4 and time.time() < until:
            time.sleep(1)
        assert found() == [("a", "RESUMED", 2000), ("a", "STALE", 2000), ("a", "STALE", 9000), ("b", "STALE", 5000)]
    finally:
        query.stop()


def test_calls_of_a_saved_model_equal_those_of_the_table(spark, monkeypatch):
    kept = {}
    fitted = stateful_queries.fitted
    monkeypatch.setattr(stateful_queries, "fitted", lambda *a: kept.setdefault("folder", fitted(*a)))
    got = {(r["symbol"], r["time"]): r for r in stateful_queries.r04_model(spark, SF).collect()}
    vectors = streaming.with_features(bars(spark, SF, 3600), stateful_queries._BLOCKS, stateful_queries._INPUTS)
    at = stateful_queries.CUTS[2] + 36_000
    want = streaming.with_calls(vectors, stateful_queries.scored_by(kept["folder"], "v1"), 3600, at).collect()
    assert len(want) == len(got) and {r["action"] for r in want} == {"BUY", "SELL", "NONE"}
    for r in want:
        other = got[r["symbol"], r["time"]]
        assert (r["action"], r["reason"]) == (other["action"], other["reason"]) and r["confidence"] == pytest.approx(other["confidence"], abs=1e-9)
    assert linear.load(spark, kept["folder"], "v1").features == stateful_queries._INPUTS


def test_a_key_is_forgotten_after_its_time(spark):
    requests = spark.createDataFrame([("k", 1), ("k", 2), (None, 3), (None, 4)], "key string, request_id long")
    folder = stateful.in_parts([requests, requests.filter("request_id = 2")], lambda stream, folder: stateful.run(stateful.flagged_requests(stream), folder))
    got = sorted((str(r["key"]), r["request_id"], r["n_before"]) for r in spark.read.parquet(f"{folder}/out").collect())
    assert got == [("None", 3, 0), ("None", 4, 1), ("k", 1, 0), ("k", 2, 1), ("k", 2, 2)]


class _Handle:
    """Values of one bucket's state, as a processor sees them."""

    def __init__(self):
        self.value = None

    def getValueState(self, *_):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class _Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


def _calls(processor, *batches, handle=None):
    """What calls for one bucket give, batch after batch; each batch comes in two pieces."""
    processor.init(handle or _Handle())
    return [[tuple(r) for out in processor.handleInputRows((7,), iter([b.iloc[::2], b.iloc[1::2]]), clock) for r in out.astype(object).itertuples(index=False)] for b, clock in batches]


def test_one_call_serves_all_keys_of_a_bucket():
    frame = lambda rows: pd.DataFrame(rows, columns=["key", "request_id"])
    first, second = frame([("a", 2), (None, 3), ("b", 1), ("a", 1), (None, 9)]), frame([("c", 12), ("b", 11), (None, 13), ("a", 10)])
    got = _calls(stateful.SeenKeys(None), (first, None), (second, None))
    assert sorted(got[0], key=str) == sorted([("a", 1, 0, False), ("a", 2, 1, True), ("b", 1, 0, False), (None, 3, 0, False), (None, 9, 1, True)], key=str)
    assert sorted(got[1], key=str) == sorted([("a", 10, 2, True), ("b", 11, 1, True), ("c", 12, 0, False), (None, 13, 2, True)], key=str)


def test_each_key_of_a_bucket_has_its_own_time():
    frame = lambda *rows: pd.DataFrame(rows, columns=["key", "request_id"])
    batches = [(frame(("a", 1), ("b", 2)), _Clock(1000)), (frame(("b", 3)), _Clock(1090)), (frame(("a", 4), ("b", 5)), _Clock(1100))]
    assert [[r[2] for r in out] for out in _calls(stateful.SeenKeys(100), *batches)] == [[0, 0], [1], [0, 2]]


def test_peaks_of_all_accounts_of_a_bucket_equal_a_plain_loop():
    import random

    rng = random.Random(4)
    names = ["1", "22", None, str(2**60 + 1)]
    rows = [(rng.choice(names), at, at * 10 + k, rng.choice([None, *(float(rng.randrange(80, 120)) for _ in range(9))])) for at in range(60) for k in range(5)]
    frames = [pd.DataFrame(rows[a:b], columns=["account", "at", "snapshot_id", "equity"]) for a, b in ((0, 1), (1, 150), (150, 300))]
    got = [r for out in _calls(stateful.EquityPeaks(5.0), *((f.sample(frac=1, random_state=1), None) for f in frames)) for r in out]
    want, peaks, alerted = [], {}, {}
    for account, _, snapshot, equity in rows:
        if equity is None:
            alerted[account] = False
            continue
        top = peaks[account] = max(peaks.get(account, equity), equity)
        fall = (top - equity) * 100.0 / top
        if (fall > 5.0) != alerted.get(account, False):
            want.append((None if account is None else int(account), snapshot, top, fall, "ALERT" if fall > 5.0 else "RECOVERED"))
        alerted[account] = fall > 5.0
    assert sorted(((None if pd.isna(r[0]) else r[0], *r[1:]) for r in got), key=str) == sorted(want, key=str) and len(want) > 50

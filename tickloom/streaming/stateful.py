"""Streams with keyed state: live bars with carried filters, silent feeds by timers, peaks of equity, keys seen before, late ticks.

Each processor keeps a small state of fixed size for each key (or one that a time to live bounds) in RocksDB, so that a
stream goes on where it stopped after a restart. What they give leaves in Structured Streaming's append mode; functions
that write several sinks do so in `foreachBatch`, in folders named by the batch, so that a batch that runs again
overwrites its own rows and each row counts once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tickloom.operators import features
from tickloom.streaming import HISTORY, WARMUP, checked, shared_folder

_PROVIDER, _ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed(stream: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, clock: str = "None") -> DataFrame:
    """The stream through a processor for each key. State with timers and lists needs RocksDB, which is set for streams that start from here on."""
    stream.sparkSession.conf.set(_PROVIDER, _ROCKSDB)
    return stream.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", clock)


def run(result: DataFrame, folder: str, step: Callable[[DataFrame, int], None] | None = None) -> None:
    """Runs a stream over what is there, from its checkpoint in `folder` on; appends Parquet to `folder`/out, or calls `step`."""
    writer = result.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    writer = writer.format("parquet").option("path", f"{folder}/out") if step is None else writer.foreachBatch(step)
    writer.start().awaitTermination()


def in_parts(parts: list[DataFrame], process: Callable[[DataFrame, str], None]) -> str:
    """Parts of a table arrive one after another; after each, `process` resumes its stream and runs it to the end. Gives the folder."""
    spark = parts[0].sparkSession
    folder = shared_folder(spark)
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        process(spark.readStream.schema(part.schema).parquet(f"{folder}/in"), folder)
    return folder


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """What a sink holds; nothing if no batch has written."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(jvm)
    return spark.read.schema(schema).parquet(path) if found else spark.createDataFrame([], schema)


def _seen(rows: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(list(order), kind="stable")


#: Columns of a live bar, and the recursive filters that the state carries from bar to bar.
BAR = "symbol string, time bigint, open double, high double, low double, close double, tick_volume bigint, spread double"
FILTERS = [*(f"ema_{s}" for s in features.SPANS), "gain_14", "loss_14", "wilder_range_14"]
_NUMBERS = ["open", "high", "low", "close", "spread", *FILTERS]
_HELD = "time bigint, tick_volume bigint, bar_idx bigint, " + ", ".join(f"{c} double" for c in _NUMBERS)
LIVE = f"symbol string, {_HELD}, is_new boolean, reason string"


class LiveBars(StatefulProcessor):
    """Takes each symbol's bars in the order of their arrival and carries the filters on.

    Gives the accepted bars with their index and filters, the newest `held` ones before them (is_new false), and the
    refused ones with a reason: INCOMPLETE (still forming when it was seen), DUPLICATE (held already), REGRESSION (not
    newer than the last one) or BAD_OHLC.
    """

    def __init__(self, step: int, held: int = HISTORY) -> None:
        self.step, self.held = step, held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bars = handle.getListState("bars", _HELD)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _HELD.split(", ")]
        held = [dict(zip(names, r, strict=True)) for r in self.bars.get()]
        before = len(held)
        refused, times = [], {b["time"] for b in held}
        for bar in _seen(rows, "arrival").to_dict("records"):
            reason = self._refusal(bar, times, held)
            if reason is None:
                held.append(self._carried(bar, held[-1] if held else None))
                times.add(bar["time"])
                if len(held) > self.held:
                    times.discard(held[-self.held - 1]["time"])
            else:
                refused.append({**bar, "reason": reason, "is_new": True, "bar_idx": None})
        if len(held) > before:
            self.bars.put([tuple(b[c] for c in names) for b in held[-self.held :]])
        out = [{**b, "is_new": i >= before, "reason": None} for i, b in enumerate(held)] if len(held) > before else []
        columns = [c.split()[0] for c in LIVE.split(", ")]
        made = pd.DataFrame(out + refused, columns=columns).assign(symbol=key[0])
        yield made.astype({"time": "Int64", "tick_volume": "Int64", "bar_idx": "Int64", "is_new": bool, **dict.fromkeys(_NUMBERS, "float64")})

    def _refusal(self, bar: dict, times: set[int], held: list[dict]) -> str | None:
        if bar["time"] + self.step > bar["seen_at"]:
            return "INCOMPLETE"
        if bar["time"] in times:
            return "DUPLICATE"
        if held and bar["time"] <= held[-1]["time"]:
            return "REGRESSION"
        sound = bar["low"] <= bar["open"] <= bar["high"] and bar["low"] <= bar["close"] <= bar["high"]
        return None if sound else "BAD_OHLC"

    @staticmethod
    def _carried(bar: dict, last: dict | None) -> dict:
        """The bar with its index and filters; a price of zero counts as missing, as in features of a table."""
        known = lambda x: None if x is None or x == 0 or math.isnan(x) else x
        close, high, low, before = known(bar["close"]), known(bar["high"]), known(bar["low"]), known(last["close"]) if last else None
        change = 0.0 if close is None or before is None else close - before
        spans = [high - low if high is not None and low is not None else None, *(abs(x - before) for x in (high, low) if x is not None and before is not None)]
        index = last["bar_idx"] + 1 if last else 0
        values = {f"ema_{s}": (close or 0.0, 2.0 / (s + 1), 0) for s in features.SPANS}
        values |= {n: (max(v, 0.0), 1.0 / features.WILDER, 1) for n, v in (("gain_14", change), ("loss_14", -change))}
        values["wilder_range_14"] = (max((x for x in spans if x is not None), default=0.0), 1.0 / features.WILDER, 0)
        out = {**bar, "bar_idx": index}
        for name, (x, alpha, first) in values.items():
            out[name] = None if index < first else x if index == first else alpha * x + (1.0 - alpha) * last[name]
        return out


def live_bars(stream: DataFrame, step: int) -> DataFrame:
    """`stream` has the columns of BAR, arrival (a number that grows) and seen_at (epoch seconds)."""
    return keyed(stream, ["symbol"], LiveBars(step), LIVE)


def live_features(stream: DataFrame, folder: str, names: list[str], columns: list[str], step: int, then: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """One stream, two sinks: features of accepted bars with their status in out/, refused bars in refused/.

    Frames reach into the held bars, filters into the carried state, so that all features equal those of the table,
    however the bars are dealt into micro-batches and restarts. `then` maps the features (R04).
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/seen/{number}")
        seen = batch.sparkSession.read.schema(LIVE).parquet(f"{folder}/seen/{number}")
        seen.filter("reason is not null").select("symbol", "time", "open", "high", "low", "close", "reason").write.mode("overwrite").parquet(f"{folder}/refused/{number}")
        start = features.without_zeros(seen.filter("reason is null"))
        new = start.filter("is_new").select("symbol", "time")
        made = checked(features.assemble(start, names).select("symbol", "time", "bar_idx", *columns), columns, WARMUP)
        made = made.join(new, ["symbol", "time"], "left_semi")
        (then(made) if then else made).write.mode("overwrite").parquet(f"{folder}/out/{number}")

    run(live_bars(stream, step), folder, write)


FEED = "symbol string, kind string, last_msc bigint, at_msc bigint"


class SilentFeeds(StatefulProcessor):
    """STALE once a feed has been silent for `limit` ms, by a timer without a new tick; RESUMED with its next tick.

    The clock is that of the ticks (event time: the watermark) or of the machine (processing time). A silence that new
    ticks show to be over gives both rows at once, so that event-time results don't depend on the micro-batches.
    """

    def __init__(self, limit: int, machine: bool = False) -> None:
        self.limit, self.machine = limit, machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "time_msc bigint, told boolean, due bigint")

    def close(self) -> None:
        pass

    def _rows(self, key, events: list[tuple[str, int, int]]) -> pd.DataFrame:
        made = pd.DataFrame(events, columns=["kind", "last_msc", "at_msc"]).astype({"last_msc": "int64", "at_msc": "int64"})
        made.insert(0, "symbol", key[0])
        return made

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, told, due = self.last.get() if self.last.exists() else (None, False, None)
        events = []
        for t in _seen(rows, "time_msc")["time_msc"].tolist():
            if last is not None and t <= last:
                continue
            if told:
                events.append(("RESUMED", last, t))
            elif last is not None and t - last > self.limit and not self.machine:
                events += [("STALE", last, last + self.limit), ("RESUMED", last, t)]
            last, told = t, False
        if due is not None:
            self.handle.deleteTimer(due)
        due = (timerValues.getCurrentProcessingTimeInMs() if self.machine else last) + self.limit
        self.handle.registerTimer(due)
        self.last.update((last, False, due))
        yield self._rows(key, events)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, _, due = self.last.get()
        self.last.update((last, True, None))
        yield self._rows(key, [("STALE", last, due)])


def silent_feeds(quotes: DataFrame, limit: int, watermark: str | None = "1 day") -> DataFrame:
    """Events of feeds (symbol, ts, time_msc), on the ticks' clock, or on the machine's if there is no watermark."""
    if watermark is None:
        return keyed(quotes, ["symbol"], SilentFeeds(limit, machine=True), FEED, "ProcessingTime")
    return keyed(quotes.withWatermark("ts", watermark), ["symbol"], SilentFeeds(limit), FEED, "EventTime")


ALERT = "account bigint, snapshot_id bigint, peak double, drawdown_pct double, kind string"


#: State buckets of `bucketed` streams. Part of a checkpoint: a stream goes on only with the number it started with.
BUCKETS = 1 << 11


def bucketed(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str, clock: str = "None") -> DataFrame:
    """`keyed` by hash buckets of a key with many values, so that a call of the processor serves all keys of a bucket at once."""
    return keyed(stream.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS))), ["_bucket"], processor, schema, clock)


class _Buckets(StatefulProcessor):
    """Holds a small table (a row for each key) for each bucket, in one value as Arrow bytes: read once and written once a micro-batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.table = handle.getValueState("table", "rows binary")

    def close(self) -> None:
        pass

    def _held(self, columns: list[str]) -> pd.DataFrame:
        return pa.ipc.open_stream(self.table.get()[0]).read_pandas() if self.table.exists() else pd.DataFrame({c: [] for c in columns})

    def _hold(self, table: pd.DataFrame) -> None:
        batch = pa.RecordBatch.from_pandas(table, preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as writer:
            writer.write_batch(batch)
        self.table.update((sink.getvalue().to_pybytes(),))


class EquityPeaks(_Buckets):
    """The peak of each account in state; one row when the fall passes the limit, one when it is within it again."""

    def __init__(self, limit_pct: float) -> None:
        self.limit_pct = limit_pct

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, seen = self._held(["account", "peak", "alerted"]), _seen(rows, "account", "at", "snapshot_id")
        codes, accounts = pd.factorize(np.concatenate([held["account"].to_numpy(object), seen["account"].to_numpy(object)]), use_na_sentinel=False)
        known, mine = codes[: len(held)], codes[len(held) :]
        peak, alerted = np.full(len(accounts), np.nan), np.zeros(len(accounts), bool)
        peak[known], alerted[known] = held["peak"], held["alerted"]
        equity = seen["equity"].to_numpy("float64")
        top = np.fmax(pd.Series(equity).groupby(mine).cummax().groupby(mine).ffill().to_numpy(), peak[mine])
        fall = np.divide((top - equity) * 100.0, top, out=np.zeros(len(top)), where=top != 0)
        past = fall > self.limit_pct
        first, last = np.diff(mine, prepend=-1) != 0, np.diff(mine, append=-1) != 0
        crossed = (past != np.where(first, alerted[mine], np.roll(past, 1))) & ~np.isnan(fall)  # a missing equity crosses nothing
        peak[mine[last]], alerted[mine[last]] = top[last], past[last]
        self._hold(pd.DataFrame({"account": accounts, "peak": peak, "alerted": alerted}))
        kind = np.where(past, "ALERT", "RECOVERED")
        number = pa.array(accounts, "string", from_pandas=True).cast("int64").to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        yield pd.DataFrame({"account": number.array[mine], "snapshot_id": seen["snapshot_id"].to_numpy(), "peak": top, "drawdown_pct": fall, "kind": kind})[crossed]


def equity_alerts(snapshots: DataFrame, limit_pct: float) -> DataFrame:
    """Crossings of the limit; `snapshots` has account, snapshot_id, at (orders the rows) and equity, in time order over micro-batches."""
    texts = snapshots.withColumn("account", F.col("account").cast("string"))  # whole numbers beside a null would lose digits in pandas
    return bucketed(texts, "account", EquityPeaks(limit_pct), ALERT)


class SeenKeys(_Buckets):
    """How many requests with the key there were before each one; a key is forgotten `ttl` ms after its last request."""

    def __init__(self, ttl: int | None) -> None:
        self.ttl = ttl

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, seen = self._held(["key", "n", "last"]), _seen(rows, "request_id")
        now = 0 if self.ttl is None else timerValues.getCurrentProcessingTimeInMs()
        if self.ttl is not None:
            held = held[held["last"] + self.ttl > now]
        codes, keys = pd.factorize(np.concatenate([held["key"].to_numpy(object), seen["key"].to_numpy(object)]), use_na_sentinel=False)
        known, mine = codes[: len(held)], codes[len(held) :]
        n, last = np.zeros(len(keys), "int64"), np.full(len(keys), now, "int64")
        n[known], last[known] = held["n"], held["last"]
        last[mine] = now
        before = n[mine] + pd.Series(mine).groupby(mine).cumcount().to_numpy()
        self._hold(pd.DataFrame({"key": keys, "n": n + np.bincount(mine, minlength=len(keys)), "last": last}))
        yield pd.DataFrame({"key": seen["key"].to_numpy(), "request_id": seen["request_id"].to_numpy(), "n_before": before, "is_replay": before > 0})


def flagged_requests(requests: DataFrame, ttl: int | None = None) -> DataFrame:
    """Every request (key, request_id) with a flag: the first of its key is processed, later ones are replays.

    A time to live is told by the machine's clock; such a stream needs a trigger that goes on, as `availableNow` would not end.
    """
    clock = "None" if ttl is None else "ProcessingTime"
    return bucketed(requests.select("key", "request_id"), "key", SeenKeys(ttl), "key string, request_id bigint, n_before bigint, is_replay boolean", clock)


TICK_BAR = "symbol string, kind string, time bigint, open double, high double, low double, close double, tick_volume bigint"


class TickBars(StatefulProcessor):
    """Tumbling bars, given once, when the symbol's newest tick is `delay` seconds past their end; later ticks are counted.

    A late tick adds to the LATE row of its bar in the micro-batch that brings it, so each counts once.
    """

    def __init__(self, width: int, delay: int) -> None:
        self.width, self.delay = width, delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "time_msc bigint")
        self.open = handle.getMapState("open", "time bigint", "first bigint, open double, high double, low double, last bigint, close double, n bigint")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = _seen(rows, "event_id")
        bar = seen["time_msc"] // (self.width * 1000) * self.width
        done = self.newest.get()[0] - self.delay * 1000 if self.newest.exists() else None
        late = bar.map(lambda t: done is not None and (t + self.width) * 1000 <= done)
        out = [(key[0], "LATE", t, None, None, None, None, n) for t, n in bar[late].value_counts().sort_index().items()]
        some = seen[~late].assign(bar=bar[~late])
        for t, g in some.groupby("bar"):
            own = (int(g["event_id"].iloc[0]), float(g["bid"].iloc[0]), float(g["bid"].max()), float(g["bid"].min()), int(g["event_id"].iloc[-1]), float(g["bid"].iloc[-1]), len(g))
            self.open.updateValue((int(t),), self._merged(self.open.getValue((int(t),)), own) if self.open.containsKey((int(t),)) else own)
        newest = max(int(seen["time_msc"].max()), self.newest.get()[0] if self.newest.exists() else 0)
        self.newest.update((newest,))
        for (t,), b in list(self.open.iterator()):
            if (t + self.width) * 1000 <= newest - self.delay * 1000:
                out.append((key[0], "BAR", t, b[1], b[2], b[3], b[5], b[6]))
                self.open.removeKey((t,))
        columns = [c.split()[0] for c in TICK_BAR.split(", ")]
        yield pd.DataFrame(out, columns=columns).astype({"time": "int64", "tick_volume": "int64", **dict.fromkeys(("open", "high", "low", "close"), "float64")})

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        first, last = min(a, b, key=lambda x: x[0]), max(a, b, key=lambda x: x[4])
        return first[0], first[1], max(a[2], b[2]), min(a[3], b[3]), last[4], last[5], a[6] + b[6]


def tick_bars(quotes: DataFrame, width: int, delay: int) -> DataFrame:
    """Completed bars and counts of late ticks; `quotes` has symbol, event_id, time_msc and bid."""
    return keyed(quotes, ["symbol"], TickBars(width, delay), TICK_BAR)


def with_slow_values(bars: DataFrame, slow: DataFrame, columns: list[str], tolerance_days: int) -> DataFrame:
    """Live bars (symbol, time) with the slow table's last values of a day before theirs, at most `tolerance_days` old.

    A Monday's bar takes Friday's value; a missing value carries the one before it. Each slow value is spread over the
    days that may take it and the newest stays, so that bars meet their day's row in a join on the day, without a window
    over either side. Spark reads the slow table anew for each micro-batch.
    """
    out = bars.withColumn("_day", F.unix_date(F.timestamp_seconds("time").cast("date")) - 1)
    for c in columns:
        spread = slow.filter(F.col(c).isNotNull()).select(F.unix_date("day").alias("_at"), F.explode(F.sequence(F.lit(0), F.lit(tolerance_days))).alias("_age"), c)
        daily = spread.groupBy((F.col("_at") + F.col("_age")).alias("_day")).agg(F.min_by(c, "_age").alias(c))
        out = out.join(daily, "_day", "left")
    return out.drop("_day")

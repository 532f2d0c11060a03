"""Queries of streams with keyed state, run over several micro-batches with restarts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import streaming
from tickloom.operators import features, labels, linear
from tickloom.plans import sql as q
from tickloom.plans.catalog import query, rounded
from tickloom.plans.feature_queries import ACTIVITY, GAPS, MOMENTUM, TREND, VOLATILITY, digits_of, round_all, staged
from tickloom.plans.job_queries import SHIFT
from tickloom.sources.adapters import H1, bars, exo_daily, ticks
from tickloom.streaming import WARMUP, stateful

#: Starts of the parts in which January 2024 arrives.
CUTS = (1_704_700_000, 1_705_500_000, 1_706_000_000)
_ALL = TREND | MOMENTUM | VOLATILITY | ACTIVITY | GAPS


def dealt(df, time, cuts=CUTS):
    """The table in parts of growing time."""
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= time))
    return [df.filter(part == k) for k in range(len(cuts) + 1)]


def _arrivals(spark, sf_dir):
    """Bars of an hour as they arrive: some while they form, some twice, some too late, some with a broken box."""
    b = bars(spark, sf_dir, H1)
    step = F.col("time") / H1
    b = b.select("symbol", "time", "open", "high", "low", "close", "tick_volume", "spread")
    whole = b.withColumns({"arrival": F.col("time") * 10 + 5, "seen_at": F.col("time") + H1})
    forming = b.filter(step % 7 == 0).withColumns({"close": F.col("open"), "arrival": F.col("time") * 10 + 1, "seen_at": F.col("time") + H1 - 1})
    again = b.filter(step % 11 == 0).withColumns({"arrival": F.col("time") * 10 + 6, "seen_at": F.col("time") + 2 * H1})
    broken = b.filter(step % 13 == 0).select("symbol", (F.col("time") + 1).alias("time"), "open", "high", (F.col("high") + 1.0).alias("low"), "close", "tick_volume", "spread", (F.col("time") * 10 + 7).alias("arrival"), (F.col("time") + 2 * H1).alias("seen_at"))
    old = b.filter(step % 17 == 0).select("symbol", (F.col("time") - 10).alias("time"), "open", "high", "low", "close", "tick_volume", "spread", (F.col("time") * 10 + 8).alias("arrival"), (F.col("time") + 2 * H1).alias("seen_at"))
    return whole.unionByName(forming).unionByName(again).unionByName(broken).unionByName(old)


_BLOCKS = ["trend", "momentum", "volatility", "activity", "gaps"]
_MISSING = " OR ".join(f"{n} IS NULL" for n in _ALL)


def _live(spark, sf_dir):
    parts = dealt(_arrivals(spark, sf_dir), F.col("time"))
    return stateful.in_parts(parts, lambda stream, folder: stateful.live_features(stream, folder, _BLOCKS, list(_ALL), H1))


@query(
    "R03_live_state",
    f"{staged(H1)}, f AS (SELECT symbol, time, i, {', '.join(f'{x} AS {n}' for n, x in _ALL.items())} FROM f1) SELECT symbol, time, CASE WHEN i + 1 < {WARMUP} THEN 'WARMUP' WHEN {_MISSING} THEN 'MISSING' ELSE 'OK' END AS status, {', '.join(q.rounded([n], digits_of(n)) for n in _ALL)} FROM f",
)
def r03_state(spark, sf_dir):
    """All of W01-W05 on bars that arrive in four parts; the stream stops after each and goes on from its state."""
    folder = _live(spark, sf_dir)
    return round_all(spark.read.parquet(f"{folder}/out/*"))


_INPUTS = ["roc_5", "rsi_14", "vol_std_20", "tick_vol_ratio_20"]
_MODEL_AT = CUTS[1]


def scored_by(path: str, version: str):
    """Maps rows with features to rows with p_short, p_neutral and p_long by a saved model, which each micro-batch loads."""

    def score(rows):
        p = linear.load(rows.sparkSession, path, version).probabilities()
        return rows.withColumn("_p", p).select("*", *(F.get("_p", F.lit(k)).alias(f"p_{c}") for k, c in enumerate(("short", "neutral", "long")))).drop("_p")

    return score


def fitted(spark, sf_dir):
    """A model of the direction after four bars, fitted on the bars before the second cut, under a version in the shared folder."""
    b = bars(spark, sf_dir, H1)
    x = features.build(b, _BLOCKS).select("symbol", "time", *_INPUTS)
    y = labels.label(b, labels.directions).select("symbol", "time", (F.col("direction_4") + 1.0).alias("label"))
    train = streaming.stored(x.join(y, ["symbol", "time"]).filter(F.col("time") + 4 * H1 < _MODEL_AT))
    folder = streaming.shared_folder(spark)
    linear.save(linear.fit(train, _INPUTS), spark, folder, "v1")
    return folder


@query("R04_calls_of_a_fitted_model")
def r04_model(spark, sf_dir):
    """Rows only (a test holds them against the calls of the table): a saved model on bars that arrive in parts."""
    models = fitted(spark, sf_dir)
    parts = dealt(_arrivals(spark, sf_dir), F.col("time"))
    then = lambda rows: streaming.with_calls(rows, scored_by(models, "v1"), H1, CUTS[2] + 10 * H1)
    folder = stateful.in_parts(parts, lambda stream, folder: stateful.live_features(stream, folder, _BLOCKS, _INPUTS, H1, then))
    return spark.read.parquet(f"{folder}/out/*").select("symbol", "time", "action", "reason", "confidence")


@query(
    "R01_refused_bars",
    f"{q.bars_with(H1)} SELECT symbol, time, 'INCOMPLETE' AS reason FROM bars WHERE time//{H1} % 7 = 0 UNION ALL SELECT symbol, time, 'DUPLICATE' FROM bars WHERE time//{H1} % 11 = 0 UNION ALL SELECT symbol, time + 1, 'BAD_OHLC' FROM bars WHERE time//{H1} % 13 = 0 UNION ALL SELECT symbol, time - 10, 'REGRESSION' FROM bars WHERE time//{H1} % 17 = 0",
)
def r01_refused(spark, sf_dir):
    """The other sink of the same stream: each refused bar once, with its reason."""
    return spark.read.parquet(f"{_live(spark, sf_dir)}/refused/*").select("symbol", "time", "reason")


_LIMIT, _DELAY = 3_600_000, 86_400_000  # an hour of silence; the watermark's day


@query(
    "R05_silent_feeds",
    f"WITH {q.TICKS}, t AS (SELECT symbol, time_msc, lead(time_msc) OVER (PARTITION BY symbol ORDER BY time_msc) AS next_msc FROM (SELECT DISTINCT symbol, time_msc FROM ticks)), w AS (SELECT max(time_msc) - {_DELAY} AS mark FROM ticks) "
    f"SELECT symbol, 'STALE' AS kind, time_msc AS last_msc, time_msc + {_LIMIT} AS at_msc FROM t, w WHERE next_msc - time_msc > {_LIMIT} OR (next_msc IS NULL AND time_msc + {_LIMIT} <= mark) UNION ALL SELECT symbol, 'RESUMED', time_msc, next_msc FROM t WHERE next_msc - time_msc > {_LIMIT}",
)
def r05_silent(spark, sf_dir):
    """An hour without a tick, over four parts and restarts."""
    quotes = ticks(spark, sf_dir).select("symbol", "ts", "time_msc")
    parts = dealt(quotes, F.floor(F.col("time_msc") / 1000))
    folder = stateful.in_parts(parts, lambda stream, folder: stateful.run(stateful.silent_feeds(stream, _LIMIT), folder))
    return spark.read.schema(stateful.FEED).parquet(f"{folder}/out")


_SEC = "time_msc//1000"


@query(
    "R02_late_ticks",
    f"WITH {q.TICKS}, a AS (SELECT *, time_msc//1000 >= {CUTS[1]} OR event_id % 50 <> 0 AS early FROM ticks), b AS (SELECT *, CAST(floor(time_msc/3600000.0) AS BIGINT)*3600 AS time FROM a), m AS (SELECT symbol, max(time_msc) AS newest, max(CASE WHEN {_SEC} < {CUTS[1]} AND early THEN time_msc END) AS before FROM a GROUP BY 1), "
    f"k AS (SELECT b.*, newest, NOT early AND (time+3600)*1000 <= before - 3600000 AS late FROM b JOIN m USING (symbol)) "
    "SELECT symbol, 'LATE' AS kind, time, NULL::DOUBLE AS open, NULL::DOUBLE AS close, count(*) AS tick_volume FROM k WHERE late GROUP BY symbol, time UNION ALL "
    "SELECT symbol, 'BAR', time, round(arg_min(bid,event_id),8)+0.0, round(arg_max(bid,event_id),8)+0.0, count(*) FROM k WHERE NOT late GROUP BY symbol, time HAVING (time+3600)*1000 <= max(newest) - 3600000",
)
def r02_late(spark, sf_dir):
    """Every fiftieth tick of the first part comes with the last one."""
    t = ticks(spark, sf_dir).select("symbol", "event_id", "time_msc", "bid")
    first = F.floor(F.col("time_msc") / 1000) < CUTS[1]
    parts = [t.filter(first & (F.col("event_id") % 50 != 0)), t.filter(~first | (F.col("event_id") % 50 == 0))]
    folder = stateful.in_parts(parts, lambda stream, folder: stateful.run(stateful.tick_bars(stream, H1, H1), folder))
    out = spark.read.schema(stateful.TICK_BAR).parquet(f"{folder}/out").groupBy("symbol", "kind", "time")
    return rounded(out.agg(F.first("open").alias("open"), F.first("close").alias("close"), F.sum("tick_volume").alias("tick_volume")), "open", "close")


@query("R06_flagged_replays", "SELECT o_custkey || '-' || o_orderpriority AS key, o_orderkey AS request_id, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) - 1 AS n_before, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) > 1 AS is_replay FROM orders")
def r06_flagged(spark, sf_dir):
    """Requests of a customer with one priority share a key; they arrive in parts of growing id."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    requests = o.select(F.concat_ws("-", "o_custkey", "o_orderpriority").alias("key"), F.col("o_orderkey").cast("long").alias("request_id"))
    parts = dealt(requests, F.col("request_id"), (5_000, 20_000))
    folder = stateful.in_parts(parts, lambda stream, folder: stateful.run(stateful.flagged_requests(stream), folder))
    return spark.read.parquet(f"{folder}/out")


@query("R09_asof_on_stream", f"WITH {q.TICKS}, {q.bars(H1)}, {q.EXO}, s AS (SELECT d + {SHIFT} AS day, us_2y FROM exo WHERE us_2y IS NOT NULL AND isodow(d + {SHIFT}) < 6), b AS (SELECT symbol, time, close, CAST(make_timestamp(time*1000000) AS DATE) - 1 AS before FROM bars) SELECT symbol, time, round(close,8)+0.0 AS close, CASE WHEN before - day <= 5 THEN round(us_2y,8)+0.0 END AS value FROM b ASOF LEFT JOIN s ON b.before >= s.day")
def r09_asof(spark, sf_dir):
    """Working days only, so that a Monday's bar takes Friday's value."""
    slow = exo_daily(spark, sf_dir).select(F.date_add("d", SHIFT).alias("day"), F.col("us_2y").alias("value")).filter(F.weekday("day") < 5)
    b = bars(spark, sf_dir, H1).select("symbol", "time", "close")
    folder = stateful.in_parts(dealt(b, F.col("time")), lambda stream, folder: stateful.run(stateful.with_slow_values(stream, slow, ["value"], 5), folder))
    return rounded(spark.read.parquet(f"{folder}/out").select("symbol", "time", "close", "value"), "close", "value")


@query(
    "R11_alert_crossings",
    "WITH s AS (SELECT CAST(o_custkey AS BIGINT) AS account, CAST(o_orderkey AS BIGINT) AS snapshot_id, CAST(o_orderdate AS DATE) AS d, 10000.0::DOUBLE + o_orderkey % 997 AS equity FROM orders), w AS (SELECT *, max(equity) OVER v AS peak FROM s WINDOW v AS (PARTITION BY account ORDER BY d, snapshot_id ROWS UNBOUNDED PRECEDING)), "
    "f AS (SELECT *, (peak-equity)*100.0/peak AS fall FROM w), c AS (SELECT *, coalesce(lag(fall > 5.0) OVER (PARTITION BY account ORDER BY d, snapshot_id), false) AS before FROM f) SELECT account, snapshot_id, peak, round(fall,6)+0.0 AS drawdown_pct, CASE WHEN fall > 5.0 THEN 'ALERT' ELSE 'RECOVERED' END AS kind FROM c WHERE (fall > 5.0) <> before",
)
def r11_crossings(spark, sf_dir):
    """Snapshots arrive in three parts of growing time."""
    at = F.unix_date(F.col("o_orderdate").cast("date"))
    s = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").cast("long").alias("account"), F.col("o_orderkey").cast("long").alias("snapshot_id"), at.alias("at"), (F.lit(10000.0) + F.col("o_orderkey") % 997).alias("equity"))
    parts = dealt(s, F.col("at"), (8_800, 9_900))
    folder = stateful.in_parts(parts, lambda stream, folder: stateful.run(stateful.equity_alerts(stream, 5.0), folder))
    return rounded(spark.read.schema(stateful.ALERT).parquet(f"{folder}/out"), "drawdown_pct", digits=6)

"""Exploratory statistics of bars, position reports, order and signal checks, marking of positions, greedy selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.frames import BAR_RANGE, SEVEN, with_percentiles, with_previous

#: The overlapping sessions, hours inclusive.
SESSIONS = (("asian", 0, 7), ("london", 7, 15), ("new_york", 12, 20), ("rollover", 21, 23))


def price_statistics(bars: DataFrame) -> DataFrame:
    """Distribution of closes, bull, bear and doji counts, moments of log returns (population skewness and excess kurtosis)."""
    bars = with_previous(bars, ["symbol"], ["time"], {"_prior": "close"}, BAR_RANGE)
    r = F.log(F.col("close") / F.col("_prior"))
    out = bars.withColumn("_r", r).groupBy("symbol").agg(
        F.count("*").alias("n_rows"), F.min("close").alias("min_close"), F.max("close").alias("max_close"), F.avg("close").alias("mean_close"), F.stddev_samp("close").alias("std_close"),
        F.count_if(F.col("close") > F.col("open")).alias("n_bull"), F.count_if(F.col("close") < F.col("open")).alias("n_bear"), F.count_if(F.col("close") == F.col("open")).alias("n_doji"),
        F.avg(F.col("high") - F.col("low")).alias("mean_range"), F.avg("_r").alias("mean_return"), F.stddev_samp("_r").alias("std_return"), F.skewness("_r").alias("skew_return"), F.kurtosis("_r").alias("kurtosis_return"),
    )
    return with_percentiles(out, bars, ["symbol"], "close", SEVEN)


def temporal_statistics(bars: DataFrame) -> DataFrame:
    """Counts, mean and deviation of log returns, mean spread and volume by hour, weekday, month, year and session.

    A bar belongs to one hour, weekday, month and year and to each session that holds its hour: one explode serves all.
    """
    ts = F.timestamp_seconds("time")
    bars = with_previous(bars, ["symbol"], ["time"], {"_prior": "close"}, BAR_RANGE)
    r = F.log(F.col("close") / F.col("_prior"))
    hour = F.hour(ts)
    group = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    groups = F.array_compact(F.array(group("hour", hour), group("weekday", F.weekday(ts)), group("month", F.month(ts)), group("year", F.year(ts)), *(F.when(hour.between(a, b), group("session", F.lit(n))) for n, a, b in SESSIONS)))
    # the lag comes first: an explode beside it would multiply the rows that it looks back on
    rows = bars.withColumn("r", r).select("symbol", "r", F.col("spread").cast("double").alias("spread"), "tick_volume", F.explode(groups).alias("g")).select("symbol", "r", "spread", "tick_volume", "g.*")
    return rows.groupBy("symbol", "kind", "value").agg(F.count("*").alias("n_rows"), F.avg("r").alias("mean_return"), F.stddev_samp("r").alias("std_return"), F.avg("spread").alias("mean_spread"), F.avg("tick_volume").alias("mean_volume"))


def volume_statistics(bars: DataFrame, names: list[str]) -> DataFrame:
    """Distribution and zero share of each of the columns, in long form."""
    long = bars.select("symbol", "time", *(F.col(n).cast("double").alias(n) for n in names)).unpivot(["symbol", "time"], names, "column", "value")
    return long.groupBy("column").agg(F.count("value").alias("n"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.avg("value").alias("mean_value"), F.percentile("value", F.lit(0.5)).alias("median_value"), F.percentile("value", F.lit(0.95)).alias("p95"), (F.count_if(F.col("value") == 0) * 100.0 / F.count("value")).alias("zero_pct"))


def position_identities(reports: DataFrame) -> DataFrame:
    """Largest breach of open interest = reportable + rest, negative positions, gaps beyond a week."""
    gap = F.datediff("report_date", F.lag("report_date").over(Window.partitionBy("code").orderBy("report_date")))
    columns = ("long_all", "short_all", "rest_long", "rest_short")
    negative = F.lit(False)
    for c in columns:
        negative = negative | (F.col(c) < 0)
    return reports.withColumn("_gap", gap).groupBy("code").agg(
        F.count("*").alias("n_reports"), F.max(F.abs(F.col("open_interest") - F.col("long_all") - F.col("rest_long"))).alias("long_breach"), F.max(F.abs(F.col("open_interest") - F.col("short_all") - F.col("rest_short"))).alias("short_breach"), F.count_if(negative).alias("n_negative"), F.count_if(F.col("_gap") > 7).alias("n_gaps"),
    )


def position_features(reports: DataFrame, window: int = 156, least: int = 52) -> DataFrame:
    """Net position, its rolling z-score (missing for too few reports or no spread), four-report change."""
    order = Window.partitionBy("code").orderBy("report_date")
    frame = order.rowsBetween(-(window - 1), 0)
    net = reports.withColumn("net", F.col("long_all") - F.col("short_all"))
    z = (F.col("net") - F.avg("net").over(frame)) / F.nullif(F.stddev_samp("net").over(frame), F.lit(0.0))
    return net.withColumn("net_z", F.when(F.count("net").over(frame) >= least, z)).withColumn("net_change_4", F.col("net") - F.lag("net", 4).over(order))


def silent_imputation(series: DataFrame, known_missing: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows that are known to be missing but have a value, and how many of those are zero."""
    some = series.join(known_missing, keys, "left_semi")
    return some.agg(F.count("*").alias("n_known_missing"), F.count(value).alias("n_filled"), F.count_if(F.col(value) == 0).alias("n_zero"))


def signal_problems() -> Column:
    """Every rule that a signal record breaks."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return F.array_join(
        F.array_compact(
            F.array(
                F.when(blank("symbol"), "symbol"),
                F.when(~F.coalesce(F.col("action").isin("BUY", "SELL", "HOLD"), F.lit(False)), "action"),
                F.when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence"),
                F.when(F.coalesce(F.col("stop") <= 0, F.lit(False)), "stop"),
            )
        ),
        ",",
    )


def order_problem(side: Column, quantity: Column, least: Column, most: Column, step: Column, price: Column, stop: Column, target: Column) -> Column:
    """The first rule of the symbol's specification that an order breaks."""
    steps = quantity / step
    return (
        F.when(~F.coalesce(side.isin("BUY", "SELL"), F.lit(False)), "SIDE")
        .when(quantity.isNull() | (quantity <= 0), "QUANTITY")
        .when(quantity < least, "BELOW_MINIMUM")
        .when(quantity > most, "ABOVE_MAXIMUM")
        .when(F.abs(steps - F.round(steps)) > 1e-4, "STEP")
        .when(((side == "BUY") & (stop >= price)) | ((side == "SELL") & (stop <= price)), "STOP_SIDE")
        .when(((side == "BUY") & (target <= price)) | ((side == "SELL") & (target >= price)), "TARGET_SIDE")
    )


def marked(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """P20: open positions at the latest price of their symbol: unrealised result, stop and target touched."""
    latest = prices.groupBy("symbol").agg(F.max_by("bid", F.struct("time_msc", "event_id")).alias("price"))
    side = F.when(F.col("side") == "BUY", 1.0).otherwise(-1.0)
    return positions.join(latest, "symbol").select(
        "*", (side * (F.col("price") - F.col("entry")) * F.col("units")).alias("unrealised"), (side * (F.col("price") - F.col("stop")) <= 0).alias("stop_hit"), (side * (F.col("price") - F.col("target")) >= 0).alias("target_hit")
    )


def local_to_utc(date: Column, clock: Column, zone: Column) -> Column:
    """Local date, time and zone of each row to an instant."""
    return F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", date.cast("string"), clock)), zone)


def non_overlapping(candidates: DataFrame, keys: list[str], start: str, end: str, cooldown: int, bucket: int) -> DataFrame:
    """Greedy pass in start order: a candidate is taken if it starts after the last taken one's end and the cooldown.

    Of candidates with one start the one that ends first counts. Each candidate points to the first one that starts
    late enough (an as-of join by time buckets); the chain from a key's first candidate is followed by doubling, so the
    rounds grow with the logarithm of its length and no key is walked in one task.
    """
    from tickloom.operators.asof import asof
    from tickloom.streaming import stored

    others = [c for c in candidates.columns if c not in (*keys, start)]
    first = candidates.groupBy(*keys, start).agg(F.min(F.struct(end, *(c for c in others if c != end))).alias("_c")).select(*keys, start, "_c.*")
    starts = first.select(*keys, F.col(start).alias("_to"))
    free = first.select(*keys, F.col(start).alias("_from"), (F.col(end) + cooldown + 1).alias("_free"))
    jump = stored(asof(free, starts, keys, "_free", "_to", [], bucket, forward=True).filter("_to is not null").select(*keys, "_from", "_to"))
    taken = stored(first.groupBy(*keys).agg(F.min(start).alias("_from")))
    while not jump.isEmpty():
        # the chain's first 2^k members reach the next 2^k by one jump
        taken = stored(taken.unionByName(taken.join(jump, [*keys, "_from"]).select(*keys, F.col("_to").alias("_from"))))
        further = jump.withColumnRenamed("_to", "_via").join(jump.withColumnRenamed("_from", "_via"), [*keys, "_via"])
        jump = stored(further.select(*keys, "_from", "_to"))
    return first.join(taken.withColumnRenamed("_from", start), [*keys, start], "left_semi")


def first_touch(trades: DataFrame, ticks: DataFrame, minutes: int, bucket: int) -> DataFrame:
    """Whether later ticks touch a trade's target or stop first; the target is tested first on one tick."""
    from tickloom.operators.windows import first_hits

    width = max(bucket, minutes * 60_000)  # so that a window lies in two cells at most
    windows = trades.select("symbol", "trade_id", "exit_msc", (F.col("exit_msc") + minutes * 60_000).alias("_until"), "target", "stop")
    hits = first_hits(ticks.select("symbol", "time_msc", "event_id", "bid"), windows, ["symbol"], "time_msc", "exit_msc", "_until", width, ["event_id"], "bid", "target", "stop")
    which = F.when(F.col("is_above"), "TAKE_PROFIT").otherwise("STOP_LOSS")
    touches = hits.groupBy("trade_id").agg(F.min_by(which, "hit_time").alias("touch"))
    return trades.join(touches, "trade_id", "left").withColumn("touch", F.coalesce("touch", F.lit("NONE")))

"""Market-shaped views over the event and order tables: ticks, bars, trades, slow daily series, predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

M15, H1, H4, D1 = 900, 3600, 14400, 86400


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of five symbols; spreads are whole points of 1e-5."""
    k = F.get_json_object("props", "$.k").cast("double")
    ts = F.col("ts").cast("timestamp")
    bid = F.lit(1.0) + F.col("value") / 1000.0
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_type").alias("symbol"),
        "event_id",
        ts.alias("ts"),
        F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("time_msc"),
        "user_id",
        bid.alias("bid"),
        (bid + k * F.lit(1e-5)).alias("ask"),
        k.alias("spread_points"),
        F.lit(6).alias("flags"),
    )


def bars(spark: SparkSession, sf_dir: str, seconds: int = M15) -> DataFrame:
    """OHLC bars of the quotes; `time` is the bar's open in epoch seconds."""
    from tickloom.operators.rollup import bars_from_ticks

    return bars_from_ticks(ticks(spark, sf_dir), seconds)


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of closed trades."""
    first = F.substring("o_orderpriority", 1, 1)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("trade_id"),
        F.col("o_orderdate").cast("timestamp").alias("signal_time"),
        F.when(F.col("o_custkey") % 2 == 0, "LONG").otherwise("SHORT").alias("direction"),
        F.when(first == "1", "TAKE_PROFIT").when(first == "2", "STOP_LOSS").otherwise("MAX_HOLD").alias("exit_reason"),
        ((F.col("o_orderkey") * 7919 % 20001 - 10000).cast("double") / 100.0).alias("net_pnl"),
        (F.col("o_orderkey") % 41).cast("double").alias("entry_spread_pts"),
        (F.col("o_orderkey") * 7 % 37).cast("double").alias("exit_spread_pts"),
        (F.col("o_custkey") % 5 + 1).cast("int").alias("holding_bars"),
    )


def exo_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two slow daily series with missing days, in whole cents until the last division."""
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    mean = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, F.col("cents"))).cast("double") / F.nullif(F.count(F.when(F.col("o_orderstatus") == s, 1)), F.lit(0)) / F.lit(1e7)
    daily = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("cents", cents).groupBy(F.col("o_orderdate").cast("date").alias("d"))
    return daily.agg(mean("F").alias("us_2y"), mean("O").alias("german_2y"))


def preds(spark: SparkSession, sf_dir: str, a: int = 37, b: int = 59, c: int = 83) -> DataFrame:
    """Three-class predictions; other multipliers give another model."""
    e = F.col("event_id")
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("symbol"),
        (e * 13 % 3 - 1).cast("double").alias("y_true"),
        (e * a % 101 + 1).cast("double").alias("a"),
        (e * b % 103 + 1).cast("double").alias("b"),
        (e * c % 107 + 1).cast("double").alias("c"),
    )
    total = F.col("a") + F.col("b") + F.col("c")
    y_pred = F.when((F.col("a") >= F.col("b")) & (F.col("a") >= F.col("c")), -1.0).when(F.col("b") >= F.col("c"), 0.0).otherwise(1.0)
    return raw.select("event_id", "ts", "symbol", "y_true", (F.col("a") / total).alias("p_short"), (F.col("b") / total).alias("p_neutral"), (F.col("c") / total).alias("p_long"), y_pred.alias("y_pred"))

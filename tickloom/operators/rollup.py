"""Roll-up of ticks to bars and of bars to longer bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bars_from_ticks(ticks: DataFrame, seconds: int) -> DataFrame:
    """First, highest, lowest and last bid, tick count and median spread of each bar that has ticks."""
    key = F.floor(F.col("time_msc") / (seconds * 1000.0)).cast("long")
    return (
        ticks.groupBy("symbol", key.alias("bar_key"))
        .agg(
            F.min_by("bid", "event_id").alias("open"),
            F.max("bid").alias("high"),
            F.min("bid").alias("low"),
            F.max_by("bid", "event_id").alias("close"),
            F.count("*").alias("tick_volume"),
            F.percentile("spread_points", F.lit(0.5)).alias("spread"),
        )
        .select("symbol", (F.col("bar_key") * seconds).alias("time"), "open", "high", "low", "close", "tick_volume", "spread", F.lit(0).cast("long").alias("real_volume"))
    )


def longer_bars(bars: DataFrame, seconds: int) -> DataFrame:
    """Left-closed, left-labelled bins from midnight UTC; empty bins do not appear."""
    key = F.floor(F.col("time") / seconds).cast("long")
    return (
        bars.groupBy("symbol", key.alias("bar_key"))
        .agg(
            F.min_by("open", "time").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "time").alias("close"),
            F.sum("tick_volume").alias("tick_volume"),
            F.percentile("spread", F.lit(0.5)).alias("spread"),
            F.sum("real_volume").alias("real_volume"),
            F.min("time").alias("first_time"),
        )
        .select("symbol", (F.col("bar_key") * seconds).alias("time"), "first_time", "open", "high", "low", "close", "tick_volume", "spread", "real_volume")
    )


def tick_bars(ticks: DataFrame, seconds: int) -> DataFrame:
    """Bars with tick count and mean and largest spread."""
    key = F.floor(F.col("time_msc") / (seconds * 1000.0)).cast("long")
    return (
        ticks.groupBy("symbol", key.alias("bar_key"))
        .agg(
            F.min_by("bid", "event_id").alias("open"),
            F.max("bid").alias("high"),
            F.min("bid").alias("low"),
            F.max_by("bid", "event_id").alias("close"),
            F.count("*").alias("tick_count"),
            F.sum(F.col("spread_points").cast("long")).alias("_points"),
            F.max("spread_points").alias("max_spread_points"),
        )
        .select("symbol", (F.col("bar_key") * seconds).alias("time"), "open", "high", "low", "close", "tick_count", (F.col("_points") / F.col("tick_count")).alias("mean_spread_points"), "max_spread_points")
    )

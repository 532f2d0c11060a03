"""Forward-looking labels of bars."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.features import TINY, true_range
from tickloom.operators.frames import BAR_RANGE, SEVEN, Frame, in_blocks, with_percentiles, with_row_index

#: Horizons in bars, and the fixed return thresholds of each.
HORIZONS = (1, 4, 8, 16)
THRESHOLDS = {1: 0.00025, 4: 0.0005, 8: 0.00075, 16: 0.001}


def future_return(f: Frame, h: int) -> Column:
    C = F.col("close")
    return f.lead("close", h) / C - 1.0


def three_way(value: Column, band: Column) -> Column:
    """1 above the band, -1 below it, 0 inside; missing where either is missing."""
    return F.when(value > band, 1.0).when(value < -band, -1.0).when((value >= -band) & (value <= band), 0.0)


def two_way(value: Column, band: Column) -> Column:
    """1 above the band, -1 below it, missing inside."""
    return F.when(value > band, 1.0).when(value < -band, -1.0)


def returns(f: Frame, horizons: tuple[int, ...] = HORIZONS) -> dict[str, Column]:
    """W15; needs _atr_norm."""
    C = F.col("close")
    out = {}
    for h in horizons:
        r = future_return(f, h)
        out |= {f"future_return_{h}": r, f"future_log_return_{h}": F.log(f.lead("close", h) / C), f"future_vol_adj_return_{h}": r / (F.col("_atr_norm") + TINY)}
    return out


def directions(f: Frame, horizons: tuple[int, ...] = HORIZONS, thresholds: dict[int, float] | None = None) -> dict[str, Column]:
    """By fixed thresholds, and by half the root of the horizon times the ATR."""
    thresholds = thresholds or THRESHOLDS
    out = {}
    for h in horizons:
        r = future_return(f, h)
        out |= {f"direction_{h}": three_way(r, F.lit(thresholds[h])), f"direction_vol_{h}": three_way(r, F.col("_atr_norm") * (0.5 * math.sqrt(h)))}
    return out


def swing_targets(f: Frame, horizons: tuple[int, ...] = (4, 8, 12)) -> dict[str, Column]:
    """Two-way targets, and the sign of the past return as the persistence baseline."""
    C = F.col("close")
    out = {}
    for h in horizons:
        r, past = future_return(f, h), C / f.lag("close", h) - 1.0
        out |= {f"future_return_{h}": r, f"direction_{h}": two_way(r, F.lit(0.0)), f"direction_vol_{h}": two_way(r, F.col("_atr_norm") * (0.5 * math.sqrt(h))), f"baseline_{h}": F.when(past < 0, -1.0).otherwise(1.0)}
    return out


def alternatives(h: int = 4) -> dict[str, Column]:
    """Four binary targets from the labels of a horizon."""
    r, d, v = F.col(f"future_return_{h}"), F.col(f"direction_{h}"), F.col(f"direction_vol_{h}")
    return {"target_a": F.when(d != 0, d), "target_b": two_way(r, F.lit(0.0)), "target_c": F.when(v != 0, v), "target_d": F.when(F.abs(r) > 0.0002, F.signum(r))}


def label(bars: DataFrame, *blocks, reach: int = max(HORIZONS), block_rows: int | None = 4096) -> DataFrame:
    """Symbol, time and the labels of the blocks, whose horizons are `reach` bars at most.

    Long series are cut into blocks of `block_rows` rows with halos; None leaves a symbol whole.
    """

    def apply(df: DataFrame, f: Frame) -> DataFrame:
        ranged = df.withColumn("_true_range", true_range(f)).withColumn("_atr_norm", f.mean("_true_range", 14) / F.col("close"))
        columns: dict[str, Column] = {}
        for b in blocks or (returns, directions):
            columns |= b(f)
        keep = [c for c in ("_home", "_block") if c in df.columns]
        return ranged.select("symbol", "time", *keep, *(c.alias(n) for n, c in columns.items()))

    if block_rows is None:
        return apply(bars, Frame("symbol"))
    return in_blocks(with_row_index(bars, ["symbol"], "time", BAR_RANGE), ["symbol"], apply, max(15, reach), reach, block_rows)


def class_balance(labels: DataFrame, name: str) -> DataFrame:
    """Class counts and shares of a three-way label, and the imbalance of long and short."""
    d = F.col(name)
    out = labels.groupBy("symbol").agg(F.count(d).alias("n_valid"), F.count_if(d == 1).alias("n_long"), F.count_if(d == 0).alias("n_neutral"), F.count_if(d == -1).alias("n_short"))
    share = lambda c: F.round(F.col(c) * 100.0 / F.nullif("n_valid", F.lit(0)), 6) + F.lit(0.0)
    imbalance = F.greatest("n_long", "n_short") / F.nullif(F.least("n_long", "n_short"), F.lit(0))
    return out.select("*", share("n_long").alias("long_pct"), share("n_neutral").alias("neutral_pct"), share("n_short").alias("short_pct"), (F.round(imbalance, 6) + F.lit(0.0)).alias("imbalance"))


def distribution(labels: DataFrame, names: list[str]) -> DataFrame:
    """Moments and quantiles of continuous labels, in long form."""
    long = labels.unpivot(["symbol", "time"], names, "label", "value")
    per = long.groupBy("label").agg(F.count("value").alias("n_valid"), F.avg("value").alias("mean_value"), F.stddev_samp("value").alias("std_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))
    return with_percentiles(per, long, ["label"], "value", SEVEN)


def swing_distribution(targets: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """Per horizon: sample, excluded share, long and short shares, mean and median return in basis points."""
    rows = targets.select("symbol", F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"direction_{h}").alias("d"), F.col(f"future_return_{h}").alias("r")) for h in horizons))).alias("x")).select("symbol", "x.*")
    n = F.count("d")
    rows = rows.withColumn("bps", F.when(F.col("d").isNotNull(), F.col("r") * 10_000))
    per = rows.groupBy("horizon").agg(
        n.alias("n_sample"), ((F.count("*") - n) * 100.0 / F.count("*")).alias("excluded_pct"), (F.count_if(F.col("d") > 0) * 100.0 / n).alias("long_pct"), (F.count_if(F.col("d") < 0) * 100.0 / n).alias("short_pct"),
        F.avg("bps").alias("mean_bps"),
    )
    return with_percentiles(per, rows, ["horizon"], "bps", {"median_bps": 0.5})

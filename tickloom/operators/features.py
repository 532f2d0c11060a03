"""Point-in-time features of bars, as blocks of columns and as a registry that users extend.

A block maps names to columns over a Frame. Frames carry the missing-value rules; comparisons with a missing value give 0.
Exponential filters are added first by `with_filters`, as they need the row index. Every block works on whole series
(Frame("symbol")) and inside halo blocks (frames.in_blocks).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.frames import BAR_RANGE, Frame, exponential, flag, in_blocks, with_row_index

TINY, SMALL = 1e-12, 1e-8
#: Fixed value: M15 bars of a year of 252 days.
ANNUAL = math.sqrt(24192)
LOOKBACK = 100
Block = Callable[[Frame], dict[str, Column]]


def true_range(f: Frame) -> Column:
    """The first bar has no previous close: its range alone."""
    H, L = F.col("high"), F.col("low")
    before = f.lag("close")
    return F.greatest(H - L, F.abs(H - before), F.abs(L - before))


def log_return(f: Frame) -> Column:
    C = F.col("close")
    return F.log(C / f.lag("close"))


def price(f: Frame) -> dict[str, Column]:
    """P01."""
    O, H, L, C = F.col("open"), F.col("high"), F.col("low"), F.col("close")
    span, upper, lower = H - L, H - F.greatest(O, C), F.least(O, C) - L
    return {
        "return_1": C / f.lag("close") - 1,
        "log_return_1": log_return(f),
        "open_to_close_return": (C - O) / O,
        "hl_range": span,
        "hl_range_norm": span / C,
        "candle_body": F.abs(C - O),
        "candle_body_norm": F.abs(C - O) / C,
        "upper_wick": upper,
        "upper_wick_ratio": upper / (span + SMALL),
        "lower_wick": lower,
        "lower_wick_ratio": lower / (span + SMALL),
        "candle_direction": F.signum(C - O),
        "return_mean_5": f.mean("_log_return", 5),
        "return_mean_20": f.mean("_log_return", 20),
    }


def clock(f: Frame) -> dict[str, Column]:
    """P02; the session hours include both ends, so they overlap."""
    ts = F.timestamp_seconds("time")
    hour, minute, day = F.hour(ts), F.minute(ts), F.weekday(ts)
    out = {"hour": hour.cast("double"), "minute": minute.cast("double"), "day_of_week": day.cast("double")}
    for name, value, period in (("hour", hour, 24.0), ("minute", minute, 60.0), ("day_of_week", day, 7.0)):
        out[f"sin_{name}"], out[f"cos_{name}"] = F.sin(value * (2 * math.pi / period)), F.cos(value * (2 * math.pi / period))
    for name, a, b in (("asian_session", 0, 7), ("london_session", 7, 15), ("ny_session", 12, 20), ("rollover_window", 21, 23)):
        out[f"is_{name}"] = flag(hour.between(a, b))
    return out


def trend(f: Frame) -> dict[str, Column]:
    """W01; needs the filters ema_10 to ema_80."""
    C = F.col("close")
    ema = {w: F.col(f"ema_{w}") for w in (10, 20, 40, 80)}
    out = {f"sma_{w}": f.mean("close", w) for w in ema} | {f"ema_{w}": e for w, e in ema.items()} | {f"dist_ema_{w}": (C - e) / e for w, e in ema.items()}
    out |= {f"ema_spread_{a}_{b}": (ema[a] - ema[b]) / ema[b] for a, b in ((10, 40), (20, 80))}
    return out | {f"ema_slope_{w}": (ema[w] - f.lag(f"ema_{w}", 5)) / (f.lag(f"ema_{w}", 5) * 5.0) for w in (10, 20)}


def rsi(index: str = "bar_idx", period: int = 14) -> Column:
    """From the filters of gains and losses, once `period` of them are there; the first bar has none."""
    value = 100.0 - 100.0 / (1.0 + F.col("gain_14") / (F.col("loss_14") + TINY))
    return F.when(F.col(index) >= period, value)


def momentum(f: Frame) -> dict[str, Column]:
    """W02; needs the filters gain_14 and loss_14."""
    C = F.col("close")
    out = {f"roc_{w}": (C - f.lag("close", w)) / f.lag("close", w) for w in (5, 10, 20, 40, 80)}
    return out | {f"dist_sma_{w}": (C - f.mean("close", w)) / f.mean("close", w) for w in (10, 20, 40, 80)} | {"rsi_14": rsi()}


def volatility(f: Frame) -> dict[str, Column]:
    """W03; the ATR here is a simple mean."""
    C = F.col("close")
    std = {w: f.std("_log_return", w) for w in (10, 20, 40, 80)}
    atr = {w: f.mean("_true_range", w) for w in (14, 40)}
    out = {f"vol_std_{w}": s for w, s in std.items()} | {f"vol_ann_{w}": std[w] * ANNUAL for w in (20, 80)}
    out |= {f"atr_{w}": a for w, a in atr.items()} | {f"atr_norm_{w}": a / C for w, a in atr.items()}
    out |= {f"vol_ratio_{a}_{b}": std[a] / (std[b] + SMALL) for a, b in ((10, 40), (20, 80))}
    return out | {"rolling_hl_ratio_20": (f.max("high", 20) - f.min("low", 20)) / C}


def activity(f: Frame) -> dict[str, Column]:
    """W04."""
    C, V, S = F.col("close"), F.col("tick_volume"), F.col("spread")
    v20, v80, s20 = f.mean(V, 20), f.mean(V, 80), f.mean(S, 20)
    return {
        "log_tick_volume": F.log1p(V),
        "tick_vol_sma_20": v20,
        "tick_vol_ratio_20": V / (v20 + SMALL),
        "tick_vol_zscore_20": (V - v20) / (f.std(V, 20) + SMALL),
        "tick_vol_zscore_80": (V - v80) / (f.std(V, 80) + SMALL),
        "spread_norm": S * 1e-5 / C,
        "spread_sma_20": s20,
        "spread_ratio_20": S / (s20 + SMALL),
        "spread_zscore_20": (S - s20) / (f.std(S, 20) + SMALL),
    }


def gap_state(f: Frame, step: int = 900, most: int = 96) -> dict[str, Column]:
    """W05. Bars since the last gap look back at most `most` rows, as the count is capped there."""
    delta = F.col("time") - f.lag("time")
    after = F.coalesce(delta > step, F.lit(False))
    day = F.weekday(F.timestamp_seconds("time"))
    # place of the last gap bar among the last rows; without one, of the first row
    last_gap = F.max(F.when(F.col("_post_gap") == 1, F.col("bar_idx"))).over(f.w.rowsBetween(-most, 0))
    return {
        "delta_seconds": delta.cast("double"),
        "is_normal": flag(delta == step),
        "is_post_gap": flag(after),
        "is_weekend_reopen": flag(after & (delta >= 129_600) & day.isin(6, 0)),
        "bars_since_last_gap": F.least(F.col("bar_idx") - F.coalesce(last_gap, F.lit(0)), F.lit(most)).cast("double"),
    }


def extended(f: Frame) -> dict[str, Column]:
    """W06; needs the filters ema_10 and ema_20."""
    O, H, L, C, V = F.col("open"), F.col("high"), F.col("low"), F.col("close"), F.col("tick_volume")
    near = C + TINY
    h20, l20, h80, l80 = f.max("high", 20), f.min("low", 20), f.max("high", 80), f.min("low", 80)
    s20, s80 = f.mean("close", 20), f.mean("close", 80)
    c5, c10, c20 = f.lag("close", 5), f.lag("close", 10), f.lag("close", 20)
    span = H - L
    hour = F.hour(F.timestamp_seconds("time"))
    volume = f.mean(V, 5) / (f.mean(V, 20) + TINY)
    score = flag(C > s20) + flag(s20 > s80) + flag(F.col("ema_10") > F.col("ema_20"))
    return {
        "dist_high_20": (h20 - C) / near,
        "dist_low_20": (C - l20) / near,
        "dist_high_80": (h80 - C) / near,
        "dist_low_80": (C - l80) / near,
        "channel_width_20": (h20 - l20) / near,
        "channel_width_80": (h80 - l80) / near,
        "breakout_high_20": flag(H >= f.max("high", 20, shift=1)),
        "breakout_low_20": flag(L <= f.min("low", 20, shift=1)),
        "return_persistence_5": f.mean("_up", 5),
        "return_persistence_20": f.mean("_up", 20),
        "momentum_acceleration_5": ((C - c5) - (c5 - c10)) / near,
        "roc_acceleration_20": (C - c10) / (c10 + TINY) - (C - c20) / (c20 + TINY),
        "range_expansion_ratio": span / (f.mean("_true_range", 14) + TINY),
        "range_compression_5": (f.max("high", 5) - f.min("low", 5)) / (h20 - l20 + TINY),
        "vol_regime_ratio_10_80": f.std("_return", 10) / (f.std("_return", 80) + TINY),
        "high_low_wick_imbalance": ((H - F.greatest(O, C)) - (F.least(O, C) - L)) / (span + TINY),
        "body_to_range_ratio": F.abs(C - O) / (span + TINY),
        "trend_regime_score": (score - 1.5) / 1.5,
        "dist_daily_pivot": (C - (h80 + l80 + f.lag("close")) / 3.0) / near,
        "session_transition_london_open": flag(hour == 7),
        "session_transition_ny_open": flag(hour == 12),
        "session_transition_london_close": flag(hour.isin(15, 16)),
        "volume_momentum_5": volume,
        "volume_price_trend_5": (C / c5 - 1) * volume,
        "consecutive_direction_run": direction_run(f),
    }


def direction_run(f: Frame, most: int = 5) -> Column:
    """Signed number of bars in a row with the body's direction, up to `most`; 0 for flat bars.

    The first bar of a series counts 0, and a run that starts there one less. Only the last `most` bars decide.
    """
    O, C = F.col("open"), F.col("close")
    sign = F.signum(C - O)
    same = [F.coalesce(F.lag(sign, k).over(f.w) == sign, F.lit(False)) for k in range(1, most + 1)]
    run = F.lit(most)
    for k in range(most, 0, -1):
        run = F.when(~same[k - 1], k).otherwise(run)
    # a run that reaches back to the first bar counts from there
    return (sign * F.least(run, F.col("bar_idx"))).cast("double")


def swing(f: Frame, hours: bool = True) -> dict[str, Column]:
    """W07; needs the filters ema_10, ema_20, gain_14 and loss_14."""
    O, H, L, C, V = F.col("open"), F.col("high"), F.col("low"), F.col("close"), F.col("tick_volume")
    near = C + TINY
    span = H - L
    sma = {w: f.mean("close", w) for w in (10, 20, 50)}
    back = {k: f.lag("close", k) for k in (5, 10, 20)}
    h20, l20 = f.max("high", 20), f.min("low", 20)
    std = {w: f.std("_return", w) for w in (5, 10, 20)}
    atr = f.mean("_true_range", 14)
    score = flag(C > sma[20]) + flag(sma[20] > sma[50]) + flag(F.col("ema_10") > F.col("ema_20"))
    ts = F.timestamp_seconds("time")
    day, hour = F.weekday(ts), F.hour(ts)
    out = {f"return_{k}": C / f.lag("close", k) - 1 for k in (1, 2, 4, 8)}
    out |= {
        "hl_range_norm": span / near,
        "candle_body_norm": F.abs(C - O) / near,
        "candle_direction": F.signum(C - O),
        "upper_wick_ratio": (H - F.greatest(O, C)) / (span + TINY),
        "lower_wick_ratio": (F.least(O, C) - L) / (span + TINY),
    }
    out |= {f"dist_sma_{w}": (C - m) / near for w, m in sma.items()}
    out |= {"sma_slope_10": (sma[10] - f.lag("_sma_10", 3)) / near, "sma_slope_20": (sma[20] - f.lag("_sma_20", 5)) / near, "ema_spread_10_20": (F.col("ema_10") - F.col("ema_20")) / near, "trend_regime": (score - 1.5) / 1.5}
    out |= {f"roc_{k}": (C - b) / (b + TINY) for k, b in back.items()}
    out |= {
        "rsi_14": rsi(),
        "momentum_acceleration": ((C - back[5]) - (back[5] - back[10])) / near,
        "atr_14": atr,
        "atr_norm_14": atr / near,
        "vol_std_10": std[10],
        "vol_std_20": std[20],
        "vol_ratio_5_20": std[5] / (std[20] + TINY),
        "dist_rolling_high_10": (f.max("high", 10) - C) / near,
        "dist_rolling_low_10": (C - f.min("low", 10)) / near,
        "dist_rolling_high_20": (h20 - C) / near,
        "dist_rolling_low_20": (C - l20) / near,
        "rolling_hl_ratio_20": (C - l20) / (h20 - l20 + TINY),
        "channel_width_20": (h20 - l20) / near,
        "breakout_high_10": flag(H >= f.max("high", 10, shift=1)),
        "breakout_low_10": flag(L <= f.min("low", 10, shift=1)),
        "vol_ratio_10": V / (f.mean(V, 10) + TINY),
        "day_of_week": day.cast("double"),
        "sin_day_of_week": F.sin(day * (2 * math.pi / 5.0)),
        "cos_day_of_week": F.cos(day * (2 * math.pi / 5.0)),
    }
    if hours:
        out |= {"hour": hour.cast("double"), "sin_hour": F.sin(hour * (2 * math.pi / 24.0)), "cos_hour": F.cos(hour * (2 * math.pi / 24.0))}
    return out


def regime(f: Frame) -> dict[str, Column]:
    """W09; needs the filter ema_50."""
    C = F.col("close")
    atr = f.roll(F.avg, "_true_range", 14, least=1)
    realised = f.std("_log_return", 20, least=5)
    low, high = f.roll(F.min, "_vol", 100, least=20), f.roll(F.max, "_vol", 100, least=20)
    h20, l20 = f.max("high", 20), f.min("low", 20)
    out = {
        "slope_20": f.slope(C, F.col("bar_idx").cast("double"), 20) / C,
        "dist_ema_50": (C - F.col("ema_50")) / F.col("ema_50"),
        "trend_persistence_10": f.mean("_up", 10),
        "atr_norm": atr / C,
        "realised_vol_20": realised,
        "vol_percentile_100": (F.col("_vol") - low) / (high - low + TINY),
        "range_position_20": (C - l20) / (h20 - l20 + TINY),
        "dist_high_20": (h20 - C) / C,
        "breakout_state": flag(C > f.max("high", 20, shift=1)) - flag(C < f.min("low", 20, shift=1)),
        "sign_mean_8": f.mean(F.signum(F.col("_return")), 8),
    }
    return out | {f"scaled_return_{k}": F.least(F.greatest((C / f.lag("close", k) - 1) / (realised * math.sqrt(k) + TINY), F.lit(-5.0)), F.lit(5.0)) for k in (4, 8)}


def regime_states(f: Frame) -> dict[str, Column]:
    """Four states from the ATR against its rolling median and the gap of two averages; needs ema_20 and ema_50."""
    atr = f.roll(F.avg, "_true_range", 14, least=1)
    wide = F.coalesce(atr > f.median("_atr", 100, least=20), F.lit(False))
    trending = F.coalesce(F.abs(F.col("ema_20") - F.col("ema_50")) / (atr + TINY) > 0.5, F.lit(False))
    state = F.when(trending & wide, "TREND_WIDE").when(trending, "TREND_CALM").when(wide, "RANGE_WIDE").otherwise("RANGE_CALM")
    return {"regime_state": state}


def range_estimators() -> dict[str, Column]:
    """Parkinson, Garman-Klass and Rogers-Satchell volatility of one bar."""
    O, H, L, C = F.col("open"), F.col("high"), F.col("low"), F.col("close")
    low, opened, close = F.greatest(L, F.lit(TINY)), F.greatest(O, F.lit(TINY)), F.greatest(C, F.lit(TINY))
    high = F.greatest(H, F.lit(TINY))
    hl = F.log(F.greatest(high / low, F.lit(1.0)))
    return {
        "parkinson": F.sqrt(F.greatest(hl * hl / (4 * math.log(2)), F.lit(0.0))),
        "garman_klass": F.sqrt(F.greatest(0.5 * hl * hl - (2 * math.log(2) - 1) * F.pow(F.log(close / opened), 2.0), F.lit(0.0))),
        "rogers_satchell": F.sqrt(F.greatest(F.log(high / close) * F.log(high / opened) + F.log(low / close) * F.log(low / opened), F.lit(0.0))),
    }


def volatility_memory(f: Frame) -> dict[str, Column]:
    """Root mean squares over several spans, changes and a ratio, of the three estimators (columns of that name)."""
    out = {}
    for e in ("parkinson", "garman_klass", "rogers_satchell"):
        square = F.col(e) * F.col(e)
        rms = {w: F.sqrt(f.mean(square, w)) for w in (1, 6, 12, 24, 72)}
        out |= {f"{e}_{w}": v for w, v in rms.items()}
        out |= {f"{e}_change_{k}": F.col(e) - f.lag(e, k) for k in (1, 6)} | {f"{e}_ratio_6_72": rms[6] / (rms[72] + TINY)}
    return out


def realised_pair(f: Frame, horizon: int) -> dict[str, Column]:
    """Root mean square of the last and of the next `horizon` log returns; both only where both are whole."""
    square = F.col("_log_return") * F.col("_log_return")
    back, ahead = f.w.rowsBetween(-(horizon - 1), 0), f.w.rowsBetween(1, horizon)
    whole = (F.count(square).over(back) >= horizon) & (F.count(square).over(ahead) >= horizon)
    return {"trailing_rv": F.when(whole, F.sqrt(F.avg(square).over(back))), "forward_rv": F.when(whole, F.sqrt(F.avg(square).over(ahead)))}


def base(df: DataFrame, f: Frame) -> DataFrame:
    """Columns that several blocks share, each computed once."""
    C = F.col("close")
    out = df.withColumns({"_log_return": log_return(f), "_return": C / f.lag("close") - 1, "_true_range": true_range(f), "_up": flag(C > f.lag("close")), "_post_gap": F.when(F.col("time") - f.lag("time") > 900, 1).otherwise(0)})
    return out.withColumns({"_sma_10": f.mean("close", 10), "_sma_20": f.mean("close", 20), "_vol": f.std("_log_return", 20, least=5), "_atr": f.roll(F.avg, "_true_range", 14, least=1)})


SHARED = ("_log_return", "_return", "_true_range", "_up", "_post_gap", "_sma_10", "_sma_20", "_vol", "_atr")


#: Spans of the exponential filters of closes, and the period of the Wilder filters.
SPANS, WILDER = (10, 20, 40, 50, 80), 14


def with_filters(bars: DataFrame, spans: tuple[int, ...] = SPANS, width: int = 86_400 * 30) -> DataFrame:
    """Bars with the row index and the exponential filters: ema_* of closes, Wilder filters of gains, losses and range."""
    C = F.col("close")
    indexed = with_row_index(bars, ["symbol"], "time", width)

    def stage(df: DataFrame, f: Frame) -> DataFrame:
        change = C - f.lag("close")
        return df.withColumn("_gain", F.greatest(change, F.lit(0.0))).withColumn("_loss", F.greatest(-change, F.lit(0.0))).withColumn("_tr", true_range(f))

    staged = in_blocks(indexed, ["symbol"], stage, 1, 0, 4096)
    filters = {f"ema_{s}": (C, 2.0 / (s + 1), 0) for s in spans}
    filters |= {"gain_14": (F.col("_gain"), 1.0 / WILDER, 1), "loss_14": (F.col("_loss"), 1.0 / WILDER, 1), "wilder_range_14": (F.col("_tr"), 1.0 / WILDER, 0)}
    return exponential(staged, ["symbol"], filters).drop("_gain", "_loss", "_tr")


@dataclass(frozen=True)
class FeatureSpec:
    """A named block of features, with how far its frames look back and ahead."""

    name: str
    block: Block
    lookback: int = LOOKBACK
    lookahead: int = 0
    needs_filters: bool = False


REGISTRY: dict[str, FeatureSpec] = {
    s.name: s
    for s in (
        FeatureSpec("price", price, 20),
        FeatureSpec("time", clock, 0),
        FeatureSpec("trend", trend, 80, needs_filters=True),
        FeatureSpec("momentum", momentum, 80, needs_filters=True),
        FeatureSpec("volatility", volatility, 81),
        FeatureSpec("activity", activity, 80),
        FeatureSpec("gaps", gap_state, 97),
        FeatureSpec("extended", extended, 81, needs_filters=True),
        FeatureSpec("swing", swing, 51, needs_filters=True),
        FeatureSpec("regime", regime, 121, needs_filters=True),
        FeatureSpec("regime_states", regime_states, 115, needs_filters=True),
    )
}


def register(spec: FeatureSpec) -> None:
    REGISTRY[spec.name] = spec


def build(bars: DataFrame, names: list[str], block_rows: int | None = 4096) -> DataFrame:
    """Symbol, time, bar_idx and the features of the named blocks, as one plan without joins between blocks.

    Long series are cut into blocks of `block_rows` rows with halos, and each block is a task's work; None leaves a symbol whole.
    A price of zero counts as missing, so that no ratio divides by it.
    """
    specs = [REGISTRY[n] for n in names]
    bars = without_zeros(bars)
    start = with_filters(bars) if any(s.needs_filters for s in specs) else with_row_index(bars, ["symbol"], "time", 86_400 * 30)
    return assemble(start, names, block_rows)


def without_zeros(bars: DataFrame) -> DataFrame:
    return bars.withColumns({c: F.nullif(c, F.lit(0.0)) for c in ("open", "high", "low", "close") if c in bars.columns})


def assemble(start: DataFrame, names: list[str], block_rows: int | None = 4096) -> DataFrame:
    """The features of the named blocks from bars that have the row index (and the filters, where a block needs them)."""
    specs = [REGISTRY[n] for n in names]

    def apply(df: DataFrame, f: Frame) -> DataFrame:
        shared = base(df, f)
        columns: dict[str, Column] = {}
        for s in specs:
            columns |= s.block(f)
        keep = [c for c in ("symbol", "time", "bar_idx", "_home", "_block") if c in df.columns]
        return shared.select(*keep, *(c.alias(n) for n, c in columns.items()))

    if block_rows is None:
        return apply(start, Frame("symbol"))
    # shared columns look back too, so the halo covers both
    return in_blocks(start, ["symbol"], apply, max(s.lookback for s in specs) + 25, max(s.lookahead for s in specs), block_rows)


def after_warmup(features: DataFrame, rows: int = 80) -> DataFrame:
    return features.filter(F.col("bar_idx") >= rows)


def cross_market(wide: DataFrame, base_symbol: str, others: list[str], signs: dict[str, int], f: Frame) -> DataFrame:
    """K-bar returns, a signed basket, momentum, Wilder ranges, deviations and correlations across symbols.

    `wide` has, per symbol s, close_s and wilder_s on the base symbol's times; `signs` says how each symbol counts in
    the basket.
    """
    close = {s: F.col(f"close_{s}") for s in (base_symbol, *others)}
    ret = lambda s, k: close[s] / f.lag(f"close_{s}", k) - 1
    kept = [c for c in ("_home", "_block") if c in wide.columns]
    one = wide.withColumns({f"_r_{s}": ret(s, 1) for s in close})
    basket = lambda k: sum((F.lit(sign / len(signs)) * ret(s, k) for s, sign in signs.items()), F.lit(0.0))
    one = one.withColumn("_basket", basket(1))
    out = {f"{s}_return_{k}": ret(s, k) for s in others for k in (1, 3, 6, 12)}
    out |= {f"strength_{k}": basket(k) for k in (1, 4, 8, 12)}
    out["strength_norm_8"] = basket(8) / (f.std("_basket", 20, least=10) + SMALL)
    out |= {f"{s}_mom_{k}": (close[s] - f.mean(f"close_{s}", k)) / f.mean(f"close_{s}", k) for s in others for k in (4, 8, 12)}
    norm = {s: F.when(F.col("bar_idx") >= 13, F.col(f"wilder_{s}") / close[s]) for s in close}
    out |= {f"{s}_atr_norm_14": norm[s] for s in others} | {f"{s}_vol_std_20": f.std(f"_r_{s}", 20, least=10) for s in others}
    out |= {f"corr_{s}_{w}": f.corr(F.col(f"_r_{base_symbol}"), F.col(f"_r_{s}"), w) for s in others for w in (20, 40)}
    out |= {f"rel_vol_{s}": norm[base_symbol] / (norm[s] + SMALL) for s in others}
    return one.select("time", *kept, *(c.alias(n) for n, c in out.items()))


def aligned(bars: DataFrame, base_symbol: str, others: list[str]) -> DataFrame:
    """Bars of several symbols on the base symbol's times, one column for each; missing prices carry the last one.

    Adds the row index and Wilder ranges. A Wilder range starts at a symbol's first price.
    """
    times = bars.filter(F.col("symbol") == base_symbol).select("time")
    grid = times.crossJoin(F.broadcast(bars.sparkSession.createDataFrame([(s,) for s in (base_symbol, *others)], "symbol string")))
    joined = grid.join(bars.select("symbol", "time", "high", "low", "close"), ["symbol", "time"], "left")
    prices = ("high", "low", "close")
    marked = joined.withColumn("_range", F.floor(F.col("time") / BAR_RANGE))
    # the last price is carried inside ranges of time, and from range to range through one row a range
    last = lambda c, *keys, by, to: F.last(c, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, to))
    ends = marked.groupBy("symbol", "_range").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("time"))).alias(c) for c in prices))
    carry = ends.select("symbol", "_range", *(last(c, "symbol", by="_range", to=-1).alias(f"_{c}") for c in prices))
    inside = marked.select("symbol", "time", "_range", *(last(c, "symbol", "_range", by="time", to=0).alias(c) for c in prices))
    filled = inside.join(carry, ["symbol", "_range"]).select("symbol", "time", *(F.coalesce(c, f"_{c}").alias(c) for c in prices))
    known = with_row_index(filled.filter("close is not null"), ["symbol"], "time", 86_400 * 30)
    staged = in_blocks(known, ["symbol"], lambda df, f: df.withColumn("_tr", true_range(f)), 1, 0, 4096)
    ranged = exponential(staged, ["symbol"], {"wilder": (F.col("_tr"), 1.0 / 14, 0)})
    names = [base_symbol, *others]
    wide = ranged.groupBy("time").pivot("symbol", names).agg(F.first("close").alias("close"), F.first("wilder").alias("wilder"))
    return wide.select("time", *(F.col(f"`{s}_{c}`").alias(f"{c}_{s}") for s in names for c in ("close", "wilder")))

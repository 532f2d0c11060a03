"""Queries of features and labels (P, W, J02, J03, A14, A15, V18, V19, U01)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tickloom.operators import features, labels, quality
from tickloom.operators.frames import over_blocks
from tickloom.plans import sql as q
from tickloom.plans.catalog import query, rounded
from tickloom.sources.adapters import H1, H4, M15, bars

E8, E12 = "1e-8", "1e-12"
TS = "make_timestamp(time*1000000)"


def ema(x: str, alpha: float, first: int = 0) -> str:
    p = 1.0 - alpha
    weight = f"CASE WHEN i < {first} THEN 0.0 WHEN i = {first} THEN 1.0 ELSE {alpha!r} END"
    return f"CASE WHEN i >= {first} THEN pow({p!r}::DOUBLE, i) * sum(({weight}) * coalesce({x}, 0.0) * pow({p!r}::DOUBLE, -i)) OVER ({q.W} ROWS UNBOUNDED PRECEDING) END"


def flag(x: str) -> str:
    return f"CASE WHEN coalesce({x}, false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def staged(seconds: int) -> str:
    """Bars with the shared columns and the filters."""
    before = q.lag("close")
    first = f"f0 AS (SELECT *, row_number() OVER ({q.W}) - 1 AS i, {before} AS pc, ln(close/{before}) AS lr, close/{before} - 1 AS ret, greatest(high-low, abs(high-{before}), abs(low-{before})) AS tr, {flag(f'close > {before}')} AS up, time - {q.lag('time')} AS delta, greatest(close-{before}, 0.0) AS gain, greatest({before}-close, 0.0) AS loss FROM bars)"
    filters = ", ".join([*(f"{ema('close', 2.0 / (s + 1))} AS ema_{s}" for s in (10, 20, 40, 50, 80)), f"{ema('gain', 1 / 14, 1)} AS gain_14", f"{ema('loss', 1 / 14, 1)} AS loss_14"])
    second = f"f1 AS (SELECT *, {filters}, {q.mean('close', 10)} AS sma_10, {q.mean('close', 20)} AS sma_20, {q.std('lr', 20, 5)} AS v20, {q.roll('avg', 'tr', 14, 1)} AS atr1, CASE WHEN delta > 900 THEN i END AS gap_i FROM f0)"
    return f"{q.bars_with(seconds)}, {first}, {second}"


def digits_of(name: str) -> int:
    """Means of five-digit prices over 80 rows end at the ninth digit: fewer digits would meet rounding ties."""
    return 10 if name.startswith(("sma_", "atr_", "hl_range")) else 6


def select(seconds: int, columns: dict[str, str]) -> str:
    parts = ", ".join(q.rounded({n: x}, digits_of(n)) for n, x in columns.items())
    return f"{staged(seconds)} SELECT symbol, time, {parts} FROM f1"


def round_all(df):
    for d in (6, 10):
        df = rounded(df, *(c for c, t in df.dtypes if t == "double" and digits_of(c) == d), digits=d)
    return df


def block(spark, sf_dir, name: str, seconds: int, block_rows: int | None = 4096):
    return round_all(features.build(bars(spark, sf_dir, seconds), [name], block_rows).drop("bar_idx"))


def cyclic(name: str, value: str, period: float) -> dict[str, str]:
    return {f"sin_{name}": f"sin({value} * {2 * math.pi / period!r})", f"cos_{name}": f"cos({value} * {2 * math.pi / period!r})"}


HOUR, MINUTE, DAY = f"hour({TS})", f"minute({TS})", f"(isodow({TS}) - 1)"
SPAN, UPPER, LOWER = "(high-low)", "(high-greatest(open,close))", "(least(open,close)-low)"

PRICE = {
    "return_1": "ret", "log_return_1": "lr", "open_to_close_return": "(close-open)/open", "hl_range": SPAN, "hl_range_norm": f"{SPAN}/close", "candle_body": "abs(close-open)", "candle_body_norm": "abs(close-open)/close",
    "upper_wick": UPPER, "upper_wick_ratio": f"{UPPER}/({SPAN}+{E8})", "lower_wick": LOWER, "lower_wick_ratio": f"{LOWER}/({SPAN}+{E8})", "candle_direction": "CAST(sign(close-open) AS DOUBLE)", "return_mean_5": q.mean("lr", 5), "return_mean_20": q.mean("lr", 20),
}
CLOCK = {"hour": f"{HOUR}::DOUBLE", "minute": f"{MINUTE}::DOUBLE", "day_of_week": f"{DAY}::DOUBLE", **cyclic("hour", HOUR, 24.0), **cyclic("minute", MINUTE, 60.0), **cyclic("day_of_week", DAY, 7.0)} | {
    f"is_{n}": flag(f"{HOUR} BETWEEN {a} AND {b}") for n, a, b in (("asian_session", 0, 7), ("london_session", 7, 15), ("ny_session", 12, 20), ("rollover_window", 21, 23))
}
TREND = {f"sma_{w}": q.mean("close", w) for w in (10, 20, 40, 80)} | {f"ema_{w}": f"ema_{w}" for w in (10, 20, 40, 80)} | {f"dist_ema_{w}": f"(close-ema_{w})/ema_{w}" for w in (10, 20, 40, 80)}
TREND |= {f"ema_spread_{a}_{b}": f"(ema_{a}-ema_{b})/ema_{b}" for a, b in ((10, 40), (20, 80))} | {f"ema_slope_{w}": f"(ema_{w}-{q.lag(f'ema_{w}', 5)})/(5.0*{q.lag(f'ema_{w}', 5)})" for w in (10, 20)}
RSI = f"CASE WHEN i >= 14 THEN 100.0 - 100.0/(1.0 + gain_14/(loss_14+{E12})) END"
MOMENTUM = {f"roc_{w}": f"(close-{q.lag('close', w)})/{q.lag('close', w)}" for w in (5, 10, 20, 40, 80)} | {f"dist_sma_{w}": f"(close-{q.mean('close', w)})/({q.mean('close', w)})" for w in (10, 20, 40, 80)} | {"rsi_14": RSI}
STD = {w: f"({q.std('lr', w)})" for w in (10, 20, 40, 80)}
VOLATILITY = {f"vol_std_{w}": s for w, s in STD.items()} | {f"vol_ann_{w}": f"{STD[w]}*sqrt(24192)" for w in (20, 80)} | {f"atr_{w}": q.mean("tr", w) for w in (14, 40)} | {f"atr_norm_{w}": f"({q.mean('tr', w)})/close" for w in (14, 40)}
VOLATILITY |= {f"vol_ratio_{a}_{b}": f"{STD[a]}/({STD[b]}+{E8})" for a, b in ((10, 40), (20, 80))} | {"rolling_hl_ratio_20": f"(({q.roll('max', 'high', 20)})-({q.roll('min', 'low', 20)}))/close"}
V20, S20 = f"({q.mean('tick_volume', 20)})", f"({q.mean('spread', 20)})"
ACTIVITY = {
    "log_tick_volume": "ln(1+tick_volume)", "tick_vol_sma_20": V20, "tick_vol_ratio_20": f"tick_volume/({V20}+{E8})", "tick_vol_zscore_20": f"(tick_volume-{V20})/(({q.std('tick_volume', 20)})+{E8})",
    "tick_vol_zscore_80": f"(tick_volume-({q.mean('tick_volume', 80)}))/(({q.std('tick_volume', 80)})+{E8})", "spread_norm": "spread*1e-5/close", "spread_sma_20": S20, "spread_ratio_20": f"spread/({S20}+{E8})", "spread_zscore_20": f"(spread-{S20})/(({q.std('spread', 20)})+{E8})",
}
GAPS = {
    "delta_seconds": "delta::DOUBLE", "is_normal": flag("delta = 900"), "is_post_gap": flag("delta > 900"), "is_weekend_reopen": flag(f"delta > 900 AND delta >= 129600 AND {DAY} IN (6, 0)"),
    "bars_since_last_gap": f"least(i - coalesce(max(gap_i) OVER ({q.W} ROWS UNBOUNDED PRECEDING), 0), 96)::DOUBLE",
}
NEAR = f"(close+{E12})"
MAX = {w: f"({q.roll('max', 'high', w)})" for w in (5, 10, 20, 80)}
MIN = {w: f"({q.roll('min', 'low', w)})" for w in (5, 10, 20, 80)}
LAG = {k: q.lag("close", k) for k in (1, 5, 10, 20)}
VOL5 = f"(({q.mean('tick_volume', 5)})/({V20}+{E12}))"
RUN = {k: f"coalesce(lag(sign(close-open), {k}) OVER ({q.W}) = sign(close-open), false)" for k in range(1, 6)}
EXTENDED = {
    "dist_high_20": f"({MAX[20]}-close)/{NEAR}", "dist_low_20": f"(close-{MIN[20]})/{NEAR}", "dist_high_80": f"({MAX[80]}-close)/{NEAR}", "dist_low_80": f"(close-{MIN[80]})/{NEAR}",
    "channel_width_20": f"({MAX[20]}-{MIN[20]})/{NEAR}", "channel_width_80": f"({MAX[80]}-{MIN[80]})/{NEAR}", "breakout_high_20": flag(f"high >= ({q.roll('max', 'high', 20, shift=1)})"), "breakout_low_20": flag(f"low <= ({q.roll('min', 'low', 20, shift=1)})"),
    "return_persistence_5": q.mean("up", 5), "return_persistence_20": q.mean("up", 20), "momentum_acceleration_5": f"((close-{LAG[5]})-({LAG[5]}-{LAG[10]}))/{NEAR}",
    "roc_acceleration_20": f"(close-{LAG[10]})/({LAG[10]}+{E12})-(close-{LAG[20]})/({LAG[20]}+{E12})", "range_expansion_ratio": f"{SPAN}/(({q.mean('tr', 14)})+{E12})", "range_compression_5": f"({MAX[5]}-{MIN[5]})/({MAX[20]}-{MIN[20]}+{E12})",
    "vol_regime_ratio_10_80": f"({q.std('ret', 10)})/(({q.std('ret', 80)})+{E12})", "high_low_wick_imbalance": f"({UPPER}-{LOWER})/({SPAN}+{E12})", "body_to_range_ratio": f"abs(close-open)/({SPAN}+{E12})",
    "trend_regime_score": f"({flag('close > sma_20')} + {flag(f'sma_20 > ({q.mean("close", 80)})')} + {flag('ema_10 > ema_20')} - 1.5)/1.5", "dist_daily_pivot": f"(close-({MAX[80]}+{MIN[80]}+pc)/3.0)/{NEAR}",
    "session_transition_london_open": flag(f"{HOUR} = 7"), "session_transition_ny_open": flag(f"{HOUR} = 12"), "session_transition_london_close": flag(f"{HOUR} IN (15, 16)"), "volume_momentum_5": VOL5, "volume_price_trend_5": f"(close/{LAG[5]}-1)*{VOL5}",
    "consecutive_direction_run": f"sign(close-open) * least(i, CASE WHEN NOT {RUN[1]} THEN 1 WHEN NOT {RUN[2]} THEN 2 WHEN NOT {RUN[3]} THEN 3 WHEN NOT {RUN[4]} THEN 4 ELSE 5 END)::DOUBLE",
}
SMA50 = f"({q.mean('close', 50)})"
RSTD = {w: f"({q.std('ret', w)})" for w in (5, 10, 20)}
ATR14 = f"({q.mean('tr', 14)})"
SWING = {f"return_{k}": f"close/{q.lag('close', k)} - 1" for k in (1, 2, 4, 8)} | {
    "hl_range_norm": f"{SPAN}/{NEAR}", "candle_body_norm": f"abs(close-open)/{NEAR}", "candle_direction": "CAST(sign(close-open) AS DOUBLE)", "upper_wick_ratio": f"{UPPER}/({SPAN}+{E12})", "lower_wick_ratio": f"{LOWER}/({SPAN}+{E12})",
    "dist_sma_10": f"(close-sma_10)/{NEAR}", "dist_sma_20": f"(close-sma_20)/{NEAR}", "dist_sma_50": f"(close-{SMA50})/{NEAR}", "sma_slope_10": f"(sma_10-{q.lag('sma_10', 3)})/{NEAR}", "sma_slope_20": f"(sma_20-{q.lag('sma_20', 5)})/{NEAR}",
    "ema_spread_10_20": f"(ema_10-ema_20)/{NEAR}", "trend_regime": f"({flag('close > sma_20')} + {flag(f'sma_20 > {SMA50}')} + {flag('ema_10 > ema_20')} - 1.5)/1.5", **{f"roc_{k}": f"(close-{LAG[k]})/({LAG[k]}+{E12})" for k in (5, 10, 20)},
    "rsi_14": RSI, "momentum_acceleration": f"((close-{LAG[5]})-({LAG[5]}-{LAG[10]}))/{NEAR}", "atr_14": ATR14, "atr_norm_14": f"{ATR14}/{NEAR}", "vol_std_10": RSTD[10], "vol_std_20": RSTD[20], "vol_ratio_5_20": f"{RSTD[5]}/({RSTD[20]}+{E12})",
    "dist_rolling_high_10": f"({MAX[10]}-close)/{NEAR}", "dist_rolling_low_10": f"(close-{MIN[10]})/{NEAR}", "dist_rolling_high_20": f"({MAX[20]}-close)/{NEAR}", "dist_rolling_low_20": f"(close-{MIN[20]})/{NEAR}", "rolling_hl_ratio_20": f"(close-{MIN[20]})/({MAX[20]}-{MIN[20]}+{E12})",
    "channel_width_20": f"({MAX[20]}-{MIN[20]})/{NEAR}", "breakout_high_10": flag(f"high >= ({q.roll('max', 'high', 10, shift=1)})"), "breakout_low_10": flag(f"low <= ({q.roll('min', 'low', 10, shift=1)})"), "vol_ratio_10": f"tick_volume/(({q.mean('tick_volume', 10)})+{E12})",
    "day_of_week": f"{DAY}::DOUBLE", **cyclic("day_of_week", DAY, 5.0), "hour": f"{HOUR}::DOUBLE", **cyclic("hour", HOUR, 24.0),
}
REALISED = f"({q.std('lr', 20, 5)})"
REGIME = {
    "slope_20": f"(CASE WHEN count(close) OVER ({q.W} ROWS 19 PRECEDING) >= 20 THEN regr_slope(close, i::DOUBLE) OVER ({q.W} ROWS 19 PRECEDING) END)/close", "dist_ema_50": "(close-ema_50)/ema_50", "trend_persistence_10": q.mean("up", 10), "atr_norm": "atr1/close", "realised_vol_20": REALISED,
    "vol_percentile_100": f"(v20-({q.roll('min', 'v20', 100, 20)}))/(({q.roll('max', 'v20', 100, 20)})-({q.roll('min', 'v20', 100, 20)})+{E12})", "range_position_20": f"(close-{MIN[20]})/({MAX[20]}-{MIN[20]}+{E12})", "dist_high_20": f"({MAX[20]}-close)/close",
    "breakout_state": f"{flag(f'close > ({q.roll("max", "high", 20, shift=1)})')} - {flag(f'close < ({q.roll("min", "low", 20, shift=1)})')}", "sign_mean_8": q.mean("CAST(sign(ret) AS DOUBLE)", 8),
    **{f"scaled_return_{k}": f"CASE WHEN {REALISED} IS NOT NULL AND {q.lag('close', k)} IS NOT NULL THEN least(greatest((close/{q.lag('close', k)}-1)/({REALISED}*{math.sqrt(k)!r}+{E12}), -5.0), 5.0) ELSE -5.0 END" for k in (4, 8)},
}

for _id, _name, _seconds, _columns in (
    ("P01_price", "price", M15, PRICE), ("P02_time", "time", M15, CLOCK), ("W01_trend", "trend", M15, TREND), ("W02_momentum", "momentum", M15, MOMENTUM), ("W03_volatility", "volatility", M15, VOLATILITY),
    ("W04_activity", "activity", M15, ACTIVITY), ("W05_gap_state", "gaps", M15, GAPS), ("W06_extended", "extended", M15, EXTENDED), ("W07_swing", "swing", H4, SWING), ("W09_regime", "regime", H4, REGIME),
):

    @query(_id, select(_seconds, _columns))
    def _features(spark, sf_dir, name=_name, seconds=_seconds):
        return block(spark, sf_dir, name, seconds)


@query("W06_extended_in_blocks", select(M15, EXTENDED))
def w06_blocks(spark, sf_dir):
    """The same features with long series cut into blocks with halos."""
    return block(spark, sf_dir, "extended", M15, 512)


_P19 = ["return_1", "return_4", "dist_sma_20", "rsi_14", "atr_norm_14", "vol_ratio_5_20", "trend_regime"]


@query("P19_baseline_features", select(H4, {n: SWING[n] for n in _P19}))
def p19(spark, sf_dir):
    return block(spark, sf_dir, "swing", H4).select("symbol", "time", *_P19)


_J02 = {**PRICE, **VOLATILITY, **MOMENTUM}


@query("J02_feature_matrix", f"WITH f2 AS ({select(M15, {'i': 'i', **_J02})}) SELECT * EXCLUDE (i) FROM f2 WHERE i >= 80")
def j02(spark, sf_dir):
    return round_all(features.after_warmup(features.build(bars(spark, sf_dir), ["price", "volatility", "momentum"])).drop("bar_idx"))


_WIDE = f"coalesce(atr1 > ({q.roll('median', 'atr1', 100, 20)}), false)"
_TRENDING = f"coalesce(abs(ema_20-ema_50)/(atr1+{E12}) > 0.5, false)"


@query("W10_regime_states", f"{staged(H4)} SELECT symbol, time, CASE WHEN {_TRENDING} AND {_WIDE} THEN 'TREND_WIDE' WHEN {_TRENDING} THEN 'TREND_CALM' WHEN {_WIDE} THEN 'RANGE_WIDE' ELSE 'RANGE_CALM' END AS regime_state FROM f1")
def w10(spark, sf_dir):
    return features.build(bars(spark, sf_dir, H4), ["regime_states"]).drop("bar_idx")


_HL = f"ln(greatest(greatest(high,{E12})/greatest(low,{E12}),1.0))"
_EST = {
    "parkinson": f"sqrt(greatest({_HL}*{_HL}/(4*ln(2)),0.0))", "garman_klass": f"sqrt(greatest(0.5*{_HL}*{_HL}-(2*ln(2)-1)*pow(ln(close/open),2),0.0))", "rogers_satchell": "sqrt(greatest(ln(high/close)*ln(high/open)+ln(low/close)*ln(low/open),0.0))",
}


@query("P03_P05_range_volatility", f"{q.bars_with(H1)} SELECT symbol, time, {q.rounded(_EST, 6)} FROM bars")
def p03(spark, sf_dir):
    b = bars(spark, sf_dir, H1)
    return rounded(b.select("symbol", "time", *(c.alias(n) for n, c in features.range_estimators().items())), *_EST, digits=6)


_W11 = {}
for _e in _EST:
    _W11 |= {f"{_e}_{w}": f"sqrt({q.mean(f'({_e}*{_e})', w)})" for w in (1, 6, 12, 24, 72)}
    _W11 |= {f"{_e}_change_{k}": f"{_e} - {q.lag(_e, k)}" for k in (1, 6)} | {f"{_e}_ratio_6_72": f"sqrt({q.mean(f'({_e}*{_e})', 6)})/(sqrt({q.mean(f'({_e}*{_e})', 72)})+{E12})"}


@query("W11_volatility_memory", f"{q.bars_with(H1)}, e AS (SELECT symbol, time, {', '.join(f'{x} AS {n}' for n, x in _EST.items())} FROM bars) SELECT symbol, time, {q.rounded(_W11, 6)} FROM e")
def w11(spark, sf_dir):
    e = bars(spark, sf_dir, H1).withColumns(features.range_estimators())
    out = over_blocks(e, lambda df, f: df.withColumns(features.volatility_memory(f)), 72).select("symbol", "time", *_W11)
    return rounded(out, *_W11, digits=6)


def _w12_sql(h: int) -> str:
    back, ahead = f"({q.W} ROWS {h - 1} PRECEDING)", f"({q.W} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    whole = f"count(lr) OVER {back} >= {h} AND count(lr) OVER {ahead} >= {h}"
    return f"{staged(H4)} SELECT symbol, time, round(CASE WHEN {whole} THEN sqrt(avg(lr*lr) OVER {back}) END, 6)+0.0 AS trailing_rv, round(CASE WHEN {whole} THEN sqrt(avg(lr*lr) OVER {ahead}) END, 6)+0.0 AS forward_rv FROM f1"


@query("W12_forward_trailing_rv", _w12_sql(6))
def w12(spark, sf_dir):
    out = over_blocks(bars(spark, sf_dir, H4), lambda df, f: df.withColumn("_log_return", features.log_return(f)).withColumns(features.realised_pair(f, 6)), 7, 6)
    return rounded(out.select("symbol", "time", "trailing_rv", "forward_rv"), "trailing_rv", "forward_rv", digits=6)


@query(
    "W14_volatility_autocorrelation",
    f"{q.bars_with(H1)}, e AS (SELECT symbol, time, {', '.join(f'{x} AS {n}' for n, x in _EST.items())} FROM bars), l AS (SELECT 'parkinson' AS series, symbol, time, parkinson AS v FROM e UNION ALL SELECT 'garman_klass', symbol, time, garman_klass FROM e), k AS (SELECT series, v, unnest([{', '.join(f'{{k: {k}, w: lag(v, {k}) OVER (PARTITION BY series, symbol ORDER BY time)}}' for k in (1, 2, 6, 24))}]) AS x FROM l) SELECT series, x.k AS lag, round(corr(v, x.w), 6)+0.0 AS autocorrelation FROM k GROUP BY ALL",
)
def w14(spark, sf_dir):
    from tickloom.operators.stats import autocorrelation

    e = bars(spark, sf_dir, H1).withColumns(features.range_estimators())
    return rounded(autocorrelation(e, ["parkinson", "garman_klass"], (1, 2, 6, 24)), "autocorrelation", digits=6)


SYMBOLS = ["purchase", "signup", "view"]
SIGNS = {"click": -1, "purchase": 1, "signup": -1, "view": 1}
_C = {s: f"close_{s}" for s in ("click", *SYMBOLS)}
_LAGT = lambda x, k: f"lag({x}, {k}) OVER (ORDER BY time)"
_ROLLT = lambda agg, x, n, least=None: f"CASE WHEN count({x}) OVER (ORDER BY time ROWS {n - 1} PRECEDING) >= {least or n} THEN {agg}({x}) OVER (ORDER BY time ROWS {n - 1} PRECEDING) END"
_RET = lambda s, k: f"({_C[s]}/{_LAGT(_C[s], k)} - 1)"
_BASKET = lambda k: "(0.0 + " + " + ".join(f"{sign / len(SIGNS)!r}*{_RET(s, k)}" for s, sign in SIGNS.items()) + ")"
_NORM = {s: f"(CASE WHEN i >= 13 THEN wilder_{s}/{_C[s]} END)" for s in _C}
_W08 = {f"{s}_return_{k}": _RET(s, k) for s in SYMBOLS for k in (1, 3, 6, 12)} | {f"strength_{k}": _BASKET(k) for k in (1, 4, 8, 12)} | {"strength_norm_8": f"{_BASKET(8)}/(({_ROLLT('stddev_samp', 'basket', 20, 10)})+{E8})"}
_W08 |= {f"{s}_mom_{k}": f"({_C[s]}-({_ROLLT('avg', _C[s], k)}))/({_ROLLT('avg', _C[s], k)})" for s in SYMBOLS for k in (4, 8, 12)}
_W08 |= {f"{s}_atr_norm_14": _NORM[s] for s in SYMBOLS} | {f"{s}_vol_std_20": _ROLLT("stddev_samp", f"r_{s}", 20, 10) for s in SYMBOLS}
_W08 |= {f"corr_{s}_{w}": f"CASE WHEN count(CASE WHEN r_click IS NOT NULL AND r_{s} IS NOT NULL THEN 1 END) OVER (ORDER BY time ROWS {w - 1} PRECEDING) >= {w} THEN corr(r_click, r_{s}) OVER (ORDER BY time ROWS {w - 1} PRECEDING) END" for s in SYMBOLS for w in (20, 40)}
_W08 |= {f"rel_vol_{s}": f"{_NORM['click']}/({_NORM[s]}+{E8})" for s in SYMBOLS}
_J03 = f"""{q.bars_with(H4)}, g AS (SELECT t.time, s.symbol, b.high, b.low, b.close FROM (SELECT time FROM bars WHERE symbol='click') t CROSS JOIN (VALUES ('click'),('purchase'),('signup'),('view')) s(symbol) LEFT JOIN bars b ON b.symbol = s.symbol AND b.time = t.time),
fill AS (SELECT symbol, time, last_value(high IGNORE NULLS) OVER w AS high, last_value(low IGNORE NULLS) OVER w AS low, last_value(close IGNORE NULLS) OVER w AS close FROM g WINDOW w AS (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING)),
k AS (SELECT *, row_number() OVER ({q.W}) - 1 AS i, greatest(high-low, abs(high-{q.lag("close")}), abs(low-{q.lag("close")})) AS tr FROM fill WHERE close IS NOT NULL), wl AS (SELECT symbol, time, close, {ema("tr", 1 / 14, 0)} AS wilder FROM k),
wide AS (SELECT time, {", ".join(f"any_value(close) FILTER (symbol='{s}') AS close_{s}, any_value(wilder) FILTER (symbol='{s}') AS wilder_{s}" for s in _C)} FROM wl GROUP BY time)"""


@query("J03_aligned_symbols", f"{_J03} SELECT time, {q.rounded([x for s in _C for x in (f'close_{s}', f'wilder_{s}')], 8)} FROM wide")
def j03(spark, sf_dir):
    out = features.aligned(bars(spark, sf_dir, H4), "click", SYMBOLS)
    return rounded(out, *(c for c in out.columns if c != "time"))


@query(
    "W08_cross_market",
    f"{_J03}, n AS (SELECT *, row_number() OVER (ORDER BY time) - 1 AS i, {', '.join(f'{_RET(s, 1)} AS r_{s}' for s in _C)} FROM wide), b AS (SELECT *, {'(0.0 + ' + ' + '.join(f'{sign / len(SIGNS)!r}*r_{s}' for s, sign in SIGNS.items()) + ')'} AS basket FROM n) SELECT time, {q.rounded(_W08, 6)} FROM b",
)
def w08(spark, sf_dir):
    from tickloom.operators.frames import BAR_RANGE, in_blocks, with_row_index

    wide = features.aligned(bars(spark, sf_dir, H4), "click", SYMBOLS).withColumn("market", F.lit("all"))
    indexed = with_row_index(wide, ["market"], "time", BAR_RANGE)
    out = in_blocks(indexed, ["market"], lambda df, f: features.cross_market(df, "click", SYMBOLS, SIGNS, f), 64, 0, 4096)
    return rounded(out, *(c for c in out.columns if c != "time"), digits=6)


# labels
_RANGED = f"{q.bars_with()}, t AS (SELECT *, greatest(high-low, abs(high-{q.lag('close')}), abs(low-{q.lag('close')})) AS tr FROM bars), a AS (SELECT *, ({q.mean('tr', 14)})/close AS an FROM t)"
_RANGED_H4 = _RANGED.replace(q.bars(900), q.bars(H4))
_FR = {h: f"({q.lead('close', h)}/close - 1.0)" for h in (1, 4, 8, 12, 16)}
_THREE = lambda r, b: f"CASE WHEN {r} > {b} THEN 1.0::DOUBLE WHEN {r} < -({b}) THEN -1.0::DOUBLE WHEN {r} >= -({b}) AND {r} <= {b} THEN 0.0::DOUBLE END"
_TWO = lambda r, b: f"CASE WHEN {r} > {b} THEN 1.0::DOUBLE WHEN {r} < -({b}) THEN -1.0::DOUBLE END"
_RETURNS, _DIRECTIONS, _SWINGS = {}, {}, {}
for _h in labels.HORIZONS:
    _RETURNS |= {f"future_return_{_h}": _FR[_h], f"future_log_return_{_h}": f"ln({q.lead('close', _h)}/close)", f"future_vol_adj_return_{_h}": f"{_FR[_h]}/(an+{E12})"}
    _DIRECTIONS |= {f"direction_{_h}": _THREE(_FR[_h], f"{labels.THRESHOLDS[_h]!r}::DOUBLE"), f"direction_vol_{_h}": _THREE(_FR[_h], f"an*{0.5 * math.sqrt(_h)!r}")}
for _h in (4, 8, 12):
    _SWINGS |= {f"future_return_{_h}": _FR[_h], f"direction_{_h}": _TWO(_FR[_h], "0.0"), f"direction_vol_{_h}": _TWO(_FR[_h], f"an*{0.5 * math.sqrt(_h)!r}"), f"baseline_{_h}": f"CASE WHEN close/{q.lag('close', _h)} - 1.0 < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END"}


def _labels(df):
    return rounded(df, *(c for c, t in df.dtypes if t == "double"), digits=6)


@query("W15_future_returns", f"{_RANGED} SELECT symbol, time, {q.rounded(_RETURNS, 6)} FROM a")
def w15(spark, sf_dir):
    return _labels(labels.label(bars(spark, sf_dir), labels.returns))


@query("W16_directions", f"{_RANGED} SELECT symbol, time, {q.rounded(_DIRECTIONS, 6)} FROM a")
def w16(spark, sf_dir):
    return _labels(labels.label(bars(spark, sf_dir), labels.directions))


@query("W17_swing_targets", f"{_RANGED_H4} SELECT symbol, time, {q.rounded(_SWINGS, 6)} FROM a")
def w17(spark, sf_dir):
    return _labels(labels.label(bars(spark, sf_dir, H4), labels.swing_targets))


@query("W19_label_matrix", f"{_RANGED} SELECT symbol, time, {q.rounded({**_RETURNS, **_DIRECTIONS}, 6)} FROM a")
def w19(spark, sf_dir):
    return _labels(labels.label(bars(spark, sf_dir)))


_L4 = f"l AS (SELECT symbol, time, {_FR[4]} AS r, {_DIRECTIONS['direction_4']} AS d, {_DIRECTIONS['direction_vol_4']} AS v FROM a)"


@query("W18_alternative_targets", f"{_RANGED}, {_L4} SELECT symbol, time, CASE WHEN d <> 0 THEN d END AS target_a, {_TWO('r', '0.0')} AS target_b, CASE WHEN v <> 0 THEN v END AS target_c, CASE WHEN abs(r) > 0.0002::DOUBLE THEN CAST(sign(r) AS DOUBLE) END AS target_d FROM l")
def w18(spark, sf_dir):
    made = labels.label(bars(spark, sf_dir))
    return made.select("symbol", "time", *(c.alias(n) for n, c in labels.alternatives(4).items()))


@query(
    "A14_label_balance",
    f"{_RANGED_H4.replace(q.bars(H4), q.bars(H1))}, {_L4}, c AS (SELECT symbol, count(d) AS n_valid, {q.count_if('d = 1')} AS n_long, {q.count_if('d = 0')} AS n_neutral, {q.count_if('d = -1')} AS n_short FROM l GROUP BY symbol) SELECT *, round(n_long*100.0::DOUBLE/nullif(n_valid,0),6)+0.0 AS long_pct, round(n_neutral*100.0::DOUBLE/nullif(n_valid,0),6)+0.0 AS neutral_pct, round(n_short*100.0::DOUBLE/nullif(n_valid,0),6)+0.0 AS short_pct, round(greatest(n_long,n_short)::DOUBLE/nullif(least(n_long,n_short),0),6)+0.0 AS imbalance FROM c",
)
def a14(spark, sf_dir):
    """Events to ticks to H1 bars to labels to class shares: the flagship query."""
    return labels.class_balance(labels.label(bars(spark, sf_dir, H1), labels.directions), "direction_4")


_Q7 = (("p01", 0.01), ("p05", 0.05), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95), ("p99", 0.99))


@query(
    "A14_return_distribution",
    f"{_RANGED}, l AS (SELECT unnest([{', '.join(f'''{{label: 'future_return_{h}', v: {_FR[h]}}}''' for h in (1, 4, 8))}]) AS x FROM a) SELECT x.label AS label, count(x.v) AS n_valid, round(avg(x.v),6)+0.0 AS mean_value, round(stddev_samp(x.v),6)+0.0 AS std_value, round(min(x.v),6)+0.0 AS min_value, round(max(x.v),6)+0.0 AS max_value, {', '.join(f'round(quantile_cont(x.v,{p}),6)+0.0 AS {n}' for n, p in _Q7)} FROM l GROUP BY 1",
)
def a14_returns(spark, sf_dir):
    return _labels(labels.distribution(labels.label(bars(spark, sf_dir), labels.returns), [f"future_return_{h}" for h in (1, 4, 8)]))


@query(
    "A15_swing_distribution",
    f"{_RANGED_H4}, l AS (SELECT unnest([{', '.join(f'''{{h: {h}, d: {_TWO(_FR[h], '0.0')}, r: {_FR[h]}}}''' for h in (4, 8, 12))}]) AS x FROM a) SELECT x.h AS horizon, count(x.d) AS n_sample, round((count(*)-count(x.d))*100.0/count(*),6)+0.0 AS excluded_pct, round({q.count_if('x.d > 0')}*100.0/count(x.d),6)+0.0 AS long_pct, round({q.count_if('x.d < 0')}*100.0/count(x.d),6)+0.0 AS short_pct, round(avg(CASE WHEN x.d IS NOT NULL THEN x.r END)*10000,6)+0.0 AS mean_bps, round(quantile_cont(CASE WHEN x.d IS NOT NULL THEN x.r END,0.5)*10000,6)+0.0 AS median_bps FROM l GROUP BY 1",
)
def a15(spark, sf_dir):
    return _labels(labels.swing_distribution(labels.label(bars(spark, sf_dir, H4), labels.swing_targets), (4, 8, 12)))


_V18 = ["return_1", "return_mean_20", "hl_range", "candle_direction"]


@query(
    "V18_feature_quality",
    f"{staged(M15)}, p AS (SELECT symbol, time, unnest([{', '.join(f'''{{feature: '{n}', v: {PRICE[n]}}}''' for n in _V18)}]) AS x FROM f1), g AS (SELECT x.feature AS feature, count(*) AS n_rows, count(*)-count(x.v) AS n_missing, CAST(0 AS BIGINT) AS n_infinite, min(x.v) AS mn, max(x.v) AS mx, avg(x.v) AS av, var_samp(x.v) AS va, min(CASE WHEN x.v IS NOT NULL THEN time END) AS first_valid, max(CASE WHEN x.v IS NOT NULL THEN time END) AS last_valid FROM p GROUP BY 1) SELECT feature, n_rows, n_missing, n_infinite, round(mn,6)+0.0 AS min_value, round(mx,6)+0.0 AS max_value, round(av,6)+0.0 AS mean_value, round(va,6)+0.0 AS variance, first_valid, last_valid, round(n_missing*100.0/n_rows,6)+0.0 AS missing_pct, coalesce(TRY_CAST(nullif(regexp_extract(feature,'(\\d+)',1),'') AS INT),0) AS lookback, CASE WHEN n_missing*100.0/n_rows > 25 OR coalesce(va,0) < 1e-12 THEN 'REJECTED' ELSE 'OK' END AS status FROM g",
)
def v18(spark, sf_dir):
    return _labels(quality.feature_quality(features.build(bars(spark, sf_dir), ["price"]), _V18))

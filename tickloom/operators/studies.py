"""Composed studies: sliced metrics, confirmations, persistence, folds over valid rows, tick paths, event trades, governance, whole jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators import asof, explore, micro
from tickloom.operators.frames import BAR_RANGE, running


def persistence(past_return: Column) -> Column:
    """The sign of the past return; a missing or unmoved one counts as down."""
    return F.when(past_return > 0, 1.0).otherwise(-1.0)


def sliced_metrics(calls: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """Metrics of two-way calls (y_true, y_pred of 1 and -1) in each of many slices, in one pass over the rows.

    A slice without rows, or with one class only, says so in `status`.
    """
    hit = F.col("y_true") == F.col("y_pred")
    named = {n: F.coalesce(m, F.lit(False)) for n, m in masks.items()}
    counts = {}
    for k, m in enumerate(named.values()):
        counts |= {f"n{k}": m, f"h{k}": m & hit, f"u{k}": m & (F.col("y_true") == 1), f"hu{k}": m & (F.col("y_true") == 1) & hit, f"d{k}": m & (F.col("y_true") == -1), f"hd{k}": m & (F.col("y_true") == -1) & hit}
    row = calls.agg(F.count("*").alias("n_all"), *(F.count_if(c).alias(n) for n, c in counts.items()))
    structs = [F.struct(F.lit(n).alias("slice"), *(F.col(f"{c}{k}").alias(a) for c, a in (("n", "n"), ("h", "hits"), ("u", "n_long"), ("hu", "hits_long"), ("d", "n_short"), ("hd", "hits_short")))) for k, n in enumerate(named)]
    out = row.select("n_all", F.explode(F.array(*structs)).alias("s")).select("n_all", "s.*")
    both = (F.col("n_long") > 0) & (F.col("n_short") > 0)
    share = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    return out.select(
        "slice", "n", "n_long", "n_short", ((1 - F.col("n") / F.nullif(F.col("n_all"), F.lit(0))) * 100).alias("pct_filtered"), share("hits", "n").alias("accuracy"),
        F.when(both, (share("hits_long", "n_long") + share("hits_short", "n_short")) / 2).alias("balanced_accuracy"),
        F.when(F.col("n") == 0, "NO_SAMPLES").when(~both, "SINGLE_CLASS").otherwise("VALID").alias("status"),
    )


def confirmations(direction: Column, rsi: Column, trend: Column) -> dict[str, Column]:
    """Masks of the base and of the rules A (direction), B (momentum), C (trend) and two of three."""
    up = F.col("y_pred") == 1
    rules = [F.col("y_pred") == direction, F.when(up, rsi > 50).otherwise(rsi < 50), F.when(up, trend > 0).otherwise(trend < 0)]
    a, b, c = (F.coalesce(r, F.lit(False)) for r in rules)
    return {"BASE": F.lit(True), "A": a, "B": b, "C": c, "TWO_OF_THREE": a.cast("int") + b.cast("int") + c.cast("int") >= 2}


#: Ranges of scores that ranks are counted in.
SCORE_RANGES = 256


def sliced_auc(calls: DataFrame, masks: dict[str, Column], score: str) -> DataFrame:
    """(slice, auc) of many overlapping slices: the chance that a long row outranks a short one, ties counting half.

    One table of distinct scores holds every slice's counts, so a row is read once whatever the slices it lies in. Running
    counts go inside ranges of scores, whose bounds come from a sketch, and start from the counts of earlier ranges; any
    bounds give the same result. Rows without a score take no part; a slice of one class has none.
    """
    names = list(masks)
    up = F.col("y_true") == 1
    counted = {f"{side}{k}": F.count_if(F.coalesce(m, F.lit(False)) & (up if side == "p" else ~up)) for k, m in enumerate(masks.values()) for side in ("p", "n")}
    cells = calls.filter(F.col(score).isNotNull() & F.col("y_true").isin(1, -1)).groupBy(F.col(score).alias("_v")).agg(*(c.alias(n) for n, c in counted.items()))
    bounds = cells.agg(F.approx_percentile("_v", [k / SCORE_RANGES for k in range(1, SCORE_RANGES)], 2000).alias("_bounds"))
    placed = cells.crossJoin(F.broadcast(bounds)).withColumn("_range", F.size(F.filter("_bounds", lambda b: b < F.col("_v")))).drop("_bounds")  # one row
    ranges = placed.groupBy("_range").agg(*(F.sum(n).alias(n) for n in counted))  # SCORE_RANGES rows
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("_range", *(F.coalesce(F.sum(f"n{k}").over(earlier), F.lit(0)).alias(f"_o{k}") for k in range(len(names))))
    inside = Window.partitionBy("_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    below = placed.withColumns({f"_b{k}": F.coalesce(F.sum(f"n{k}").over(inside), F.lit(0)) for k in range(len(names))}).join(F.broadcast(offsets), "_range")
    won = [F.sum(F.col(f"p{k}") * (F.col(f"_b{k}") + F.col(f"_o{k}") + F.col(f"n{k}") / 2.0)) for k in range(len(names))]
    pairs = [F.sum(f"p{k}") * F.sum(f"n{k}") for k in range(len(names))]
    row = below.agg(*(F.struct(F.lit(n).alias("slice"), (w / F.nullif(p, F.lit(0))).alias("auc")).alias(f"s{k}") for k, (n, w, p) in enumerate(zip(names, won, pairs, strict=True))))
    return row.select(F.explode(F.array(*(F.col(f"s{k}") for k in range(len(names))))).alias("s")).select("s.*")


def regime_slices(atr_median: Column, channel_median: Column) -> dict[str, Column]:
    """Masks over the columns of the swing features."""
    atr, width, trend, ratio, hour, day = (F.col(c) for c in ("atr_norm_14", "channel_width_20", "trend_regime", "vol_ratio_5_20", "hour", "day_of_week"))
    return {
        "atr_low": atr <= atr_median, "atr_high": atr > atr_median, "compression": ratio <= 1, "expansion": ratio > 1,
        "bullish": trend == 1, "bearish": trend == -1, "mixed": F.abs(trend) < 1, "ranging": width <= channel_median, "breakout": width > channel_median,
        **{f"hour_{h}": hour == h for h in range(0, 24, 4)}, "early_week": day <= 1, "mid_week": day == 2, "late_week": day >= 3,
    }


def folds_before_holdout(df: DataFrame, n_folds: int, purge: int, least_share: float = 0.22) -> DataFrame:
    """Folds over valid rows (usable_idx, n_usable); train ends `purge` raw bars (bar_idx) before the first validation bar.

    Validation slices are equal; the last takes the remainder. Folds count from 1.
    """
    start = F.floor(F.col("n_usable") * F.lit(least_share))
    size = F.floor((F.col("n_usable") - start) / n_folds)
    spread = df.withColumn("fold_idx", F.explode(F.sequence(F.lit(1), F.lit(n_folds))))
    begin = start + (F.col("fold_idx") - 1) * size
    end = F.when(F.col("fold_idx") < n_folds, begin + size).otherwise(F.col("n_usable"))
    marked = spread.withColumn("_v", (F.col("usable_idx") >= begin) & (F.col("usable_idx") < end))
    firsts = marked.filter("_v").groupBy("symbol", "fold_idx").agg(F.min("bar_idx").alias("_first"))  # one row a symbol and fold
    role = F.when(F.col("_v"), "validation").when(F.col("bar_idx") <= F.col("_first") - purge - 1, "train")
    return marked.join(firsts, ["symbol", "fold_idx"]).withColumn("role", role).filter("role is not null").drop("_v", "_first")


def stepped_folds(df: DataFrame, n_folds: int, horizon: int, initial: float = 0.4) -> DataFrame:
    """Folds over all rows (bar_idx, n_rows): both train and validation lose `horizon` rows at their end."""
    start = F.floor(F.col("n_rows") * F.lit(initial))
    size = F.floor((F.col("n_rows") - start) / n_folds)
    spread = df.withColumn("fold_idx", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    begin = start + F.col("fold_idx") * size
    end = F.when(F.col("fold_idx") < n_folds - 1, begin + size).otherwise(F.col("n_rows"))
    role = F.when(F.col("bar_idx") < begin - horizon, "train").when((F.col("bar_idx") >= begin) & (F.col("bar_idx") < end - horizon), "validation")
    return spread.withColumn("role", role).filter("role is not null")


def governance(table: DataFrame, least_rows: dict[str, int], purge: int, forbidden: set[str], features: list[str], classes: set[float], target: str) -> DataFrame:
    """Named checks of each symbol's split table (split, time, usable_idx, target) before its test rows may be used."""
    is_ = lambda s: F.col("split") == s
    row = table.groupBy("symbol").agg(
        *(F.count_if(is_(s)).alias(f"n_{s}") for s in least_rows), *(F.min(F.when(is_(s), F.col("time"))).alias(f"from_{s}") for s in least_rows), *(F.max(F.when(is_(s), F.col("time"))).alias(f"to_{s}") for s in least_rows),
        *(F.min(F.when(is_(s), F.col("usable_idx"))).alias(f"first_{s}") for s in least_rows), *(F.max(F.when(is_(s), F.col("usable_idx"))).alias(f"last_{s}") for s in least_rows),
        F.array_sort(F.collect_set(F.when(is_("test"), F.col(target)))).alias("classes"),
    )
    rules = {
        "row_counts": " and ".join(f"n_{s} >= {n}" for s, n in least_rows.items()),
        "chronology": "to_train < from_validation and to_validation < from_test",
        "purge_gap": f"first_validation - last_train >= {purge} and first_test - last_validation >= {purge}",
        "forbidden_columns": "false" if forbidden & set(features) else "true",
        "classes": f"classes = array({', '.join(f'double({c})' for c in sorted(classes))})",
    }
    rows = F.array(*(F.struct(F.lit(n).alias("check"), F.coalesce(F.expr(r), F.lit(False)).alias("passed")) for n, r in rules.items()))
    return row.select("symbol", F.explode(rows).alias("r")).select("symbol", "r.*")


def merged_reports(legacy: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Both deduplicated by key (the row that is first in all columns stays), then joined to the left."""
    one = lambda df: df.groupBy(*keys).agg(F.min(F.struct(*(c for c in df.columns if c not in keys))).alias("_r")).select(*keys, "_r.*")
    return one(legacy).join(one(other), keys, "left")


def tick_barriers(signals: DataFrame, ticks: DataFrame, take: float, stop: float, minutes: int, tolerance: int, bucket: int) -> DataFrame:
    """Outcome on the tick path: LONG enters at the ask and leaves on the bid, SHORT the other way round.

    `signals` has trade_id, symbol, direction and signal_msc. The first tick that touches a level counts, the stop before
    the target; without a touch the last tick of the window; without an entry tick in `tolerance`, DATA_UNAVAILABLE.
    """
    quotes = ticks.select("symbol", "time_msc", "event_id", "bid", "ask")
    entered = asof.asof(signals, quotes, ["symbol"], "signal_msc", "time_msc", ["bid", "ask"], bucket, tolerance, forward=True, ties=["event_id"], prefix="entry_")
    long = F.col("direction") == "LONG"
    sign = F.when(long, 1.0).otherwise(-1.0)
    entered = entered.withColumn("entry", F.when(long, F.col("entry_ask")).otherwise(F.col("entry_bid")))
    entered = entered.withColumn("stop", F.col("entry") * (1 - sign * stop)).withColumn("target", F.col("entry") * (1 + sign * take)).withColumn("until", F.col("entry_time_msc") + minutes * 60_000)
    held = asof.in_windows(quotes, entered.filter("entry is not null").drop("entry_bid", "entry_ask"), ["symbol"], "time_msc", "entry_time_msc", "until", bucket).withColumn("price", F.when(long, F.col("bid")).otherwise(F.col("ask")))
    touch = F.when(sign * (F.col("price") - F.col("stop")) <= 0, "STOP_LOSS").when(sign * (F.col("price") - F.col("target")) >= 0, "TAKE_PROFIT")
    order = F.struct("time_msc", "event_id")
    marked = held.withColumn("touch", touch)
    ends = marked.groupBy("trade_id").agg(F.min_by(F.struct("touch", "price"), F.when(F.col("touch").isNotNull(), order)).alias("hit"), F.max_by("price", order).alias("last_price"))
    out = entered.join(ends, "trade_id", "left")
    reason = F.when(F.col("entry").isNull(), "DATA_UNAVAILABLE").otherwise(F.coalesce("hit.touch", F.lit("MAX_HOLD")))
    return out.select("trade_id", "symbol", "direction", "entry", reason.alias("exit_reason"), F.coalesce("hit.price", "last_price").alias("exit_price"))


def event_trades(events: DataFrame, bars: DataFrame, step: int, hold: int, costs: tuple[float, ...], bucket: int) -> DataFrame:
    """One row per event, entry mode and cost tier: entered at the event's next bar or one bar later, left `hold` seconds on.

    `events` has symbol, event_id, event_time and side (1 or -1). Events without both bars are left out.
    """
    modes = F.array(*(F.struct(F.lit(n).alias("mode"), F.lit(d).alias("delay")) for n, d in (("IMMEDIATE", 0), ("DELAYED", step))))
    wide = events.withColumn("_m", F.explode(modes)).select("*", "_m.*").drop("_m").withColumn("due", F.col("event_time") + F.col("delay"))
    opens = bars.select("symbol", "time", "open")
    entered = asof.asof(wide, opens, ["symbol"], "due", "time", ["open"], bucket, forward=True, prefix="entry_").withColumn("leave", F.col("entry_time") + hold)
    left = asof.asof(entered, opens, ["symbol"], "leave", "time", ["open"], bucket, forward=True, prefix="exit_").filter("entry_open is not null and exit_open is not null")
    gross = F.col("side") * (F.col("exit_open") / F.col("entry_open") - 1) * 10_000
    return left.withColumn("cost", F.explode(F.array(*map(F.lit, costs)))).withColumn("net", gross - F.col("cost"))


def validated(bars: DataFrame, step: int) -> DataFrame:
    """Sound bars with their instant, after the OHLC, spread and volume checks."""
    box = (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close"))
    sound = box & (F.col("low") > 0) & (F.col("spread") >= 0) & (F.col("tick_volume") > 0) & (F.col("time") % step == 0)
    return bars.filter(F.coalesce(sound, F.lit(False))).withColumn("timestamp", F.timestamp_seconds("time"))


def explored(bars: DataFrame, step: int) -> DataFrame:
    """The whole exploratory report in long form (symbol, section, name, value): prices (A03), times (A04), volumes over all symbols (A05), gaps by class and their longest (A06), steps."""

    def melted(made: DataFrame, section: str, *keys: str) -> DataFrame:
        measures = [c for c in made.columns if c not in ("symbol", *keys)]
        name = lambda c: F.concat_ws("/", *keys, F.lit(c))
        return made.select("symbol", F.explode(F.array(*(F.struct(name(c).alias("name"), F.col(c).cast("double").alias("value")) for c in measures))).alias("m")).select("symbol", F.lit(section).alias("section"), "m.*")

    found = micro.gaps(bars, step).groupBy("symbol", "gap_class").agg(F.count("*").alias("n"), F.max("missing_bars").alias("longest"))
    volumes = explore.volume_statistics(bars, ["tick_volume", "spread", "real_volume"]).withColumn("symbol", F.lit("all"))
    parts = [
        melted(explore.price_statistics(bars), "prices"),
        melted(explore.temporal_statistics(bars), "times", "kind", "value"),
        melted(volumes, "volumes", "column"),
        melted(found, "gaps", "gap_class"),
        melted(micro.gap_statistics(bars, step), "steps"),
    ]
    return reduce(DataFrame.unionByName, parts)


def split_report(usable: DataFrame, horizons: tuple[int, ...], embargo: int, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """Rows of each split for every horizon (the purge), with and without embargo."""
    cases = F.array(*(F.struct(F.lit(h).alias("horizon"), F.lit(e).alias("embargo")) for h in horizons for e in (0, embargo)))
    wide = usable.withColumn("_c", F.explode(cases)).select("*", "_c.*").drop("_c")
    i, n = F.col("usable_idx"), F.col("n_usable")
    a = F.floor(n * F.lit(float(train)))
    b = a + F.floor(n * F.lit(float(validation)))
    part = F.when(i < a - F.col("horizon"), "train").when((i >= a + F.col("embargo")) & (i < b - F.col("horizon")), "validation").when(i >= b + F.col("embargo"), "test")
    return wide.withColumn("split", part).filter("split is not null").groupBy("horizon", "embargo", "split").agg(F.count("*").alias("n_rows"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))


def drawdown_alerts(equity: DataFrame, keys: list[str], order: list[str], limit_pct: float) -> DataFrame:
    """Running peak, fall from it in percent, and whether it passes the limit; in time order of each account."""
    fall = (F.col("peak") - F.col("equity")) * 100.0 / F.nullif(F.col("peak"), F.lit(0.0))
    return running(equity, keys, order, F.max, "equity", "peak", BAR_RANGE).withColumn("drawdown_pct", fall).withColumn("is_alert", F.col("drawdown_pct") > limit_pct)



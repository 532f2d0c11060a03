"""Gaps, coverage and tick microstructure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.frames import BAR_RANGE, ID_RANGE, TICK_RANGE, running_sum, with_percentiles, with_previous

#: Month and day of the days on which the market is closed or nearly so, at a gap's start and end.
HOLIDAY_STARTS, HOLIDAY_ENDS = ("12-24", "12-25", "12-31", "01-01"), ("12-25", "12-26", "01-01", "01-02")
HOUR = 3600
#: Half-open UTC hours of the sessions.
SESSIONS = (("ASIAN", 7), ("LONDON", 12), ("OVERLAP", 16), ("NEW_YORK", 21), ("ROLLOVER", 24))


def gap_class(start: Column, end: Column) -> Column:
    """Class of a gap between two epochs; the order of the rules matters."""
    a, b, seconds = F.timestamp_seconds(start), F.timestamp_seconds(end), end - start
    sd, ed = F.weekday(a), F.weekday(b)
    holiday = F.date_format(a, "MM-dd").isin(*HOLIDAY_STARTS) | F.date_format(b, "MM-dd").isin(*HOLIDAY_ENDS)
    return (
        F.when((sd == 4) & ed.isin(6, 0) & seconds.between(36 * HOUR, 65 * HOUR), "WEEKEND")
        .when(sd.isin(4, 5) & ed.isin(6, 0, 1) & seconds.between(36 * HOUR, 80 * HOUR), F.when(holiday, "HOLIDAY").otherwise("WEEKEND"))
        .when(holiday & (seconds <= 72 * HOUR), "HOLIDAY")
        .when((sd < 4) & (ed < 4), "UNEXPECTED")
        .otherwise("UNCLASSIFIED")
    )


def _steps(bars: DataFrame) -> DataFrame:
    return with_previous(bars.select("symbol", "time"), ["symbol"], ["time"], {"start_time": "time"}, BAR_RANGE).withColumn("seconds", F.col("time") - F.col("start_time"))


def gaps(bars: DataFrame, step: int) -> DataFrame:
    """Each gap with its missing bars and class."""
    found = _steps(bars).filter(F.col("seconds") > step)
    return found.select("symbol", "start_time", F.col("time").alias("end_time"), "seconds", (F.floor(F.col("seconds") / step) - 1).cast("long").alias("missing_bars"), gap_class(F.col("start_time"), F.col("time")).alias("gap_class"))


def gap_statistics(bars: DataFrame, step: int) -> DataFrame:
    """A07."""
    normal = F.count_if(F.col("seconds") == step)
    return _steps(bars).groupBy("symbol").agg(F.count("seconds").alias("n_steps"), (normal * 100.0 / F.count("seconds")).alias("normal_pct"), F.max("seconds").alias("max_gap"))


def top_gaps(bars: DataFrame, step: int, n: int) -> DataFrame:
    """The n longest gaps."""
    return _steps(bars).filter(F.col("seconds") > step).select("symbol", "time", "seconds").orderBy(F.desc("seconds"), "symbol", "time").limit(n)


def spread_metrics(ticks: DataFrame) -> DataFrame:
    """A08."""
    s = F.col("spread_points")
    at = F.percentile(s, F.array(*(F.lit(p) for p in (0.5, 0.9, 0.95, 0.99))))
    missing = F.count_if(s.isNull()) * 100.0 / F.count("*")
    return ticks.groupBy("symbol").agg(
        F.count("*").alias("n_ticks"), F.avg(s).alias("mean_points"), at[0].alias("median_points"), at[1].alias("p90"), at[2].alias("p95"), at[3].alias("p99"), F.min(s).alias("min_points"), F.max(s).alias("max_points"), F.stddev_samp(s).alias("std_points"), missing.alias("missing_pct"),
    )


def intensity(ticks: DataFrame, minutes: tuple[int, ...]) -> DataFrame:
    """Tick counts of the bins that have ticks, for several bin widths in one pass."""
    widths = ticks.select("symbol", "time_msc", F.explode(F.array(*map(F.lit, minutes))).alias("minutes"))
    bins = widths.groupBy("symbol", "minutes", F.floor(F.col("time_msc") / (F.col("minutes") * 60_000)).alias("bin")).agg(F.count("*").alias("n"))
    return bins.groupBy("symbol", "minutes").agg(F.count("*").alias("n_bins"), F.avg("n").alias("mean_ticks"), F.percentile("n", F.lit(0.5)).alias("median_ticks"), F.max("n").alias("max_ticks"), F.min("n").alias("min_ticks"))


def direction(ticks: DataFrame, bits: tuple[int, ...]) -> DataFrame:
    """A10: rises, falls and unchanged quotes, and flag bits."""
    quotes = with_previous(ticks.select("symbol", "event_id", "flags", "bid", "ask"), ["symbol"], ["event_id"], {"_bid": "bid", "_ask": "ask"}, ID_RANGE)
    moves = quotes.select("symbol", "flags", *(F.signum(F.col(c) - F.col(f"_{c}")).alias(c) for c in ("bid", "ask")))
    counts = [F.count_if(F.col(c) * s > 0 if s else F.col(c) == 0).alias(f"{c}_{n}") for c in ("bid", "ask") for n, s in (("up", 1), ("down", -1), ("same", 0))]
    flags = [F.count_if(F.col("flags").bitwiseAND(b) > 0).alias(f"n_flag_{b}") for b in bits]
    return moves.groupBy("symbol").agg(*counts, (F.count_if(F.col("bid") > 0) / (F.count("*") - 1.0)).alias("bid_up_share"), *flags)


def intrabar_path(ticks: DataFrame, seconds: int) -> DataFrame:
    """Path length, range, net move, efficiency and turns inside each bar of two ticks or more."""
    bar = F.floor(F.col("time_msc") / (seconds * 1000)).cast("long")
    w = Window.partitionBy("symbol", "bar").orderBy("event_id")
    moves = ticks.withColumn("bar", bar).withColumn("d", F.col("bid") - F.lag("bid").over(w))
    turns = moves.filter("d != 0").withColumn("turn", F.signum("d") != F.lag(F.signum("d")).over(w)).groupBy("symbol", "bar").agg(F.count_if("turn").alias("n_turns"))
    net = F.max_by("bid", "event_id") - F.min_by("bid", "event_id")
    whole = moves.groupBy("symbol", "bar").agg(F.count("*").alias("n_ticks"), F.sum(F.abs("d")).alias("path_length"), (F.max("bid") - F.min("bid")).alias("price_range"), net.alias("net_move")).filter("n_ticks >= 2")
    out = whole.join(turns, ["symbol", "bar"], "left").withColumn("n_turns", F.coalesce("n_turns", F.lit(0)))
    efficiency = F.when(F.col("path_length") > 1e-9, F.abs("net_move") / F.col("path_length"))
    return out.select("symbol", (F.col("bar") * seconds).alias("time"), "n_ticks", "path_length", "price_range", "net_move", efficiency.alias("efficiency"), "n_turns")


def realized_volatility(ticks: DataFrame, seconds: int) -> DataFrame:
    """Sums over the log returns inside each bar of three ticks or more."""
    bar = F.floor(F.col("time_msc") / (seconds * 1000)).cast("long")
    w = Window.partitionBy("symbol", "bar").orderBy("event_id")
    r = F.log("bid") - F.log(F.lag("bid").over(w))
    out = ticks.withColumn("bar", bar).withColumn("r", r).groupBy("symbol", "bar").agg(F.count("*").alias("n_ticks"), F.sum(F.col("r") * F.col("r")).alias("realized_variance"), F.sum(F.abs("r")).alias("absolute_variation"), F.stddev_pop("r").alias("std_return")).filter("n_ticks >= 3")
    return out.select("symbol", (F.col("bar") * seconds).alias("time"), "n_ticks", "realized_variance", F.sqrt("realized_variance").alias("realized_volatility"), "absolute_variation", "std_return")


def session_of(hour: Column) -> Column:
    return reduce(lambda c, s: c.when(hour < s[1], s[0]), SESSIONS[1:], F.when(hour < SESSIONS[0][1], SESSIONS[0][0]))


def sessions(ticks: DataFrame) -> DataFrame:
    """Per session: share, spreads, ticks a minute over the session's whole span, median time between its ticks."""
    marked = ticks.withColumn("session", session_of(F.floor(F.col("time_msc") / 3_600_000) % 24))
    marked = with_previous(marked, ["symbol", "session"], ["event_id"], {"_before": "time_msc"}, ID_RANGE).withColumn("gap", F.col("time_msc") - F.col("_before"))
    s = F.col("spread_points")
    keys = ["symbol", "session"]
    per = marked.groupBy(*keys).agg(F.count("*").alias("n_ticks"), F.avg(s).alias("mean_points"), (F.count("*") * 60_000.0 / F.nullif(F.max("time_msc") - F.min("time_msc"), F.lit(0))).alias("ticks_per_minute"))
    per = with_percentiles(per, marked, keys, "spread_points", {"median_points": 0.5, "p95_points": 0.95})
    per = with_percentiles(per, marked, keys, "gap", {"median_gap_ms": 0.5})
    total = F.sum("n_ticks").over(Window.partitionBy("symbol"))  # five rows a symbol
    return per.withColumn("share", F.col("n_ticks") / total)


def coverage(ticks: DataFrame, most_gap_msc: int) -> DataFrame:
    """Runs of ticks with no gap beyond the limit."""
    stepped = with_previous(ticks.select("symbol", "time_msc"), ["symbol"], ["time_msc"], {"_before": "time_msc"}, TICK_RANGE)
    cut = F.when(F.col("time_msc") - F.col("_before") > most_gap_msc, 1).otherwise(0)
    islands = running_sum(stepped.withColumn("cut", cut), ["symbol"], "time_msc", "cut", "island", TICK_RANGE)
    return islands.groupBy("symbol", "island").agg(F.min("time_msc").alias("start_msc"), F.max("time_msc").alias("end_msc"), F.count("*").alias("n_ticks"))


def drop_adjacent(df: DataFrame, columns: list[str], order: list[str], width: int) -> DataFrame:
    """Rows that differ from their predecessor in one of the columns; ranges of `width` as in `with_previous`."""
    before = with_previous(df.withColumn("_row", F.lit(True)), ["symbol"], order, {"_known": "_row"} | {f"_b{k}": c for k, c in enumerate(columns)}, width)
    same = reduce(lambda a, b: a & b, (F.col(f"_b{k}").eqNullSafe(F.col(c)) for k, c in enumerate(columns)), F.col("_known").isNotNull())
    return before.filter(~same).select(*df.columns)


def merge_extracts(extracts: list[DataFrame]) -> DataFrame:
    """Union of overlapping extracts; the first that has a bar wins. Adds `extract`, from 1."""
    union = reduce(DataFrame.unionByName, (e.withColumn("extract", F.lit(i + 1)) for i, e in enumerate(extracts)))
    best = Window.partitionBy("symbol", "time").orderBy("extract")
    return union.withColumn("_rn", F.row_number().over(best)).filter("_rn = 1").drop("_rn")


def overlap_mismatches(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows that two extracts share, and in how many each column differs."""
    both = a.select(*keys, *columns).join(b.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns)), keys)
    return both.agg(F.count("*").alias("n_overlap"), *(F.count_if(~F.col(c).eqNullSafe(F.col(f"_{c}"))).alias(f"{c}_mismatch") for c in columns))


def reconstruction_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Largest price differences of bars that two sources share."""
    prices = ("open", "high", "low", "close")
    both = a.select("symbol", "time", *prices).join(b.select("symbol", "time", *(F.col(p).alias(f"_{p}") for p in prices)), ["symbol", "time"])
    return both.agg(F.count("*").alias("n_matched"), *(F.max(F.abs(F.col(p) - F.col(f"_{p}"))).alias(f"{p}_diff") for p in prices))

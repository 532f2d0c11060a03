"""Data-quality audits: one row for each symbol (or for the table), computed in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.frames import BAR_RANGE, ID_RANGE, with_percentiles, with_previous
from pyspark.sql.types import DoubleType, FloatType, IntegralType, NumericType

PRICES = ("open", "high", "low", "close")
BAR_FLOATS, BAR_WHOLES = PRICES, ("time", "tick_volume", "spread", "real_volume")


def _some(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _sum_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def validate_schema(df: DataFrame, strict: bool = False) -> DataFrame:
    """(check, column) rows of missing and unexpected columns and wrong types; reads the schema only, and one row."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    rows = [("missing", c) for c in (*BAR_WHOLES[:1], *BAR_FLOATS, *BAR_WHOLES[1:]) if c not in fields]
    rows += [("not_float", c) for c in BAR_FLOATS if c in fields and isinstance(fields[c], NumericType) and not isinstance(fields[c], (DoubleType, FloatType))]
    rows += [("not_whole", c) for c in BAR_WHOLES if c in fields and isinstance(fields[c], NumericType) and not isinstance(fields[c], IntegralType)]
    rows += [("not_numeric", c) for c in (*BAR_FLOATS, *BAR_WHOLES) if c in fields and not isinstance(fields[c], NumericType)]
    if strict:
        rows += [("unexpected", c) for c in fields if c not in (*BAR_FLOATS, *BAR_WHOLES)]
    if df.isEmpty():
        rows.append(("empty", ""))
    return df.sparkSession.createDataFrame(rows, "check string, column string")


def _stepped(df: DataFrame, name: str) -> DataFrame:
    """Adds the seconds since the bar before."""
    return with_previous(df, ["symbol"], ["time"], {"_prior": "time"}, BAR_RANGE).withColumn(name, F.col("time") - F.col("_prior")).drop("_prior")


def validate_timestamps(df: DataFrame, sequence: list[str], time: str = "time", width: int = ID_RANGE) -> DataFrame:
    """Non-positive, null and duplicate times, order violations by ingest sequence (in ranges of `width` of its first column), bounds."""
    stepped = with_previous(df.select("symbol", time, *sequence), ["symbol"], sequence, {"_prior": time}, width)
    return stepped.withColumn("_step", F.col(time) - F.col("_prior")).groupBy("symbol").agg(
        F.count("*").alias("n_rows"),
        _sum_if(F.col(time).isNull()).alias("n_null"),
        _sum_if(F.col(time) <= 0).alias("n_non_positive"),
        (F.count(time) - F.count_distinct(time)).alias("n_duplicate"),
        _sum_if(F.col("_step") < 0).alias("n_out_of_order"),
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
    )


def ohlc_counts() -> dict[str, Column]:
    o, h, l, c = map(F.col, PRICES)
    bad = [F.isnan(p) | p.isin(float("inf"), float("-inf")) for p in (o, h, l, c)]
    return {
        "n_high_below_low": _sum_if(h < l),
        "n_high_below_open": _sum_if(h < o),
        "n_high_below_close": _sum_if(h < c),
        "n_low_above_open": _sum_if(l > o),
        "n_low_above_close": _sum_if(l > c),
        "n_missing": sum((_sum_if(p.isNull() | F.isnan(p)) for p in (o, h, l, c)), F.lit(0)),
        "n_infinite": sum((_sum_if(b & ~F.isnan(p)) for b, p in zip(bad, (o, h, l, c), strict=True)), F.lit(0)),
        "n_non_positive": sum((_sum_if(p <= 0) for p in (o, h, l, c)), F.lit(0)),
    }


def validate_ohlc(df: DataFrame) -> DataFrame:
    """Geometry, missing, infinite and non-positive counts of the four prices, their total and validity."""
    counts = ohlc_counts()
    total = sum((F.col(n) for n in counts), F.lit(0))
    return df.groupBy("symbol").agg(F.count("*").alias("n_rows"), *(c.alias(n) for n, c in counts.items())).withColumn("n_total", total.cast("long")).withColumn("is_valid", F.col("n_total") == 0)


def validate_spread(df: DataFrame, spread: str = "spread") -> DataFrame:
    """V05."""
    s = F.col(spread)
    at = F.percentile(s, F.array(*(F.lit(p) for p in (0.25, 0.5, 0.75, 0.95, 0.99))))
    out = df.groupBy("symbol").agg(
        _sum_if(s < 0).alias("n_negative"), _sum_if(s == 0).alias("n_zero"), _sum_if(s.isNull()).alias("n_missing"), F.min(s).alias("min_spread"), F.max(s).alias("max_spread"), F.round(F.avg(s), 2).alias("mean_spread"), at.alias("_q")
    )
    return out.select("*", *(F.col("_q")[i].alias(n) for i, n in enumerate(("p25", "median", "p75", "p95", "p99")))).drop("_q")


def validate_volume(df: DataFrame, volume: str = "tick_volume", real: str = "real_volume") -> DataFrame:
    """V06."""
    v, r = F.col(volume), F.col(real)
    return df.groupBy("symbol").agg(
        _sum_if(v.isNull()).alias("n_missing"), _sum_if(v == 0).alias("n_zero"), F.min(v).alias("min_volume"), F.max(v).alias("max_volume"), F.round(F.avg(v), 2).alias("mean_volume"), F.percentile(v, F.lit(0.5)).alias("median_volume"),
        F.round(_sum_if(r == 0) * 100.0 / F.count("*"), 4).alias("real_volume_zero_pct"),
    )


def duplicates_and_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """Full-row duplicates and null cells."""
    folded = df.groupBy(*columns).agg(F.count("*").alias("_n"))
    nulls = sum((F.col(c).isNull().cast("long") for c in columns), F.lit(0))
    return folded.agg(F.sum(F.col("_n") - 1).alias("n_duplicate_rows"), F.sum(nulls * F.col("_n")).alias("n_null_cells"))


def validate_market_data(df: DataFrame, step: int) -> DataFrame:
    """Critical errors and warnings of each symbol, PASS or FAIL."""
    counts = ohlc_counts()
    got = _stepped(df, "_gap").groupBy("symbol").agg(
        *(c.alias(n) for n, c in counts.items()),
        (F.count("time") - F.count_distinct("time")).alias("n_duplicate"),
        _sum_if(F.col("spread") < 0).alias("n_negative_spread"),
        _sum_if(F.col("tick_volume") == 0).alias("n_zero_volume"),
        _sum_if(F.col("_gap") > step).alias("n_gaps"),
    )
    geometry = F.col("n_high_below_low") + F.col("n_high_below_open") + F.col("n_high_below_close") + F.col("n_low_above_open") + F.col("n_low_above_close")
    errors = F.array_compact(F.array(F.when(geometry > 0, "ohlc geometry"), F.when(F.col("n_missing") + F.col("n_infinite") + F.col("n_non_positive") > 0, "bad prices"), F.when(F.col("n_duplicate") > 0, "duplicate times"), F.when(F.col("n_negative_spread") > 0, "negative spread")))
    warnings = F.array_compact(F.array(F.when(F.col("n_zero_volume") > 0, "zero volume"), F.when(F.col("n_gaps") > 0, "gaps")))
    return got.select("symbol", F.when(F.size(errors) == 0, "PASS").otherwise("FAIL").alias("status"), F.array_join(errors, "; ").alias("errors"), F.array_join(warnings, "; ").alias("warnings"), "n_gaps")


def validate_bar_records(df: DataFrame) -> DataFrame:
    """Ranges of step, volume and spread of raw bars."""
    return _stepped(df, "_step").groupBy("symbol").agg(
        F.count("*").alias("n_rows"), F.min("_step").alias("min_step"), F.max("_step").alias("max_step"), F.min("tick_volume").alias("min_volume"), F.max("tick_volume").alias("max_volume"),
        F.min("spread").alias("min_spread"), F.max("spread").alias("max_spread"), _sum_if(F.col("high") < F.col("low")).alias("n_inverted"), _sum_if(F.col("_step") <= 0).alias("n_bad_step"),
    )


def validate_swing_data(df: DataFrame, seconds: int) -> DataFrame:
    """Order, duplicates, geometry, positivity, and gaps beyond 1.5 bars."""
    h, l = F.col("high"), F.col("low")
    geometry = (h < l) | (h < F.greatest("open", "close")) | (l > F.least("open", "close"))
    return _stepped(df, "_step").groupBy("symbol").agg(
        F.count("*").alias("n_rows"), (F.count("*") - F.count_distinct("time")).alias("n_duplicate"), _sum_if(geometry).alias("n_geometry"), _sum_if(_some(*(F.col(p) <= 0 for p in PRICES))).alias("n_non_positive"),
        _sum_if(_some(*(F.col(p).isNull() for p in PRICES))).alias("n_null"), _sum_if(F.col("_step") > 1.5 * seconds).alias("n_gaps"), F.max("_step").alias("max_gap"),
    )


def validate_ticks(df: DataFrame) -> DataFrame:
    """Order, repeated milliseconds and quotes, spreads, and times between ticks."""
    df = with_previous(df.select("symbol", "event_id", "time_msc", "bid", "ask"), ["symbol"], ["event_id"], {"_msc": "time_msc", "_bid": "bid", "_ask": "ask"}, ID_RANGE)
    gap = F.col("time_msc") - F.col("_msc")
    same = (F.col("_bid") == F.col("bid")) & (F.col("_ask") == F.col("ask"))
    marked = df.withColumn("_gap", gap).withColumn("_same", same)
    per = marked.groupBy("symbol").agg(
        F.count("*").alias("n_ticks"),
        _sum_if(F.col("_gap") < 0).alias("n_out_of_order"),
        (F.count("time_msc") - F.count_distinct("time_msc")).alias("n_duplicate_ms"),
        _sum_if(F.col("_same")).alias("n_duplicate_quotes"),
        _sum_if(F.col("ask") < F.col("bid")).alias("n_negative_spread"),
        _sum_if(F.col("ask") == F.col("bid")).alias("n_zero_spread"),
        _sum_if((F.col("bid") <= 0) | (F.col("ask") <= 0)).alias("n_invalid_price"),
        F.round(F.max("_gap") / 1000.0, 6).alias("max_gap_s"),
    )
    made = with_percentiles(per, marked, ["symbol"], "_gap", {"median_gap_ms": 0.5, "p95_gap_ms": 0.95})
    return made.withColumns({c: F.round(c, 6) for c in ("median_gap_ms", "p95_gap_ms")})


def tick_violations(df: DataFrame, cutoff_msc: int) -> DataFrame:
    """Every tick with the first rule it breaks (null if none): rows to keep and to quarantine from one pass."""
    reason = (
        F.when(F.col("bid").isNull() | F.col("ask").isNull() | F.isnan("bid") | F.isnan("ask"), "NON_FINITE")
        .when((F.col("bid") <= 0) | (F.col("ask") <= 0), "NON_POSITIVE")
        .when(F.col("ask") - F.col("bid") < -1e-9, "CROSSED")
        .when(F.col("time_msc") >= cutoff_msc, "BEYOND_CUTOFF")
    )
    return df.withColumn("reason", reason)


def validate_raw_series(df: DataFrame, date: str, value: str, low: float = -10.0, high: float = 50.0, least_gap: int = 0, most_gap: int = 7) -> DataFrame:
    """Counts, impossible values, and the median gap in days between dates with a value."""
    v = F.col(value)
    gap = F.datediff(F.col(date), F.lag(date).over(Window.partitionBy(F.year(date)).orderBy(date)))
    with_gap = df.filter(v.isNotNull()).select(date).distinct().withColumn("_gap", gap)
    gaps = with_gap.agg(F.percentile("_gap", F.lit(0.5)).alias("median_gap_days"), F.max("_gap").alias("max_gap_days"))
    counts = df.agg(
        F.count("*").alias("n_rows"), F.count(v).alias("n_valid"), (F.count("*") - F.count(v)).alias("n_missing"), (F.count(date) - F.count_distinct(date)).alias("n_duplicate"), _sum_if((v < low) | (v > high)).alias("n_impossible"),
    )
    return counts.crossJoin(F.broadcast(gaps)).withColumn("gap_ok", F.col("median_gap_days").between(least_gap, most_gap))


def normalised_ticks(df: DataFrame, offset_hours: int) -> DataFrame:
    """Broker rows to canonical ones: seconds or milliseconds by size, broker offset, symbol case, reason of rejection."""
    ms = F.when(F.col("raw_time") > 100_000_000_000, F.col("raw_time")).otherwise(F.col("raw_time") * 1000)
    reason = F.when(F.col("bid").isNull() | F.col("ask").isNull() | (F.col("bid") <= 0) | (F.col("ask") <= 0), "INVALID_PRICE").when(F.col("ask") < F.col("bid"), "INVERTED_SPREAD")
    return df.withColumn("symbol", F.upper(F.trim("symbol"))).withColumn("time_msc", (ms - offset_hours * 3_600_000).cast("long")).withColumn("reason", reason)


def replay_checks(df: DataFrame, cutoff: int) -> DataFrame:
    """Replay-grade reason for each bar, and the price to replay."""
    columns = df.columns
    df = with_previous(df, ["symbol"], ["time"], {"_prior": "time"}, BAR_RANGE)
    box = (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close")) | (F.col("high") < F.col("low"))
    reason = (
        F.when(F.col("time") >= cutoff, "QUARANTINED")
        .when(F.col("time") == F.col("_prior"), "DUPLICATE")
        .when(_some(*(F.col(p).isNull() | (F.col(p) <= 0) for p in PRICES)), "BAD_PRICE")
        .when(box, "BAD_OHLC")
    )
    return df.select(*columns, reason.alias("reason")).withColumn("mid", (F.col("high") + F.col("low")) / 2).withColumn("last", F.coalesce(F.col("close"), F.col("mid")))


def locked_period(df: DataFrame, cutoff: int, unlocked: bool = False) -> DataFrame:
    """Rows before the locked period; all rows only when it has been unlocked."""
    return df if unlocked else df.filter(F.col("time") < cutoff)


def audit_chain(events: DataFrame) -> DataFrame:
    """Checks a hash chain in parallel: first failing sequence, counts of broken links and of wrong hashes."""
    genesis = "0" * 64
    before = F.coalesce(F.col("_before"), F.lit(genesis))
    own = F.sha2(F.concat_ws(":", "prev_hash", "event_id", "timestamp", "event_type", "payload"), 256)
    linked = with_previous(events, ["ledger"], ["sequence"], {"_before": "event_hash"}, ID_RANGE)
    marked = linked.withColumn("_link", F.col("prev_hash") != before).withColumn("_hash", F.col("event_hash") != own)
    return marked.groupBy("ledger").agg(
        F.count("*").alias("n_events"), F.count_if("_link").alias("n_broken_links"), F.count_if("_hash").alias("n_wrong_hashes"), F.min(F.when(F.col("_link") | F.col("_hash"), F.col("sequence"))).alias("first_failure"),
    )


def lifecycle_violations(history: DataFrame, allowed: list[tuple[str, str]]) -> DataFrame:
    """Status changes of each order that are not among the allowed ones."""
    pairs = history.sparkSession.createDataFrame(allowed, "before string, status string")
    before = F.lag("status").over(Window.partitionBy("order_id").orderBy("changed_at", "sequence"))
    steps = history.withColumn("before", F.coalesce(before, F.lit("NEW"))).filter(F.col("before") != F.col("status"))
    return steps.join(F.broadcast(pairs), ["before", "status"], "left_anti")


def untracked_revisions(points: DataFrame) -> DataFrame:
    """Points whose value changed while the vintage did not grow."""
    w = Window.partitionBy("series_id", "observation_period").orderBy("information_timestamp")
    changed = (F.lag("actual").over(w) != F.col("actual")) & (F.col("revision_vintage") <= F.lag("revision_vintage").over(w))
    return points.withColumn("_bad", F.coalesce(changed, F.lit(False))).filter("_bad").drop("_bad")


def feature_quality(features: DataFrame, names: list[str], time: str = "time", most_missing: float = 25.0) -> DataFrame:
    """Per feature: missing and infinite counts, bounds, mean, deviations, valid span, status."""
    long = features.unpivot([time], names, "feature", "value").withColumn("value", F.col("value").cast("double"))
    finite = F.when(~F.isnan("value") & ~F.col("value").isin(float("inf"), float("-inf")), F.col("value"))
    out = long.withColumn("_v", finite).groupBy("feature").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("value").isNull() | F.isnan("value")).alias("n_missing"), F.count_if(F.col("value").isin(float("inf"), float("-inf"))).alias("n_infinite"),
        F.min("_v").alias("min_value"), F.max("_v").alias("max_value"), F.avg("_v").alias("mean_value"), F.var_samp("_v").alias("variance"),
        F.min(F.when(F.col("_v").isNotNull(), F.col(time))).alias("first_valid"), F.max(F.when(F.col("_v").isNotNull(), F.col(time))).alias("last_valid"),
    )
    lookback = F.coalesce(F.array_max(F.transform(F.regexp_extract_all("feature", F.lit(r"(\d+)"), F.lit(1)), lambda d: d.cast("int"))), F.lit(0))
    rejected = (F.col("n_missing") * 100.0 / F.col("n_rows") > most_missing) | (F.col("n_infinite") > 0) | (F.coalesce("variance", F.lit(0.0)) < 1e-12)
    return out.withColumn("missing_pct", F.col("n_missing") * 100.0 / F.col("n_rows")).withColumn("lookback", lookback).withColumn("status", F.when(rejected, "REJECTED").otherwise("OK"))


def feature_metadata(features: DataFrame, names: list[str]) -> DataFrame:
    """Per feature: missing and infinite counts, bounds, mean, deviation, its group (the name's first word) and the group's size."""
    long = features.select(*names).unpivot([], names, "feature", "value").withColumn("value", F.col("value").cast("double"))
    infinite = F.col("value").isin(float("inf"), float("-inf"))
    v = F.when(~F.isnan("value") & ~infinite, F.col("value"))
    out = long.groupBy("feature").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("value").isNull() | F.isnan("value")).alias("n_missing"), F.count_if(infinite).alias("n_infinite"),
        F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.avg(v).alias("mean_value"), F.stddev_samp(v).alias("std_value"),
    )
    out = out.withColumn("missing_pct", F.col("n_missing") * 100.0 / F.col("n_rows")).withColumn("feature_group", F.substring_index("feature", "_", 1))
    return out.withColumn("n_in_group", F.count("*").over(Window.partitionBy("feature_group")))  # one row a feature

"""Trade-ledger analytics and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.frames import BAR_RANGE, running, with_percentiles



def drawdown(trades: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Cumulative result, its running maximum (without a leading zero) and drawdown, for each key."""
    equity = running(trades, keys, order, F.sum, "net_pnl", "equity", BAR_RANGE)
    return running(equity, keys, order, F.max, "equity", "peak", BAR_RANGE).withColumn("drawdown", F.col("peak") - F.col("equity"))


def performance(trades: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Counts, averages, profit factor, expectancy, sides, holding, drawdown of each key."""
    pnl = F.col("net_pnl")
    win, loss = F.sum(F.when(pnl > 0, pnl)), F.sum(F.when(pnl < 0, -pnl))
    n = F.count("*")
    return drawdown(trades, keys, order).groupBy(*keys).agg(
        n.alias("n_trades"), F.count_if(pnl > 0).alias("n_wins"), F.count_if(pnl < 0).alias("n_losses"), F.count_if(pnl == 0).alias("n_even"), F.sum(pnl).alias("total_pnl"), F.avg(pnl).alias("expectancy"),
        F.avg(F.when(pnl > 0, pnl)).alias("mean_win"), F.avg(F.when(pnl < 0, pnl)).alias("mean_loss"), (F.count_if(pnl > 0) * 100.0 / n).alias("win_rate"), (win / loss).alias("profit_factor"),
        F.sum(F.when(F.col("direction") == "LONG", pnl)).alias("long_pnl"), F.sum(F.when(F.col("direction") == "SHORT", pnl)).alias("short_pnl"), F.avg("holding_bars").alias("mean_holding"), F.max("drawdown").alias("max_drawdown"), F.stddev_samp(pnl).alias("std_pnl"),
    )


def concentration(trades: DataFrame, tops: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Share of the best trades in the total, and the total without them. Only the best few rows are ranked."""
    pnl = F.col("net_pnl")
    total = trades.agg(F.sum(pnl).alias("total_pnl"))
    best = trades.select("trade_id", "net_pnl").orderBy(F.desc("net_pnl"), "trade_id").limit(max(tops))
    ranked = best.withColumn("_rank", F.row_number().over(Window.orderBy(F.desc("net_pnl"), "trade_id")))  # at most ten rows
    sums = ranked.agg(*(F.sum(F.when(F.col("_rank") <= k, pnl)).alias(f"top_{k}") for k in tops))
    out = total.crossJoin(F.broadcast(sums))  # one row each
    for k in tops:
        out = out.withColumn(f"without_top_{k}", F.col("total_pnl") - F.col(f"top_{k}")).withColumn(f"top_{k}_pct", F.col(f"top_{k}") * 100.0 / F.col("total_pnl")).withColumn(f"flips_{k}", F.signum(f"without_top_{k}") != F.signum("total_pnl"))
    return out


def time_blocks(trades: DataFrame, time: Column, start: int, end: int, n_blocks: int) -> DataFrame:
    """Adds the number of the equal time block [start, end) of each trade; trades outside go."""
    width = (end - start) / n_blocks
    t = time.cast("long")
    return trades.filter((t >= start) & (t < end)).withColumn("block", F.floor((t - start) / width).cast("int"))


def exits(trades: DataFrame) -> DataFrame:
    """By exit reason."""
    pnl = F.col("net_pnl")
    per = trades.groupBy("exit_reason").agg(F.count("*").alias("n_trades"), F.sum(pnl).alias("total_pnl"), F.avg(pnl).alias("mean_pnl"), F.count_if(pnl > 0).alias("n_wins"))
    per = with_percentiles(per, trades, ["exit_reason"], "net_pnl", {"median_pnl": 0.5})
    return per.withColumn("trade_pct", F.col("n_trades") * 100.0 / F.sum("n_trades").over(Window.partitionBy(F.lit(0)))).withColumn("win_share", F.col("n_wins") / F.sum("n_wins").over(Window.partitionBy(F.lit(0))))  # a few reasons


def rollover(trades: DataFrame, hour_minute: Column, wide: float) -> DataFrame:
    """Classes by wide spread and by the minutes around the daily rollover, with their exit reasons."""
    pnl = F.col("net_pnl")
    late = hour_minute.between(21 * 60 + 50, 22 * 60 + 20)
    spread = F.greatest("entry_spread_pts", "exit_spread_pts") > wide
    kind = F.when(late & spread, "A").when(late | spread, "B").otherwise("C")
    counts = trades.withColumn("rollover_class", kind).groupBy("rollover_class", "exit_reason").agg(F.count("*").alias("n"), F.sum(pnl).alias("p"), F.sum(F.col("entry_spread_pts")).alias("s"))
    return counts.groupBy("rollover_class").agg(F.sum("n").alias("n_trades"), F.sum("p").alias("total_pnl"), (F.sum("s") / F.sum("n")).alias("mean_entry_spread"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "exit_reason", "n"))), ",").alias("exits"))


def outliers(trades: DataFrame, reconciled: DataFrame, n: int) -> DataFrame:
    """The n largest results by size, with what the reconciliation says of them."""
    top = trades.orderBy(F.desc(F.abs("net_pnl")), "trade_id").limit(n)
    return reconciled.join(F.broadcast(top.select("trade_id", "net_pnl", "exit_reason")), "trade_id", "right")


def transitions(reconciled: DataFrame) -> DataFrame:
    """Exit reasons of two ledgers against each other."""
    both = reconciled.filter("a_pnl is not null and b_pnl is not null").withColumn("_d", F.col("b_pnl") - F.col("a_pnl"))
    per = both.groupBy("a_reason", "b_reason").agg(F.count("*").alias("n"), F.sum("_d").alias("sum_diff"), F.avg("_d").alias("mean_diff"))
    return with_percentiles(per, both, ["a_reason", "b_reason"], "_d", {"median_diff": 0.5})


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of each account, the loss of its day against the day's first equity, exposure."""
    day = F.to_date("ts")
    per_day = snapshots.groupBy("account", day.alias("day")).agg(F.min_by("equity", F.struct("ts", "snapshot_id")).alias("first_equity"), F.max_by("equity", F.struct("ts", "snapshot_id")).alias("last_equity"), F.max_by("exposure", F.struct("ts", "snapshot_id")).alias("exposure"))
    newest = per_day.groupBy("account").agg(F.max_by(F.struct("day", "first_equity", "last_equity", "exposure"), "day").alias("x")).select("account", "x.*")
    return newest.withColumn("daily_loss_pct", F.greatest(F.lit(0.0), (F.col("first_equity") - F.col("last_equity")) * 100.0 / F.col("first_equity"))).withColumn("exposure_pct", F.col("exposure") * 100.0 / F.col("last_equity"))


# costs and gates, each an expression on one row

POINT = 1e-5


def spread_price(points: Column, fallback: float = 10.0, floor: float = 1.0) -> Column:
    """Spread as a price; missing or negative points take the fallback, small ones the floor."""
    return F.greatest(F.when(points.isNull() | (points < 0), F.lit(fallback)).otherwise(points), F.lit(floor)) * POINT


def entry_fill(opened: Column, direction: Column, points: Column, slippage: float = 1.0) -> Column:
    """A LONG pays the spread when it enters; both pay slippage."""
    return F.when(direction == "LONG", opened + spread_price(points) + slippage * POINT).otherwise(opened - slippage * POINT)


def exit_fill(price: Column, direction: Column, points: Column, slippage: float = 1.0) -> Column:
    return F.when(direction == "LONG", price - slippage * POINT).otherwise(price + spread_price(points) + slippage * POINT)


def trade_costs(units: Column, price: Column, days: Column, spread: float, slippage: float, commission: float, swap: float) -> dict[str, Column]:
    """Each cost rounded to four digits."""
    r = lambda c: F.round(c, 4)
    return {"spread_cost": r(units * spread), "slippage_cost": r(units * slippage), "commission_cost": r(units * price * commission), "swap_cost": r(units * swap * days)}


def position_size(equity: Column, entry: Column, stop: Column, risk_pct: float, most_pct: float) -> dict[str, Column]:
    """Units so that the stop costs the given share of the equity; else why not."""
    bad = F.when(equity <= 0, "NO_EQUITY").when(entry.isNull() | stop.isNull() | (entry <= 0) | (stop <= 0), "BAD_PRICE").when(entry == stop, "ZERO_DISTANCE").when(F.lit(risk_pct > most_pct), "RISK_TOO_HIGH")
    return {"size_reason": bad, "units": F.when(bad.isNull(), F.round(equity * risk_pct / 100.0 / F.abs(entry - stop), 4))}


def gate(confidence: Column, action: Column, open_positions: Column, daily_loss: Column, price: Column, stop: Column) -> Column:
    """The first rule that stops a signal, in order; NULL lets it pass."""
    return (
        F.when(action == "HOLD", "HOLD")
        .when(confidence < 0.55, "LOW_CONFIDENCE")
        .when(daily_loss >= 3.0, "DAILY_LOSS")
        .when(open_positions >= 3, "OPEN_POSITIONS")
        .when(price.isNull() | stop.isNull(), "MISSING_PRICE")
        .when(F.abs(price - stop) < 1e-9, "ZERO_DISTANCE")
    )


def decision(short: Column, neutral: Column, long: Column, threshold: float) -> Column:
    """P10: the class with the largest probability, if it reaches the threshold."""
    best = F.greatest(short, neutral, long)
    return F.when((long == best) & (long > short) & (long >= threshold), "BUY").when((short == best) & (short >= threshold) & (short > long), "SELL").otherwise("HOLD")


def first_usable_bar(information: Column, latency: int, step: int, stamps_are_opens: bool) -> Column:
    """Bar at whose close the information can be used, in epoch seconds."""
    close = F.ceil((information + latency) / step) * step
    return (close - step if stamps_are_opens else close).cast("long")


def publication(observed: Column) -> Column:
    """Weekly reports of a Tuesday appear on Friday at 15:30 New York time; the UTC instant."""
    friday = F.next_day(F.date_sub(observed, 1), "Fri")
    return F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", friday.cast("string"), F.lit("15:30:00"))), "America/New_York")


def zone_offsets(ts: Column) -> dict[str, Column]:
    """Offsets of New York and Frankfurt in hours, and whether their difference is not the usual six."""
    hours = lambda zone: ((F.unix_timestamp(F.from_utc_timestamp(ts, zone)) - F.unix_timestamp(ts)) / 3600).cast("int")
    us, eu = hours("America/New_York"), hours("Europe/Berlin")
    return {"us_offset": us, "eu_offset": eu, "is_desync": (eu - us) == 5}


def idempotency_key(request: Column, *fingerprint: Column) -> Column:
    """The request's key, or a hash of what identifies the signal."""
    return F.coalesce(F.concat(F.lit("req_"), request), F.sha2(F.concat_ws("_", *(c.cast("string") for c in fingerprint)), 256))

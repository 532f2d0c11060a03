"""Queries of exploratory statistics, reports, order checks and path studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import streaming
from tickloom.operators import asof, explore, ledger, stats
from tickloom.operators.frames import over_blocks, with_row_index
from tickloom.plans import sql as q
from tickloom.plans.catalog import query, rounded
from tickloom.plans.ledger_queries import _EXO, _SECOND, exo_shifted
from tickloom.sources.adapters import H1, H4, M15, bars, ticks, trades

_LR = f"ln(close/{q.lag('close')})"


@query(
    "A03_price_statistics",
    f"{q.bars_with(H1)}, l AS (SELECT *, {_LR} AS r FROM bars), m AS (SELECT symbol, avg(r) AS mu FROM l GROUP BY 1), z AS (SELECT l.*, l.r - m.mu AS d FROM l JOIN m USING (symbol)) SELECT symbol, count(*) AS n_rows, round(min(close),8)+0.0 AS min_close, round(max(close),8)+0.0 AS max_close, round(avg(close),6)+0.0 AS mean_close, round(stddev_samp(close),6)+0.0 AS std_close, {', '.join(f'round(quantile_cont(close,{p}),9)+0.0 AS {n}' for n, p in (('p01', 0.01), ('p05', 0.05), ('p25', 0.25), ('p50', 0.5), ('p75', 0.75), ('p95', 0.95), ('p99', 0.99)))}, {q.count_if('close>open')} AS n_bull, {q.count_if('close<open')} AS n_bear, {q.count_if('close=open')} AS n_doji, round(avg(high-low),6)+0.0 AS mean_range, round(avg(r),6)+0.0 AS mean_return, round(stddev_samp(r),6)+0.0 AS std_return, round(avg(d*d*d)/pow(avg(d*d),1.5),4)+0.0 AS skew_return, round(avg(d*d*d*d)/pow(avg(d*d),2)-3,4)+0.0 AS kurtosis_return FROM z GROUP BY 1",
)
def a03(spark, sf_dir):
    out = explore.price_statistics(bars(spark, sf_dir, H1))
    out = rounded(rounded(out, "min_close", "max_close"), "p01", "p05", "p25", "p50", "p75", "p95", "p99", digits=9)
    return rounded(rounded(out, "mean_close", "std_close", "mean_range", "mean_return", "std_return", digits=6), "skew_return", "kurtosis_return", digits=4)


_TS = "make_timestamp(time*1000000)"


@query(
    "A04_temporal_statistics",
    f"{q.bars_with(H1)}, l AS (SELECT *, {_LR} AS r, hour({_TS}) AS h FROM bars), g AS (SELECT symbol, r, spread, tick_volume, unnest(list_filter([{{kind: 'hour', value: CAST(h AS VARCHAR)}}, {{kind: 'weekday', value: CAST(isodow({_TS})-1 AS VARCHAR)}}, {{kind: 'month', value: CAST(month({_TS}) AS VARCHAR)}}, {{kind: 'year', value: CAST(year({_TS}) AS VARCHAR)}}, {', '.join(f'''CASE WHEN h BETWEEN {a} AND {b} THEN {{kind: 'session', value: '{n}'}} END''' for n, a, b in explore.SESSIONS)}], lambda x: x IS NOT NULL)) AS x FROM l) SELECT symbol, x.kind AS kind, x.value AS value, count(*) AS n_rows, round(avg(r),6)+0.0 AS mean_return, round(stddev_samp(r),6)+0.0 AS std_return, round(avg(spread),6)+0.0 AS mean_spread, round(avg(tick_volume),6)+0.0 AS mean_volume FROM g GROUP BY ALL",
)
def a04(spark, sf_dir):
    return rounded(explore.temporal_statistics(bars(spark, sf_dir, H1)), "mean_return", "std_return", "mean_spread", "mean_volume", digits=6)


_A05 = ["tick_volume", "spread", "real_volume"]


@query("A05_volume_statistics", f"{q.bars_with(H1)}, l AS ({' UNION ALL '.join(f'SELECT {chr(39)}{c}{chr(39)} AS c, CAST({c} AS DOUBLE) AS v FROM bars' for c in _A05)}) SELECT c AS \"column\", count(v) AS n, min(v) AS min_value, max(v) AS max_value, round(avg(v),6)+0.0 AS mean_value, round(quantile_cont(v,0.5),6)+0.0 AS median_value, round(quantile_cont(v,0.95),6)+0.0 AS p95, round({q.count_if('v=0')}*100.0/count(v),6)+0.0 AS zero_pct FROM l GROUP BY 1")
def a05(spark, sf_dir):
    return rounded(explore.volume_statistics(bars(spark, sf_dir, H1), _A05), "mean_value", "median_value", "p95", "zero_pct", digits=6)


_REPORTS = "reports AS (SELECT o_custkey % 4 AS code, CAST(o_orderdate AS DATE) AS report_date, CAST(sum(o_orderkey % 1000) AS BIGINT) AS open_interest, CAST(sum(o_orderkey % 600) AS BIGINT) AS long_all, CAST(sum(o_orderkey % 500) AS BIGINT) AS short_all, CAST(sum(o_orderkey % 1000 - o_orderkey % 600) AS BIGINT) AS rest_long, CAST(sum(o_orderkey % 400) AS BIGINT) AS rest_short FROM orders GROUP BY ALL)"


def reports(spark, sf_dir):
    k = F.col("o_orderkey")
    sums = {"open_interest": k % 1000, "long_all": k % 600, "short_all": k % 500, "rest_long": k % 1000 - k % 600, "rest_short": k % 400}
    return spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy((F.col("o_custkey") % 4).alias("code"), F.col("o_orderdate").cast("date").alias("report_date")).agg(*(F.sum(c).alias(n) for n, c in sums.items()))


@query("V14_position_identities", f"WITH {_REPORTS}, g AS (SELECT *, date_diff('day', lag(report_date) OVER (PARTITION BY code ORDER BY report_date), report_date) AS gap FROM reports) SELECT code, count(*) AS n_reports, max(abs(open_interest-long_all-rest_long)) AS long_breach, max(abs(open_interest-short_all-rest_short)) AS short_breach, {q.count_if('long_all<0 OR short_all<0 OR rest_long<0 OR rest_short<0')} AS n_negative, {q.count_if('gap>7')} AS n_gaps FROM g GROUP BY 1")
def v14(spark, sf_dir):
    return explore.position_identities(reports(spark, sf_dir))


@query("W20_position_features", f"WITH {_REPORTS}, n AS (SELECT code, report_date, long_all-short_all AS net FROM reports) SELECT code, report_date, net, round(CASE WHEN count(net) OVER f >= 52 THEN (net - avg(net) OVER f)/nullif(stddev_samp(net) OVER f,0) END,6)+0.0 AS net_z, net - lag(net,4) OVER (PARTITION BY code ORDER BY report_date) AS net_change_4 FROM n WINDOW f AS (PARTITION BY code ORDER BY report_date ROWS 155 PRECEDING)")
def w20(spark, sf_dir):
    return rounded(explore.position_features(reports(spark, sf_dir)).select("code", "report_date", "net", "net_z", "net_change_4"), "net_z", digits=6)


@query("V17_silent_imputation", f"{q.bars_with(H4)} SELECT count(*) AS n_known_missing, count(CASE WHEN (time//14400) % 3 <> 0 THEN CASE WHEN (time//14400) % 3 = 1 THEN 0.0 ELSE close END END) AS n_filled, {q.count_if('(time//14400) % 3 = 1')} AS n_zero FROM bars WHERE tick_volume < 5")
def v17(spark, sf_dir):
    k = F.floor(F.col("time") / H4) % 3
    b = bars(spark, sf_dir, H4)
    filled = b.withColumn("close", F.when(k == 1, 0.0).when(k == 2, F.col("close")))
    return explore.silent_imputation(filled, b.filter("tick_volume < 5").select("symbol", "time"), ["symbol", "time"], "close")


_SIG = "s AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN ' ' ELSE event_type END AS symbol, CASE event_id % 5 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' WHEN 2 THEN 'HOLD' WHEN 3 THEN 'BUY' ELSE 'WAIT' END AS action, (event_id % 130)/100.0::DOUBLE AS confidence, CAST(event_id % 7 - 1 AS DOUBLE) AS stop FROM events)"


@query("V24_signal_checks", f"WITH {_SIG} SELECT array_to_string(list_filter([CASE WHEN trim(symbol)='' THEN 'symbol' END, CASE WHEN action NOT IN ('BUY','SELL','HOLD') THEN 'action' END, CASE WHEN NOT confidence BETWEEN 0 AND 1 THEN 'confidence' END, CASE WHEN stop<=0 THEN 'stop' END], lambda x: x IS NOT NULL), ',') AS problems, count(*) AS n FROM s GROUP BY 1")
def v24(spark, sf_dir):
    i = F.col("event_id")
    action = F.when(i % 5 == 0, "BUY").when(i % 5 == 1, "SELL").when(i % 5 == 2, "HOLD").when(i % 5 == 3, "BUY").otherwise("WAIT")
    s = ticks(spark, sf_dir).select("event_id", F.when(i % 17 == 0, " ").otherwise(F.col("symbol")).alias("symbol"), action.alias("action"), ((i % 130) / 100.0).alias("confidence"), (i % 7 - 1).cast("double").alias("stop"))
    return s.groupBy(explore.signal_problems().alias("problems")).agg(F.count("*").alias("n"))


@query("V25_order_checks", "WITH o AS (SELECT CASE event_id % 3 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' ELSE 'HOLD' END AS side, (event_id % 120)/10.0::DOUBLE AS q, 1.0::DOUBLE AS p, 0.9 + (event_id % 4)/10.0::DOUBLE AS st, 0.85 + (event_id % 7)/10.0::DOUBLE AS tg FROM events) SELECT coalesce(CASE WHEN side NOT IN ('BUY','SELL') THEN 'SIDE' WHEN q <= 0 THEN 'QUANTITY' WHEN q < 0.5 THEN 'BELOW_MINIMUM' WHEN q > 10 THEN 'ABOVE_MAXIMUM' WHEN abs(q/0.5::DOUBLE-round(q/0.5::DOUBLE))>1e-4 THEN 'STEP' WHEN (side='BUY' AND st>=p) OR (side='SELL' AND st<=p) THEN 'STOP_SIDE' WHEN (side='BUY' AND tg<=p) OR (side='SELL' AND tg>=p) THEN 'TARGET_SIDE' END,'OK') AS reason, count(*) AS n FROM o GROUP BY 1")
def v25(spark, sf_dir):
    i = F.col("event_id")
    side = F.when(i % 3 == 0, "BUY").when(i % 3 == 1, "SELL").otherwise("HOLD")
    reason = explore.order_problem(side, (i % 120) / 10.0, F.lit(0.5), F.lit(10.0), F.lit(0.5), F.lit(1.0), F.lit(0.9) + (i % 4) / 10.0, F.lit(0.85) + (i % 7) / 10.0)
    return ticks(spark, sf_dir).groupBy(F.coalesce(reason, F.lit("OK")).alias("reason")).agg(F.count("*").alias("n"))


@query("P20_marked_positions", f"WITH {q.TICKS}, pr AS (SELECT symbol, arg_max(bid,(time_msc,event_id)) AS price FROM ticks GROUP BY 1), po AS (SELECT event_id, symbol, CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE -1.0 END AS sd, bid AS entry, CASE WHEN event_id % 2 = 0 THEN bid*0.95::DOUBLE ELSE bid*1.05::DOUBLE END AS st, CASE WHEN event_id % 2 = 0 THEN bid*1.05::DOUBLE ELSE bid*0.95::DOUBLE END AS tg FROM ticks) SELECT event_id, round(sd*(price-entry)*1000,6)+0.0 AS unrealised, sd*(price-st) <= 0 AS stop_hit, sd*(price-tg) >= 0 AS target_hit FROM po JOIN pr USING (symbol)")
def p20(spark, sf_dir):
    t = ticks(spark, sf_dir)
    even = F.col("event_id") % 2 == 0
    po = t.select("event_id", "symbol", F.when(even, "BUY").otherwise("SELL").alias("side"), F.col("bid").alias("entry"), F.when(even, F.col("bid") * 0.95).otherwise(F.col("bid") * 1.05).alias("stop"), F.when(even, F.col("bid") * 1.05).otherwise(F.col("bid") * 0.95).alias("target"), F.lit(1000.0).alias("units"))
    return rounded(explore.marked(po, t).select("event_id", "unrealised", "stop_hit", "target_hit"), "unrealised", digits=6)


@query("P14_local_to_utc", "SELECT o_orderkey, epoch(((CAST(o_orderdate AS DATE) + INTERVAL 8 HOUR + INTERVAL 30 MINUTE) AT TIME ZONE CASE WHEN o_custkey % 2 = 0 THEN 'America/New_York' ELSE 'Europe/Berlin' END) AT TIME ZONE 'UTC')::BIGINT AS utc FROM orders")
def p14(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    zone = F.when(F.col("o_custkey") % 2 == 0, "America/New_York").otherwise("Europe/Berlin")
    return o.select("o_orderkey", F.unix_timestamp(explore.local_to_utc(F.col("o_orderdate").cast("date"), F.lit("08:30:00"), zone)).alias("utc"))


@query("W22_non_overlapping", f"WITH RECURSIVE {q.bars_with(H1)[5:]}, c AS (SELECT symbol, row_number() OVER ({q.W}) - 1 AS i FROM bars), k AS (SELECT symbol, i, i + 1 + i % 4 AS e, row_number() OVER (PARTITION BY symbol ORDER BY i) AS rn FROM c), r(symbol, rn, i, free, taken) AS (SELECT symbol, rn, i, e + 2, true FROM k WHERE rn = 1 UNION ALL SELECT k.symbol, k.rn, k.i, CASE WHEN k.i > r.free THEN k.e + 2 ELSE r.free END, k.i > r.free FROM r JOIN k ON k.symbol = r.symbol AND k.rn = r.rn + 1) SELECT symbol, i AS start_idx FROM r WHERE taken")
def w22(spark, sf_dir):
    c = with_row_index(bars(spark, sf_dir, H1).select("symbol", "time"), ["symbol"], "time", 30 * 86_400, "start_idx")
    c = c.select("symbol", "start_idx", (F.col("start_idx") + 1 + F.col("start_idx") % 4).alias("end_idx"))
    return explore.non_overlapping(c, ["symbol"], "start_idx", "end_idx", 2, 4096).select("symbol", "start_idx")


@query("J05_causal_yields", f"WITH {q.TICKS}, {q.bars(H4)}, {_EXO}, j AS (SELECT b.symbol, b.time, x.usable_time, x.value FROM bars b ASOF LEFT JOIN x ON b.time >= x.usable_time), v AS (SELECT {q.count_if('usable_time > time')} AS n FROM j) SELECT symbol, time, round(value,8)+0.0 AS value, CASE WHEN value IS NULL THEN 'UNAVAILABLE' WHEN v.n > 0 THEN 'VIOLATION' ELSE 'ALIGNED' END AS status FROM j, v")
def j05(spark, sf_dir):
    out = asof.asof_slow(bars(spark, sf_dir, H4), exo_shifted(spark, sf_dir), "time", "usable_time", ["value"]).select("symbol", "time", "usable_time", "value")
    violations = out.agg(F.count_if(F.col("usable_time") > F.col("time")).alias("n"))  # one row
    status = F.when(F.col("value").isNull(), "UNAVAILABLE").when(F.col("n") > 0, "VIOLATION").otherwise("ALIGNED")
    return rounded(out.crossJoin(F.broadcast(violations)).select("symbol", "time", "value", status.alias("status")), "value")


_TR = "tr AS (SELECT event_id AS trade_id, symbol, time_msc AS exit_msc, bid*1.03::DOUBLE AS target, bid*0.97::DOUBLE AS stop FROM ticks)"


@query("J17_later_path", f"WITH {q.TICKS}, {_TR}, h AS (SELECT tr.trade_id, arg_min(CASE WHEN t.bid >= target THEN 'TAKE_PROFIT' ELSE 'STOP_LOSS' END, (t.time_msc, t.event_id)) AS touch FROM tr JOIN ticks t ON t.symbol = tr.symbol AND t.time_msc BETWEEN exit_msc AND exit_msc + 3600000 WHERE t.bid >= target OR t.bid <= stop GROUP BY 1) SELECT trade_id, coalesce(touch,'NONE') AS touch FROM tr LEFT JOIN h USING (trade_id)")
def j17(spark, sf_dir):
    t = ticks(spark, sf_dir)
    tr = t.select(F.col("event_id").alias("trade_id"), "symbol", F.col("time_msc").alias("exit_msc"), (F.col("bid") * 1.03).alias("target"), (F.col("bid") * 0.97).alias("stop"))
    return explore.first_touch(tr, t, 60, 900_000).select("trade_id", "touch")


@query("J16_quotes_of_trades", f"WITH {q.TICKS}, tr AS (SELECT event_id AS trade_id, symbol, time_msc - 20000 AS entry_msc, time_msc + 30000 AS exit_msc, bid FROM ticks), a AS (SELECT tr.*, CASE WHEN t.time_msc - entry_msc <= 60000 THEN t.bid END AS b1 FROM tr ASOF LEFT JOIN ticks t ON tr.symbol = t.symbol AND tr.entry_msc <= t.time_msc), b AS (SELECT a.*, CASE WHEN t.time_msc - exit_msc <= 60000 THEN t.bid END AS b2 FROM a ASOF LEFT JOIN ticks t ON a.symbol = t.symbol AND a.exit_msc <= t.time_msc) SELECT trade_id, round(coalesce(b1,bid-1e-4),8)+0.0 AS entry_bid, round(coalesce(b2,bid+1e-4),8)+0.0 AS exit_bid FROM b")
def j16(spark, sf_dir):
    t = ticks(spark, sf_dir)
    tr = t.select(F.col("event_id").alias("trade_id"), "symbol", (F.col("time_msc") - 20_000).alias("entry_msc"), (F.col("time_msc") + 30_000).alias("exit_msc"), F.col("bid").alias("fallback"))
    quotes = t.select("symbol", "time_msc", "event_id", "bid")
    a = asof.asof(tr, quotes, ["symbol"], "entry_msc", "time_msc", ["bid"], 86_400_000, 60_000, forward=True, ties=["event_id"], prefix="entry_")
    b = asof.asof(a, quotes, ["symbol"], "exit_msc", "time_msc", ["bid"], 86_400_000, 60_000, forward=True, ties=["event_id"], prefix="exit_")
    return rounded(b.select("trade_id", F.coalesce("entry_bid", F.col("fallback") - 1e-4).alias("entry_bid"), F.coalesce("exit_bid", F.col("fallback") + 1e-4).alias("exit_bid")), "entry_bid", "exit_bid")


@query("T01_paired_test", f"WITH {q.TRADES}, {_SECOND}, d AS (SELECT a.direction, b.net_pnl - a.net_pnl AS x FROM trades a JOIN second b USING (trade_id)) SELECT direction, count(x) AS n, round(avg(x),6)+0.0 AS mean_value, round(stddev_samp(x),6)+0.0 AS std_value, round(avg(x)/(stddev_samp(x)/sqrt(count(x))),6)+0.0 AS t_statistic FROM d GROUP BY 1")
def t01(spark, sf_dir):
    a = trades(spark, sf_dir)
    b = a.filter("trade_id % 50 != 0").select("trade_id", (F.col("net_pnl") + F.col("trade_id") % 7 - 3).alias("other"))
    out = stats.paired(a.join(b, "trade_id"), ["direction"], "other", "net_pnl")
    return rounded(out.select("direction", "n", "mean_value", "std_value", "t_statistic"), "mean_value", "std_value", "t_statistic", digits=6)


@query("V30_timing_audit", f"WITH {q.TICKS}, {q.bars(H4, 'h4')}, {q.bars(M15)}, s AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time) - 1 AS i, lead(time,4) OVER (PARTITION BY symbol ORDER BY time) AS outcome FROM h4), j AS (SELECT s.symbol, s.time, s.i, s.outcome, b.time AS fine FROM s ASOF LEFT JOIN bars b ON s.symbol = b.symbol AND s.time + 13500 >= b.time) SELECT symbol, time, fine AS fine_time, outcome AS outcome_time, fine + 900 <= time + 14400 AND time + 14400 <= outcome AS is_causal FROM j WHERE outcome IS NOT NULL")
def v30(spark, sf_dir):
    h4 = over_blocks(bars(spark, sf_dir, H4).select("symbol", "time"), lambda df, f: df.withColumn("outcome_time", f.lead("time", 4)), 0, 4).withColumn("cutoff", F.col("time") + H4 - M15)
    fine = bars(spark, sf_dir).select("symbol", F.col("time").alias("fine_time"))
    out = asof.asof(h4.filter("outcome_time is not null"), fine, ["symbol"], "cutoff", "fine_time", [], 86_400)
    causal = (F.col("fine_time") + M15 <= F.col("time") + H4) & (F.col("time") + H4 <= F.col("outcome_time"))
    return out.select("symbol", "time", "fine_time", "outcome_time", causal.alias("is_causal"))


@query("K02_largest_results", f"WITH {q.TRADES} SELECT trade_id, net_pnl FROM trades ORDER BY abs(net_pnl) DESC, trade_id LIMIT 15")
def k02(spark, sf_dir):
    return trades(spark, sf_dir).select("trade_id", "net_pnl").orderBy(F.desc(F.abs("net_pnl")), "trade_id").limit(15)


@query("R01_accepted_bars", f"{q.bars_with(H1)} SELECT symbol, time, CASE WHEN time + 3600 > 1706000000 THEN 'INCOMPLETE' END AS reason FROM bars")
def r01(spark, sf_dir):
    return streaming.accepted(bars(spark, sf_dir, H1), 1_706_000_000, H1).select("symbol", "time", "reason")


@query("P06_barrier_costs", f"WITH {q.TRADES} SELECT direction, round(sum(greatest(CASE WHEN entry_spread_pts < 0 THEN 10.0 ELSE entry_spread_pts END, 1.0)*1e-5),8)+0.0 AS spread_paid FROM trades GROUP BY 1")
def p06_costs(spark, sf_dir):
    out = trades(spark, sf_dir).groupBy("direction").agg(F.sum(ledger.spread_price(F.col("entry_spread_pts"))).alias("spread_paid"))
    return rounded(out, "spread_paid")



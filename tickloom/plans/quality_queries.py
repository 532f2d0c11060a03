"""Queries of sources, roll-up and data quality (S, V, A01, A02, A06-A13, A25, K01, K05, O01)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import micro, quality, rollup
from tickloom.operators.frames import ID_RANGE, with_previous
from tickloom.plans import sql as q
from tickloom.plans.catalog import query, rounded
from tickloom.sources import readers
from tickloom.sources.adapters import D1, H1, H4, M15, bars, exo_daily, ticks

BROKEN = """broken AS (SELECT symbol, time, open, CASE WHEN (time//900) % 97 = 1 THEN low - 0.5 ELSE high END AS high, low, CASE WHEN (time//900) % 97 = 2 THEN NULL WHEN (time//900) % 97 = 3 THEN -1.0 ELSE close END AS close,
  tick_volume, CASE WHEN (time//900) % 97 = 4 THEN NULL WHEN (time//900) % 97 = 5 THEN -spread ELSE spread END AS spread, CASE WHEN (time//900) % 97 = 6 THEN 0 ELSE tick_volume END AS volume, real_volume FROM bars)"""


def broken(spark, sf_dir):
    """Bars with fields broken by a rule of their time, so that the audits have something to count."""
    at = F.floor(F.col("time") / M15) % 97
    return bars(spark, sf_dir).select(
        "symbol",
        "time",
        "open",
        F.when(at == 1, F.col("low") - 0.5).otherwise(F.col("high")).alias("high"),
        "low",
        F.when(at == 2, F.lit(None)).when(at == 3, -1.0).otherwise(F.col("close")).alias("close"),
        "tick_volume",
        F.when(at == 4, F.lit(None)).when(at == 5, -F.col("spread")).otherwise(F.col("spread")).alias("spread"),
        F.when(at == 6, F.lit(0)).otherwise(F.col("tick_volume")).alias("volume"),
        "real_volume",
    )


WITH_BROKEN = f"{q.bars_with()}, {BROKEN}"
STEP = "time - lag(time) OVER (PARTITION BY symbol ORDER BY time)"


@query("A02_bars_from_ticks", f"{q.bars_with(H1)} SELECT symbol, time, {q.rounded(['open', 'high', 'low', 'close'])}, tick_volume, spread FROM bars")
def a02(spark, sf_dir):
    return rounded(bars(spark, sf_dir, H1), "open", "high", "low", "close").drop("real_volume")


@query(
    "A02_tick_bars",
    f"WITH {q.TICKS} SELECT symbol, CAST(floor(time_msc/900000.0) AS BIGINT)*900 AS time, round(arg_min(bid,event_id),8)+0.0 AS open, round(max(bid),8)+0.0 AS high, round(min(bid),8)+0.0 AS low, round(arg_max(bid,event_id),8)+0.0 AS close, count(*) AS tick_count, round(avg(spread_points),6)+0.0 AS mean_spread_points, max(spread_points) AS max_spread_points FROM ticks GROUP BY symbol, CAST(floor(time_msc/900000.0) AS BIGINT)",
)
def a02_ticks(spark, sf_dir):
    return rounded(rounded(rollup.tick_bars(ticks(spark, sf_dir), M15), "open", "high", "low", "close"), "mean_spread_points", digits=6)


for _name, _from, _to in (("h1", M15, H1), ("h4", M15, H4), ("d1", M15, D1), ("h4_to_d1", H4, D1)):

    @query(
        f"A01_rollup_{_name}",
        f"{q.bars_with(_from)} SELECT symbol, (time//{_to})*{_to} AS time, min(time) AS first_time, round(arg_min(open,time),8)+0.0 AS open, round(max(high),8)+0.0 AS high, round(min(low),8)+0.0 AS low, round(arg_max(close,time),8)+0.0 AS close, CAST(sum(tick_volume) AS BIGINT) AS tick_volume, quantile_cont(spread,0.5) AS spread, CAST(sum(real_volume) AS BIGINT) AS real_volume FROM bars GROUP BY symbol, time//{_to}",
    )
    def a01(spark, sf_dir, source=_from, target=_to):
        return rounded(rollup.longer_bars(bars(spark, sf_dir, source), target), "open", "high", "low", "close")


@query("V01_schema", "SELECT 'not_whole' AS \"check\", 'spread' AS \"column\"")
def v01(spark, sf_dir):
    return quality.validate_schema(bars(spark, sf_dir).drop("symbol"), strict=True)


@query(
    "V02_timestamps",
    f"WITH {q.TICKS}, s AS (SELECT *, time_msc//1000 AS time, (time_msc//1000) - lag(time_msc//1000) OVER (PARTITION BY symbol ORDER BY event_id * 7919 % 10007, event_id) AS step FROM ticks) SELECT symbol, count(*) AS n_rows, {q.count_if('time IS NULL')} AS n_null, {q.count_if('time <= 0')} AS n_non_positive, count(time) - count(DISTINCT time) AS n_duplicate, {q.count_if('step < 0')} AS n_out_of_order, min(time) AS first_time, max(time) AS last_time FROM s GROUP BY symbol",
)
def v02(spark, sf_dir):
    shuffled = ticks(spark, sf_dir).withColumn("time", F.expr("time_msc div 1000")).withColumn("sequence", F.col("event_id") * 7919 % 10007)
    return quality.validate_timestamps(shuffled, ["sequence", "event_id"], width=512)


@query("V03_utc_timestamp", f"{q.bars_with(H4)} SELECT symbol, time, strftime(make_timestamp(time*1000000), '%Y-%m-%d %H:%M:%S') AS utc FROM bars")
def v03(spark, sf_dir):
    return bars(spark, sf_dir, H4).select("symbol", "time", F.date_format(F.timestamp_seconds("time"), "yyyy-MM-dd HH:mm:ss").alias("utc"))


_V04 = {
    "n_high_below_low": "high < low", "n_high_below_open": "high < open", "n_high_below_close": "high < close", "n_low_above_open": "low > open", "n_low_above_close": "low > close",
}
_V04_SQL = ", ".join(f"{q.count_if(x)} AS {n}" for n, x in _V04.items())
_SUM4 = lambda cond: "CAST(" + " + ".join(f"count(CASE WHEN {cond.format(p)} THEN 1 END)" for p in ("open", "high", "low", "close")) + " AS BIGINT)"


@query(
    "V04_ohlc",
    f"{WITH_BROKEN}, c AS (SELECT symbol, count(*) AS n_rows, {_V04_SQL}, {_SUM4('{} IS NULL')} AS n_missing, CAST(0 AS BIGINT) AS n_infinite, {_SUM4('{} <= 0')} AS n_non_positive FROM broken GROUP BY symbol) SELECT *, n_high_below_low+n_high_below_open+n_high_below_close+n_low_above_open+n_low_above_close+n_missing+n_infinite+n_non_positive AS n_total, n_total = 0 AS is_valid FROM c",
)
def v04(spark, sf_dir):
    return quality.validate_ohlc(broken(spark, sf_dir)).withColumn("n_infinite", F.col("n_infinite").cast("long"))


@query(
    "V05_spread",
    f"{WITH_BROKEN} SELECT symbol, {q.count_if('spread < 0')} AS n_negative, {q.count_if('spread = 0')} AS n_zero, {q.count_if('spread IS NULL')} AS n_missing, min(spread) AS min_spread, max(spread) AS max_spread, round(avg(spread),2)+0.0 AS mean_spread, "
    + ", ".join(f"round(quantile_cont(spread,{p}),6)+0.0 AS {n}" for n, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95), ("p99", 0.99)))
    + " FROM broken GROUP BY symbol",
)
def v05(spark, sf_dir):
    return rounded(quality.validate_spread(broken(spark, sf_dir)), "p25", "median", "p75", "p95", "p99", "mean_spread", digits=6)


@query(
    "V06_volume",
    f"{WITH_BROKEN} SELECT symbol, {q.count_if('volume IS NULL')} AS n_missing, {q.count_if('volume = 0')} AS n_zero, min(volume) AS min_volume, max(volume) AS max_volume, round(avg(volume),2)+0.0 AS mean_volume, quantile_cont(volume,0.5) AS median_volume, round({q.count_if('real_volume = 0')}*100.0/count(*),4)+0.0 AS real_volume_zero_pct FROM broken GROUP BY symbol",
)
def v06(spark, sf_dir):
    return rounded(quality.validate_volume(broken(spark, sf_dir), "volume"), "mean_volume", "real_volume_zero_pct", "median_volume", digits=4)


@query("V07_duplicates_and_nulls", f"{WITH_BROKEN}, b2 AS (SELECT * FROM broken UNION ALL SELECT * FROM broken WHERE (time//900) % 97 < 9), g AS (SELECT symbol, time, close, spread, count(*) AS n FROM b2 GROUP BY ALL) SELECT CAST(sum(n-1) AS BIGINT) AS n_duplicate_rows, CAST(sum(((close IS NULL)::INT + (spread IS NULL)::INT)*n) AS BIGINT) AS n_null_cells FROM g")
def v07(spark, sf_dir):
    b = broken(spark, sf_dir)
    return quality.duplicates_and_nulls(b.unionByName(b.filter(F.floor(F.col("time") / M15) % 97 < 9)), ["symbol", "time", "close", "spread"])


@query(
    "V08_market_data",
    f"""{WITH_BROKEN}, g AS (SELECT *, {STEP} AS gap FROM broken), c AS (SELECT symbol, {q.count_if("high<low OR high<open OR high<close OR low>open OR low>close")} AS geo,
  {q.count_if("close IS NULL OR close <= 0 OR open IS NULL OR open <= 0 OR high IS NULL OR high <= 0 OR low IS NULL OR low <= 0")} AS bad, {q.count_if("spread < 0")} AS neg, {q.count_if("tick_volume = 0")} AS zero, {q.count_if("gap > 900")} AS n_gaps, count(time)-count(DISTINCT time) AS dup FROM g GROUP BY symbol)
SELECT symbol, CASE WHEN geo+bad+neg+dup = 0 THEN 'PASS' ELSE 'FAIL' END AS status, array_to_string(list_filter([CASE WHEN geo>0 THEN 'ohlc geometry' END, CASE WHEN bad>0 THEN 'bad prices' END, CASE WHEN dup>0 THEN 'duplicate times' END, CASE WHEN neg>0 THEN 'negative spread' END], lambda x: x IS NOT NULL), '; ') AS errors,
  array_to_string(list_filter([CASE WHEN zero>0 THEN 'zero volume' END, CASE WHEN n_gaps>0 THEN 'gaps' END], lambda x: x IS NOT NULL), '; ') AS warnings, n_gaps FROM c""",
)
def v08(spark, sf_dir):
    return quality.validate_market_data(broken(spark, sf_dir), M15)


@query(
    "V09_bar_records",
    f"{q.bars_with()}, g AS (SELECT *, {STEP} AS step FROM bars) SELECT symbol, count(*) AS n_rows, min(step) AS min_step, max(step) AS max_step, min(tick_volume) AS min_volume, max(tick_volume) AS max_volume, min(spread) AS min_spread, max(spread) AS max_spread, {q.count_if('high < low')} AS n_inverted, {q.count_if('step <= 0')} AS n_bad_step FROM g GROUP BY symbol",
)
def v09(spark, sf_dir):
    return quality.validate_bar_records(bars(spark, sf_dir))


@query(
    "V10_swing_data",
    f"{q.bars_with(H4)}, g AS (SELECT *, {STEP} AS step FROM bars) SELECT symbol, count(*) AS n_rows, count(*)-count(DISTINCT time) AS n_duplicate, {q.count_if('high<low OR high<greatest(open,close) OR low>least(open,close)')} AS n_geometry, {q.count_if('open<=0 OR high<=0 OR low<=0 OR close<=0')} AS n_non_positive, {q.count_if('open IS NULL OR close IS NULL')} AS n_null, {q.count_if('step > 21600')} AS n_gaps, max(step) AS max_gap FROM g GROUP BY symbol",
)
def v10(spark, sf_dir):
    return quality.validate_swing_data(bars(spark, sf_dir, H4), H4)


@query(
    "V11_tick_quality",
    f"""WITH {q.TICKS}, g AS (SELECT *, time_msc - lag(time_msc) OVER w AS gap, lag(bid) OVER w = bid AND lag(ask) OVER w = ask AS same FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY event_id))
SELECT symbol, count(*) AS n_ticks, {q.count_if("gap < 0")} AS n_out_of_order, count(time_msc)-count(DISTINCT time_msc) AS n_duplicate_ms, {q.count_if("same")} AS n_duplicate_quotes, {q.count_if("ask < bid")} AS n_negative_spread, {q.count_if("ask = bid")} AS n_zero_spread, {q.count_if("bid <= 0 OR ask <= 0")} AS n_invalid_price,
  round(quantile_cont(gap,0.5),6)+0.0 AS median_gap_ms, round(quantile_cont(gap,0.95),6)+0.0 AS p95_gap_ms, round(max(gap)/1000.0,6)+0.0 AS max_gap_s FROM g GROUP BY symbol""",
)
def v11(spark, sf_dir):
    return quality.validate_ticks(ticks(spark, sf_dir))


CUTOFF_MSC = 1_705_000_000_000


@query(
    "V12_tick_violations",
    f"WITH {q.TICKS}, t AS (SELECT symbol, event_id, time_msc, CASE WHEN event_id % 211 = 0 THEN NULL WHEN event_id % 211 = 1 THEN -bid ELSE bid END AS bid, CASE WHEN event_id % 211 = 2 THEN bid - 0.01 ELSE ask END AS ask FROM ticks), r AS (SELECT *, CASE WHEN bid IS NULL OR ask IS NULL THEN 'NON_FINITE' WHEN bid<=0 OR ask<=0 THEN 'NON_POSITIVE' WHEN ask-bid < -1e-9 THEN 'CROSSED' WHEN time_msc >= {CUTOFF_MSC} THEN 'BEYOND_CUTOFF' END AS reason FROM t) SELECT symbol, coalesce(reason,'OK') AS reason, count(*) AS n FROM r GROUP BY ALL",
)
def v12(spark, sf_dir):
    at = F.col("event_id") % 211
    dirty = ticks(spark, sf_dir).withColumn("ask", F.when(at == 2, F.col("bid") - 0.01).otherwise(F.col("ask"))).withColumn("bid", F.when(at == 0, F.lit(None)).when(at == 1, -F.col("bid")).otherwise(F.col("bid")))
    return quality.tick_violations(dirty, CUTOFF_MSC).groupBy("symbol", F.coalesce("reason", F.lit("OK")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    "V13_raw_series",
    f"WITH {q.EXO}, g AS (SELECT date_diff('day', lag(d) OVER (PARTITION BY year(d) ORDER BY d), d) AS gap FROM exo WHERE us_2y IS NOT NULL), gg AS (SELECT quantile_cont(gap,0.5) AS median_gap_days, max(gap) AS max_gap_days FROM g) SELECT count(*) AS n_rows, count(us_2y) AS n_valid, count(*)-count(us_2y) AS n_missing, count(d)-count(DISTINCT d) AS n_duplicate, {q.count_if('us_2y < -10 OR us_2y > 50')} AS n_impossible, any_value(median_gap_days) AS median_gap_days, CAST(any_value(max_gap_days) AS INT) AS max_gap_days, any_value(median_gap_days) BETWEEN 0 AND 7 AS gap_ok FROM exo, gg",
)
def v13(spark, sf_dir):
    return quality.validate_raw_series(exo_daily(spark, sf_dir), "d", "us_2y")


@query(
    "V20_normalised_ticks",
    f"WITH {q.TICKS}, t AS (SELECT upper(trim(' ' || symbol || ' ')) AS symbol, event_id, CASE WHEN event_id % 2 = 0 THEN time_msc ELSE (time_msc//1000)*1000 END - 7200000 AS time_msc, CASE WHEN event_id % 101 = 0 THEN 0 ELSE bid END AS bid, ask FROM ticks) SELECT symbol, event_id, time_msc, CASE WHEN bid <= 0 OR ask <= 0 THEN 'INVALID_PRICE' WHEN ask < bid THEN 'INVERTED_SPREAD' END AS reason FROM t",
)
def v20(spark, sf_dir):
    raw = ticks(spark, sf_dir).select(
        F.concat(F.lit(" "), "symbol", F.lit(" ")).alias("symbol"), "event_id", F.when(F.col("event_id") % 2 == 0, F.col("time_msc")).otherwise(F.expr("time_msc div 1000")).alias("raw_time"), F.when(F.col("event_id") % 101 == 0, 0.0).otherwise(F.col("bid")).alias("bid"), "ask"
    )
    return quality.normalised_ticks(raw, 2).select("symbol", "event_id", "time_msc", "reason")


CUTOFF = 1_706_000_000


@query(
    "V21_replay_checks",
    f"{WITH_BROKEN}, r AS (SELECT symbol, CASE WHEN time >= {CUTOFF} THEN 'QUARANTINED' WHEN time = {q.lag('time')} THEN 'DUPLICATE' WHEN close IS NULL OR close <= 0 OR open <= 0 OR high <= 0 OR low <= 0 THEN 'BAD_PRICE' WHEN high < greatest(open,close) OR low > least(open,close) OR high < low THEN 'BAD_OHLC' END AS reason, coalesce(close,(high+low)/2) AS last FROM broken) SELECT symbol, coalesce(reason,'OK') AS reason, count(*) AS n, round(sum(last),6)+0.0 AS sum_last FROM r GROUP BY ALL",
)
def v21(spark, sf_dir):
    out = quality.replay_checks(broken(spark, sf_dir), CUTOFF).groupBy("symbol", F.coalesce("reason", F.lit("OK")).alias("reason")).agg(F.count("*").alias("n"), F.sum("last").alias("sum_last"))
    return rounded(out, "sum_last", digits=6)


@query("V23_locked_period", f"{q.bars_with(H4)} SELECT symbol, time, round(close,8)+0.0 AS close FROM bars WHERE time < {CUTOFF}")
def v23(spark, sf_dir):
    return rounded(quality.locked_period(bars(spark, sf_dir, H4), CUTOFF).select("symbol", "time", "close"), "close")


@query(
    "V26_order_lifecycle",
    """WITH h AS (SELECT o_custkey AS order_id, o_orderdate AS changed_at, o_orderkey AS sequence, o_orderstatus AS status FROM orders), s AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY order_id ORDER BY changed_at, sequence), 'NEW') AS before FROM h)
SELECT before, status, count(*) AS n FROM s WHERE before <> status AND (before, status) NOT IN (('NEW','O'),('O','P'),('P','F'),('O','F')) GROUP BY ALL""",
)
def v26(spark, sf_dir):
    history = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("order_id"), F.col("o_orderdate").alias("changed_at"), F.col("o_orderkey").alias("sequence"), F.col("o_orderstatus").alias("status"))
    return quality.lifecycle_violations(history, [("NEW", "O"), ("O", "P"), ("P", "F"), ("O", "F")]).groupBy("before", "status").agg(F.count("*").alias("n"))


_CHAIN = "concat_ws(':', prev_hash, CAST(event_id AS VARCHAR), CAST(time_msc AS VARCHAR), symbol, props)"


@query(
    "V27_audit_chain",
    f"""WITH {q.TICKS}, e AS (SELECT t.*, e.props FROM ticks t JOIN events e USING (event_id)), p AS (SELECT *, coalesce(sha256(CAST(lag(event_id) OVER (PARTITION BY symbol ORDER BY event_id) AS VARCHAR)), repeat('0',64)) AS prev_hash FROM e),
h AS (SELECT *, sha256({_CHAIN}) AS own, CASE WHEN event_id % 1009 = 5 THEN 'x' ELSE sha256({_CHAIN}) END AS event_hash FROM p), k AS (SELECT *, prev_hash <> coalesce(lag(event_hash) OVER (PARTITION BY symbol ORDER BY event_id), repeat('0',64)) AS link FROM h)
SELECT symbol AS ledger, count(*) AS n_events, {q.count_if("link")} AS n_broken_links, {q.count_if("own <> event_hash")} AS n_wrong_hashes, min(CASE WHEN link OR own <> event_hash THEN event_id END) AS first_failure FROM k GROUP BY symbol""",
)
def v27(spark, sf_dir):
    """The tables hold no chained ledger, so each event claims a hash of its predecessor's id: every link but the first breaks."""
    props = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props")
    e = with_previous(ticks(spark, sf_dir), ["symbol"], ["event_id"], {"id_before": "event_id"}, ID_RANGE).join(props, "event_id").withColumn("prev_hash", F.coalesce(F.sha2(F.col("id_before").cast("string"), 256), F.lit("0" * 64)))
    hashed = F.sha2(F.concat_ws(":", "prev_hash", "event_id", "time_msc", "symbol", "props"), 256)
    events = e.select(F.col("symbol").alias("ledger"), F.col("event_id").alias("sequence"), "event_id", F.col("time_msc").alias("timestamp"), F.col("symbol").alias("event_type"), F.col("props").alias("payload"), "prev_hash", F.when(F.col("event_id") % 1009 == 5, "x").otherwise(hashed).alias("event_hash"))
    return quality.audit_chain(events)


_POINTS = "points AS (SELECT o_custkey % 7 AS series_id, strftime(o_orderdate,'%Y-%m') AS observation_period, o_orderkey AS information_timestamp, o_custkey % 3 AS actual, o_orderkey % 4 AS revision_vintage FROM orders)"


def points(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        (F.col("o_custkey") % 7).alias("series_id"), F.date_format("o_orderdate", "yyyy-MM").alias("observation_period"), F.col("o_orderkey").alias("information_timestamp"), (F.col("o_custkey") % 3).alias("actual"), (F.col("o_orderkey") % 4).alias("revision_vintage")
    )


@query("V16_untracked_revisions", f"WITH {_POINTS} SELECT * FROM points WINDOW w AS (PARTITION BY series_id, observation_period ORDER BY information_timestamp) QUALIFY lag(actual) OVER w <> actual AND revision_vintage <= lag(revision_vintage) OVER w")
def v16(spark, sf_dir):
    return quality.untracked_revisions(points(spark, sf_dir))


@query("V15_point_in_time", f"WITH {_POINTS} SELECT series_id, count(*) AS n FROM points WHERE information_timestamp % 1000 > revision_vintage * 250 GROUP BY ALL")
def v15(spark, sf_dir):
    late = points(spark, sf_dir).filter(F.col("revision_vintage") * 250 < F.col("information_timestamp") % 1000)
    return late.groupBy("series_id").agg(F.count("*").alias("n"))


@query(
    "A06_gaps",
    f"{q.bars_with()}, g AS (SELECT symbol, {q.lag('time')} AS start_time, time AS end_time, time - {q.lag('time')} AS seconds FROM bars), c AS (SELECT *, seconds//900 - 1 AS missing_bars, isodow(make_timestamp(start_time*1000000)) - 1 AS sd, isodow(make_timestamp(end_time*1000000)) - 1 AS ed FROM g WHERE seconds > 900) "
    + "SELECT symbol, start_time, end_time, seconds, missing_bars, CASE WHEN sd=4 AND ed IN (6,0) AND seconds BETWEEN 129600 AND 234000 THEN 'WEEKEND' WHEN sd IN (4,5) AND ed IN (6,0,1) AND seconds BETWEEN 129600 AND 288000 THEN CASE WHEN holiday THEN 'HOLIDAY' ELSE 'WEEKEND' END WHEN holiday AND seconds <= 259200 THEN 'HOLIDAY' WHEN sd < 4 AND ed < 4 THEN 'UNEXPECTED' ELSE 'UNCLASSIFIED' END AS gap_class FROM (SELECT *, strftime(make_timestamp(start_time*1000000),'%m-%d') IN ('12-24','12-25','12-31','01-01') OR strftime(make_timestamp(end_time*1000000),'%m-%d') IN ('12-25','12-26','01-01','01-02') AS holiday FROM c) x",
)
def a06(spark, sf_dir):
    return micro.gaps(bars(spark, sf_dir), M15)


@query(
    "A07_gap_statistics",
    f"{q.bars_with()}, g AS (SELECT symbol, time - {q.lag('time')} AS seconds FROM bars) SELECT symbol, count(seconds) AS n_steps, round({q.count_if('seconds = 900')}*100.0/count(seconds),6)+0.0 AS normal_pct, max(seconds) AS max_gap FROM g GROUP BY symbol",
)
def a07(spark, sf_dir):
    return rounded(micro.gap_statistics(bars(spark, sf_dir), M15), "normal_pct", digits=6)


@query("K01_top_gaps", f"{q.bars_with()}, g AS (SELECT symbol, time, time - {q.lag('time')} AS seconds FROM bars) SELECT symbol, time, seconds FROM g WHERE seconds > 900 ORDER BY seconds DESC, symbol, time LIMIT 10")
def k01(spark, sf_dir):
    return micro.top_gaps(bars(spark, sf_dir), M15, 10)


@query(
    "A08_spread_metrics",
    f"WITH {q.TICKS} SELECT symbol, count(*) AS n_ticks, round(avg(spread_points),6)+0.0 AS mean_points, round(quantile_cont(spread_points,0.5),6)+0.0 AS median_points, round(quantile_cont(spread_points,0.9),6)+0.0 AS p90, round(quantile_cont(spread_points,0.95),6)+0.0 AS p95, round(quantile_cont(spread_points,0.99),6)+0.0 AS p99, min(spread_points) AS min_points, max(spread_points) AS max_points, round(stddev_samp(spread_points),6)+0.0 AS std_points, round(count(CASE WHEN spread_points IS NULL THEN 1 END)*100.0/count(*),6)+0.0 AS missing_pct FROM ticks GROUP BY symbol",
)
def a08(spark, sf_dir):
    return rounded(micro.spread_metrics(ticks(spark, sf_dir)), "mean_points", "median_points", "p90", "p95", "p99", "std_points", "missing_pct", digits=6)


@query(
    "A09_tick_intensity",
    f"WITH {q.TICKS}, b AS (SELECT symbol, m, time_msc//(m*60000) AS k, count(*) AS n FROM ticks, (VALUES (1),(5),(15)) v(m) GROUP BY ALL) SELECT symbol, m AS minutes, count(*) AS n_bins, round(avg(n),6)+0.0 AS mean_ticks, round(quantile_cont(n,0.5),6)+0.0 AS median_ticks, max(n) AS max_ticks, min(n) AS min_ticks FROM b GROUP BY ALL",
)
def a09(spark, sf_dir):
    return rounded(micro.intensity(ticks(spark, sf_dir), (1, 5, 15)), "mean_ticks", "median_ticks", digits=6)


@query(
    "A10_tick_direction",
    f"""WITH {q.TICKS}, d AS (SELECT symbol, flags, sign(bid - lag(bid) OVER w) AS b, sign(ask - lag(ask) OVER w) AS a FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY event_id))
SELECT symbol, {q.count_if("b > 0")} AS bid_up, {q.count_if("b < 0")} AS bid_down, {q.count_if("b = 0")} AS bid_same, {q.count_if("a > 0")} AS ask_up, {q.count_if("a < 0")} AS ask_down, {q.count_if("a = 0")} AS ask_same, round({q.count_if("b > 0")}/(count(*)-1.0),8)+0.0 AS bid_up_share, {q.count_if("flags & 4 > 0")} AS n_flag_4, {q.count_if("flags & 32 > 0")} AS n_flag_32 FROM d GROUP BY symbol""",
)
def a10(spark, sf_dir):
    return rounded(micro.direction(ticks(spark, sf_dir), (4, 32)), "bid_up_share")


@query(
    "A11_intrabar_path",
    f"""WITH {q.TICKS}, m AS (SELECT symbol, time_msc//900000 AS bar, event_id, bid, bid - lag(bid) OVER (PARTITION BY symbol, time_msc//900000 ORDER BY event_id) AS d FROM ticks),
z AS (SELECT symbol, bar, event_id, sign(d) <> lag(sign(d)) OVER (PARTITION BY symbol, bar ORDER BY event_id) AS turn FROM m WHERE d <> 0), zz AS (SELECT symbol, bar, {q.count_if("turn")} AS n_turns FROM z GROUP BY ALL),
g AS (SELECT symbol, bar, count(*) AS n, sum(abs(d)) AS path, max(bid)-min(bid) AS rng, arg_max(bid,event_id)-arg_min(bid,event_id) AS net FROM m GROUP BY ALL HAVING count(*) >= 2)
SELECT symbol, bar*900 AS time, n AS n_ticks, round(path,8)+0.0 AS path_length, round(rng,8)+0.0 AS price_range, round(net,8)+0.0 AS net_move, round(CASE WHEN path > 1e-9 THEN abs(net)/path END,6)+0.0 AS efficiency, coalesce(n_turns,0) AS n_turns FROM g LEFT JOIN zz USING (symbol, bar)""",
)
def a11(spark, sf_dir):
    return rounded(rounded(micro.intrabar_path(ticks(spark, sf_dir), M15), "path_length", "price_range", "net_move"), "efficiency", digits=6)


@query(
    "A12_realized_volatility",
    f"""WITH {q.TICKS}, m AS (SELECT symbol, time_msc//900000 AS bar, ln(bid) - ln(lag(bid) OVER (PARTITION BY symbol, time_msc//900000 ORDER BY event_id)) AS r FROM ticks)
SELECT symbol, bar*900 AS time, count(*) AS n_ticks, round(sum(r*r),8)+0.0 AS realized_variance, round(sqrt(sum(r*r)),8)+0.0 AS realized_volatility, round(sum(abs(r)),8)+0.0 AS absolute_variation, round(stddev_pop(r),8)+0.0 AS std_return FROM m GROUP BY symbol, bar HAVING count(*) >= 3""",
)
def a12(spark, sf_dir):
    return rounded(micro.realized_volatility(ticks(spark, sf_dir), M15), "realized_variance", "realized_volatility", "absolute_variation", "std_return")


_SESSION = "CASE WHEN h < 7 THEN 'ASIAN' WHEN h < 12 THEN 'LONDON' WHEN h < 16 THEN 'OVERLAP' WHEN h < 21 THEN 'NEW_YORK' ELSE 'ROLLOVER' END"


@query(
    "A13_session_microstructure",
    f"""WITH {q.TICKS}, s AS (SELECT *, {_SESSION} AS session FROM (SELECT *, time_msc//3600000 % 24 AS h FROM ticks) x), g AS (SELECT *, time_msc - lag(time_msc) OVER (PARTITION BY symbol, session ORDER BY event_id) AS gap FROM s), t AS (SELECT symbol, count(*) AS n FROM ticks GROUP BY symbol)
SELECT symbol, session, count(*) AS n_ticks, round(count(*)*1.0/any_value(t.n),8)+0.0 AS share, round(avg(spread_points),6)+0.0 AS mean_points, round(quantile_cont(spread_points,0.5),6)+0.0 AS median_points, round(quantile_cont(spread_points,0.95),6)+0.0 AS p95_points, round(count(*)*60000.0/nullif(max(time_msc)-min(time_msc),0),8)+0.0 AS ticks_per_minute, round(quantile_cont(gap,0.5),6)+0.0 AS median_gap_ms FROM g JOIN t USING (symbol) GROUP BY symbol, session""",
)
def a13(spark, sf_dir):
    out = micro.sessions(ticks(spark, sf_dir))
    return rounded(rounded(out, "share", "ticks_per_minute"), "mean_points", "median_points", "p95_points", "median_gap_ms", digits=6)


@query(
    "A25_coverage",
    f"""WITH {q.TICKS}, g AS (SELECT symbol, time_msc, CASE WHEN time_msc - lag(time_msc) OVER w > 300000 THEN 1 ELSE 0 END AS cut FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY time_msc)), i AS (SELECT *, sum(cut) OVER (PARTITION BY symbol ORDER BY time_msc ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT symbol, CAST(island AS BIGINT) AS island, min(time_msc) AS start_msc, max(time_msc) AS end_msc, count(*) AS n_ticks FROM i GROUP BY symbol, island""",
)
def a25(spark, sf_dir):
    return micro.coverage(ticks(spark, sf_dir), 300_000)


@query("K05_adjacent_dedupe", f"WITH {q.TICKS}, d AS (SELECT symbol, event_id, time_msc//60000 AS minute, floor(spread_points/25) AS level FROM ticks) SELECT symbol, event_id, minute, level FROM d WINDOW w AS (PARTITION BY symbol ORDER BY event_id) QUALIFY NOT coalesce(lag(minute) OVER w = minute AND lag(level) OVER w = level, false)")
def k05(spark, sf_dir):
    coarse = ticks(spark, sf_dir).select("symbol", "event_id", F.expr("time_msc div 60000").alias("minute"), F.floor(F.col("spread_points") / 25).cast("double").alias("level"))
    return micro.drop_adjacent(coarse, ["minute", "level"], ["event_id"], ID_RANGE)


@query("O01_merge_extracts", f"{q.bars_with(H4)}, u AS (SELECT *, 1 AS p FROM bars WHERE time < 1705300000 UNION ALL SELECT *, 2 AS p FROM bars WHERE time >= 1704900000), r AS (SELECT *, row_number() OVER (PARTITION BY symbol, time ORDER BY p) AS rn FROM u) SELECT symbol, time, round(close,8)+0.0 AS close, p AS extract FROM r WHERE rn = 1")
def o01(spark, sf_dir):
    b = bars(spark, sf_dir, H4)
    out = micro.merge_extracts([b.filter("time < 1705300000"), b.filter("time >= 1704900000")])
    return rounded(out.select("symbol", "time", "close", "extract"), "close")


@query("J21_overlap_check", f"{q.bars_with(H4)}, a AS (SELECT * FROM bars WHERE time < 1705300000), b AS (SELECT symbol, time, open, high, low, CASE WHEN (time//14400) % 5 = 0 THEN close + 1 ELSE close END AS close FROM bars WHERE time >= 1704900000) SELECT count(*) AS n_overlap, {q.count_if('a.open IS DISTINCT FROM b.open')} AS open_mismatch, {q.count_if('a.close IS DISTINCT FROM b.close')} AS close_mismatch FROM a JOIN b USING (symbol, time)")
def j21(spark, sf_dir):
    b = bars(spark, sf_dir, H4)
    second = b.filter("time >= 1704900000").withColumn("close", F.when(F.floor(F.col("time") / H4) % 5 == 0, F.col("close") + 1).otherwise(F.col("close")))
    return micro.overlap_mismatches(b.filter("time < 1705300000"), second, ["symbol", "time"], ["open", "close"])


@query("J22_reconstruction", f"WITH {q.TICKS}, {q.bars(900)}, {q.bars(3600, 'h')}, r AS (SELECT symbol, (time//3600)*3600 AS time, max(high) AS high, min(low) AS low, arg_min(open,time) AS open, arg_max(close,time) AS close FROM bars GROUP BY symbol, time//3600) SELECT count(*) AS n_matched, round(max(abs(h.open-r.open)),8)+0.0 AS open_diff, round(max(abs(h.high-r.high)),8)+0.0 AS high_diff, round(max(abs(h.low-r.low)),8)+0.0 AS low_diff, round(max(abs(h.close-r.close)),8)+0.0 AS close_diff FROM h JOIN r USING (symbol, time)")
def j22(spark, sf_dir):
    out = micro.reconstruction_difference(bars(spark, sf_dir, H1), rollup.longer_bars(bars(spark, sf_dir, M15), H1))
    return rounded(out, "open_diff", "high_diff", "low_diff", "close_diff")


@query("S07_bounded_scan", "SELECT event_id, event_type AS symbol, epoch_us(ts)//1000 AS time_msc FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' ORDER BY ts, event_id LIMIT 500")
def s07(spark, sf_dir):
    out = readers.bounded_scan(spark, f"{sf_dir}/events.parquet", "ts", "2024-01-05", "2024-01-20", 500, ["event_id"])
    return out.select("event_id", F.col("event_type").alias("symbol"), F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("time_msc"))


@query("S10_ledger_scan", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O'")
def s10(spark, sf_dir):
    return readers.ledger_scan(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderstatus", "O", [F.desc("o_orderdate"), F.asc("o_orderkey")]).select("o_orderkey", "o_orderstatus")


@query("S09_latest_wins", "SELECT o_custkey AS account, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS order_id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY o_custkey")
def s09(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("account"), F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"), "o_orderdate")
    return readers.latest(rows, ["account"], ["o_orderdate", "order_id"]).select("account", "order_id", "status")


@query("S11_multi_symbol", f"{q.bars_with(H4)} SELECT symbol, time, round(close,8)+0.0 AS close FROM bars WHERE symbol IN ('click','view')")
def s11(spark, sf_dir):
    b = bars(spark, sf_dir, H4)
    return rounded(readers.symbols(b.unionByName(b), ["click", "view"]).select("symbol", "time", "close"), "close")


@query("S03_dataset_metadata", f"{q.bars_with()} SELECT count(*) AS n_rows, count(DISTINCT symbol) AS n_symbols, min(time) AS first_time, max(time) AS last_time, 9 AS n_columns FROM bars")
def s03(spark, sf_dir):
    return readers.metadata(bars(spark, sf_dir))


@query("K06_newest_events", "SELECT event_id, user_id FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 25")
def k06(spark, sf_dir):
    return readers.ledger_scan(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "click", [F.desc("ts"), F.desc("event_id")], 25).select("event_id", "user_id")

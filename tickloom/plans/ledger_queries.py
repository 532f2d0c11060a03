"""Queries of joins, splits, ledgers and costs (J, D, A16-A27, P06-P18, W13, T, K02, V28)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import asof, labels, ledger, micro, splits, stats
from tickloom.operators.windows import end_ticks, summed
from tickloom.plans import sql as q
from tickloom.plans.catalog import query, rounded
from tickloom.sources.adapters import H1, H4, M15, bars, exo_daily, ticks, trades

DAY = 86_400
SHIFT = 9131  # days from 1999-01-01 to 2024-01-01


def exo_shifted(spark, sf_dir):
    """The slow series moved onto the bars' dates, with the second at which it may be used."""
    e = exo_daily(spark, sf_dir).filter("us_2y is not null")
    return e.select((F.unix_timestamp(F.date_add("d", SHIFT).cast("timestamp")) + 57_600).cast("long").alias("usable_time"), F.col("us_2y").alias("value"))


_EXO = f"{q.EXO}, x AS (SELECT CAST(epoch(d + INTERVAL {SHIFT} DAY) AS BIGINT) + 57600 AS usable_time, us_2y AS value FROM exo WHERE us_2y IS NOT NULL)"
_B4 = f"WITH {q.TICKS}, {q.bars(H4)}, {_EXO}"


@query(
    "J04_asof_backward",
    f"{_B4}, j AS (SELECT b.symbol, b.time, x.usable_time, x.value FROM bars b ASOF LEFT JOIN x ON b.time >= x.usable_time) SELECT symbol, time, usable_time, round(value,8)+0.0 AS value FROM j",
)
def j04(spark, sf_dir):
    out = asof.asof_slow(bars(spark, sf_dir, H4), exo_shifted(spark, sf_dir), "time", "usable_time", ["value"])
    return rounded(out.select("symbol", "time", "usable_time", "value"), "value")


@query("J04_alignment_audit", f"{_B4}, j AS (SELECT b.symbol, b.time, x.usable_time FROM bars b ASOF LEFT JOIN x ON b.time >= x.usable_time) SELECT count(usable_time) AS n_aligned, count(*)-count(usable_time) AS n_unaligned, count(DISTINCT usable_time) AS n_reports, {q.count_if('usable_time > time')} AS n_violations FROM j")
def j04_audit(spark, sf_dir):
    out = asof.asof_slow(bars(spark, sf_dir, H4), exo_shifted(spark, sf_dir), "time", "usable_time", ["value"])
    return out.agg(F.count("usable_time").alias("n_aligned"), (F.count("*") - F.count("usable_time")).alias("n_unaligned"), F.count_distinct("usable_time").alias("n_reports"), F.count_if(F.col("usable_time") > F.col("time")).alias("n_violations"))


@query("J06_fine_bar_before_close", f"WITH {q.TICKS}, {q.bars(H4, 'h4')}, {q.bars(900)} SELECT h.symbol, h.time, b.time AS fine_time, round(b.close,8)+0.0 AS fine_close FROM h4 h ASOF LEFT JOIN bars b ON h.symbol = b.symbol AND h.time + 13500 >= b.time")
def j06(spark, sf_dir):
    h4 = bars(spark, sf_dir, H4).select("symbol", "time", (F.col("time") + H4 - M15).alias("cutoff"))
    fine = bars(spark, sf_dir).select("symbol", F.col("time").alias("fine_time"), F.col("close").alias("fine_close"))
    return rounded(asof.asof(h4, fine, ["symbol"], "cutoff", "fine_time", ["fine_close"], DAY).drop("cutoff"), "fine_close")


@query(
    "J07_exogenous_policies",
    f"{_B4}, y AS (SELECT usable_time, CASE WHEN (usable_time//86400) % 5 = 0 THEN NULL ELSE value END AS value FROM x), j AS (SELECT b.symbol, b.time, y.usable_time, y.value FROM bars b ASOF LEFT JOIN y ON b.time + 14400 >= y.usable_time), g AS (SELECT *, CASE WHEN usable_time IS NOT NULL THEN row_number() OVER (PARTITION BY symbol, usable_time ORDER BY time) - 1 END AS age_bars FROM j) SELECT symbol, time, age_bars, round(CASE WHEN time + 14400 - usable_time <= 172800 AND age_bars <= 3 THEN value END,8)+0.0 AS value FROM g",
)
def j07(spark, sf_dir):
    events = exo_shifted(spark, sf_dir).withColumn("value", F.when(F.floor(F.col("usable_time") / DAY) % 5 != 0, F.col("value")))
    every = bars(spark, sf_dir, H4).select("symbol", "time", (F.col("time") + H4).alias("close_time"))
    names = every.select("symbol").distinct()
    out = asof.exogenous(every, events.join(F.broadcast(names)), ["symbol"], 2 * DAY, 3, exact=False, bucket=30 * DAY)  # five symbols
    return rounded(out.select("symbol", "time", F.col("age_bars").cast("long").alias("age_bars"), "value"), "value")


_COVER = "c0 AS (SELECT symbol, time_msc, CASE WHEN time_msc - lag(time_msc) OVER w > 300000 THEN 1 ELSE 0 END AS cut FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY time_msc)), c1 AS (SELECT *, sum(cut) OVER (PARTITION BY symbol ORDER BY time_msc ROWS UNBOUNDED PRECEDING) AS island FROM c0), cover AS (SELECT symbol, min(time_msc) AS start_msc, max(time_msc) AS end_msc FROM c1 GROUP BY symbol, island), gaps AS (SELECT symbol, end_msc AS gap_start, lead(start_msc) OVER (PARTITION BY symbol ORDER BY start_msc) AS gap_end FROM cover)"
_TARGETS = "targets AS (SELECT symbol, event_id, time_msc - (event_id * 37 % 90) * 1000 AS target_msc FROM ticks)"


def targets(spark, sf_dir):
    return ticks(spark, sf_dir).select("symbol", "event_id", (F.col("time_msc") - F.col("event_id") * 37 % 90 * 1000).alias("target_msc"))


@query(
    "J08_first_tick_after",
    f"WITH {q.TICKS}, {_COVER}, {_TARGETS}, f AS (SELECT t.symbol, t.event_id, t.target_msc, k.time_msc, k.bid FROM targets t ASOF LEFT JOIN ticks k ON t.symbol = k.symbol AND t.target_msc <= k.time_msc), g AS (SELECT f.*, gp.gap_start, gp.gap_end FROM f ASOF LEFT JOIN gaps gp ON f.symbol = gp.symbol AND f.target_msc >= gp.gap_start), h AS (SELECT *, gap_start IS NOT NULL AND (gap_end IS NULL OR target_msc < gap_end) AS in_gap FROM g) SELECT symbol, event_id, target_msc, CASE WHEN NOT in_gap AND time_msc - target_msc <= 60000 THEN time_msc END AS time_msc, round(CASE WHEN NOT in_gap AND time_msc - target_msc <= 60000 THEN bid END,8)+0.0 AS bid, in_gap FROM h",
)
def j08(spark, sf_dir):
    t = ticks(spark, sf_dir)
    out = asof.first_tick_after(targets(spark, sf_dir), t, micro.coverage(t, 300_000), 60_000, DAY * 1000)
    return rounded(out.drop("ask"), "bid")


_WINDOWS = "wins AS (SELECT symbol, event_id AS window_id, time_msc - 900000 AS window_start, time_msc + 1800000 AS window_end FROM ticks)"


def windows(spark, sf_dir):
    return ticks(spark, sf_dir).select("symbol", F.col("event_id").alias("window_id"), (F.col("time_msc") - 900_000).alias("window_start"), (F.col("time_msc") + 1_800_000).alias("window_end"))


@query("J09_ticks_in_windows", f"WITH {q.TICKS}, {_WINDOWS} SELECT w.symbol, w.window_id, count(*) AS n_ticks, round(max(t.bid),8)+0.0 AS max_bid, round(min(t.bid),8)+0.0 AS min_bid FROM wins w JOIN ticks t ON t.symbol = w.symbol AND t.time_msc BETWEEN w.window_start AND w.window_end GROUP BY ALL")
def j09(spark, sf_dir):
    t = ticks(spark, sf_dir).select("symbol", "time_msc", "bid")
    out = summed(t, windows(spark, sf_dir), ["symbol"], "time_msc", "window_start", "window_end", 2_700_000, "bid", ["symbol", "window_id"])
    return rounded(out.withColumnsRenamed({"n_points": "n_ticks", "max_value": "max_bid", "min_value": "min_bid"}), "max_bid", "min_bid")


@query("J10_window_coverage", f"WITH {q.TICKS}, {_COVER}, {_WINDOWS} SELECT w.symbol, w.window_id, EXISTS (SELECT 1 FROM cover c WHERE c.symbol = w.symbol AND c.start_msc - 600000 <= w.window_start AND w.window_end <= c.end_msc + 600000) AS is_covered FROM wins w")
def j10(spark, sf_dir):
    t = ticks(spark, sf_dir)
    return asof.covered(windows(spark, sf_dir), micro.coverage(t, 300_000).select("symbol", "start_msc", "end_msc"), 600_000, DAY * 1000).select("symbol", "window_id", "is_covered")


@query(
    "J11_coverage_class",
    f"WITH {q.TICKS}, {_COVER}, {_WINDOWS}, n AS (SELECT w.symbol, w.window_id, {q.count_if('t.time_msc <= w.window_start + 600000')} AS a, {q.count_if('t.time_msc >= w.window_end - 600000')} AS b FROM wins w LEFT JOIN ticks t ON t.symbol = w.symbol AND t.time_msc BETWEEN w.window_start AND w.window_end GROUP BY ALL), c AS (SELECT w.symbol, w.window_id, EXISTS (SELECT 1 FROM cover c WHERE c.symbol = w.symbol AND c.start_msc - 600000 <= w.window_start AND w.window_end <= c.end_msc + 600000) AS ok FROM wins w) SELECT CASE WHEN a = 0 AND b = 0 THEN 'NO_TICK_COVERAGE' WHEN ok THEN 'FULL' WHEN a > 0 AND b > 0 THEN 'GAP_CROSSED' ELSE 'PARTIAL' END AS coverage_class, count(*) AS n FROM n JOIN c USING (symbol, window_id) GROUP BY 1",
)
def j11(spark, sf_dir):
    t = ticks(spark, sf_dir)
    w = windows(spark, sf_dir)
    counts = end_ticks(t.select("symbol", "time_msc"), w, 600_000, 2_700_000)
    whole = asof.covered(w, micro.coverage(t, 300_000).select("symbol", "start_msc", "end_msc"), 600_000, DAY * 1000).join(counts, ["symbol", "window_id"], "left").fillna(0, ["entry_ticks", "exit_ticks"])
    return whole.groupBy(asof.coverage_class(whole).alias("coverage_class")).agg(F.count("*").alias("n"))


_SECOND = "second AS (SELECT * REPLACE (net_pnl + trade_id % 7 - 3 AS net_pnl, CASE WHEN trade_id % 5 = 0 THEN CASE exit_reason WHEN 'TAKE_PROFIT' THEN 'STOP_LOSS' WHEN 'STOP_LOSS' THEN 'MAX_HOLD' ELSE 'TAKE_PROFIT' END ELSE exit_reason END AS exit_reason) FROM trades WHERE trade_id % 50 <> 0)"
_REC = f"WITH {q.TRADES}, {_SECOND}, rec AS (SELECT signal_time, direction, trade_id, a.net_pnl AS a_pnl, a.exit_reason AS a_reason, b.net_pnl AS b_pnl, b.exit_reason AS b_reason FROM trades a FULL OUTER JOIN second b USING (signal_time, direction, trade_id)), d AS (SELECT *, CASE WHEN b_pnl IS NULL THEN 'MISSING_IN_B' WHEN a_pnl IS NULL THEN 'MISSING_IN_A' WHEN a_reason <> b_reason THEN 'EXIT_REASON' WHEN abs(a_pnl-b_pnl) > 1e-9 THEN 'PNL' ELSE 'EQUAL' END AS difference FROM rec)"


def reconciled(spark, sf_dir):
    a = trades(spark, sf_dir)
    turned = F.when(F.col("exit_reason") == "TAKE_PROFIT", "STOP_LOSS").when(F.col("exit_reason") == "STOP_LOSS", "MAX_HOLD").otherwise("TAKE_PROFIT")
    b = a.filter("trade_id % 50 != 0").withColumn("net_pnl", F.col("net_pnl") + F.col("trade_id") % 7 - 3).withColumn("exit_reason", F.when(F.col("trade_id") % 5 == 0, turned).otherwise(F.col("exit_reason")))
    return asof.reconcile(a, b)


@query("J12_reconciliation", f"{_REC} SELECT direction, difference, count(*) AS n, round(sum(b_pnl-a_pnl),6)+0.0 AS sum_diff FROM d GROUP BY ALL")
def j12(spark, sf_dir):
    out = reconciled(spark, sf_dir).groupBy("direction", "difference").agg(F.count("*").alias("n"), F.sum(F.col("b_pnl") - F.col("a_pnl")).alias("sum_diff"))
    return rounded(out, "sum_diff", digits=6)


@query("A21_exit_transitions", f"{_REC} SELECT a_reason, b_reason, count(*) AS n, round(sum(b_pnl-a_pnl),6)+0.0 AS sum_diff, round(avg(b_pnl-a_pnl),6)+0.0 AS mean_diff, round(quantile_cont(b_pnl-a_pnl,0.5),6)+0.0 AS median_diff FROM d WHERE a_pnl IS NOT NULL AND b_pnl IS NOT NULL GROUP BY ALL")
def a21(spark, sf_dir):
    return rounded(ledger.transitions(reconciled(spark, sf_dir)), "sum_diff", "mean_diff", "median_diff", digits=6)


@query("J18_outliers", f"{_REC}, t AS (SELECT trade_id, net_pnl, exit_reason FROM trades ORDER BY abs(net_pnl) DESC, trade_id LIMIT 20) SELECT t.trade_id, t.net_pnl, t.exit_reason, d.difference FROM t LEFT JOIN d USING (trade_id)")
def j18(spark, sf_dir):
    return ledger.outliers(trades(spark, sf_dir), reconciled(spark, sf_dir), 20).select("trade_id", "net_pnl", "exit_reason", "difference")


@query(
    "J13_positions",
    """WITH i AS (SELECT event_type AS symbol, sum(CASE WHEN event_id % 3 = 0 THEN -1000.0 ELSE 1000.0 END) AS net, array_to_string(list_sort(list_distinct(list(CASE WHEN event_id % 3 = 0 THEN 'SELL' ELSE 'BUY' END))),'+') AS sides FROM events WHERE event_type <> 'view' GROUP BY 1),
x AS (SELECT event_type AS symbol, sum(CASE WHEN event_id % 3 = 0 THEN -0.01::DOUBLE ELSE 0.01::DOUBLE END)*100000 AS net, array_to_string(list_sort(list_distinct(list(CASE WHEN event_id % 3 = 0 THEN 'SELL' ELSE 'BUY' END))),'+') AS sides FROM events WHERE event_type <> 'click' AND NOT (event_type = 'signup' AND event_id % 5 = 1) GROUP BY 1)
SELECT symbol, CASE WHEN x.net IS NULL THEN 'MISSING_EXTERNAL' WHEN i.net IS NULL THEN 'MISSING_INTERNAL' WHEN i.sides <> x.sides THEN 'SIDE_MISMATCH' WHEN abs(i.net-x.net) > 1e-3 THEN 'QUANTITY_MISMATCH' ELSE 'MATCHED' END AS status, CAST(round(i.net,4) AS DOUBLE) AS internal_units, CAST(round(x.net,4) AS DOUBLE) AS external_units FROM i FULL OUTER JOIN x USING (symbol)""",
)
def j13(spark, sf_dir):
    t = ticks(spark, sf_dir).withColumn("side", F.when(F.col("event_id") % 3 == 0, "SELL").otherwise("BUY"))
    internal = t.filter("symbol != 'view'").withColumn("units", F.lit(1000.0))
    external = t.filter("symbol != 'click' and not (symbol = 'signup' and event_id % 5 = 1)").withColumn("lots", F.lit(0.01))
    return rounded(asof.reconcile_positions(internal, external, 100_000.0).select("symbol", "status", "internal_units", "external_units"), "internal_units", "external_units", digits=4)


@query(
    "J14_calendar",
    f"WITH {q.EXO}, s AS (SELECT CAST(unnest(generate_series(DATE '1996-01-01', DATE '1997-12-31', INTERVAL 1 DAY)) AS DATE) AS d), b AS (SELECT s.d, us_2y, german_2y FROM s LEFT JOIN exo USING (d) WHERE isodow(s.d) < 6), f AS (SELECT d, CASE WHEN us_2y IS NULL AND german_2y IS NULL THEN 'BOTH' WHEN us_2y IS NULL THEN 'us_2y' WHEN german_2y IS NULL THEN 'german_2y' ELSE 'NONE' END AS missing, last_value(us_2y IGNORE NULLS) OVER w AS u, last_value(german_2y IGNORE NULLS) OVER w AS g FROM b WINDOW w AS (ORDER BY d ROWS UNBOUNDED PRECEDING)) SELECT d, missing, round(u-g,12)+0.0 AS spread, round((u-g) - lag(u-g,5) OVER (ORDER BY d),12)+0.0 AS change_5 FROM f",
)
def j14(spark, sf_dir):
    out = asof.calendar(exo_daily(spark, sf_dir), "1996-01-01", "1997-12-31", ["us_2y", "german_2y"])
    return rounded(out.select("d", "missing", "spread", "change_5"), "spread", "change_5", digits=12)


@query("J20_membership", f"{q.bars_with(H4)} SELECT trade_id FROM (SELECT event_id AS trade_id, event_type AS symbol, (epoch_us(ts)//1000000//14400)*14400 AS time FROM events) t WHERE EXISTS (SELECT 1 FROM bars b WHERE b.symbol = t.symbol AND b.time = t.time AND b.tick_volume >= 8)")
def j20(spark, sf_dir):
    signals = ticks(spark, sf_dir).select(F.col("event_id").alias("trade_id"), "symbol", F.expr("time_msc div 1000 div 14400 * 14400").alias("time"))
    return signals.join(bars(spark, sf_dir, H4).filter("tick_volume >= 8"), ["symbol", "time"], "left_semi").select("trade_id")


_H = 6
_STEPS = ", ".join(f"{q.lead(c, k)} AS {c[0]}{k}" for k in range(1, _H + 1) for c in ("open", "high", "low", "close"))
_HIT = lambda k: f"WHEN o{k} <= sl THEN {{k: {k}, r: 'STOP_LOSS', p: o{k}}} WHEN o{k} >= tp THEN {{k: {k}, r: 'TAKE_PROFIT', p: o{k}}} WHEN l{k} <= sl THEN {{k: {k}, r: 'STOP_LOSS', p: sl}} WHEN h{k} >= tp THEN {{k: {k}, r: 'TAKE_PROFIT', p: tp}}"
_BARRIER = f"{q.bars_with(H1)}, s AS (SELECT symbol, time, {_STEPS} FROM bars), e AS (SELECT *, o1*(1-0.05::DOUBLE) AS sl, o1*(1+0.05::DOUBLE) AS tp FROM s WHERE o{_H} IS NOT NULL), x AS (SELECT symbol, time, o1 AS entry, CASE {' '.join(_HIT(k) for k in range(1, _H + 1))} ELSE {{k: {_H}, r: 'MAX_HOLD', p: c{_H}}} END AS hit FROM e)"


@query("J23_barrier_outcomes", f"{_BARRIER} SELECT symbol, time, round(entry,8)+0.0 AS entry, hit.r AS exit_reason, round(hit.p,8)+0.0 AS exit_price, hit.k AS holding_bars, round(hit.p/entry-1,8)+0.0 AS gross_return FROM x")
def j23(spark, sf_dir):
    return rounded(asof.barrier_outcomes(bars(spark, sf_dir, H1), 0.05, 0.05, _H), "entry", "exit_price", "gross_return")


_SCENARIOS = ((1, 0.02, 0.02), (2, 0.05, 0.05), (3, 0.10, 0.05), (4, 0.05, 0.10))


@query(
    "A27_scenario_sweep",
    " UNION ALL ".join(f"SELECT * FROM ({_BARRIER.replace('o1*(1-0.05::DOUBLE)', f'o1*(1-{s!r}::DOUBLE)').replace('o1*(1+0.05::DOUBLE)', f'o1*(1+{t!r}::DOUBLE)')} SELECT {i} AS scenario, hit.r AS exit_reason, count(*) AS n, round(avg(hit.p/entry-1),8)+0.0 AS mean_return FROM x GROUP BY ALL)" for i, t, s in _SCENARIOS),
)
def a27(spark, sf_dir):
    from functools import reduce

    from pyspark.sql import DataFrame

    b = bars(spark, sf_dir, H1)
    runs = [asof.barrier_outcomes(b, t, s, _H).withColumn("scenario", F.lit(i)) for i, t, s in _SCENARIOS]
    out = reduce(DataFrame.unionByName, runs).groupBy("scenario", "exit_reason").agg(F.count("*").alias("n"), F.avg("gross_return").alias("mean_return"))
    return rounded(out, "mean_return")


# splits
_USABLE = f"{q.bars_with()}, lb AS (SELECT symbol, time, close, {q.lead('close', 4)}/close - 1.0 AS r4 FROM bars), u AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM lb WHERE r4 IS NOT NULL), ab AS (SELECT *, CAST(floor(n*0.7::DOUBLE) AS BIGINT) AS a, CAST(floor(n*0.7::DOUBLE) AS BIGINT) + CAST(floor(n*0.15::DOUBLE) AS BIGINT) AS b FROM u), sp AS (SELECT symbol, time, i, n, r4, CASE WHEN i < a-4 THEN 'train' WHEN i >= a+2 AND i < b-4 THEN 'validation' WHEN i >= b+2 THEN 'test' END AS split FROM ab)"


def usable(spark, sf_dir):
    made = labels.label(bars(spark, sf_dir), labels.returns).select("symbol", "time", F.col("future_return_4").alias("r4"))
    return splits.usable(made, ["r4"])


@query("D01_split", f"{_USABLE} SELECT symbol, time, i AS usable_idx, split FROM sp")
def d01(spark, sf_dir):
    return splits.split(usable(spark, sf_dir), 0.7, 0.15, 4, 2).select("symbol", "time", "usable_idx", "split")


@query("W21_row_index", f"{q.bars_with()} SELECT symbol, time, row_number() OVER (PARTITION BY symbol ORDER BY time) - 1 AS bar_idx FROM bars")
def w21(spark, sf_dir):
    from tickloom.operators.frames import with_row_index

    return with_row_index(bars(spark, sf_dir).select("symbol", "time"), ["symbol"], "time", DAY)


@query(
    "V28_split_checks",
    f"{_USABLE}, g AS (SELECT symbol, {q.count_if(chr(39).join(('split = ', 'train', '')))} AS nt, {q.count_if(chr(39).join(('split = ', 'validation', '')))} AS nv, {q.count_if(chr(39).join(('split = ', 'test', '')))} AS ns, max(CASE WHEN split='train' THEN time END) AS t1, min(CASE WHEN split='validation' THEN time END) AS v0, max(CASE WHEN split='validation' THEN time END) AS v1, min(CASE WHEN split='test' THEN time END) AS s0, max(CASE WHEN split='train' THEN i END) AS ti, min(CASE WHEN split='validation' THEN i END) AS vi, max(CASE WHEN split='validation' THEN i END) AS vj, min(CASE WHEN split='test' THEN i END) AS si, count(*)-count(DISTINCT time) AS rep FROM sp GROUP BY symbol), c AS (SELECT symbol, unnest([{{c: 'non_empty', p: nt>0 AND nv>0 AND ns>0}}, {{c: 'no_nulls', p: true}}, {{c: 'unique_times', p: rep=0}}, {{c: 'time_order', p: t1<v0 AND v1<s0}}, {{c: 'train_gap', p: vi-ti>6}}, {{c: 'validation_gap', p: si-vj>6}}]) AS x FROM g) SELECT symbol, x.c AS \"check\", x.p AS passed FROM c",
)
def v28(spark, sf_dir):
    return splits.checks(splits.split(usable(spark, sf_dir), 0.7, 0.15, 4, 2), ["r4"], 6)


@query("D02_time_split", f"{_USABLE}, p AS (SELECT symbol, time, CASE WHEN time < 1705200000 THEN 'train' WHEN time < 1705900000 THEN 'validation' ELSE 'test' END AS part FROM u), k AS (SELECT *, row_number() OVER (PARTITION BY symbol, part ORDER BY time DESC) AS rn FROM p) SELECT symbol, time, CASE WHEN part = 'test' OR rn > 4 THEN part END AS split FROM k")
def d02(spark, sf_dir):
    return splits.time_split(usable(spark, sf_dir).drop("n_usable"), 1_705_200_000, 1_705_900_000, 4).select("symbol", "time", "split")


_FOLDS = f"{_USABLE}, fo AS (SELECT symbol, time, r4, f.k AS fold_idx, CASE WHEN i < 400 + f.k*((n-400)//5) - 4 THEN 'train' WHEN i >= 400 + f.k*((n-400)//5) + 2 AND i < 400 + (f.k+1)*((n-400)//5) - 4 THEN 'validation' END AS role FROM u, (SELECT unnest(range(5)) AS k) f), fk AS (SELECT * FROM fo WHERE role IS NOT NULL)"


@query("D03_folds", f"{_FOLDS} SELECT symbol, CAST(fold_idx AS INT) AS fold_idx, role, count(*) AS n_rows, min(time) AS first_time, max(time) AS last_time, {q.count_if('r4 > 0')} AS n_up, {q.count_if('r4 < 0')} AS n_down FROM fk GROUP BY ALL")
def d03(spark, sf_dir):
    return splits.fold_summary(splits.folds(usable(spark, sf_dir), 400, 5, 4, 2), "r4")


@query("D05_fold_thresholds", f"{_FOLDS}, m AS (SELECT symbol, fold_idx, quantile_cont(abs(r4),0.5) AS th FROM fk WHERE role='train' GROUP BY ALL) SELECT fk.symbol, CAST(fk.fold_idx AS INT) AS fold_idx, role, round(any_value(th),8)+0.0 AS threshold, {q.count_if('abs(r4) > th')} AS n_high, count(*) AS n_rows FROM fk JOIN m ON m.symbol = fk.symbol AND m.fold_idx = fk.fold_idx GROUP BY ALL")
def d05(spark, sf_dir):
    f = splits.folds(usable(spark, sf_dir), 400, 5, 4, 2).withColumn("size", F.abs("r4"))
    out = splits.fold_thresholds(f, "size").groupBy("symbol", "fold_idx", "role").agg(F.first("threshold").alias("threshold"), F.sum("is_high").alias("n_high"), F.count("*").alias("n_rows"))
    return rounded(out, "threshold")


@query("D08_blocks", f"{_USABLE} SELECT symbol, CAST(least(i//greatest(n//3,1),2) AS INT) AS block, count(*) AS n_rows, min(time) AS first_time, max(time) AS last_time FROM u GROUP BY ALL")
def d08(spark, sf_dir):
    return splits.blocks(usable(spark, sf_dir)).groupBy("symbol", "block").agg(F.count("*").alias("n_rows"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))


@query("O05_research_partition", f"{q.bars_with(H4)} SELECT symbol, CASE WHEN time < 1705200000 THEN 'research' ELSE 'locked' END AS part, count(*) AS n FROM bars WHERE time < 1705200000 OR time >= 1705900000 GROUP BY ALL")
def o05(spark, sf_dir):
    b = bars(spark, sf_dir, H4)
    parts = b.filter("time < 1705200000").withColumn("part", F.lit("research")).unionByName(b.filter("time >= 1705900000").withColumn("part", F.lit("locked")))
    return parts.groupBy("symbol", "part").agg(F.count("*").alias("n"))


@query("O02_split_overlap", f"{_USABLE} SELECT count(*) AS n_overlap FROM (SELECT symbol, time FROM sp WHERE split='train' INTERSECT SELECT symbol, time FROM sp WHERE split='test')")
def o02(spark, sf_dir):
    s = splits.split(usable(spark, sf_dir), 0.7, 0.15, 4, 2)
    keys = ["symbol", "time"]
    return s.filter("split = 'train'").select(*keys).intersect(s.filter("split = 'test'").select(*keys)).agg(F.count("*").alias("n_overlap"))


@query("J01_assembled_dataset", f"{_USABLE}, f AS (SELECT symbol, time, {q.mean('close', 20)} AS sma_20 FROM bars) SELECT f.symbol, f.time, round(sma_20,10)+0.0 AS sma_20, round(r4,8)+0.0 AS r4 FROM f JOIN u USING (symbol, time) WHERE sma_20 IS NOT NULL")
def j01(spark, sf_dir):
    from tickloom.operators.frames import over_blocks

    feats = over_blocks(bars(spark, sf_dir), lambda df, f: df.withColumn("sma_20", f.mean("close", 20)), 20).select("symbol", "time", "sma_20")
    both = feats.join(usable(spark, sf_dir).select("symbol", "time", "r4"), ["symbol", "time"]).dropna(subset=["sma_20", "r4"])
    return rounded(rounded(both, "sma_20", digits=10), "r4")


# ledgers
_T = f"WITH {q.TRADES}"
_PERF = "count(*) AS n_trades, {w} AS n_wins, {l} AS n_losses, {e} AS n_even, round(sum(net_pnl),6)+0.0 AS total_pnl, round(avg(net_pnl),6)+0.0 AS expectancy, round(avg(CASE WHEN net_pnl>0 THEN net_pnl END),6)+0.0 AS mean_win, round(avg(CASE WHEN net_pnl<0 THEN net_pnl END),6)+0.0 AS mean_loss, round({w}*100.0/count(*),6)+0.0 AS win_rate, round(sum(CASE WHEN net_pnl>0 THEN net_pnl END)/sum(CASE WHEN net_pnl<0 THEN -net_pnl END),6)+0.0 AS profit_factor, round(sum(CASE WHEN direction='LONG' THEN net_pnl END),6)+0.0 AS long_pnl, round(sum(CASE WHEN direction='SHORT' THEN net_pnl END),6)+0.0 AS short_pnl, round(avg(holding_bars),6)+0.0 AS mean_holding, round(max(dd),6)+0.0 AS max_drawdown, round(stddev_samp(net_pnl),6)+0.0 AS std_pnl".format(
    w=q.count_if("net_pnl > 0"), l=q.count_if("net_pnl < 0"), e=q.count_if("net_pnl = 0")
)
_PCOLS = ("total_pnl", "expectancy", "mean_win", "mean_loss", "win_rate", "profit_factor", "long_pnl", "short_pnl", "mean_holding", "max_drawdown", "std_pnl")


def _dd(key: str, order: str = "signal_time, trade_id") -> str:
    w = f"(PARTITION BY {key} ORDER BY {order} ROWS UNBOUNDED PRECEDING)"
    return f"q AS (SELECT *, sum(net_pnl) OVER {w} AS eq FROM k), d AS (SELECT *, max(eq) OVER {w} - eq AS dd FROM q)"


@query("A16_performance", f"{_T}, k AS (SELECT *, exit_reason AS key FROM trades), {_dd('key')} SELECT key AS exit_reason, {_PERF} FROM d GROUP BY 1")
def a16(spark, sf_dir):
    return rounded(ledger.performance(trades(spark, sf_dir), ["exit_reason"], ["signal_time", "trade_id"]), *_PCOLS, digits=6)


@query("A19_monthly", f"{_T}, k AS (SELECT *, strftime(signal_time,'%Y-%m') AS key FROM trades), {_dd('key')} SELECT key AS month, {_PERF} FROM d GROUP BY 1")
def a19(spark, sf_dir):
    by_month = trades(spark, sf_dir).withColumn("month", F.date_format("signal_time", "yyyy-MM"))
    return rounded(ledger.performance(by_month, ["month"], ["signal_time", "trade_id"]), *_PCOLS, digits=6)


_T0, _T1 = 820_454_400, 978_307_200


@query("A18_time_blocks", f"{_T}, k AS (SELECT *, CAST(floor((epoch(signal_time)-{_T0})/({(_T1 - _T0) / 8!r})) AS INT) AS key FROM trades WHERE epoch(signal_time) >= {_T0} AND epoch(signal_time) < {_T1}), {_dd('key')} SELECT key AS block, {_PERF} FROM d GROUP BY 1")
def a18(spark, sf_dir):
    b = ledger.time_blocks(trades(spark, sf_dir), F.col("signal_time"), _T0, _T1, 8)
    return rounded(ledger.performance(b, ["block"], ["signal_time", "trade_id"]), *_PCOLS, digits=6)


@query("W13_drawdown", f"{_T}, k AS (SELECT *, direction AS key FROM trades), {_dd('key')} SELECT trade_id, round(eq,6)+0.0 AS equity, round(dd,6)+0.0 AS drawdown FROM d")
def w13(spark, sf_dir):
    return rounded(ledger.drawdown(trades(spark, sf_dir), ["direction"], ["signal_time", "trade_id"]).select("trade_id", "equity", "drawdown"), "equity", "drawdown", digits=6)


_K = (1, 3, 5, 10)


@query("A17_concentration", f"{_T}, r AS (SELECT net_pnl, row_number() OVER (ORDER BY net_pnl DESC, trade_id) AS rn FROM trades), s AS (SELECT sum(net_pnl) AS total, {', '.join(f'sum(CASE WHEN rn <= {k} THEN net_pnl END) AS t{k}' for k in _K)} FROM r) SELECT round(total,6)+0.0 AS total_pnl, {', '.join(f'round(t{k},6)+0.0 AS top_{k}, round(total-t{k},6)+0.0 AS without_top_{k}, round(t{k}*100.0/total,6)+0.0 AS top_{k}_pct, sign(total-t{k}) <> sign(total) AS flips_{k}' for k in _K)} FROM s")
def a17(spark, sf_dir):
    return rounded(ledger.concentration(trades(spark, sf_dir)), "total_pnl", *(f"{p}_{k}{s}" for k in _K for p, s in (("top", ""), ("without_top", ""), ("top", "_pct"))), digits=6)


@query("A20_exits", f"{_T}, g AS (SELECT exit_reason, count(*) AS n_trades, sum(net_pnl) AS s, avg(net_pnl) AS a, quantile_cont(net_pnl,0.5) AS m, {q.count_if('net_pnl > 0')} AS n_wins FROM trades GROUP BY 1) SELECT exit_reason, n_trades, round(s,6)+0.0 AS total_pnl, round(a,6)+0.0 AS mean_pnl, round(m,6)+0.0 AS median_pnl, n_wins, round(n_trades*100.0/sum(n_trades) OVER (),6)+0.0 AS trade_pct, round(n_wins::DOUBLE/sum(n_wins) OVER (),6)+0.0 AS win_share FROM g")
def a20(spark, sf_dir):
    return rounded(ledger.exits(trades(spark, sf_dir)), "total_pnl", "mean_pnl", "median_pnl", "trade_pct", "win_share", digits=6)


@query(
    "A22_rollover",
    f"{_T}, k AS (SELECT *, trade_id * 7 % 1440 BETWEEN 1310 AND 1340 AS late, greatest(entry_spread_pts, exit_spread_pts) > 35 AS wide FROM trades), g AS (SELECT CASE WHEN late AND wide THEN 'A' WHEN late OR wide THEN 'B' ELSE 'C' END AS rollover_class, exit_reason, count(*) AS n, sum(net_pnl) AS p, sum(entry_spread_pts) AS s FROM k GROUP BY ALL) SELECT rollover_class, CAST(sum(n) AS BIGINT) AS n_trades, round(sum(p),6)+0.0 AS total_pnl, round(sum(s)/sum(n),6)+0.0 AS mean_entry_spread, string_agg(exit_reason || '=' || n, ',' ORDER BY exit_reason || '=' || n) AS exits FROM g GROUP BY 1",
)
def a22(spark, sf_dir):
    return rounded(ledger.rollover(trades(spark, sf_dir), (F.col("trade_id") * 7 % 1440), 35.0), "total_pnl", "mean_entry_spread", digits=6)


@query("A23_ledger_counts", "SELECT o_orderstatus AS status, count(*) AS n_rows, CAST(max(o_orderdate) AS DATE) AS last_date FROM orders GROUP BY 1")
def a23(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n_rows"), F.max("o_orderdate").cast("date").alias("last_date"))


@query(
    "A24_account_snapshots",
    "WITH s AS (SELECT o_custkey AS account, o_orderkey AS snapshot_id, CAST(o_orderdate AS TIMESTAMP) AS ts, 10000.0 + o_orderkey % 997 AS equity, (o_orderkey % 53) * 100.0 AS exposure FROM orders), d AS (SELECT account, CAST(ts AS DATE) AS day, arg_min(equity,(ts,snapshot_id)) AS fe, arg_max(equity,(ts,snapshot_id)) AS le, arg_max(exposure,(ts,snapshot_id)) AS x FROM s GROUP BY ALL), n AS (SELECT account, max(day) AS day FROM d GROUP BY 1) SELECT account, day, round(greatest(0.0,(fe-le)*100.0/fe),6)+0.0 AS daily_loss_pct, round(x*100.0/le,6)+0.0 AS exposure_pct FROM d JOIN n USING (account, day)",
)
def a24(spark, sf_dir):
    k = F.col("o_orderkey")
    s = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("account"), k.alias("snapshot_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), (F.lit(10000.0) + k % 997).alias("equity"), ((k % 53) * 100.0).alias("exposure"))
    return rounded(ledger.latest_snapshots(s).select("account", "day", "daily_loss_pct", "exposure_pct"), "daily_loss_pct", "exposure_pct", digits=6)


@query("A26_era_breakdown", f"{_T} SELECT year(signal_time)::INT AS year, direction, count(*) AS n, round(sum(net_pnl),6)+0.0 AS total_pnl, round(max(net_pnl)/nullif(sum(CASE WHEN net_pnl>0 THEN net_pnl END),0),6)+0.0 AS top_share FROM trades GROUP BY ALL")
def a26(spark, sf_dir):
    out = trades(spark, sf_dir).groupBy(F.year("signal_time").alias("year"), "direction").agg(F.count("*").alias("n"), F.sum("net_pnl").alias("total_pnl"), (F.max("net_pnl") / F.sum(F.when(F.col("net_pnl") > 0, F.col("net_pnl")))).alias("top_share"))
    return rounded(out, "total_pnl", "top_share", digits=6)


# costs, gates, clocks
_SP = "greatest(CASE WHEN entry_spread_pts IS NULL OR entry_spread_pts < 0 THEN 10.0 ELSE entry_spread_pts END, 1.0)*1e-5"


@query("P06_fills", f"{_T}, k AS (SELECT trade_id, direction, entry_spread_pts, 1.0::DOUBLE + (trade_id % 1000)/1000.0 AS p FROM trades) SELECT trade_id, round(CASE WHEN direction='LONG' THEN p + {_SP} + 1e-5 ELSE p - 1e-5 END,8)+0.0 AS entry_fill, round(CASE WHEN direction='LONG' THEN p - 1e-5 ELSE p + {_SP} + 1e-5 END,8)+0.0 AS exit_fill FROM k")
def p06(spark, sf_dir):
    t = trades(spark, sf_dir).withColumn("p", F.lit(1.0) + (F.col("trade_id") % 1000) / 1000.0)
    args = (F.col("p"), F.col("direction"), F.col("entry_spread_pts"))
    return rounded(t.select("trade_id", ledger.entry_fill(*args).alias("entry_fill"), ledger.exit_fill(*args).alias("exit_fill")), "entry_fill", "exit_fill")


@query("P07_costs", f"{_T} SELECT trade_id, CAST(round((trade_id % 100)*0.01,4) AS DOUBLE) AS spread_cost, CAST(round((trade_id % 100)*0.005,4) AS DOUBLE) AS slippage_cost, CAST(round((trade_id % 100)*1.25*0.002,4) AS DOUBLE) AS commission_cost, CAST(round((trade_id % 100)*0.001*holding_bars,4) AS DOUBLE) AS swap_cost FROM trades")
def p07(spark, sf_dir):
    costs = ledger.trade_costs((F.col("trade_id") % 100).cast("double"), F.lit(1.25), F.col("holding_bars"), 0.01, 0.005, 0.002, 0.001)
    return trades(spark, sf_dir).select("trade_id", *((c + F.lit(0.0)).alias(n) for n, c in costs.items()))


@query("P08_position_size", f"{_T}, k AS (SELECT trade_id, net_pnl + 50.0 AS equity, 1.0::DOUBLE + (trade_id % 10)/100.0 AS e, 1.0::DOUBLE + (trade_id % 7)/100.0 AS s FROM trades), r AS (SELECT *, CASE WHEN equity <= 0 THEN 'NO_EQUITY' WHEN e = s THEN 'ZERO_DISTANCE' END AS size_reason FROM k) SELECT trade_id, size_reason, CASE WHEN size_reason IS NULL THEN round(equity*1.0/100.0/abs(e-s),4)+0.0 END AS units FROM r")
def p08(spark, sf_dir):
    t = trades(spark, sf_dir).select("trade_id", (F.col("net_pnl") + 50.0).alias("equity"), (F.lit(1.0) + (F.col("trade_id") % 10) / 100.0).alias("e"), (F.lit(1.0) + (F.col("trade_id") % 7) / 100.0).alias("s"))
    sized = ledger.position_size(F.col("equity"), F.col("e"), F.col("s"), 1.0, 2.0)
    return rounded(t.select("trade_id", *(c.alias(n) for n, c in sized.items())), "units", digits=4)


@query("P09_gate", f"{_T} SELECT coalesce(CASE WHEN trade_id % 11 = 0 THEN 'HOLD' WHEN (trade_id % 100)/100.0 < 0.55 THEN 'LOW_CONFIDENCE' WHEN trade_id % 5 >= 3 THEN 'DAILY_LOSS' WHEN trade_id % 6 >= 3 THEN 'OPEN_POSITIONS' END, 'PASSED') AS reason, count(*) AS n FROM trades GROUP BY 1")
def p09(spark, sf_dir):
    i = F.col("trade_id")
    reason = ledger.gate((i % 100) / 100.0, F.when(i % 11 == 0, "HOLD").otherwise("BUY"), i % 6, (i % 5).cast("double"), F.lit(1.1), F.lit(1.0))
    return trades(spark, sf_dir).groupBy(F.coalesce(reason, F.lit("PASSED")).alias("reason")).agg(F.count("*").alias("n"))


@query("P12_first_usable_bar", f"WITH {q.TICKS} SELECT event_id, CAST(ceil((time_msc//1000 + 5)/14400.0)*14400 AS BIGINT) AS by_close, CAST(ceil((time_msc//1000 + 5)/14400.0)*14400 - 14400 AS BIGINT) AS by_open FROM ticks")
def p12(spark, sf_dir):
    t = ticks(spark, sf_dir).withColumn("s", F.expr("time_msc div 1000"))
    return t.select("event_id", ledger.first_usable_bar(F.col("s"), 5, H4, False).alias("by_close"), ledger.first_usable_bar(F.col("s"), 5, H4, True).alias("by_open"))


@query("P18_idempotency_key", f"{_T} SELECT trade_id, coalesce('req_' || CASE WHEN trade_id % 3 = 0 THEN CAST(trade_id AS VARCHAR) END, sha256(concat_ws('_', CAST(trade_id AS VARCHAR), direction, exit_reason))) AS key FROM trades")
def p18(spark, sf_dir):
    request = F.when(F.col("trade_id") % 3 == 0, F.col("trade_id").cast("string"))
    return trades(spark, sf_dir).select("trade_id", ledger.idempotency_key(request, F.col("trade_id"), F.col("direction"), F.col("exit_reason")).alias("key"))


@query("P11_publication", "SELECT o_orderkey AS report_id, CAST(o_orderdate AS DATE) AS observed, CAST(o_orderdate AS DATE) + CAST((5 - isodow(o_orderdate) + 7) % 7 AS INT) AS friday FROM orders")
def p11(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("report_id"), F.col("o_orderdate").cast("date").alias("observed"))
    return o.select("report_id", "observed", ledger.publication(F.col("observed")).cast("date").alias("friday"))


@query("P13_zone_offsets", "WITH d AS (SELECT DISTINCT CAST(o_orderdate AS TIMESTAMP) AS ts FROM orders) SELECT CAST(ts AS DATE) AS d, CAST(date_diff('hour', ts, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS INT) AS us_offset, CAST(date_diff('hour', ts, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Berlin') AS INT) AS eu_offset FROM d")
def p13(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderdate").cast("timestamp").alias("ts")).distinct()
    z = ledger.zone_offsets(F.col("ts"))
    return d.select(F.col("ts").cast("date").alias("d"), z["us_offset"].alias("us_offset"), z["eu_offset"].alias("eu_offset"))


# tests
@query("T03_one_sample_tests", f"{_T}, g AS (SELECT exit_reason, count(*) AS n, avg(net_pnl) AS m, quantile_cont(net_pnl,0.5) AS md, stddev_samp(net_pnl) AS s, {q.count_if('net_pnl > 0')} AS n_positive, {q.count_if('net_pnl <> 0')} AS n_moved FROM trades GROUP BY 1) SELECT exit_reason, n, round(m,6)+0.0 AS mean_value, round(md,6)+0.0 AS median_value, round(s,6)+0.0 AS std_value, n_positive, n_moved, round(m/(s/sqrt(n)),6)+0.0 AS t_statistic FROM g")
def t03(spark, sf_dir):
    return rounded(stats.one_sample(trades(spark, sf_dir), ["exit_reason"], "net_pnl"), "mean_value", "median_value", "std_value", "t_statistic", digits=6)


@query("T03_p_values")
def t03_p(spark, sf_dir):
    """Rows only: the p-values need the incomplete beta function."""
    return stats.with_p_values(stats.one_sample(trades(spark, sf_dir), ["exit_reason"], "net_pnl"))


@query("T02_signed_rank", f"{_T}, a AS (SELECT direction, net_pnl, abs(net_pnl) AS s FROM trades WHERE net_pnl <> 0), r AS (SELECT direction, net_pnl, rank() OVER (PARTITION BY direction ORDER BY s) + (count(*) OVER (PARTITION BY direction, s) - 1)/2.0 AS rk FROM a) SELECT direction, count(*) AS n, round(sum(CASE WHEN net_pnl>0 THEN rk ELSE 0.0 END),4)+0.0 AS w_plus, round(sum(CASE WHEN net_pnl<0 THEN rk ELSE 0.0 END),4)+0.0 AS w_minus FROM r GROUP BY 1")
def t02(spark, sf_dir):
    out = stats.signed_rank(trades(spark, sf_dir), ["direction"], "net_pnl")
    return rounded(out.select("direction", "n", F.col("w_plus").cast("double"), F.col("w_minus").cast("double")), "w_plus", "w_minus", digits=4)


@query("T04_bootstrap")
def t04(spark, sf_dir):
    """Rows only: 10,000 seeded resamples (tested against a plain loop and against the theory)."""
    return stats.bootstrap_summary(stats.bootstrap(trades(spark, sf_dir), "net_pnl", 10_000))


@query("T05_gates", f"{_T}, m AS (SELECT count(*) AS n, sum(net_pnl) AS total, avg(CASE WHEN net_pnl > 0 THEN 1.0 ELSE 0.0 END) AS wr FROM trades) SELECT unnest([{{g: 'enough_trades', p: n >= 100}}, {{g: 'profitable', p: total > 0}}, {{g: 'win_rate', p: wr > 0.5}}]).g AS gate, unnest([{{g: 'enough_trades', p: n >= 100}}, {{g: 'profitable', p: total > 0}}, {{g: 'win_rate', p: wr > 0.5}}]).p AS passed FROM m")
def t05(spark, sf_dir):
    m = trades(spark, sf_dir).agg(F.count("*").alias("n"), F.sum("net_pnl").alias("total"), F.avg(F.when(F.col("net_pnl") > 0, 1.0).otherwise(0.0)).alias("wr"))
    return stats.gates(m, {"enough_trades": "n >= 100", "profitable": "total > 0", "win_rate": "wr > 0.5"})

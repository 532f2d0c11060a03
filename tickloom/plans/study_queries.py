"""Queries of composed studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import streaming
from tickloom.operators import asof, features, micro, splits, studies
from tickloom.operators.frames import TICK_RANGE, over_blocks, with_row_index
from tickloom.plans import sql as q
from tickloom.plans.catalog import ORACLE_SQL, query, rounded
from tickloom.plans import explore_queries, quality_queries  # noqa: F401  their SQL
from tickloom.plans.feature_queries import SWING, staged
from tickloom.plans.ledger_queries import _USABLE, DAY, usable
from tickloom.sources.adapters import H1, H4, M15, bars, ticks

# how far the last four bars went; prices have five digits
_SCORE = f"round(close - {q.lag('close', 4)}, 7) + 0.0 AS score"
# two-way calls of the persistence model on four-hour bars
_CALLS = f"CASE WHEN close > {q.lag('close', 4)} THEN 1.0::DOUBLE ELSE -1.0 END AS y_pred, CASE WHEN {q.lead('close', 4)} > close THEN 1.0::DOUBLE WHEN {q.lead('close', 4)} < close THEN -1.0 END AS y_true"


def calls(spark, sf_dir):
    def add(df, f):
        later = f.lead("close", 4)
        moved = F.col("close") - f.lag("close", 4)
        return df.withColumn("y_pred", studies.persistence(moved)).withColumn("score", F.round(moved, 7) + F.lit(0.0)).withColumn("y_true", F.when(later > F.col("close"), 1.0).when(later < F.col("close"), -1.0))

    made = over_blocks(bars(spark, sf_dir, H4), add, 4, 4)
    return made.filter("y_true is not null").select("symbol", "time", "y_pred", "y_true", "score")


def sliced_sql(masks: dict[str, str], source: str) -> str:
    rows = ", ".join(f"{{s: '{n}', m: coalesce({m}, false)}}" for n, m in masks.items())
    hit = "y_true = y_pred"
    return (
        f"z AS (SELECT y_true, y_pred, unnest([{rows}]) AS x FROM {source}), g AS (SELECT x.s AS slice, {q.count_if('x.m')} AS n, {q.count_if('x.m AND y_true=1')} AS n_long, {q.count_if('x.m AND y_true=-1')} AS n_short, count(*) AS n_all, {q.count_if(f'x.m AND {hit}')} AS h, {q.count_if(f'x.m AND y_true=1 AND {hit}')} AS hl, {q.count_if(f'x.m AND y_true=-1 AND {hit}')} AS hs FROM z GROUP BY 1) "
        "SELECT slice, n, n_long, n_short, round((1-n::DOUBLE/n_all)*100,6)+0.0 AS pct_filtered, round(h::DOUBLE/nullif(n,0),6)+0.0 AS accuracy, CASE WHEN n_long>0 AND n_short>0 THEN round((hl::DOUBLE/n_long+hs::DOUBLE/n_short)/2,6)+0.0 END AS balanced_accuracy, CASE WHEN n=0 THEN 'NO_SAMPLES' WHEN n_long=0 OR n_short=0 THEN 'SINGLE_CLASS' ELSE 'VALID' END AS status FROM g"
    )


def sliced(df):
    return rounded(df, "pct_filtered", "accuracy", "balanced_accuracy", digits=6)


@query("M02_persistence", f"{q.bars_with(H4)}, c AS (SELECT {_CALLS} FROM bars), k AS (SELECT * FROM c WHERE y_true IS NOT NULL), {sliced_sql({'all': 'true', 'called_long': 'y_pred = 1', 'called_short': 'y_pred = -1'}, 'k')}")
def m02(spark, sf_dir):
    return sliced(studies.sliced_metrics(calls(spark, sf_dir), {"all": F.lit(True), "called_long": F.col("y_pred") == 1, "called_short": F.col("y_pred") == -1}))


_SLICES = {
    "atr_low": "atr <= am", "atr_high": "atr > am", "compression": "ratio <= 1", "expansion": "ratio > 1", "bullish": "trend = 1", "bearish": "trend = -1", "mixed": "abs(trend) < 1", "ranging": "width <= wm", "breakout": "width > wm",
    **{f"hour_{h}": f"hour = {h}" for h in range(0, 24, 4)}, "early_week": "day <= 1", "mid_week": "day = 2", "late_week": "day >= 3",
}
_TAKEN = {"atr": "atr_norm_14", "ratio": "vol_ratio_5_20", "trend": "trend_regime", "width": "channel_width_20", "hour": "hour", "day": "day_of_week"}


@query(
    "M19_regime_slices",
    f"{staged(H4)}, ft AS (SELECT symbol, time, {', '.join(f'round({SWING[c]}, 9) AS {a}' for a, c in _TAKEN.items())} FROM f1), c AS (SELECT symbol, time, {_CALLS}, {_SCORE} FROM bars), k0 AS (SELECT * FROM c JOIN ft USING (symbol, time) WHERE y_true IS NOT NULL), k AS (SELECT k0.*, (SELECT quantile_cont(atr, 0.5) FROM k0) AS am, (SELECT quantile_cont(width, 0.5) FROM k0) AS wm FROM k0), "
    f"q AS (SELECT y_true, score, unnest([{', '.join(f'{{s: {chr(39)}{n}{chr(39)}, m: coalesce({m}, false)}}' for n, m in _SLICES.items())}]) AS x FROM k WHERE score IS NOT NULL), r AS (SELECT x.s AS slice, y_true, rank() OVER w + (count(*) OVER (PARTITION BY x.s, score) - 1)/2.0 AS rk FROM q WHERE x.m WINDOW w AS (PARTITION BY x.s ORDER BY score)), "
    f"u AS (SELECT slice, {q.count_if('y_true=1')} AS np, {q.count_if('y_true=-1')} AS nn, sum(CASE WHEN y_true=1 THEN rk END) AS rs FROM r GROUP BY 1), base AS (WITH {sliced_sql(_SLICES, 'k')}) "
    "SELECT base.*, round((rs - np*(np+1)/2.0)/nullif(np*nn,0),6)+0.0 AS auc FROM base LEFT JOIN u USING (slice)",
)
def m19(spark, sf_dir):
    made = features.build(bars(spark, sf_dir, H4), ["swing"])
    made = made.select("symbol", "time", *(F.round(c, 9).alias(c) for c in _TAKEN.values()))  # clear of ties at the bounds
    both = streaming.stored(calls(spark, sf_dir).join(made, ["symbol", "time"]))
    bounds = both.agg(F.percentile("atr_norm_14", F.lit(0.5)).alias("atr_median"), F.percentile("channel_width_20", F.lit(0.5)).alias("channel_median"))
    marked = streaming.stored(both.crossJoin(F.broadcast(bounds)))  # one row of bounds
    slices = studies.regime_slices(F.col("atr_median"), F.col("channel_median"))
    return rounded(sliced(studies.sliced_metrics(marked, slices)).join(studies.sliced_auc(marked, slices, "score"), "slice", "left"), "auc", digits=6)


_FINE = f"d1 AS (SELECT symbol, time, open, close, close - {q.lag('close')} AS dlt FROM bars), fine AS (SELECT symbol, time, sign(close-open) AS direction, round(100.0*({q.mean('greatest(dlt,0.0)', 14)})/nullif(({q.mean('greatest(dlt,0.0)', 14)})+({q.mean('greatest(-dlt,0.0)', 14)}),0),8) AS rsi, round(close/({q.mean('close', 20)})-1,10) AS trend FROM d1)"
_RULES = {"BASE": "true", "A": "a", "B": "b", "C": "c", "TWO_OF_THREE": "a::INT+b::INT+c::INT >= 2"}


@query(
    "M20_confirmations",
    f"WITH {q.TICKS}, {q.bars(H4, 'h4')}, {q.bars(M15)}, {_FINE}, c AS (SELECT symbol, time, {_CALLS} FROM h4), k0 AS (SELECT c.*, direction, rsi, trend FROM c ASOF LEFT JOIN fine ON c.symbol = fine.symbol AND c.time + {H4 - M15} >= fine.time WHERE y_true IS NOT NULL), k AS (SELECT y_true, y_pred, coalesce(y_pred = direction, false) AS a, coalesce(CASE WHEN y_pred=1 THEN rsi > 50 ELSE rsi < 50 END, false) AS b, coalesce(CASE WHEN y_pred=1 THEN trend > 0 ELSE trend < 0 END, false) AS c FROM k0), {sliced_sql(_RULES, 'k')}",
)
def m20(spark, sf_dir):
    def add(df, f):
        change = df.withColumn("dlt", F.col("close") - f.lag("close"))
        # a missing change counts as none, as in the counterpart's greatest()
        up, down = f.mean(F.greatest(F.col("dlt"), F.lit(0.0)), 14), f.mean(F.greatest(-F.col("dlt"), F.lit(0.0)), 14)
        return change.withColumns({"rsi": F.round(100.0 * up / F.nullif(up + down, F.lit(0.0)), 8), "trend": F.round(F.col("close") / f.mean("close", 20) - 1, 10)})

    made = over_blocks(bars(spark, sf_dir).select("symbol", "time", "open", "close"), add, 20)
    fine = made.select("symbol", F.col("time").alias("fine_time"), F.signum(F.col("close") - F.col("open")).alias("direction"), "rsi", "trend")
    both = asof.asof(calls(spark, sf_dir).withColumn("cutoff", F.col("time") + H4 - M15), fine, ["symbol"], "cutoff", "fine_time", ["direction", "rsi", "trend"], DAY)
    return sliced(studies.sliced_metrics(both, studies.confirmations(F.col("direction"), F.col("rsi"), F.col("trend"))))


_FOLD_SUMMARY = f"symbol, CAST(fold_idx AS INT) AS fold_idx, role, count(*) AS n_rows, min(time) AS first_time, max(time) AS last_time, {q.count_if('r4 > 0')} AS n_up, {q.count_if('r4 < 0')} AS n_down"


@query("D04_embargoed_folds", f"{_USABLE}, fo AS (SELECT symbol, time, r4, f.k AS fold_idx, CASE WHEN i < 300 + f.k*((n-300)//4) - 8 THEN 'train' WHEN i >= 300 + f.k*((n-300)//4) + 4 AND i < 300 + (f.k+1)*((n-300)//4) - 8 THEN 'validation' END AS role FROM u, (SELECT unnest(range(4)) AS k) f) SELECT {_FOLD_SUMMARY} FROM fo WHERE role IS NOT NULL GROUP BY ALL")
def d04(spark, sf_dir):
    return splits.fold_summary(splits.folds(usable(spark, sf_dir), 300, 4, 8, 4), "r4")


_RAW = f"{q.bars_with()}, lb AS (SELECT symbol, time, tick_volume, {q.lead('close', 4)}/close - 1.0 AS r4, row_number() OVER ({q.W}) - 1 AS b, count(*) OVER (PARTITION BY symbol) AS nb FROM bars)"


def raw_labels(spark, sf_dir):
    made = over_blocks(bars(spark, sf_dir), lambda df, f: df.withColumn("r4", f.lead("close", 4) / F.col("close") - 1), 0, 4).select("symbol", "time", "tick_volume", "r4")
    return with_row_index(made, ["symbol"], "time", 30 * DAY)


@query(
    "D06_folds_before_holdout",
    f"{_RAW}, v AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM lb WHERE r4 IS NOT NULL AND tick_volume >= 1 + b % 2), p AS (SELECT *, CAST(floor(n*0.22::DOUBLE) AS BIGINT) AS a FROM v), fo AS (SELECT p.*, k AS fold_idx, i >= a + (k-1)*((n-a)//5) AND (k = 5 OR i < a + k*((n-a)//5)) AS val FROM p, (SELECT unnest(range(1,6)) AS k)), fv AS (SELECT symbol, fold_idx, min(b) AS fb FROM fo WHERE val GROUP BY ALL), fr AS (SELECT fo.symbol, time, r4, fo.fold_idx, CASE WHEN val THEN 'validation' WHEN b <= fb - 9 THEN 'train' END AS role FROM fo JOIN fv ON fo.symbol = fv.symbol AND fo.fold_idx = fv.fold_idx) SELECT {_FOLD_SUMMARY} FROM fr WHERE role IS NOT NULL GROUP BY ALL",
)
def d06(spark, sf_dir):
    """Valid rows have a label and enough ticks, so that valid and raw places differ."""
    valid = raw_labels(spark, sf_dir).filter(F.col("r4").isNotNull() & (F.col("tick_volume") >= 1 + F.col("bar_idx") % 2))
    return splits.fold_summary(studies.folds_before_holdout(splits.usable(valid, ["r4"]), 5, 8), "r4")


@query(
    "D07_stepped_folds",
    f"{_RAW}, p AS (SELECT *, CAST(floor(nb*0.4::DOUBLE) AS BIGINT) AS a FROM lb), fo AS (SELECT p.*, k AS fold_idx, CASE WHEN b < a + k*((nb-a)//5) - 4 THEN 'train' WHEN b >= a + k*((nb-a)//5) AND b < (CASE WHEN k < 4 THEN a + (k+1)*((nb-a)//5) ELSE nb END) - 4 THEN 'validation' END AS role FROM p, (SELECT unnest(range(5)) AS k)) SELECT {_FOLD_SUMMARY} FROM fo WHERE role IS NOT NULL AND r4 IS NOT NULL GROUP BY ALL",
)
def d07(spark, sf_dir):
    made = raw_labels(spark, sf_dir)
    counted = made.join(made.groupBy("symbol").agg(F.count("*").alias("n_rows")), "symbol")
    return splits.fold_summary(studies.stepped_folds(counted, 5, 4).filter("r4 is not null"), "r4")


@query(
    "V29_governance",
    f"{_USABLE}, t AS (SELECT *, CASE WHEN r4 > 0 THEN 1.0::DOUBLE WHEN r4 < 0 THEN -1.0 ELSE 0.0 END AS y FROM sp), g AS (SELECT symbol, {q.count_if(chr(39).join(('split=', 'train', '')))} AS nt, {q.count_if(chr(39).join(('split=', 'validation', '')))} AS nv, {q.count_if(chr(39).join(('split=', 'test', '')))} AS ns, max(CASE WHEN split='train' THEN time END) AS t1, min(CASE WHEN split='validation' THEN time END) AS v0, max(CASE WHEN split='validation' THEN time END) AS v1, min(CASE WHEN split='test' THEN time END) AS s0, max(CASE WHEN split='train' THEN i END) AS ti, min(CASE WHEN split='validation' THEN i END) AS vi, max(CASE WHEN split='validation' THEN i END) AS vj, min(CASE WHEN split='test' THEN i END) AS si, list_sort(list(DISTINCT y) FILTER (split='test')) = [-1.0::DOUBLE, 1.0::DOUBLE] AS nc FROM t GROUP BY symbol), c AS (SELECT symbol, unnest([{{c: 'row_counts', p: nt>=20 AND nv>=5 AND ns>=5}}, {{c: 'chronology', p: t1<v0 AND v1<s0}}, {{c: 'purge_gap', p: vi-ti>=4 AND si-vj>=4}}, {{c: 'forbidden_columns', p: true}}, {{c: 'classes', p: nc}}]) AS x FROM g) SELECT symbol, x.c AS \"check\", coalesce(x.p, false) AS passed FROM c",
)
def v29(spark, sf_dir):
    table = splits.split(usable(spark, sf_dir), 0.7, 0.15, 4, 2).withColumn("y", F.when(F.col("r4") > 0, 1.0).when(F.col("r4") < 0, -1.0).otherwise(0.0))
    return studies.governance(table, {"train": 20, "validation": 5, "test": 5}, 4, {"y", "r4", "time", "close"}, ["sma_20"], {-1.0, 1.0}, "y")


@query(
    "J15_merged_reports",
    "WITH r AS (SELECT o_custkey % 4 AS code, CAST(o_orderdate AS DATE) AS report_date, o_orderstatus AS kind, o_orderkey % 1000 AS positions FROM orders), a AS (SELECT code, report_date, min(positions) AS legacy FROM r WHERE kind='F' GROUP BY ALL), b AS (SELECT code, report_date, min(positions) AS other FROM r WHERE kind='O' GROUP BY ALL) SELECT code, report_date, legacy, other FROM a LEFT JOIN b USING (code, report_date)",
)
def j15(spark, sf_dir):
    r = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % 4).alias("code"), F.col("o_orderdate").cast("date").alias("report_date"), F.col("o_orderstatus").alias("kind"), (F.col("o_orderkey") % 1000).alias("positions"))
    one = lambda kind, name: r.filter(F.col("kind") == kind).select("code", "report_date", F.col("positions").alias(name))
    return studies.merged_reports(one("F", "legacy"), one("O", "other"), ["code", "report_date"])


_EVENTS = f"WITH {q.TICKS}, {q.bars()}, e AS (SELECT symbol, event_id, time_msc//1000 AS event_time, CASE WHEN event_id % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0 END AS side FROM ticks)"


def events(spark, sf_dir):
    return ticks(spark, sf_dir).select("symbol", "event_id", F.expr("time_msc div 1000").alias("event_time"), F.when(F.col("event_id") % 2 == 0, 1.0).otherwise(-1.0).alias("side"))


@query(
    "J19_event_study",
    f"{_EVENTS}, b AS (SELECT e.*, k.close AS c0 FROM e ASOF LEFT JOIN bars k ON e.symbol = k.symbol AND e.event_time >= k.time), w AS (SELECT *, unnest([900, 3600]) AS win FROM b), a AS (SELECT w.*, k.time AS t1, k.close AS c1 FROM w ASOF LEFT JOIN bars k ON w.symbol = k.symbol AND w.event_time + w.win <= k.time), x AS (SELECT a.event_id, a.win, max(k.high) AS hi, min(k.low) AS lo, count(*) AS n FROM a JOIN bars k ON k.symbol = a.symbol AND k.time BETWEEN a.event_time AND a.t1 WHERE c0 IS NOT NULL GROUP BY ALL) SELECT symbol, event_id, win AS \"window\", round(c1-c0,8)+0.0 AS move, round(hi-c0,8)+0.0 AS up_excursion, round(lo-c0,8)+0.0 AS down_excursion, coalesce(n,0) AS n_bars FROM a LEFT JOIN x USING (event_id, win) WHERE c0 IS NOT NULL AND c1 IS NOT NULL",
)
def j19(spark, sf_dir):
    out = asof.event_study(events(spark, sf_dir).drop("side"), bars(spark, sf_dir), (900, 3600), M15, DAY)
    return rounded(out, "move", "up_excursion", "down_excursion")


@query(
    "J24_tick_barriers",
    f"WITH {q.TICKS}, {q.bars(H1)}, s AS (SELECT row_number() OVER (ORDER BY symbol, time) AS id, symbol, time, CASE WHEN (time//3600) % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS direction, (time+3600)*1000 AS msc FROM bars), f AS (SELECT s.*, CASE WHEN t.time_msc - msc <= 7200000 THEN t.time_msc END AS em, CASE WHEN t.time_msc - msc <= 7200000 THEN CASE WHEN direction='LONG' THEN t.ask ELSE t.bid END END AS entry FROM s ASOF LEFT JOIN ticks t ON s.symbol = t.symbol AND s.msc <= t.time_msc), g AS (SELECT *, CASE WHEN direction='LONG' THEN 1.0::DOUBLE ELSE -1.0 END AS sg FROM f), h AS (SELECT g.id, t.time_msc, t.event_id, CASE WHEN direction='LONG' THEN t.bid ELSE t.ask END AS price, entry*(1-sg*0.05::DOUBLE) AS st, entry*(1+sg*0.05::DOUBLE) AS tg, sg FROM g JOIN ticks t ON t.symbol = g.symbol AND t.time_msc BETWEEN em AND em + 21600000 WHERE entry IS NOT NULL), m AS (SELECT *, CASE WHEN sg*(price-st) <= 0 THEN 'STOP_LOSS' WHEN sg*(price-tg) >= 0 THEN 'TAKE_PROFIT' END AS touch FROM h), o AS (SELECT id, arg_min({{t: touch, p: price}}, (time_msc, event_id)) FILTER (touch IS NOT NULL) AS hit, arg_max(price, (time_msc, event_id)) AS lastp FROM m GROUP BY 1) SELECT symbol, time, direction, round(entry,8)+0.0 AS entry, CASE WHEN entry IS NULL THEN 'DATA_UNAVAILABLE' ELSE coalesce(hit.t,'MAX_HOLD') END AS exit_reason, round(coalesce(hit.p,lastp),8)+0.0 AS exit_price FROM g LEFT JOIN o USING (id)",
)
def j24(spark, sf_dir):
    b = bars(spark, sf_dir, H1).select("symbol", "time", F.when(F.floor(F.col("time") / H1) % 2 == 0, "LONG").otherwise("SHORT").alias("direction"), ((F.col("time") + H1) * 1000).alias("signal_msc"))
    signals = b.withColumn("trade_id", F.struct("symbol", "time"))
    out = studies.tick_barriers(signals, ticks(spark, sf_dir), 0.05, 0.05, 360, 7_200_000, 3_600_000)
    return rounded(out.select("symbol", "trade_id.time", "direction", "entry", "exit_reason", "exit_price"), "entry", "exit_price")


_COSTS = (0.0, 1.0, 2.0, 3.0, 5.0)


@query(
    "J25_event_trades",
    f"{_EVENTS}, w AS (SELECT e.*, x.m AS mode, event_time + x.d AS due FROM (SELECT e.*, unnest([{{m: 'IMMEDIATE', d: 0}}, {{m: 'DELAYED', d: 900}}]) AS x FROM e) e), a AS (SELECT w.*, k.time AS t0, k.open AS o0 FROM w ASOF LEFT JOIN bars k ON w.symbol = k.symbol AND w.due <= k.time), b AS (SELECT a.*, k.open AS o1 FROM a ASOF LEFT JOIN bars k ON a.symbol = k.symbol AND a.t0 + 3600 <= k.time), t AS (SELECT mode, CASE WHEN event_time < 1705708800 THEN 'research' ELSE 'holdout' END AS part, unnest([{', '.join(f'{c}::DOUBLE' for c in _COSTS)}]) AS cost, side*(o1/o0-1)*10000 AS gross FROM b WHERE o0 IS NOT NULL AND o1 IS NOT NULL) SELECT mode, part, cost, count(*) AS n_trades, round(avg(gross-cost),4)+0.0 AS mean_net, {q.count_if('gross-cost > 1e-9')} AS n_wins FROM t GROUP BY ALL",
)
def j25(spark, sf_dir):
    out = studies.event_trades(events(spark, sf_dir), bars(spark, sf_dir), M15, H1, _COSTS, DAY)
    part = F.when(F.col("event_time") < 1_705_708_800, "research").otherwise("holdout")
    return rounded(out.groupBy("mode", part.alias("part"), "cost").agg(F.count("*").alias("n_trades"), F.avg("net").alias("mean_net"), F.count_if(F.col("net") > 1e-9).alias("n_wins")), "mean_net", digits=4)


@query("O03_repaired_archive", f"WITH {q.TICKS}, u AS (SELECT symbol, event_id, time_msc, bid FROM ticks UNION ALL SELECT symbol, event_id, time_msc, bid FROM ticks WHERE time_msc % 7 < 3) SELECT symbol, count(DISTINCT event_id) AS n_ticks, min(time_msc) AS first_msc, max(time_msc) AS last_msc FROM u GROUP BY 1")
def o03(spark, sf_dir):
    """The archive and windows that were fetched again: a union, and equal neighbours once."""
    t = ticks(spark, sf_dir).select("symbol", "event_id", "time_msc", "bid")
    whole = t.unionByName(t.filter("time_msc % 7 < 3"))
    once = micro.drop_adjacent(whole, ["event_id", "bid"], ["time_msc", "event_id"], TICK_RANGE)
    return once.groupBy("symbol").agg(F.count("*").alias("n_ticks"), F.min("time_msc").alias("first_msc"), F.max("time_msc").alias("last_msc"))


@query("R05_stale_feed", f"WITH {q.TICKS}, {q.bars(H1)}, a AS (SELECT symbol, (time+3600)*1000 AS at_msc FROM bars) SELECT a.symbol, at_msc, at_msc - t.time_msc AS age_msc, coalesce(at_msc - t.time_msc > 600000, true) AS is_stale FROM a ASOF LEFT JOIN ticks t ON a.symbol = t.symbol AND a.at_msc >= t.time_msc")
def r05(spark, sf_dir):
    at = bars(spark, sf_dir, H1).select("symbol", ((F.col("time") + H1) * 1000).alias("at_msc"))
    return streaming.stale(ticks(spark, sf_dir), at, 600_000, DAY * 1000)


@query("R11_drawdown_alerts", "WITH s AS (SELECT o_custkey AS account, o_orderkey AS snapshot_id, CAST(o_orderdate AS DATE) AS d, 10000.0::DOUBLE + o_orderkey % 997 AS equity FROM orders), w AS (SELECT *, max(equity) OVER (PARTITION BY account ORDER BY d, snapshot_id) AS peak FROM s) SELECT account, snapshot_id, peak, round((peak-equity)*100.0/peak,6)+0.0 AS drawdown_pct, (peak-equity)*100.0/peak > 5.0 AS is_alert FROM w")
def r11(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("account"), F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderdate").cast("date").alias("d"), (F.lit(10000.0) + F.col("o_orderkey") % 997).alias("equity"))
    out = studies.drawdown_alerts(s, ["account"], ["d", "snapshot_id"], 5.0)
    return rounded(out.select("account", "snapshot_id", "peak", "drawdown_pct", "is_alert"), "drawdown_pct", digits=6)


@query("C01_validated_bars", f"{q.bars_with(H1)} SELECT symbol, count(*) AS n_rows, min(time) AS first_time, max(time) AS last_time FROM bars WHERE high >= greatest(open,close,low) AND low <= least(open,close) AND low > 0 AND spread >= 0 AND tick_volume > 0 AND time % 3600 = 0 GROUP BY 1")
def c01(spark, sf_dir):
    return studies.validated(bars(spark, sf_dir, H1), H1).groupBy("symbol").agg(F.count("*").alias("n_rows"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))


def _melt(name: str, section: str, keys: tuple[str, ...] = (), symbol: str = "symbol") -> str:
    """A query's rows in long form; hours' bars in place of quarters'."""
    sql = ORACLE_SQL[name].replace("900", "3600") if name.startswith(("A06", "A07")) else ORACLE_SQL[name]
    out = [c for c in (symbol, *keys) if c != "'all'"]
    dropped = ", ".join(f'"{c}"' for c in out)
    labels = " || '/' || ".join([*(f'"{c}"' for c in keys), "name"])
    if name.startswith("A06"):
        sql = f"SELECT symbol, gap_class, count(*) AS n, max(missing_bars) AS longest FROM ({sql}) GROUP BY ALL"
    ids = ", ".join(f'"{c}" AS k_{i}' for i, c in enumerate(out))
    labels = " || '/' || ".join([*(f"k_{out.index(c)}" for c in keys), "name"])
    first = "'all'" if symbol == "'all'" else "k_0"
    return f"SELECT {first} AS symbol, '{section}' AS section, {labels} AS name, value FROM (UNPIVOT (SELECT {ids}{', ' if ids else ''}CAST(COLUMNS(* EXCLUDE ({dropped})) AS DOUBLE) FROM ({sql})) ON COLUMNS(* EXCLUDE ({', '.join(f'k_{i}' for i in range(len(out)))})) INTO NAME name VALUE value)"


_PARTS = " UNION ALL ".join(f"({x})" for x in (_melt("A03_price_statistics", "prices"), _melt("A04_temporal_statistics", "times", ("kind", "value")), _melt("A05_volume_statistics", "volumes", ("column",), "'all'"), _melt("A06_gaps", "gaps", ("gap_class",)), _melt("A07_gap_statistics", "steps")))


@query("C02_explored", f"SELECT symbol, section, name, round(value, 6) + 0.0 AS value FROM ({_PARTS}) WHERE value IS NOT NULL")
def c02(spark, sf_dir):
    """Moments of returns have four digits, as in A03; values that are missing are left out."""
    made = studies.explored(streaming.stored(bars(spark, sf_dir, H1)), H1).filter("value is not null")
    short = F.col("name").isin("skew_return", "kurtosis_return")
    return made.withColumn("value", F.when(short, F.round("value", 4)).otherwise(F.round("value", 6)) + F.lit(0.0))



_C06 = "unnest([" + ", ".join(f"{{h: {h}, e: {e}}}" for h in (1, 2, 4, 8) for e in (0, 3)) + "])"


@query("C06_split_report", f"{_USABLE}, x AS (SELECT symbol, time, i, a, b, {_C06} AS k FROM ab), y AS (SELECT k.h AS horizon, k.e AS embargo, time, CASE WHEN i < a-k.h THEN 'train' WHEN i >= a+k.e AND i < b-k.h THEN 'validation' WHEN i >= b+k.e THEN 'test' END AS split FROM x) SELECT horizon, embargo, split, count(*) AS n_rows, min(time) AS first_time, max(time) AS last_time FROM y WHERE split IS NOT NULL GROUP BY ALL")
def c06(spark, sf_dir):
    return studies.split_report(usable(spark, sf_dir), (1, 2, 4, 8), 3)

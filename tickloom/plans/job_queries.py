"""Queries of whole jobs and of feature metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import streaming
from tickloom.operators import evaluate, features, jobs, linear, quality, splits, trees
from tickloom.plans import sql as q
from tickloom.plans.catalog import query, rounded
from tickloom.plans.explore_queries import _EXO, _REPORTS, exo_shifted, reports
from tickloom.plans.feature_queries import PRICE, staged
from tickloom.plans.model_queries import FEATURES, dataset
from tickloom.plans.quality_queries import CUTOFF
from tickloom.plans.study_queries import _COSTS, _EVENTS, events
from tickloom.sources.adapters import D1, H1, H4, M15, bars, preds

#: Days between the years of the orders and those of the events.
SHIFT = 9131

_V19 = ["return_1", "return_mean_20", "hl_range", "candle_direction"]


@query(
    "V19_feature_metadata",
    f"{staged(M15)}, p AS (SELECT unnest([{', '.join(f'''{{feature: '{n}', v: {PRICE[n]}}}''' for n in _V19)}]) AS x FROM f1) SELECT x.feature AS feature, count(*) AS n_rows, count(*)-count(x.v) AS n_missing, CAST(0 AS BIGINT) AS n_infinite, "
    "round((count(*)-count(x.v))*100.0/count(*),6)+0.0 AS missing_pct, round(min(x.v),6)+0.0 AS min_value, round(max(x.v),6)+0.0 AS max_value, round(avg(x.v),6)+0.0 AS mean_value, round(stddev_samp(x.v),6)+0.0 AS std_value, "
    "CASE WHEN x.feature LIKE 'return%' THEN 'return' WHEN x.feature LIKE 'hl%' THEN 'hl' ELSE 'candle' END AS feature_group, count(*) OVER (PARTITION BY CASE WHEN x.feature LIKE 'return%' THEN 'return' WHEN x.feature LIKE 'hl%' THEN 'hl' ELSE 'candle' END) AS n_in_group FROM p GROUP BY x.feature",
)
def v19(spark, sf_dir):
    made = quality.feature_metadata(features.build(bars(spark, sf_dir), ["price"]), _V19)
    return rounded(made, "missing_pct", "min_value", "max_value", "mean_value", "std_value", digits=6)


@query("C03_yields_on_bars", f"WITH {q.TICKS}, {q.bars(H4)}, {_EXO}, k AS (SELECT * FROM x WHERE value BETWEEN 0.01 AND 0.02), j AS (SELECT b.symbol, b.time, k.usable_time, k.value FROM bars b ASOF LEFT JOIN k ON b.time >= k.usable_time) SELECT symbol, time, usable_time, round(value,8)+0.0 AS value FROM j")
def c03(spark, sf_dir):
    out = jobs.yields_on_bars(bars(spark, sf_dir, H4).select("symbol", "time"), exo_shifted(spark, sf_dir), 0.01, 0.02)
    return rounded(out.select("symbol", "time", "usable_time", "value"), "value")


@query(
    "C04_reports_on_bars",
    f"WITH {q.TICKS}, {q.bars(D1)}, {_REPORTS}, n AS (SELECT code, report_date, long_all-short_all AS net, long_all-short_all - lag(long_all-short_all,4) OVER (PARTITION BY code ORDER BY report_date) AS net_change_4 FROM reports WHERE NOT (least(long_all,short_all,rest_long,rest_short) < 0)), "
    f"u AS (SELECT code, CAST(epoch((CAST(report_date + CAST((5 - isodow(report_date) + 7) % 7 AS INT) AS TIMESTAMP) + INTERVAL '15 hours 30 minutes') AT TIME ZONE 'America/New_York') AS BIGINT) + {SHIFT * 86_400} AS usable_time, arg_max({{d: report_date, n: net, c: net_change_4}}, report_date) AS r FROM n GROUP BY 1, 2), "
    "w AS (SELECT symbol, time, CAST(unnest([0, 1, 2, 3]) AS BIGINT) AS code FROM bars) SELECT w.symbol, w.time, w.code, r.d AS report_date, r.n AS net, r.c AS net_change_4 FROM w ASOF LEFT JOIN u ON w.code = u.code AND w.time >= u.usable_time",
)
def c04(spark, sf_dir):
    out = jobs.reports_on_bars(bars(spark, sf_dir, D1), reports(spark, sf_dir), [0, 1, 2, 3], SHIFT)
    return out.select("symbol", "time", "code", "report_date", "net", "net_change_4")


@query("C05_daily_research", f"WITH {q.TICKS}, {q.bars(D1)}, {_EXO} SELECT symbol, time, round(close,8)+0.0 AS close, tick_volume, round(value,8)+0.0 AS value FROM bars b ASOF LEFT JOIN x ON b.time >= x.usable_time WHERE time < {CUTOFF}")
def c05(spark, sf_dir):
    out = jobs.daily_research(bars(spark, sf_dir, H4), exo_shifted(spark, sf_dir), CUTOFF)
    return rounded(out.select("symbol", "time", "close", "tick_volume", "value"), "close", "value")


_HOLDOUT = 1_705_708_800


@query(
    "C10_filtered_event_trades",
    f"{_EVENTS}, m AS (SELECT e.*, round(abs(k.close/k.open-1),6) AS move FROM e ASOF LEFT JOIN bars k ON e.symbol = k.symbol AND e.event_time - 900 >= k.time), th AS (SELECT quantile_cont(move, 0.75) AS bound FROM m WHERE event_time < {_HOLDOUT}), s AS (SELECT m.* FROM m, th WHERE move >= bound - 1e-9::DOUBLE), "
    "w AS (SELECT e.*, x.m AS mode, event_time + x.d AS due FROM (SELECT s.*, unnest([{m: 'IMMEDIATE', d: 0}, {m: 'DELAYED', d: 900}]) AS x FROM s) e), a AS (SELECT w.*, k.time AS t0, k.open AS o0 FROM w ASOF LEFT JOIN bars k ON w.symbol = k.symbol AND w.due <= k.time), b AS (SELECT a.*, k.open AS o1 FROM a ASOF LEFT JOIN bars k ON a.symbol = k.symbol AND a.t0 + 3600 <= k.time), "
    f"t AS (SELECT mode, CASE WHEN event_time < {_HOLDOUT} THEN 'research' ELSE 'holdout' END AS part, unnest([{', '.join(f'{c!r}::DOUBLE' for c in _COSTS)}]) AS cost, side*(o1/o0-1)*10000 AS gross FROM b WHERE o0 IS NOT NULL AND o1 IS NOT NULL) "
    f"SELECT mode, part, cost, count(*) AS n_trades, round(avg(gross-cost),4)+0.0 AS mean_net, {q.count_if('gross-cost > 1e-9')} AS n_wins FROM t GROUP BY ALL",
)
def c10(spark, sf_dir):
    out = jobs.strong_event_trades(events(spark, sf_dir), bars(spark, sf_dir), M15, H1, _COSTS, _HOLDOUT)
    part = F.when(F.col("event_time") < _HOLDOUT, "research").otherwise("holdout")
    return rounded(out.groupBy("mode", part.alias("part"), "cost").agg(F.count("*").alias("n_trades"), F.avg("net").alias("mean_net"), F.count_if(F.col("net") > 1e-9).alias("n_wins")), "mean_net", digits=4)


@query("M21_gated_calls", f"WITH {q.preds()}, g AS (SELECT symbol, y_pred, CASE WHEN hour(ts) BETWEEN 7 AND 20 AND greatest(p_short,p_neutral,p_long) >= 0.4::DOUBLE THEN y_pred ELSE 0.0 END AS y_gated FROM preds) SELECT symbol, y_pred, y_gated, count(*) AS n FROM g GROUP BY ALL")
def m21(spark, sf_dir):
    made = jobs.gated(preds(spark, sf_dir), F.hour("ts").between(7, 20) & (evaluate.top() >= 0.4))
    return made.groupBy("symbol", "y_pred", "y_gated").agg(F.count("*").alias("n"))


FITS = {
    "logistic": linear.fit,
    "logistic_balanced": lambda t, f: linear.fit(t, f, balanced=True),
    "forest": lambda t, f: trees.fit(t, f, keys=["symbol", "time"]),
    "forest_balanced": lambda t, f: trees.fit(t, f, keys=["symbol", "time"], balanced=True),
}


@query("M06_ablation")
def m06(spark, sf_dir):
    """Rows only: a logistic model without and with groups of features, on ten folds."""
    masked = streaming.stored(splits.fold_masks(dataset(spark, sf_dir), 300, 10, 4))
    return jobs.ablation(masked, {"returns": FEATURES[:2], "all": FEATURES}, 10)


@query("C08_final_test")
def c08(spark, sf_dir):
    """Rows only: the measures on validation and test rows, and what a model loses between them."""
    table = streaming.stored(splits.split(dataset(spark, sf_dir)))
    calls = streaming.stored(jobs.calls_of(table, FEATURES, {n: FITS[n] for n in ("logistic_balanced", "forest_balanced")}, ("validation", "test")))
    both = jobs.held_out(calls).groupBy("model", "metric").pivot("split", ["validation", "test"]).agg(F.first("value"))
    return both.withColumn("fall", F.col("validation") - F.col("test"))

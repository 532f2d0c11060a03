"""Queries of prediction diagnostics, model fits and streams (M, K03, K04, P10, P17, R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import streaming
from tickloom.operators import evaluate, features, labels, ledger, linear, models, splits, trees
from tickloom.plans import sql as q
from tickloom.plans.catalog import query, rounded
from tickloom.sources.adapters import H1, H4, bars, preds

_P = f"WITH {q.preds()}, p AS (SELECT *, greatest(p_short,p_neutral,p_long) AS top FROM preds)"
_RATIO = "coalesce({a}::DOUBLE/nullif({b},0),0.0)"


def _scores(source: str, keys: str) -> str:
    sums = ", ".join(f"{q.count_if(f'y_true={v}')} AS t{c}, {q.count_if(f'y_pred={v}')} AS p{c}, {q.count_if(f'y_true={v} AND y_pred={v}')} AS h{c}" for v, c in ((-1, "s"), (0, "n"), (1, "l")))
    return f"(SELECT {keys}, count(*) AS n_rows, {q.count_if('y_true=y_pred')} AS n_hits, {sums} FROM {source} GROUP BY {keys})"


_BAL = "(" + "+".join(_RATIO.format(a=f"h{c}", b=f"t{c}") for c in "snl") + ")/nullif((ts>0)::INT+(tn>0)::INT+(tl>0)::INT,0)"
_F1 = {c: f"coalesce(2.0*h{c}/nullif(t{c}+p{c},0),0.0)" for c in "snl"}
_MACRO = f"({'+'.join(_F1.values())})/3.0"
_NAMES = {"s": "short", "n": "neutral", "l": "long"}
_M07 = {"accuracy": _RATIO.format(a="n_hits", b="n_rows"), "balanced_accuracy": _BAL, "macro_f1": _MACRO} | {f"precision_{n}": _RATIO.format(a=f"h{c}", b=f"p{c}") for c, n in _NAMES.items()} | {f"recall_{n}": _RATIO.format(a=f"h{c}", b=f"t{c}") for c, n in _NAMES.items()} | {f"f1_{n}": _F1[c] for c, n in _NAMES.items()}


@query("M07_scores", f"{_P} SELECT symbol, n_rows, {q.rounded({k: f'CAST({v} AS DOUBLE)' for k, v in _M07.items()})}, ts AS support_short, tn AS support_neutral, tl AS support_long FROM {_scores('p', 'symbol')}")
def m07(spark, sf_dir):
    return rounded(evaluate.scores(evaluate.confusion(preds(spark, sf_dir), ["symbol"]), ["symbol"]), *_M07)


@query("M07_confusion", f"{_P} SELECT y_true, y_pred, count(*) AS n FROM p GROUP BY ALL")
def m07_cells(spark, sf_dir):
    return evaluate.confusion(preds(spark, sf_dir), [])


_OVR = "o AS (SELECT 'short' AS class, p_short AS score, y_true=-1 AS pos FROM p UNION ALL SELECT 'neutral', p_neutral, y_true=0 FROM p UNION ALL SELECT 'long', p_long, y_true=1 FROM p)"
_RANK = f"{_P}, {_OVR}, c AS (SELECT class, score, {q.count_if('pos')} AS pos, {q.count_if('NOT pos')} AS neg FROM o GROUP BY ALL), r AS (SELECT *, coalesce(sum(neg) OVER w, 0) AS nb, coalesce(sum(pos) OVER w, 0) AS pb, sum(pos) OVER (PARTITION BY class) AS np, sum(neg) OVER (PARTITION BY class) AS nn FROM c WINDOW w AS (PARTITION BY class ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"


@query("M08_auc", f"{_RANK} SELECT class, round(sum(pos*(nb+neg/2.0))/(max(np)*max(nn)),8)+0.0 AS auc FROM r GROUP BY 1")
def m08(spark, sf_dir):
    o = evaluate.one_vs_rest(preds(spark, sf_dir))
    return rounded(evaluate.area_under_curve(evaluate.ranked(o, F.col("score"), F.col("positive"), ["class"]), ["class"]), "auc")


@query("M09_average_precision", f"{_RANK} SELECT class, round(sum(pos::DOUBLE/np*(np-pb)/((np-pb)+(nn-nb))),8)+0.0 AS average_precision FROM r GROUP BY 1")
def m09(spark, sf_dir):
    o = evaluate.one_vs_rest(preds(spark, sf_dir))
    return rounded(evaluate.average_precision(evaluate.ranked(o, F.col("score"), F.col("positive"), ["class"]), ["class"]), "average_precision")


@query("M10_probabilities", f"{_P}, o AS (SELECT 'max' AS class, top AS p, abs(p_short+p_neutral+p_long-1)>1e-4 AS off FROM p UNION ALL SELECT 'short', p_short, abs(p_short+p_neutral+p_long-1)>1e-4 FROM p UNION ALL SELECT 'neutral', p_neutral, abs(p_short+p_neutral+p_long-1)>1e-4 FROM p UNION ALL SELECT 'long', p_long, abs(p_short+p_neutral+p_long-1)>1e-4 FROM p) SELECT class, round(avg(p),8)+0.0 AS mean_p, round(stddev_pop(p),8)+0.0 AS std_p, round(min(p),8)+0.0 AS min_p, round(max(p),8)+0.0 AS max_p, round(quantile_cont(p,0.05),8)+0.0 AS p05, round(quantile_cont(p,0.5),8)+0.0 AS p50, round(quantile_cont(p,0.95),8)+0.0 AS p95, {q.count_if('off')} AS n_off FROM o GROUP BY 1")
def m10(spark, sf_dir):
    return rounded(evaluate.probabilities(preds(spark, sf_dir)), "mean_p", "std_p", "min_p", "max_p", "p05", "p50", "p95")


_TH = (0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.99)


@query("M11_coverage", f"{_P}, th AS (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in _TH)}]) AS threshold), c AS (SELECT threshold, y_true, y_pred FROM th JOIN p ON p.top >= threshold), s AS (SELECT * FROM {_scores('c', 'threshold')}) SELECT threshold, coalesce(n_rows,0) AS n_covered, round(coalesce(n_rows,0)::DOUBLE/(SELECT count(*) FROM p),8)+0.0 AS coverage, CASE WHEN n_rows IS NOT NULL THEN round({_M07['accuracy']},8)+0.0 END AS accuracy, CASE WHEN n_rows IS NOT NULL THEN round({_BAL},8)+0.0 END AS balanced_accuracy, CASE WHEN n_rows IS NOT NULL THEN round(CAST({_MACRO} AS DOUBLE),8)+0.0 END AS macro_f1 FROM th LEFT JOIN s USING (threshold)")
def m11(spark, sf_dir):
    return rounded(evaluate.coverage(preds(spark, sf_dir), _TH), "coverage", "accuracy", "balanced_accuracy", "macro_f1")


@query("M12_buckets", f"{_P} SELECT CASE WHEN top >= 0.8::DOUBLE THEN 3 WHEN top >= 0.6::DOUBLE THEN 2 WHEN top >= 0.5::DOUBLE THEN 1 ELSE 0 END AS bucket, count(*) AS n, round(avg((y_true=y_pred)::INT),8)+0.0 AS accuracy, round(avg(top),8)+0.0 AS mean_confidence FROM p WHERE top >= 0.4::DOUBLE GROUP BY 1")
def m12(spark, sf_dir):
    return rounded(evaluate.buckets(preds(spark, sf_dir), (0.4, 0.5, 0.6, 0.8)), "accuracy", "mean_confidence")


@query("M13_errors", f"{_P}, g AS (SELECT y_true, y_pred, count(*) AS n, avg(top) AS a, quantile_cont(top,0.5) AS m, min(top) AS mn, max(top) AS mx FROM p GROUP BY ALL), v AS (SELECT a.x AS y_true, b.x AS y_pred FROM (VALUES (-1.0::DOUBLE),(0.0),(1.0)) a(x), (VALUES (-1.0::DOUBLE),(0.0),(1.0)) b(x)), f AS (SELECT v.y_true, v.y_pred, coalesce(n,0) AS n, a, m, mn, mx FROM v LEFT JOIN g USING (y_true, y_pred)) SELECT y_true, y_pred, n, round(a,8)+0.0 AS mean_confidence, round(m,8)+0.0 AS median_confidence, round(mn,8)+0.0 AS min_confidence, round(mx,8)+0.0 AS max_confidence, round(n*100.0/sum(n) OVER (),8)+0.0 AS pct, CASE WHEN y_true <> y_pred THEN round(n*100.0/sum(CASE WHEN y_true<>y_pred THEN n ELSE 0 END) OVER (),8)+0.0 END AS error_pct FROM f")
def m13(spark, sf_dir):
    return rounded(evaluate.errors(preds(spark, sf_dir)), "mean_confidence", "median_confidence", "min_confidence", "max_confidence", "pct", "error_pct")


@query("M14_agreement", f"WITH {q.preds()}, {q.preds(41, 61, 89, 'other')}, j AS (SELECT a.y_true, a.y_pred AS a, b.y_pred AS b FROM preds a JOIN other b USING (event_id)), g AS (SELECT count(*) AS n_rows, avg((a=b)::INT) AS ag, avg(CASE WHEN a=b THEN (y_true=a)::INT END) AS acc, avg(CASE WHEN a<>b THEN (y_true=a)::INT END) AS nacc, {' + '.join(f'avg((a={v})::INT)*avg((b={v})::INT)' for v in (-1, 0, 1))} AS ch FROM j) SELECT n_rows, round(ag,8)+0.0 AS agreement, round(acc,8)+0.0 AS accuracy_when_agreed, round(nacc,8)+0.0 AS a_accuracy_when_not, round((ag-ch)/nullif(1.0-ch,0),8)+0.0 AS kappa FROM g")
def m14(spark, sf_dir):
    return rounded(evaluate.agreement(preds(spark, sf_dir), preds(spark, sf_dir, 41, 61, 89), "event_id"), "agreement", "accuracy_when_agreed", "a_accuracy_when_not", "kappa")


@query("M15_calibration", f"{_P}, {_OVR} SELECT class, CAST(greatest(ceil(score*10)-1,0) AS INT) AS bin, count(*) AS n, round(avg(score),8)+0.0 AS mean_p, round(avg(pos::INT),8)+0.0 AS observed FROM o GROUP BY ALL")
def m15(spark, sf_dir):
    return rounded(evaluate.calibration(preds(spark, sf_dir)), "mean_p", "observed")


_SQ = {"short": "pow(p_short-(y_true=-1)::INT,2)", "neutral": "pow(p_neutral-(y_true=0)::INT,2)", "long": "pow(p_long-(y_true=1)::INT,2)"}


@query("M16_brier", f"{_P} SELECT round(avg({' + '.join(_SQ.values())}),8)+0.0 AS brier, {', '.join(f'round(avg({x}),8)+0.0 AS brier_{n}' for n, x in _SQ.items())} FROM p")
def m16(spark, sf_dir):
    return rounded(evaluate.brier(preds(spark, sf_dir)), "brier", *(f"brier_{n}" for n in _SQ))


@query("M17_reliability", f"{_P}, b AS (SELECT ceil(top*10)-1 AS bin, count(*) AS n, sum(top) AS c, sum((y_true=y_pred)::INT) AS h, sum(-ln(greatest(CASE WHEN y_true=-1 THEN p_short WHEN y_true=0 THEN p_neutral ELSE p_long END,1e-12))) AS loss, sum(-p_short*ln(greatest(p_short,1e-12))-p_neutral*ln(greatest(p_neutral,1e-12))-p_long*ln(greatest(p_long,1e-12))) AS e FROM p GROUP BY 1) SELECT round(sum(abs(h-c))/sum(n),6)+0.0 AS ece, round(max(abs(h-c)/n),6)+0.0 AS mce, round(sum(loss)/sum(n),6)+0.0 AS log_loss, round(sum(e)/sum(n),6)+0.0 AS mean_entropy FROM b")
def m17(spark, sf_dir):
    return rounded(evaluate.reliability(preds(spark, sf_dir)), "ece", "mce", "log_loss", "mean_entropy", digits=6)


_MASKS = {"all": "true", "confident": "top >= 0.5::DOUBLE", "night": "hour(ts) < 7", "monday": "isodow(ts) = 1", "sure_and_night": "top >= 0.5::DOUBLE AND hour(ts) < 7", "never": "top > 1.0::DOUBLE"}


@query("M18_directional_regimes", f"{_P}, r AS (SELECT y_true, y_pred, unnest(list_filter([{', '.join(f'CASE WHEN {m} THEN {chr(39)}{n}{chr(39)} END' for n, m in _MASKS.items())}], lambda x: x IS NOT NULL)) AS regime FROM p WHERE y_true <> 0), g AS (SELECT regime, count(*) AS n_moved, {q.count_if('y_pred <> 0')} AS n_called, avg(CASE WHEN y_pred<>0 THEN (y_true=y_pred)::INT END) AS a, avg(CASE WHEN y_pred<>0 AND y_true=1 THEN (y_true=y_pred)::INT END) AS u, avg(CASE WHEN y_pred<>0 AND y_true=-1 THEN (y_true=y_pred)::INT END) AS d FROM r GROUP BY 1) SELECT regime, n_moved, n_called, round(a,8)+0.0 AS accuracy, round((u+d)/2,8)+0.0 AS balanced_accuracy, CASE WHEN n_called=0 THEN 'NO_SAMPLES' WHEN u+d IS NULL THEN 'SINGLE_CLASS' ELSE 'OK' END AS status FROM g")
def m18(spark, sf_dir):
    sure, night = evaluate.top() >= 0.5, F.hour("ts") < 7
    masks = {"all": F.lit(True), "confident": sure, "night": night, "monday": F.weekday("ts") == 0, "sure_and_night": sure & night, "never": evaluate.top() > 1.0}
    return rounded(evaluate.directional(preds(spark, sf_dir), masks), "accuracy", "balanced_accuracy")


_SH = (0.01, 0.05, 0.1, 0.2, 0.5, 1.0)


@query("K04_confident_subsets", " UNION ALL ".join(f"SELECT * FROM ({_P}, d AS (SELECT *, abs(p_long-p_short) AS dd FROM p), c AS (SELECT quantile_cont(dd,{1.0 - s!r}) AS t FROM d) SELECT {s!r}::DOUBLE AS share, count(*) AS n, round(avg((y_true=y_pred)::INT),8)+0.0 AS accuracy, {q.count_if('y_pred>0')} AS n_long, {q.count_if('y_pred<0')} AS n_short FROM d, c WHERE dd >= t)" for s in _SH))
def k04(spark, sf_dir):
    return rounded(evaluate.confident_subsets(preds(spark, sf_dir), _SH), "accuracy")


@query("M01_majority", f"{_P}, c AS (SELECT y_true, count(*) AS n FROM p GROUP BY 1) SELECT arg_max(y_true,(n,-y_true)) AS majority, CAST(sum(n) AS BIGINT) AS n_rows, round(sum(CASE WHEN y_true=-1 THEN n ELSE 0 END)::DOUBLE/sum(n),8)+0.0 AS prior_short, round(sum(CASE WHEN y_true=0 THEN n ELSE 0 END)::DOUBLE/sum(n),8)+0.0 AS prior_neutral, round(sum(CASE WHEN y_true=1 THEN n ELSE 0 END)::DOUBLE/sum(n),8)+0.0 AS prior_long FROM c")
def m01(spark, sf_dir):
    return rounded(evaluate.majority(preds(spark, sf_dir), "y_true"), "prior_short", "prior_neutral", "prior_long")


@query("P10_decisions", f"{_P} SELECT symbol, CASE WHEN p_long = top AND p_long > p_short AND p_long >= 0.45::DOUBLE THEN 'BUY' WHEN p_short = top AND p_short >= 0.45::DOUBLE AND p_short > p_long THEN 'SELL' ELSE 'HOLD' END AS action, count(*) AS n FROM p GROUP BY ALL")
def p10(spark, sf_dir):
    d = ledger.decision(F.col("p_short"), F.col("p_neutral"), F.col("p_long"), 0.45)
    return preds(spark, sf_dir).groupBy("symbol", d.alias("action")).agg(F.count("*").alias("n"))


@query("P17_economic_simulation", f"{q.bars_with(H4)}, l AS (SELECT symbol, {q.lead('close', 4)}/close-1.0 AS r, sign(close - {q.lag('close', 4)}) AS y FROM bars), n AS (SELECT symbol, CASE WHEN y <> 0 THEN y*r*10000 - 1.5 END AS net FROM l) SELECT symbol, count(net) AS n_trades, round(avg(CASE WHEN net IS NOT NULL THEN (net>0)::INT END),6)+0.0 AS win_rate, round(avg(net),6)+0.0 AS mean_net, round(sum(net),6)+0.0 AS total_net, coalesce(avg(net)>0,false) AS is_viable FROM n GROUP BY 1")
def p17(spark, sf_dir):
    from tickloom.operators.frames import over_blocks

    p = over_blocks(bars(spark, sf_dir, H4), lambda df, f: df.withColumns({"r": f.lead("close", 4) / F.col("close") - 1.0, "y_pred": F.signum(F.col("close") - f.lag("close", 4))}), 4, 4)
    return rounded(evaluate.economic(p, "r", 1.5), "win_rate", "mean_net", "total_net", digits=6)


FEATURES = ["return_1", "return_4", "dist_sma_20", "rsi_14", "atr_norm_14", "vol_std_20", "trend_regime"]


def dataset(spark, sf_dir):
    """Swing features with the class of the next four bars, usable rows only."""
    b = bars(spark, sf_dir, H1)
    x = features.build(b, ["swing"]).select("symbol", "time", *FEATURES)
    y = labels.label(b, labels.directions).select("symbol", "time", (F.col("direction_4") + 1.0).alias("label"))
    return splits.usable(x.join(y, ["symbol", "time"]), [*FEATURES, "label"])


def train_rows(spark, sf_dir):
    """Stored once: a fit scans it in each step."""
    return streaming.stored(splits.split(dataset(spark, sf_dir)).filter("split = 'train'"))


@query("M03_logistic")
def m03(spark, sf_dir):
    """Rows only: mean absolute coefficients of the converged fit (M03_newton_steps has SQL)."""
    return models.importances(linear.fit(train_rows(spark, sf_dir), FEATURES, balanced=True), FEATURES)


@query("M04_forest")
def m04(spark, sf_dir):
    """Rows only: importances of 100 trees of ten levels (M04_grown_tree has SQL)."""
    return models.importances(trees.fit(train_rows(spark, sf_dir), FEATURES, keys=["symbol", "time"]), FEATURES)


@query("M05_walk_forward")
def m05(spark, sf_dir):
    """Rows only: out-of-fold metrics of logistic models on ten folds, fitted in the same scans."""
    data = streaming.stored(splits.fold_masks(dataset(spark, sf_dir), 300, 10, 4))
    return models.fold_metrics(models.walk_forward_logistic(data, {"plain": FEATURES, "balanced_few": FEATURES[:3]}, 10))


# streams: the result of a replay over the files equals the batch result
@query("R02_streamed_bars", f"WITH {q.TICKS}, {q.bars(3600)} SELECT symbol, time, round(open,8)+0.0 AS open, round(high,8)+0.0 AS high, round(low,8)+0.0 AS low, round(close,8)+0.0 AS close, tick_volume FROM bars WHERE (time+3600)*1000000 <= (SELECT max(epoch_us(ts)) FROM events) - 86400000000")
def r02(spark, sf_dir):
    quotes = streaming.read_quotes(spark, f"{sf_dir}/events.parquet")
    return rounded(streaming.replay(streaming.completed_bars(quotes, "1 hour")), "open", "high", "low", "close")


@query("R06_once", "SELECT user_id, count(*) AS n FROM (SELECT DISTINCT event_id, user_id FROM events) GROUP BY 1")
def r06(spark, sf_dir):
    quotes = streaming.read_quotes(spark, f"{sf_dir}/events.parquet")
    return streaming.replay(streaming.once(quotes.unionByName(quotes), ["event_id"])).groupBy("user_id").agg(F.count("*").alias("n"))


# a run ends 300 s after its last tick, and is written when the watermark, one day behind the newest tick, has passed its end
_RUNS = "t AS (SELECT event_type AS symbol, epoch_us(ts) AS us, event_id FROM events), s AS (SELECT *, CASE WHEN us - lag(us) OVER w <= 300000000 THEN 0 ELSE 1 END AS cut FROM t WINDOW w AS (PARTITION BY symbol ORDER BY us, event_id)), i AS (SELECT *, sum(cut) OVER (PARTITION BY symbol ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM s)"


@query("R07_outages", f"WITH {_RUNS} SELECT symbol, min(us)//1000000 AS start_time, count(*) AS n_ticks FROM i GROUP BY symbol, run HAVING max(us) + 300000000 <= (SELECT max(us)//1000*1000 FROM t) - 86400000000")
def r07(spark, sf_dir):
    """Sessions that the watermark has closed."""
    return streaming.replay(streaming.outages(streaming.read_quotes(spark, f"{sf_dir}/events.parquet")))


@query("R08_running_counts", f"WITH {q.TICKS} SELECT symbol, count(*) AS n_ticks, min(spread_points) AS min_spread, max(spread_points) AS max_spread, round(avg(spread_points),6)+0.0 AS mean_spread FROM ticks GROUP BY 1")
def r08(spark, sf_dir):
    out = streaming.replay(streaming.running_counts(streaming.read_quotes(spark, f"{sf_dir}/events.parquet")), "complete")
    return rounded(out, "mean_spread", digits=6)

"""Queries of model fits with SQL counterparts: Newton steps, a grown tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import streaming
from tickloom.operators import evaluate, jobs, ledger, linear, trees
from tickloom.plans import sql as q
from tickloom.plans.catalog import query, rounded
from tickloom.plans.study_queries import events
from tickloom.sources.adapters import H1, M15, bars, trades

_STEPS = 4
_X = ["entry_spread_pts", "holding_bars"]


def _newton_sql() -> str:
    """The same steps for two classes: with b the difference of the classes' coefficients, the penalty is b^2 / 4."""
    parts = [
        f"WITH {q.TRADES}, d AS (SELECT CAST(net_pnl > 0 AS INT) AS y, {', '.join(f'({c} - avg({c}) OVER ())/stddev_pop({c}) OVER () AS x{j}' for j, c in enumerate(_X, 1))} FROM trades)",
        "s0 AS (SELECT 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2)",
    ]
    for k in range(_STEPS):
        x = ["1.0::DOUBLE", "x1", "x2"]
        g = ", ".join(f"sum((p-y)*{x[i]}){f'+0.5*max(b{i})' if i else ''} AS g{i}" for i in range(3))
        h = ", ".join(f"sum(p*(1-p)*{x[i]}*{x[j]}){'+0.5' if i == j and i else ''} AS h{i}{j}" for i in range(3) for j in range(i, 3))
        parts.append(f"p{k} AS (SELECT d.*, b0, b1, b2, 1.0/(1.0+exp(-(b0+b1*x1+b2*x2))) AS p FROM d, s{k})")
        parts.append(f"m{k} AS (SELECT max(b0) AS b0, max(b1) AS b1, max(b2) AS b2, {g}, {h} FROM p{k})")
        m = [["h00", "h01", "h02"], ["h01", "h11", "h12"], ["h02", "h12", "h22"]]
        det = lambda a: f"({a[0][0]}*({a[1][1]}*{a[2][2]}-{a[1][2]}*{a[2][1]})-{a[0][1]}*({a[1][0]}*{a[2][2]}-{a[1][2]}*{a[2][0]})+{a[0][2]}*({a[1][0]}*{a[2][1]}-{a[1][1]}*{a[2][0]}))"
        swapped = lambda j, m=m: [[f"g{i}" if c == j else m[i][c] for c in range(3)] for i in range(3)]
        parts.append(f"s{k + 1} AS (SELECT {', '.join(f'b{j} - {det(swapped(j))}/{det(m)} AS b{j}' for j in range(3))} FROM m{k})")
    return ", ".join(parts) + f" SELECT unnest(['intercept', '{_X[0]}', '{_X[1]}']) AS feature, round(unnest([b0, b1, b2]), 6)+0.0 AS coefficient FROM s{_STEPS}"


@query("M03_newton_steps", _newton_sql())
def m03_steps(spark, sf_dir):
    """Does a trade win? Four Newton steps; the difference of the two classes' coefficients."""
    table = trades(spark, sf_dir).select(*_X, (F.col("net_pnl") > 0).cast("double").alias("label"))
    model = linear.fit(table, _X, steps=_STEPS, tolerance=0.0)
    values = [model.intercept[1] - model.intercept[0], *(model.coef[1] - model.coef[0])]
    return rounded(spark.createDataFrame([(n, float(v)) for n, v in zip(["intercept", *_X], values, strict=True)], "feature string, coefficient double"), "coefficient", digits=6)


_DEPTH, _BINS, _LEAF = 3, 16, 20
_T = ["entry_spread_pts", "exit_spread_pts", "holding_bars"]
#: A label that the spreads explain in part.
_LABEL = "(CASE WHEN entry_spread_pts > exit_spread_pts + holding_bars THEN 2 WHEN (trade_id * 31 % 17) < 6 THEN 1 ELSE 0 END)"


def _tree_sql() -> str:
    cuts = " UNION ALL ".join(f"SELECT DISTINCT {j} AS feature, unnest(quantile_cont({c}, [{', '.join(f'{i / _BINS!r}' for i in range(1, _BINS))}])) AS threshold FROM t" for j, c in enumerate(_T))
    parts = [
        f"WITH {q.TRADES}, t AS (SELECT trade_id, {', '.join(f'{c}::DOUBLE AS {c}' for c in _T)}, {_LABEL} AS y FROM trades), cut AS ({cuts})",
        "n0 AS (SELECT t.*, 1 AS node FROM t)",
    ]
    total = lambda p: f"({p}0+{p}1+{p}2)"
    pure = lambda p: f"(({p}0*{p}0+{p}1*{p}1+{p}2*{p}2)/{total(p)}::DOUBLE)"
    for k in range(_DEPTH):
        value = f"CASE feature {' '.join(f'WHEN {j} THEN {c}' for j, c in enumerate(_T))} END"
        counts = ", ".join(f"count(*) FILTER (y = {c} AND {value} <= threshold) AS l{c}, count(*) FILTER (y = {c} AND {value} > threshold) AS r{c}, count(*) FILTER (y = {c}) AS a{c}" for c in range(3))
        parts.append(f"h{k} AS (SELECT node, feature, threshold, {counts} FROM n{k}, cut GROUP BY ALL)")
        parts.append(f"g{k} AS (SELECT *, {pure('l')} + {pure('r')} - {pure('a')} AS gain FROM h{k} WHERE {total('l')} >= {_LEAF} AND {total('r')} >= {_LEAF})")
        parts.append(f"b{k} AS (SELECT * FROM g{k} WHERE gain > 1e-9 QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(gain, 9) DESC, feature, threshold) = 1)")
        parts.append(f"n{k + 1} AS (SELECT n.* EXCLUDE (node), 2*node + CASE WHEN {value.replace('feature', 'b.feature', 1)} <= threshold THEN 0 ELSE 1 END AS node FROM n{k} n JOIN b{k} b USING (node))")
    names = f"['{_T[0]}', '{_T[1]}', '{_T[2]}'][feature+1]"
    return ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT node, {names} AS feature, round(threshold,6)+0.0 AS threshold, round(gain,6)+0.0 AS gain, CAST({total('a')} AS BIGINT) AS n_rows FROM b{k}" for k in range(_DEPTH))


def _grown(spark, sf_dir):
    table = trades(spark, sf_dir).select("trade_id", *_T, F.expr(_LABEL).cast("double").alias("label"))
    return trees.fit(table, _T, keys=["trade_id"], trees=1, depth=_DEPTH, least_leaf=_LEAF, bins=_BINS, draw=False)


@query("M22_importances", f"SELECT feature, round(coalesce(g, 0)/sum(g) OVER (), 5)+0.0 AS importance, CAST(row_number() OVER (ORDER BY coalesce(g, 0) DESC, feature) AS INTEGER) AS rank FROM (SELECT unnest({_T}) AS feature) LEFT JOIN (SELECT feature, sum(gain) AS g FROM ({_tree_sql()}) GROUP BY 1) USING (feature)")
def m22(spark, sf_dir):
    """Shares of the gains of the grown tree."""
    return rounded(_grown(spark, sf_dir).importances(spark), "importance", digits=5)


@query("M04_grown_tree", _tree_sql())
def m04_tree(spark, sf_dir):
    """The splits of one tree of three levels, without draws."""
    nodes = _grown(spark, sf_dir).table(spark).filter("feature is not null")
    return rounded(nodes.select("node", "feature", "threshold", "gain", F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c).alias("n_rows")), "threshold", "gain", digits=6)


_BUY, _SELL = "p_long = top AND p_long > p_short AND p_long >= 0.45::DOUBLE", "p_short = top AND p_short >= 0.45::DOUBLE AND p_short > p_long"


@query(
    "R08_decision_counts",
    f"WITH {q.preds()}, p AS (SELECT *, greatest(p_short,p_neutral,p_long) AS top, event_id * 17 % 500 AS latency_ms FROM preds), d AS (SELECT *, CASE WHEN {_BUY} THEN 'BUY' WHEN {_SELL} THEN 'SELL' ELSE 'HOLD' END AS action FROM p) "
    "SELECT symbol, action, CAST(y_pred AS INT) AS class, top >= 0.6::DOUBLE AS is_sure, count(*) AS n, round(min(top),8)+0.0 AS min_confidence, round(max(top),8)+0.0 AS max_confidence, round(avg(top),8)+0.0 AS mean_confidence, round(avg(latency_ms),6)+0.0 AS mean_latency_ms, max(latency_ms) AS max_latency_ms FROM d GROUP BY ALL",
)
def r08_counts(spark, sf_dir):
    """Running counts by decision, class and threshold, with confidences and latencies, at the stream's end."""
    e = F.col("event_id")
    quotes = streaming.read_quotes(spark, f"{sf_dir}/events.parquet")
    raw = quotes.select("symbol", "event_id", *((e * m % k + 1).cast("double").alias(n) for n, m, k in (("a", 37, 101), ("b", 59, 103), ("c", 83, 107))))
    total = F.col("a") + F.col("b") + F.col("c")
    y_pred = F.when((F.col("a") >= F.col("b")) & (F.col("a") >= F.col("c")), -1).when(F.col("b") >= F.col("c"), 0).otherwise(1)
    scored = raw.select("symbol", "event_id", y_pred.alias("class"), *((F.col(x) / total).alias(n) for x, n in (("a", "p_short"), ("b", "p_neutral"), ("c", "p_long"))), (e * 17 % 500).alias("latency_ms"))
    called = scored.withColumns({"action": ledger.decision(F.col("p_short"), F.col("p_neutral"), F.col("p_long"), 0.45), "top": evaluate.top()})
    return rounded(rounded(streaming.replay(streaming.running_decisions(called, 0.6), "complete"), "min_confidence", "max_confidence", "mean_confidence"), "mean_latency_ms", digits=6)


_EVENT_INPUTS = ["move", "hour_sin", "hour_cos", "side"]
_HOLDOUT = 1_705_500_000


@query("C10_event_models")
def c10_models(spark, sf_dir):
    """Rows only (the fits and the trades have SQL of their own): does the entry at once win? Models on event features, fitted before the holdout."""
    table = streaming.stored(jobs.event_features(events(spark, sf_dir), bars(spark, sf_dir), M15, H1, 1.5))
    train, rest = table.filter(F.col("event_time") < _HOLDOUT), table.filter(F.col("event_time") >= _HOLDOUT)
    return jobs.two_class_scores(train, rest, _EVENT_INPUTS, {"logistic": linear.fit, "forest": lambda t, f: trees.fit(t, f, keys=["event_id"])})

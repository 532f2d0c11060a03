"""Whole jobs: slow series and reports onto bars, daily research data, filtered event trades, model comparisons."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators import asof, evaluate, explore, ledger, models, quality, rollup, studies

DAY = 86_400


def yields_on_bars(bars: DataFrame, series: DataFrame, least: float, most: float) -> DataFrame:
    """A slow series (usable_time, value), without missing and impossible values, on bars from the instant it may be used."""
    sound = series.filter(F.col("value").between(least, most))
    return asof.asof_slow(bars, sound, "time", "usable_time", ["value"])


def reports_on_bars(bars: DataFrame, reports: DataFrame, codes: list[int], shift_days: int = 0, bucket: int = 30 * DAY) -> DataFrame:
    """Position reports without negative fields, with their features, on bars from the Friday on which they appear.

    One row per bar and code; of reports that appear together the latest counts. `shift_days` moves reports in time.
    """
    sound = reports.filter(~(F.least("long_all", "short_all", "rest_long", "rest_short") < 0))
    made = explore.position_features(sound).withColumn("usable_time", F.unix_timestamp(ledger.publication(F.col("report_date"))) + shift_days * DAY)
    wide = bars.select("symbol", "time", F.explode(F.array(*(F.lit(c).cast("long") for c in codes))).alias("code"))
    return asof.asof(wide, made, ["code"], "time", "usable_time", ["report_date", "net", "net_change_4"], bucket, ties=["report_date"])


def daily_research(bars: DataFrame, series: DataFrame, cutoff: int) -> DataFrame:
    """Daily bars with the slow value that may be used at their open, without the locked period."""
    daily = rollup.longer_bars(bars, DAY)
    return quality.locked_period(asof.asof_slow(daily, series, "time", "usable_time", ["value"]), cutoff)


def strong_event_trades(events: DataFrame, bars: DataFrame, step: int, hold: int, costs: tuple[float, ...], cutoff: int, share: float = 0.75) -> DataFrame:
    """Trades of the events after a large move: that of the last whole bar, at or above the quantile of the events before the cutoff.

    Moves are whole millionths, so that the quantile's table of distinct values is bounded.
    """
    moves = bars.select("symbol", "time", F.round(F.abs(F.col("close") / F.col("open") - 1), 6).alias("move"))
    placed = asof.asof(events.withColumn("_whole", F.col("event_time") - step), moves, ["symbol"], "_whole", "time", ["move"], DAY).drop("_whole", "time")
    bound = placed.filter(F.col("event_time") < cutoff).agg(F.percentile("move", F.lit(share)).alias("_bound"))
    strong = placed.crossJoin(F.broadcast(bound)).filter(F.col("move") >= F.col("_bound") - 1e-9).select(*events.columns)  # the bound is one row
    return studies.event_trades(strong, bars, step, hold, costs, DAY)


def event_features(events: DataFrame, bars: DataFrame, step: int, hold: int, cost: float) -> DataFrame:
    """Each event entered at once, with the move of the last whole bar, the hour on a circle and its side; label 1 if the trade wins after cost."""
    moves = bars.select("symbol", "time", F.round(F.abs(F.col("close") / F.col("open") - 1), 6).alias("move"))
    placed = asof.asof(events.withColumn("_whole", F.col("event_time") - step), moves, ["symbol"], "_whole", "time", ["move"], DAY).drop("_whole", "time")
    traded = studies.event_trades(placed, bars, step, hold, (cost,), DAY).filter("mode = 'IMMEDIATE' and move is not null")
    turn = F.hour(F.timestamp_seconds("event_time")) * (2 * math.pi / 24)
    return traded.select("symbol", "event_id", "event_time", "move", F.sin(turn).alias("hour_sin"), F.cos(turn).alias("hour_cos"), "side", "net", (F.col("net") > 0).cast("double").alias("label"))


def two_class_scores(train: DataFrame, rest: DataFrame, features: list[str], fits: dict) -> DataFrame:
    """(model, n_rows, accuracy, auc, n_taken, mean_net) of models of a label of 0 and 1 on rows that they were not fitted on; trades with a chance above a half are taken."""
    out = []
    for name, fit in fits.items():
        called = models.predict(fit(train, features), rest, ["event_id", "net"]).withColumn("score", F.get("probability", F.lit(1)))
        sums = called.agg(F.count("*").alias("n_rows"), F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"), F.count_if(F.col("score") > 0.5).alias("n_taken"), F.avg(F.when(F.col("score") > 0.5, F.col("net"))).alias("mean_net"))
        ranks = evaluate.ranked(called.withColumn("_one", F.lit(1)), F.col("score"), F.col("label") == 1, ["_one"])
        out.append(sums.crossJoin(F.broadcast(evaluate.area_under_curve(ranks, ["_one"]).select("auc"))).withColumn("model", F.lit(name)))  # one row each
    return reduce(DataFrame.unionByName, out)


def gated(scored: DataFrame, mask: Column, neutral: float = 0.0) -> DataFrame:
    """Rows scored once; outside the regime mask (missing included) the call is neutral."""
    return scored.withColumn("y_gated", F.when(F.coalesce(mask, F.lit(False)), F.col("y_pred")).otherwise(neutral))


def ablation(masked: DataFrame, subsets: dict[str, list[str]], n_folds: int, **options) -> DataFrame:
    """The walk-forward metrics of a logistic model for each named subset of the features, and the gain over the first subset."""
    out = models.fold_metrics(models.walk_forward_logistic(masked, subsets, n_folds, **options)).withColumnRenamed("model", "feature_set")
    first = out.filter(F.col("feature_set") == next(iter(subsets))).select("fold_idx", F.col("balanced_accuracy").alias("_base"))  # one row a fold
    return out.join(F.broadcast(first), "fold_idx").withColumn("gain", F.col("balanced_accuracy") - F.col("_base")).drop("_base")


def calls_of(table: DataFrame, features: list[str], fits: dict, parts: tuple[str, ...]) -> DataFrame:
    """Models fitted on the train rows, and the majority class, called on other parts of a split table.

    model, split, usable_idx, n_usable, symbol, label, prediction, probability (of -1, 0, 1 as classes 0, 1, 2).
    """
    train, rest = table.filter("split = 'train'"), table.filter(F.col("split").isin(*parts))
    shares = train.groupBy("label").count()
    top = shares.agg(F.max_by("label", F.struct("count", -F.col("label"))).alias("prediction"), *(F.sum(F.when(F.col("label") == k, F.col("count")).otherwise(0)).alias(f"_{k}") for k in range(3)))  # one row
    whole = F.col("_0") + F.col("_1") + F.col("_2")
    keep = ["split", "symbol", "usable_idx", "n_usable"]
    out = [rest.select(*keep, "label").crossJoin(F.broadcast(top)).select(*keep, F.col("label").cast("double").alias("label"), "prediction", F.array(*(F.col(f"_{k}") / whole for k in range(3))).alias("probability")).withColumn("model", F.lit("majority"))]
    out += [models.predict(fit(train, features), rest, keep).withColumn("model", F.lit(n)) for n, fit in fits.items()]
    return reduce(DataFrame.unionByName, out)


#: Confidence that calls are counted from.
COVERED = (0.4, 0.5, 0.6, 0.7, 0.8)


def held_out(calls: DataFrame, n_blocks: int = 3) -> DataFrame:
    """(model, split, metric, value): M07 on all rows and on blocks of time (D08), M08 and M09 a class, M11, M16."""
    p = lambda k: F.get("probability", F.lit(k))
    table = calls.select("model", "split", "symbol", "usable_idx", (F.col("label") - 1).alias("y_true"), (F.col("prediction") - 1).alias("y_pred"), *(p(k).alias(f"p_{c}") for k, c in enumerate(("short", "neutral", "long"))))
    ends = table.groupBy("model", "split", "symbol").agg(F.min("usable_idx").alias("_a"), F.max("usable_idx").alias("_z"))
    placed = table.join(ends, ["model", "split", "symbol"]).withColumn("_block", F.floor((F.col("usable_idx") - F.col("_a")) * n_blocks / (F.col("_z") - F.col("_a") + 1)))
    keys = ["model", "split", "part"]
    blocks = placed.withColumn("part", F.explode(F.array(F.lit("all"), F.concat(F.lit("block_"), F.col("_block").cast("string")))))
    made = evaluate.scores(evaluate.confusion(blocks, keys), keys)
    measures = [c for c, t in made.dtypes if t == "double"]
    long = [made.select("model", "split", F.explode(F.array(*(F.struct(F.concat_ws("_", F.when(F.col("part") != "all", F.col("part")), F.lit(c)).alias("metric"), F.col(c).alias("value")) for c in measures))).alias("m")).select("model", "split", "m.*")]
    each = table.select("model", "split", F.explode(F.array(*(F.struct(F.lit(c).alias("class"), F.col(f"p_{c}").alias("score"), (F.col("y_true") == v).alias("positive")) for v, c in evaluate.CLASSES))).alias("r")).select("model", "split", "r.*")
    ranks = evaluate.ranked(each, F.col("score"), F.col("positive"), ["model", "split", "class"])
    for name, f in (("auc", evaluate.area_under_curve), ("average_precision", evaluate.average_precision)):
        long.append(f(ranks, ["model", "split", "class"]).select("model", "split", F.concat_ws("_", F.lit(name), "class").alias("metric"), F.col(name).alias("value")))
    top, hit = F.greatest("p_short", "p_neutral", "p_long"), (F.col("y_true") == F.col("y_pred")).cast("double")
    square = sum((F.pow(F.col(f"p_{c}") - (F.col("y_true") == v).cast("double"), 2.0) for v, c in evaluate.CLASSES), F.lit(0.0))
    sums = table.groupBy("model", "split").agg(F.avg(square).alias("brier"), *(F.avg((top >= t).cast("double")).alias(f"coverage_{round(t * 100)}") for t in COVERED), *(F.avg(F.when(top >= t, hit)).alias(f"covered_accuracy_{round(t * 100)}") for t in COVERED))
    names = [c for c in sums.columns if c not in ("model", "split")]
    long.append(sums.select("model", "split", F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in names))).alias("m")).select("model", "split", "m.*"))
    return reduce(DataFrame.unionByName, long)

"""Diagnostics of prediction tables (y_true, y_pred, p_short, p_neutral, p_long), all from small counted tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.frames import with_percentiles

CLASSES = ((-1.0, "short"), (0.0, "neutral"), (1.0, "long"))


def top() -> Column:
    """The confidence of a prediction: its largest probability."""
    return F.greatest("p_short", "p_neutral", "p_long")


def confusion(preds: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of (actual, predicted) pairs: a few rows for each key."""
    return preds.groupBy(*keys, "y_true", "y_pred").agg(F.count("*").alias("n"))


def scores(cells: DataFrame, keys: list[str]) -> DataFrame:
    """M07 from confusion counts: accuracy, balanced accuracy over classes that occur, macro F1 over the fixed classes."""
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    sums = [F.sum("n").alias("n_rows"), F.sum(hit).alias("n_hits")]
    for v, c in CLASSES:
        sums += [F.sum(F.when(F.col("y_true") == v, F.col("n")).otherwise(0)).alias(f"t_{c}"), F.sum(F.when(F.col("y_pred") == v, F.col("n")).otherwise(0)).alias(f"p_{c}"), F.sum(F.when(F.col("y_true") == v, hit).otherwise(0)).alias(f"h_{c}")]
    out = cells.groupBy(*keys).agg(*sums) if keys else cells.agg(*sums)
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    recalls = {c: ratio(f"h_{c}", f"t_{c}") for _, c in CLASSES}
    f1 = {c: F.coalesce(2.0 * F.col(f"h_{c}") / F.nullif(F.col(f"t_{c}") + F.col(f"p_{c}"), F.lit(0)), F.lit(0.0)) for _, c in CLASSES}
    present = sum((F.when(F.col(f"t_{c}") > 0, 1).otherwise(0) for _, c in CLASSES), F.lit(0))
    columns = {"accuracy": ratio("n_hits", "n_rows"), "balanced_accuracy": sum(recalls.values(), F.lit(0.0)) / F.nullif(present, F.lit(0)), "macro_f1": sum(f1.values(), F.lit(0.0)) / 3.0}
    columns |= {f"precision_{c}": ratio(f"h_{c}", f"p_{c}") for _, c in CLASSES} | {f"recall_{c}": r for c, r in recalls.items()} | {f"f1_{c}": f for c, f in f1.items()}
    return out.select(*keys, "n_rows", *(c.alias(n) for n, c in columns.items()), *(F.col(f"t_{c}").alias(f"support_{c}") for _, c in CLASSES))


def ranked(preds: DataFrame, score: Column, positive: Column, keys: list[str]) -> DataFrame:
    """One row for each key and distinct score with its positives and negatives, and how many lie below and above.

    Scores are collapsed first, so ties share their place. The running counts need order within a key: scores are
    summed by coarse score ranges, and a range's rows are offset by the ranges before it.
    """
    cells = preds.select(*keys, score.alias("score"), positive.cast("long").alias("pos")).groupBy(*keys, "score").agg(F.sum("pos").alias("pos"), F.sum(1 - F.col("pos")).alias("neg"))
    cells = cells.withColumn("_range", F.floor(F.col("score") * 1024))
    ranges = cells.groupBy(*keys, "_range").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = ranges.select(*keys, "_range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_b{c}") for c in ("_p", "_n")), F.sum("_p").over(whole).alias("n_pos"), F.sum("_n").over(whole).alias("n_neg"))
    inside = Window.partitionBy(*keys, "_range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("_ip", F.coalesce(F.sum("pos").over(inside), F.lit(0))).withColumn("_in", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(offsets, [*keys, "_range"])
    return placed.select(*keys, "score", "pos", "neg", (F.col("_ip") + F.col("_b_p")).alias("pos_below"), (F.col("_in") + F.col("_b_n")).alias("neg_below"), "n_pos", "n_neg")


def area_under_curve(table: DataFrame, keys: list[str]) -> DataFrame:
    """Probability that a positive outranks a negative; ties count half."""
    auc = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)) / (F.max("n_pos") * F.max("n_neg"))
    return table.groupBy(*keys).agg(auc.alias("auc"))


def average_precision(table: DataFrame, keys: list[str]) -> DataFrame:
    """Precision at each distinct score from the top, weighted by the recall it adds."""
    tp = F.col("n_pos") - F.col("pos_below")
    fp = F.col("n_neg") - F.col("neg_below")
    return table.groupBy(*keys).agg(F.sum(F.col("pos") / F.col("n_pos") * tp / (tp + fp)).alias("average_precision"))


def one_vs_rest(preds: DataFrame) -> DataFrame:
    """Rows (class, score, positive) for each class."""
    rows = F.array(*(F.struct(F.lit(c).alias("class"), F.col(f"p_{c}").alias("score"), (F.col("y_true") == v).alias("positive")) for v, c in CLASSES))
    return preds.select(F.explode(rows).alias("r")).select("r.*")


def probabilities(preds: DataFrame) -> DataFrame:
    """Distribution of the largest and of each class's probability, and rows that are no distribution."""
    off = F.abs(F.col("p_short") + F.col("p_neutral") + F.col("p_long") - 1.0) > 1e-4
    rows = F.array(F.struct(F.lit("max").alias("class"), top().alias("p")), *(F.struct(F.lit(c).alias("class"), F.col(f"p_{c}").alias("p")) for _, c in CLASSES))
    long = preds.select(off.alias("off"), F.explode(rows).alias("r")).select("off", "r.*")
    per = long.groupBy("class").agg(F.avg("p").alias("mean_p"), F.stddev_pop("p").alias("std_p"), F.min("p").alias("min_p"), F.max("p").alias("max_p"), F.count_if("off").alias("n_off"))
    return with_percentiles(per, long, ["class"], "p", {"p05": 0.05, "p50": 0.5, "p95": 0.95})


def coverage(preds: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """Scores of the rows whose confidence reaches each threshold; thresholds that no row reaches stay, with 0."""
    levels = F.filter(F.array(*(F.lit(t) for t in thresholds)), lambda t: t <= F.col("_top"))
    covered = preds.withColumn("_top", top()).withColumn("threshold", F.explode(levels))
    spine = preds.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double")
    total = preds.agg(F.count("*").alias("n_all"))
    out = F.broadcast(spine).join(scores(confusion(covered, ["threshold"]), ["threshold"]), "threshold", "left")
    return out.crossJoin(F.broadcast(total)).select("threshold", F.coalesce("n_rows", F.lit(0)).alias("n_covered"), (F.coalesce("n_rows", F.lit(0)) / F.col("n_all")).alias("coverage"), "accuracy", "balanced_accuracy", "macro_f1")  # one row


def buckets(preds: DataFrame, edges: tuple[float, ...]) -> DataFrame:
    """Accuracy by confidence in [low, high); the last bucket is open."""
    kind = F.lit(None).cast("int")
    for i, low in enumerate(edges):
        kind = F.when(top() >= low, i).otherwise(kind)
    hit = (F.col("y_true") == F.col("y_pred")).cast("double")
    return preds.withColumn("bucket", kind).filter("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"), F.avg(top()).alias("mean_confidence"))


def errors(preds: DataFrame) -> DataFrame:
    """Every (actual, predicted) cell, empty ones too, with shares and confidence."""
    values = preds.sparkSession.createDataFrame([(a, b) for a, _ in CLASSES for b, _ in CLASSES], "y_true double, y_pred double")
    marked = preds.withColumn("_c", top())
    cells = marked.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"), F.avg("_c").alias("mean_confidence"), F.min("_c").alias("min_confidence"), F.max("_c").alias("max_confidence"))
    cells = with_percentiles(cells, marked, ["y_true", "y_pred"], "_c", {"median_confidence": 0.5})
    full = F.broadcast(values).join(cells, ["y_true", "y_pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    nine = Window.partitionBy(F.lit(0))
    wrong = F.when(F.col("y_true") != F.col("y_pred"), F.col("n")).otherwise(0)
    return full.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(nine)).withColumn("error_pct", F.when(F.col("y_true") != F.col("y_pred"), F.col("n") * 100.0 / F.nullif(F.sum(wrong).over(nine), F.lit(0))))


def agreement(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Agreement of two models, Cohen's kappa, accuracy where they agree and where they do not."""
    both = a.select(key, "y_true", F.col("y_pred").alias("a")).join(b.select(key, F.col("y_pred").alias("b")), key)
    same, n = F.col("a") == F.col("b"), F.count("*")
    hit = F.when(F.col("y_true") == F.col("a"), 1.0).otherwise(0.0)
    out = both.agg(
        n.alias("n_rows"), (F.count_if(same) / n).alias("agreement"), F.avg(F.when(same, hit)).alias("accuracy_when_agreed"), F.avg(F.when(~same, hit)).alias("a_accuracy_when_not"),
        *((F.count_if(F.col(m) == v) / n).alias(f"{m}_{c}") for m in "ab" for v, c in CLASSES),
    )
    chance = sum((F.col(f"a_{c}") * F.col(f"b_{c}") for _, c in CLASSES), F.lit(0.0))
    return out.withColumn("kappa", (F.col("agreement") - chance) / F.nullif(1.0 - chance, F.lit(0.0))).drop(*(f"{m}_{c}" for m in "ab" for _, c in CLASSES))


def calibration(preds: DataFrame, n_bins: int = 10) -> DataFrame:
    """Observed share and mean probability in uniform bins of each class; a bin's upper edge belongs to it."""
    bins = F.greatest(F.ceil(F.col("score") * n_bins) - 1, F.lit(0)).cast("int")
    return one_vs_rest(preds).groupBy("class", bins.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_p"), F.avg(F.col("positive").cast("double")).alias("observed"))


def brier(preds: DataFrame) -> DataFrame:
    """Squared error of each class's probability, and their sum."""
    parts = {c: F.pow(F.col(f"p_{c}") - (F.col("y_true") == v).cast("double"), 2.0) for v, c in CLASSES}
    return preds.agg(F.avg(sum(parts.values(), F.lit(0.0))).alias("brier"), *(F.avg(p).alias(f"brier_{c}") for c, p in parts.items()))


def reliability(preds: DataFrame, n_bins: int = 10) -> DataFrame:
    """Expected and largest calibration gap of the confidence, log loss, entropy."""
    hit = (F.col("y_true") == F.col("y_pred")).cast("double")
    own = F.when(F.col("y_true") == -1, F.col("p_short")).when(F.col("y_true") == 0, F.col("p_neutral")).otherwise(F.col("p_long"))
    clipped = lambda p: F.greatest(p, F.lit(1e-12))
    entropy = sum((-F.col(f"p_{c}") * F.log(clipped(F.col(f"p_{c}"))) for _, c in CLASSES), F.lit(0.0))
    bins = preds.groupBy((F.ceil(top() * n_bins) - 1).alias("bin")).agg(F.count("*").alias("n"), F.sum(top()).alias("c"), F.sum(hit).alias("h"), F.sum(-F.log(clipped(own))).alias("loss"), F.sum(entropy).alias("entropy"))
    gap = F.abs(F.col("h") - F.col("c"))
    return bins.agg((F.sum(gap) / F.sum("n")).alias("ece"), F.max(gap / F.col("n")).alias("mce"), (F.sum("loss") / F.sum("n")).alias("log_loss"), (F.sum("entropy") / F.sum("n")).alias("mean_entropy"))


def directional(preds: DataFrame, regimes: dict[str, Column]) -> DataFrame:
    """Accuracy where the market moved and the model called a direction, for each of many masks in one pass."""
    named = F.array_compact(F.array(*(F.when(F.coalesce(m, F.lit(False)), F.lit(n)) for n, m in regimes.items())))
    calls = preds.filter("y_true != 0").withColumn("regime", F.explode(named))
    called = F.col("y_pred") != 0
    hit = F.when(called, (F.col("y_true") == F.col("y_pred")).cast("double"))
    side = lambda v: F.avg(F.when(F.col("y_true") == v, hit))
    out = calls.groupBy("regime").agg(F.count("*").alias("n_moved"), F.count_if(called).alias("n_called"), F.avg(hit).alias("accuracy"), ((side(1) + side(-1)) / 2).alias("balanced_accuracy"))
    return out.withColumn("status", F.when(F.col("n_called") == 0, "NO_SAMPLES").when(F.col("balanced_accuracy").isNull(), "SINGLE_CLASS").otherwise("OK"))


def confident_subsets(preds: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """The most confident shares of the rows, ties included; thresholds are percentiles of the confidence."""
    direction = F.abs(F.col("p_long") - F.col("p_short"))
    marked = preds.withColumn("_d", direction)
    bounds = {f"_q{i}": 1.0 - s for i, s in enumerate(shares)}
    cut = with_percentiles(marked.agg(F.count("*").alias("_all")), marked, [], "_d", bounds).select(*bounds)
    rows = marked.crossJoin(F.broadcast(cut)).withColumn("share", F.explode(F.array_compact(F.array(*(F.when(F.col("_d") >= F.col(f"_q{i}"), F.lit(s)) for i, s in enumerate(shares))))))  # one row of thresholds
    hit = (F.col("y_true") == F.col("y_pred")).cast("double")
    return rows.groupBy("share").agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"), F.count_if(F.col("y_pred") > 0).alias("n_long"), F.count_if(F.col("y_pred") < 0).alias("n_short"))


def majority(labels: DataFrame, target: str) -> DataFrame:
    """The most frequent class (the smallest wins a tie) and the class shares."""
    counts = labels.filter(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("n"))
    return counts.agg(F.max_by(target, F.struct("n", -F.col(target))).alias("majority"), F.sum("n").alias("n_rows"), *((F.sum(F.when(F.col(target) == v, F.col("n")).otherwise(0)) / F.sum("n")).alias(f"prior_{c}") for v, c in CLASSES))


def economic(preds: DataFrame, future_return: str, friction: float) -> DataFrame:
    """Prediction times future return, less friction."""
    net = F.when(F.col("y_pred") != 0, F.col("y_pred") * F.col(future_return) * 10_000 - friction)
    out = preds.withColumn("_net", net).groupBy("symbol").agg(F.count("_net").alias("n_trades"), F.avg(F.when(F.col("_net").isNotNull(), (F.col("_net") > 0).cast("double"))).alias("win_rate"), F.avg("_net").alias("mean_net"), F.sum("_net").alias("total_net"))
    return out.withColumn("is_viable", F.coalesce(F.col("mean_net") > 0, F.lit(False)))

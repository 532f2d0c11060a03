"""Leakage-safe splits and walk-forward folds, by position among the usable rows of each symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.frames import with_percentiles, with_row_index

WIDTH = 86_400 * 30


def usable(df: DataFrame, needed: list[str], keys: list[str] = ["symbol"], time: str = "time") -> DataFrame:  # noqa: B006
    """Rows without missing values in `needed`, with usable_idx and the number n_usable of their key."""
    some = with_row_index(df.dropna(subset=needed), keys, time, WIDTH, "usable_idx")
    return some.join(some.groupBy(*keys).agg(F.count("*").alias("n_usable")), keys)


def split(df: DataFrame, train: float = 0.7, validation: float = 0.15, purge: int = 4, embargo: int = 0) -> DataFrame:
    """Labels rows with usable_idx train, validation or test; purged and embargoed rows get NULL.

    Cut points are whole numbers of rows, cut off, from double products.
    """
    i, n = F.col("usable_idx"), F.col("n_usable")
    a = F.floor(n * F.lit(float(train)))
    b = a + F.floor(n * F.lit(float(validation)))
    label = F.when(i < a - purge, "train").when((i >= a + embargo) & (i < b - purge), "validation").when(i >= b + embargo, "test")
    return df.withColumn("split", label)


def time_split(df: DataFrame, first: int, second: int, horizon: int, time: str = "time") -> DataFrame:
    """Split at two instants; the last `horizon` rows of train and validation go, as their labels reach over."""
    part = F.when(F.col(time) < first, "train").when(F.col(time) < second, "validation").otherwise("test")
    marked = with_row_index(df.withColumn("_part", part), ["symbol", "_part"], time, WIDTH, "_i")
    sizes = marked.groupBy("symbol", "_part").agg(F.count("*").alias("_n"))
    near = (F.col("_part") != "test") & (F.col("_i") >= F.col("_n") - horizon)
    return marked.join(sizes, ["symbol", "_part"]).withColumn("split", F.when(~near, F.col("_part"))).drop("_part", "_i", "_n")


def folds(df: DataFrame, initial: int, n_folds: int, purge: int, embargo: int = 0) -> DataFrame:
    """Expanding folds over usable_idx: rows with fold_idx and role (train or validation).

    A fold's validation rows follow its train rows; both lose `purge` rows at their end, and validation starts
    `embargo` rows late. The folds are a short list, so the join on them is a broadcast of that list.
    """
    size = F.floor((F.col("n_usable") - initial) / n_folds)
    spread = df.withColumn("fold_idx", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    start = initial + F.col("fold_idx") * size
    i = F.col("usable_idx")
    role = F.when(i < start - purge, "train").when((i >= start + embargo) & (i < start + size - purge), "validation")
    return spread.withColumn("role", role).filter("role is not null")


def fold_summary(folded: DataFrame, target: str, time: str = "time") -> DataFrame:
    """Rows, bounds and class mix of each fold and role."""
    return folded.groupBy("symbol", "fold_idx", "role").agg(F.count("*").alias("n_rows"), F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.count_if(F.col(target) > 0).alias("n_up"), F.count_if(F.col(target) < 0).alias("n_down"))


def fold_thresholds(folded: DataFrame, value: str) -> DataFrame:
    """The median of a value over each fold's train rows, and each row's side of it."""
    train = folded.filter("role = 'train'")
    medians = with_percentiles(train.select("symbol", "fold_idx").distinct(), train, ["symbol", "fold_idx"], value, {"threshold": 0.5})
    return folded.join(medians, ["symbol", "fold_idx"]).withColumn("is_high", (F.col(value) > F.col("threshold")).cast("int"))


def blocks(df: DataFrame, n_blocks: int = 3) -> DataFrame:
    """Blocks of equal numbers of rows in time order; the last takes the remainder."""
    return df.withColumn("block", F.least(F.floor(F.col("usable_idx") / F.greatest(F.floor(F.col("n_usable") / n_blocks), F.lit(1))), F.lit(n_blocks - 1)).cast("int"))


def checks(splits: DataFrame, needed: list[str], gap: int, time: str = "time") -> DataFrame:
    """Named checks of a split table, one row (symbol, check, passed) each."""
    is_ = lambda s: F.col("split") == s
    bound = lambda f, s, c: f(F.when(is_(s), F.col(c)))
    per = splits.groupBy("symbol").agg(
        *(F.count_if(is_(s)).alias(f"n_{s}") for s in ("train", "validation", "test")),
        *(bound(F.min, s, time).alias(f"from_{s}") for s in ("train", "validation", "test")),
        *(bound(F.max, s, time).alias(f"to_{s}") for s in ("train", "validation", "test")),
        *(bound(F.min, s, "usable_idx").alias(f"first_{s}") for s in ("validation", "test")),
        *(bound(F.max, s, "usable_idx").alias(f"last_{s}") for s in ("train", "validation")),
        F.count_if(F.greatest(*(F.col(c).isNull().cast("int") for c in needed), F.lit(0)) > 0).alias("n_null"),
        (F.count("*") - F.count_distinct(time)).alias("n_repeated"),
    )
    rules = {
        "non_empty": "n_train > 0 and n_validation > 0 and n_test > 0",
        "no_nulls": "n_null = 0",
        "unique_times": "n_repeated = 0",
        "time_order": "to_train < from_validation and to_validation < from_test",
        "train_gap": f"first_validation - last_train > {gap}",
        "validation_gap": f"first_test - last_validation > {gap}",
    }
    rows = F.array(*(F.struct(F.lit(n).alias("check"), F.coalesce(F.expr(r), F.lit(False)).alias("passed")) for n, r in rules.items()))
    return per.select("symbol", F.explode(rows).alias("r")).select("symbol", "r.*")


def fold_masks(df: DataFrame, initial: int, n_folds: int, purge: int, embargo: int = 0) -> DataFrame:
    """The folds of `folds` as columns, a row once: train_of (the folds that train on it) and valid_of (the one that it validates, or null)."""
    size = F.floor((F.col("n_usable") - initial) / n_folds)
    i = F.col("usable_idx")
    fold = F.floor((i - initial) / size)
    start = initial + fold * size
    inside = (i >= initial) & (fold < n_folds) & (i >= start + embargo) & (i < start + size - purge)
    train = F.filter(F.sequence(F.lit(0), F.lit(n_folds - 1)), lambda k: i < initial + k * size - purge)
    return df.withColumn("train_of", train).withColumn("valid_of", F.when(inside, fold).cast("int"))

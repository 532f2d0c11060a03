"""Autocorrelation, tests and resampling."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tickloom.operators.frames import Frame, over_blocks, with_percentiles


def autocorrelation(df: DataFrame, names: list[str], lags: tuple[int, ...]) -> DataFrame:
    """Pearson correlation of each series with itself some rows earlier; all lags and series in one pass."""

    def add(rows: DataFrame, f: Frame) -> DataFrame:
        return rows.withColumn("x", F.array(*(F.struct(F.lit(n).alias("series"), F.lit(k).alias("lag"), F.col(n).alias("value"), f.lag(n, k).alias("before")) for n in names for k in lags)))

    pairs = over_blocks(df.select("symbol", "time", *names), add, max(lags)).select(F.explode("x").alias("x")).select("x.*")
    return pairs.groupBy("series", "lag").agg(F.corr("value", "before").alias("autocorrelation"))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + num * d or 1e-300)
            c = 1.0 + num / c or 1e-300
            h *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return front * h


def t_p_value(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


@F.pandas_udf(DoubleType())
def _t_p(t: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([t_p_value(a, b - 1) if a == a and b > 1 else float("nan") for a, b in zip(t, n, strict=True)])


@F.pandas_udf(DoubleType())
def _sign_p(wins: pd.Series, n: pd.Series) -> pd.Series:
    def p(k: int, n: int) -> float:
        tail = sum(math.comb(n, i) for i in range(max(k, n - k), n + 1)) / 2**n if n <= 1000 else 0.5 * math.erfc((abs(2 * k - n) - 1) / math.sqrt(2 * n))
        return min(1.0, 2 * tail)

    return pd.Series([p(int(a), int(b)) if b > 0 else 1.0 for a, b in zip(wins, n, strict=True)])


@F.pandas_udf(DoubleType())
def _signed_rank_p(w: pd.Series, n: pd.Series) -> pd.Series:
    def p(w: float, n: int) -> float:
        if n > 25:
            mean, sd = n * (n + 1) / 4, math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
            return math.erfc(abs(w - mean) / sd / math.sqrt(2))
        ways = [1] + [0] * (n * (n + 1) // 2)
        for k in range(1, n + 1):
            for s in range(len(ways) - 1, k - 1, -1):
                ways[s] += ways[s - k]
        return min(1.0, 2 * sum(ways[: int(math.floor(w)) + 1]) / 2**n)

    return pd.Series([p(float(a), int(b)) if b > 0 else 1.0 for a, b in zip(w, n, strict=True)])


def one_sample(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Moments, t against zero and its p-value, sign test; all-equal zeros give t 0 and p 1."""
    per = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean_value"), F.stddev_samp(value).alias("std_value"), F.count_if(F.col(value) > 0).alias("n_positive"), F.count_if(F.col(value) != 0).alias("n_moved"))
    t = F.when((F.col("std_value") == 0) & (F.col("mean_value") == 0), 0.0).otherwise(F.col("mean_value") / F.nullif(F.col("std_value") / F.sqrt("n"), F.lit(0.0)))
    return with_percentiles(per, df, keys, value, {"median_value": 0.5}).withColumn("t_statistic", t)


def with_p_values(tested: DataFrame) -> DataFrame:
    return tested.withColumn("p_value", _t_p("t_statistic", "n")).withColumn("sign_p_value", _sign_p("n_positive", "n_moved"))


def paired(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """T01 on the differences of two columns."""
    return one_sample(df.withColumn("_d", F.col(a) - F.col(b)), keys, "_d")


def signed_rank(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Wilcoxon's W, the smaller of the rank sums of positive and negative values; equal sizes share their mean rank."""
    moved = df.filter(F.col(value) != 0).withColumn("_size", F.abs(value))
    sizes = moved.groupBy(*keys, "_size").agg(F.count("*").alias("_ties"), F.count_if(F.col(value) > 0).alias("_up"))
    before = F.coalesce(F.sum("_ties").over(Window.partitionBy(*keys).orderBy("_size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sizes.withColumn("_rank", before + (F.col("_ties") + 1) / 2.0)
    sums = ranked.groupBy(*keys).agg(F.sum("_ties").alias("n"), F.sum(F.col("_rank") * F.col("_up")).alias("w_plus"), F.sum(F.col("_rank") * (F.col("_ties") - F.col("_up"))).alias("w_minus"))
    return sums.withColumn("w_statistic", F.least("w_plus", "w_minus"))


def with_signed_rank_p(ranked: DataFrame) -> DataFrame:
    return ranked.withColumn("p_value", _signed_rank_p("w_statistic", "n"))


#: Ranges of the values that medians of resamples are looked for in.
MEDIAN_RANGES = 256


def _poisson(seed: int, value: float, copies: int, iterations: int) -> np.ndarray:
    """How often the rows that hold a value are drawn in each iteration: Poisson draws with mean 1, added up over `copies` rows."""
    key = np.frombuffer(np.float64(value).tobytes() + np.int64(seed).tobytes(), dtype=np.uint64)
    return np.random.Generator(np.random.Philox(key=key)).poisson(copies, iterations)


def bootstrap(trades: DataFrame, value: str, iterations: int = 10_000, seed: int = 0) -> DataFrame:
    """n_drawn, mean, median and total of seeded resamples, one row an iteration.

    Rows fold to distinct values first. Each value is drawn in all iterations at once, from a generator that its bits
    and the seed key, so that a task that runs again, or meets the value a second time, draws alike. Tasks add up counts
    and sums by ranges of values: a block of iterations x ranges, whatever the rows. The block says in which range each
    iteration's median lies; a second pass walks each range's values in order and reads the medians there. No row
    stands for a trade and an iteration. An iteration that draws nothing has no mean and no median.
    """
    cells = trades.select((F.col(value).cast("double") + F.lit(0.0)).alias("v")).dropna().groupBy("v").agg(F.count("*").alias("m"))
    # few bytes, much work: as many tasks as the session asks for
    n_tasks = int(trades.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = cells.filter(~F.isnan("v")).repartition(n_tasks, "v")
    bounds = cells.agg(F.approx_percentile("v", [k / MEDIAN_RANGES for k in range(1, MEDIAN_RANGES)], 2000).alias("b")).first()["b"]  # a fixed number
    cuts = np.unique(np.array(bounds or [], dtype=np.float64))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(cuts) + 1, iterations), dtype=np.int64)
        sums = np.zeros((len(cuts) + 1, iterations))
        for batch in batches:
            for v, m in zip(batch.column("v").to_pylist(), batch.column("m").to_pylist(), strict=True):
                at, drawn = int(np.searchsorted(cuts, v)), _poisson(seed, v, m, iterations)
                counts[at] += drawn
                sums[at] += drawn * v
        some = np.flatnonzero(counts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([counts[r].tobytes() for r in some], pa.binary()), pa.array([sums[r].tobytes() for r in some], pa.binary())], ["r", "counts", "sums"])

    def merge(table: pa.Table) -> pa.Table:
        counts = sum(np.frombuffer(x, dtype=np.int64) for x in table.column("counts").to_pylist())
        sums = sum(np.frombuffer(x, dtype=np.float64) for x in table.column("sums").to_pylist())
        return pa.table({"r": table.column("r").slice(0, 1), "counts": pa.array([counts.tobytes()], pa.binary()), "sums": pa.array([sums.tobytes()], pa.binary())})

    schema = "r int, counts binary, sums binary"
    blocks = cells.mapInArrow(block, schema).groupBy("r").applyInArrow(merge, schema).orderBy("r").collect()  # MEDIAN_RANGES rows of fixed size
    counts = np.zeros((len(cuts) + 1, iterations), dtype=np.int64)
    total = np.zeros(iterations)
    for row in blocks:
        counts[row["r"]] = np.frombuffer(bytes(row["counts"]), dtype=np.int64)
        total += np.frombuffer(bytes(row["sums"]), dtype=np.float64)
    upto = counts.cumsum(axis=0)
    n = upto[-1]
    # the two middle ranks, from 0: the range of each, and the rows of earlier ranges
    ranks = np.stack([(n - 1) // 2, n // 2])
    where = np.stack([(upto <= r).sum(axis=0) for r in ranks])
    before = np.vstack([np.zeros((1, iterations), dtype=np.int64), upto])[np.minimum(where, len(cuts)), np.arange(iterations)]

    def middle(table: pa.Table) -> pa.Table:
        at = int(np.searchsorted(cuts, table.column("v")[0].as_py()))
        mine = (where == at) & (n > 0)
        seen, found = np.zeros(iterations, dtype=np.int64), {}
        for v, m in sorted(zip(table.column("v").to_pylist(), table.column("m").to_pylist(), strict=True)):
            then = seen + _poisson(seed, v, m, iterations)
            for side in (0, 1):
                rank = ranks[side] - before[side]
                for i in np.flatnonzero(mine[side] & (seen <= rank) & (rank < then)).tolist():
                    found[i, side] = v
            seen = then
        keys = sorted(found)
        return pa.table({"iteration": pa.array([i for i, _ in keys], pa.int32()), "v": pa.array([found[k] for k in keys], pa.float64())})

    placed = cells.withColumn("r", F.size(F.filter(F.array(*(F.lit(float(c)) for c in cuts)).cast("array<double>"), lambda c: c < F.col("v"))))
    middles = placed.repartition(n_tasks, "r").groupBy("r").applyInArrow(middle, "iteration int, v double").groupBy("iteration").agg(F.avg("v").alias("median_value"))
    spark = trades.sparkSession
    sums = spark.createDataFrame(pa.table({"iteration": pa.array(range(iterations), pa.int32()), "n_drawn": n, "total": total}))  # one row an iteration
    mean = F.col("total") / F.nullif(F.col("n_drawn"), F.lit(0))
    return sums.join(middles, "iteration", "left").select("iteration", "n_drawn", mean.alias("mean_value"), "median_value", "total")


def bootstrap_summary(resamples: DataFrame) -> DataFrame:
    at = lambda c: F.percentile(c, F.array(F.lit(0.025), F.lit(0.975)))
    return resamples.agg(F.count("*").alias("n_iterations"), *(at(c)[i].alias(f"{c}_{n}") for c in ("mean_value", "median_value", "total") for i, n in ((0, "low"), (1, "high"))), (F.count_if(F.col("total") > 0) / F.count("*")).alias("p_total_positive"))


def gates(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """One row (gate, passed) for each named rule over a one-row table of metrics."""
    return df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("gate"), F.coalesce(F.expr(r), F.lit(False)).alias("passed")) for n, r in rules.items()))).alias("g")).select("g.*")


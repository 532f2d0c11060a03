"""Row frames with the missing-value rules of rolling statistics, row indexes, halo blocks, and exponential filters.

A rolling statistic is NULL until its frame holds as many non-null values as it asks for.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Frame:
    """Lags and rolling statistics over one series for each key."""

    def __init__(self, *keys: str, order: str = "time") -> None:
        self.keys, self.order = keys or ("symbol",), order
        self.w = Window.partitionBy(*self.keys).orderBy(order)

    def lag(self, c: Column | str, k: int = 1) -> Column:
        return F.lag(c, k).over(self.w)

    def lead(self, c: Column | str, k: int = 1) -> Column:
        return F.lead(c, k).over(self.w)

    def roll(self, agg: Callable[[Column], Column], c: Column | str, n: int, least: int | None = None, shift: int = 0) -> Column:
        """`agg` over the n rows that end `shift` rows back."""
        c = F.col(c) if isinstance(c, str) else c
        w = self.w.rowsBetween(-(n - 1) - shift, -shift)
        return F.when(F.count(c).over(w) >= (least or n), agg(c).over(w))

    def mean(self, c, n: int, least: int | None = None) -> Column:
        return self.roll(F.avg, c, n, least)

    def std(self, c, n: int, least: int | None = None) -> Column:
        return self.roll(F.stddev_samp, c, n, least)

    def max(self, c, n: int, shift: int = 0) -> Column:
        return self.roll(F.max, c, n, shift=shift)

    def min(self, c, n: int, shift: int = 0) -> Column:
        return self.roll(F.min, c, n, shift=shift)

    def median(self, c, n: int, least: int | None = None) -> Column:
        return self.roll(lambda x: F.percentile(x, F.lit(0.5)), c, n, least)

    def corr(self, a: Column, b: Column, n: int) -> Column:
        w = self.w.rowsBetween(-(n - 1), 0)
        both = F.when(a.isNotNull() & b.isNotNull(), 1)
        return F.when(F.count(both).over(w) >= n, F.corr(a, b).over(w))

    def slope(self, y: Column, x: Column, n: int) -> Column:
        w = self.w.rowsBetween(-(n - 1), 0)
        return F.when(F.count(y).over(w) >= n, F.regr_slope(y, x).over(w))


def flag(condition: Column) -> Column:
    """1.0 or 0.0; a comparison with a missing value is false."""
    return F.when(F.coalesce(condition, F.lit(False)), 1.0).otherwise(0.0)


def with_row_index(df: DataFrame, keys: list[str], order: str, width: int, name: str = "bar_idx") -> DataFrame:
    """Adds the place (from 0) of each row in its key's order.

    Rows are numbered inside ranges of `width` of the order column and offset by the counts of earlier ranges, so that a
    long series is not sorted in one task.
    """
    bucket = F.floor(F.col(order) / width)
    marked = df.withColumn("_bucket", bucket)
    counts = marked.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order)
    numbered = marked.withColumn("_place", F.row_number().over(inside) - 1)
    return numbered.join(offsets, [*keys, "_bucket"]).withColumn(name, (F.col("_offset") + F.col("_place")).cast("long")).drop("_bucket", "_offset", "_place")


#: Widths of the ranges in which rows look back: 30 days of bars, a day of ticks, and as many event ids.
BAR_RANGE, TICK_RANGE, ID_RANGE = 86_400 * 30, 86_400_000, 1 << 17


def _range(order: str, width: int) -> Column:
    """Number of the range; rows without a place sort first, as in a window."""
    return F.coalesce(F.floor(F.col(order) / width), F.lit(-(1 << 62))).cast("long")


def with_previous(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str], width: int) -> DataFrame:
    """Adds columns of the row before in the key's order: `columns` maps a new name to the column that is read.

    Rows look back inside ranges of `width` of the first order column; the first row of a range takes the last one of
    the range before, so that a long series is not sorted in one task. The key's first row gets nulls.
    """
    row = F.struct(*(F.col(c).alias(n) for n, c in columns.items()))
    marked = df.withColumn("_range", _range(order[0], width))
    lasts = marked.groupBy(*keys, "_range").agg(F.max_by(row, F.struct(*order)).alias("_last"))
    carry = lasts.select(*keys, "_range", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_range")).alias("_carry"))
    own = F.lag(row).over(Window.partitionBy(*keys, "_range").orderBy(*order))
    joined = marked.withColumn("_own", own).join(carry, [*keys, "_range"])
    return joined.withColumn("_before", F.coalesce("_own", "_carry")).select(*df.columns, *(F.col(f"_before.{n}").alias(n) for n in columns))


def running_sum(df: DataFrame, keys: list[str], order: str, value: str, name: str, width: int) -> DataFrame:
    """Adds the sum of `value` up to each row of the key's order, in ranges that start from the sums of earlier ones; rows of one place share it."""
    marked = df.withColumn("_range", _range(order, width))
    sums = marked.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_range").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("_inside", F.sum(value).over(inside)).join(offsets, [*keys, "_range"]).withColumn(name, F.col("_offset") + F.col("_inside")).drop("_range", "_inside", "_offset")


def in_blocks(df: DataFrame, keys: list[str], apply: Callable[[DataFrame, Frame], DataFrame], lookback: int, lookahead: int, block_rows: int, order: str = "time", index: str = "bar_idx") -> DataFrame:
    """`apply` over blocks of `block_rows` rows, each with the rows that its frames reach into on both sides.

    Exact for frames and lags up to `lookback` and leads up to `lookahead`. `df` has the row index.
    """
    i = F.col(index)
    block, place = F.floor(i / block_rows).cast("long"), i % block_rows
    homes = F.array_compact(F.array(block, F.when(place >= block_rows - lookback, block + 1), F.when((place < lookahead) & (block > 0), block - 1)))
    spread = df.withColumn("_home", block).withColumn("_block", F.explode(homes))
    done = apply(spread, Frame(*keys, "_block", order=order))
    return done.filter(F.col("_home") == F.col("_block")).drop("_home", "_block")


def over_blocks(df: DataFrame, apply: Callable[[DataFrame, Frame], DataFrame], lookback: int, lookahead: int = 0, block_rows: int = 4096, width: int = 86_400 * 30) -> DataFrame:
    """`in_blocks` on bars (symbol, time) that have no row index yet; `apply` adds columns."""
    return in_blocks(with_row_index(df, ["symbol"], "time", width), ["symbol"], apply, lookback, lookahead, block_rows).drop("bar_idx")


def exponential(df: DataFrame, keys: list[str], filters: dict[str, tuple[Column, float, int]], index: str = "bar_idx", rows: int = 128) -> DataFrame:
    """Adds recursive filters y = alpha * x + (1 - alpha) * y_before, the first value being x itself.

    `filters` maps a name to (value, alpha, first row index with a value); later values are not null. Inside a
    sub-block of `rows` rows the filter is a weighted running sum; what earlier sub-blocks carry in is a short sum
    over their last values, as their weights fall below double precision. So no task walks a whole series.
    """
    marked = df.withColumn("_sub", F.floor(F.col(index) / rows).cast("long")).withColumn("_at", (F.col(index) % rows).cast("int"))
    inside = Window.partitionBy(*keys, "_sub").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    parts = {}
    for name, (value, alpha, first) in filters.items():
        q = F.lit(1.0 - alpha)
        weight = F.when(F.col(index) < first, 0.0).when(F.col(index) == first, 1.0).otherwise(alpha)
        parts[f"_{name}"] = F.pow(q, F.col("_at")) * F.sum(weight * F.coalesce(value, F.lit(0.0)) * F.pow(q, -F.col("_at"))).over(inside)
    partial = marked.withColumns(parts)
    ends = partial.groupBy(*keys, "_sub").agg(*(F.max_by(p, "_at").alias(p) for p in parts))
    over = Window.partitionBy(*keys).orderBy("_sub")
    carried = {}
    for name, (_, alpha, _first) in filters.items():
        big = (1.0 - alpha) ** rows
        terms = max(1, math.ceil(-40.0 / math.log(big)))
        carried[f"_in_{name}"] = sum((F.lit(big**k) * F.coalesce(F.lag(f"_{name}", k + 1).over(over), F.lit(0.0)) for k in range(terms)), F.lit(0.0))
    carry = ends.withColumns(carried).select(*keys, "_sub", *carried)
    joined = partial.join(carry, [*keys, "_sub"])
    out = {name: F.when(F.col(index) >= first, F.col(f"_{name}") + F.pow(F.lit(1.0 - alpha), F.col("_at") + 1) * F.col(f"_in_{name}")) for name, (_, alpha, first) in filters.items()}
    return joined.withColumns(out).drop("_sub", "_at", *parts, *carried)


def running(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[Column], Column], value: str, name: str, width: int) -> DataFrame:
    """Adds the sum or maximum (`fold`) of `value` up to each row of the key's order, nulls passed over.

    Rows fold inside ranges of `width` seconds of the first order column, a date or an instant; one row a range carries
    what earlier ranges gave. Null keys are a key, and rows without a place come first.
    """
    place = F.floor(F.col(order[0]).cast("timestamp").cast("long") / width)
    marked = df.withColumn("_range", F.coalesce(place, F.lit(-(1 << 62))).cast("long"))
    ends = marked.groupBy(*keys, "_range").agg(fold(value).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*(F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)), F.col("_range").alias("_at"), fold("_end").over(earlier).alias("_carry"))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)), F.col("_range") == F.col("_at"))
    joined = marked.withColumn("_own", fold(value).over(inside)).join(carried, same)
    both = F.greatest("_own", "_carry") if fold is F.max else F.coalesce(F.col("_carry") + F.col("_own"), "_own", "_carry")
    return joined.withColumn(name, both).drop("_range", "_own", "_at", "_carry", *(f"_key_{i}" for i in range(len(keys))))


#: Names of the percentiles of a distribution.
SEVEN = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
#: Ranges that the values of a key are counted in.
VALUE_RANGES = 256


def with_percentiles(per: DataFrame, df: DataFrame, keys: list[str], value: str, names: dict[str, float]) -> DataFrame:
    """Adds exact percentiles of `value` (interpolated, nulls passed over) to a table of one row for each key.

    Values are counted in ranges of each key, whose bounds come from a sketch of fixed size; only the ranges that hold
    a wanted rank are put in order. So no task holds all values of a key; any bounds give the same result.
    """
    v, key = F.col("_v"), [f"_key_{i}" for i in range(len(keys))]
    pairs = list(zip(keys, key, strict=True))
    cells = df.select(*(F.col(a).alias(b) for a, b in pairs), F.col(value).cast("double").alias("_v")).filter(v.isNotNull()).groupBy(*key, "_v").agg(F.count("*").alias("_c"))
    bounds = cells.groupBy(*key).agg(F.approx_percentile(v, [k / VALUE_RANGES for k in range(1, VALUE_RANGES)], 2000).alias("_bounds"), F.sum("_c").alias("_n"))
    joined = cells.join(bounds.withColumnsRenamed({k: f"{k}b" for k in key}), reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"{k}b")) for k in key), F.lit(True)))
    placed = joined.withColumn("_range", F.size(F.filter("_bounds", lambda b: b < v))).drop("_bounds", *(f"{k}b" for k in key))
    ranges = placed.groupBy(*key, "_range").agg(F.sum("_c").alias("_rows"), F.max("_n").alias("_n"))
    earlier = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    place = {n: F.lit(p) * (F.col("_n") - 1) for n, p in names.items()}
    ends = {f"{n}_{side}": f(c) for n, c in place.items() for side, f in (("low", F.floor), ("high", F.ceil))}
    first = F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
    needed = ranges.withColumn("_first", first).filter(reduce(lambda a, b: a | b, ((r >= F.col("_first")) & (r < F.col("_first") + F.col("_rows")) for r in ends.values())))
    needed = needed.select(*(F.col(k).alias(f"{k}r") for k in key), F.col("_range").alias("_at"), "_first")
    near = placed.join(needed, reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"{k}r")) for k in key), F.col("_range") == F.col("_at")))
    inside = Window.partitionBy(*key, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    upto = near.withColumn("_upto", F.col("_first") + F.sum("_c").over(inside))
    hits = {n: F.max(F.when((r >= F.col("_upto") - F.col("_c")) & (r < F.col("_upto")), v)).alias(n) for n, r in ends.items()}
    found = upto.groupBy(*key).agg(F.max("_n").alias("_n"), *hits.values())
    low, high = (lambda n: F.col(f"{n}_low")), (lambda n: F.col(f"{n}_high"))
    out = found.select(*key, *((low(n) + (high(n) - low(n)) * (c - F.floor(c))).alias(n) for n, c in place.items()))
    kept = reduce(lambda x, y: x & y, (F.col(a).eqNullSafe(F.col(b)) for a, b in pairs), F.lit(True))
    return per.join(out, kept, "left").drop(*key)

"""What the points of a series give inside windows of time, without a row for each pair of a window and a point.

Windows are cut at cells of time. A task reads cells one after another, a cell's points in order before its windows, and
answers windows from trees of extremes over the points. So work grows with points and windows, not with their product,
and a task holds the points of one cell and a buffer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a task gathers before it answers, at least.
BUFFER = 1 << 18

Answer = Callable[[pa.Table, pa.Table, np.ndarray, np.ndarray], dict[str, np.ndarray]]


def in_cells(points: DataFrame, windows: DataFrame, keys: list[str], time: str, start: str, end: str, width: int, ties: list[str], answer: Answer, schema: str) -> DataFrame:
    """Windows cut at cells of `width`, each piece with what `answer` gives for the points with start <= time <= end.

    `answer` gets points (in the order of time and `ties`), pieces, and the places of each piece's first point and of the
    one after its last. Times are whole numbers; windows without keys or times have no pieces. A long window has many
    pieces; choose `width` near the usual length.
    """
    cell = lambda c: F.floor(F.col(c) / width)
    values = [c for c in points.columns if c not in (*keys, time)]
    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in (*keys, start, end)), F.col(start) <= F.col(end))
    pieces = windows.filter(known).withColumn("_cell", F.explode(F.sequence(cell(start), cell(end))))
    first = F.col("_cell") * width
    own = [c for c in windows.columns if c not in keys]
    names = {c: f"_w{i}" for i, c in enumerate(own)}
    asked = pieces.select(*keys, "_cell", F.lit(1).alias("_side"), (F.greatest(F.col(start), first) - first).cast("long").alias("_at"), (F.least(F.col(end), first + width - 1) - first).cast("long").alias("_to"), *(F.col(c).alias(n) for c, n in names.items()))
    given = points.select(*keys, cell(time).alias("_cell"), F.lit(0).alias("_side"), (F.col(time) - cell(time) * width).cast("long").alias("_at"), *(F.col(c).alias(f"_p{i}") for i, c in enumerate(values)))
    given = given.filter(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in (*keys, "_at"))))
    order = [f"_p{values.index(t)}" for t in ties]
    both = given.unionByName(asked, allowMissingColumns=True).repartition(*keys, "_cell").sortWithinPartitions(*keys, "_cell", "_side", "_at", *order)

    def step(table: pa.Table) -> tuple[pa.Table, pa.Table]:
        change = np.zeros(table.num_rows, bool)
        for c in (*keys, "_cell"):
            column = table[c].combine_chunks()
            change[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        group, at, side = np.cumsum(change), table["_at"].to_numpy(), table["_side"].to_numpy()
        is_point = side == 0
        mine, wanted = table.filter(pa.array(is_point)), table.filter(pa.array(~is_point))
        place, base = (group * width + at)[is_point], group[~is_point] * width
        low, high = np.searchsorted(place, base + at[~is_point], "left"), np.searchsorted(place, base + wanted["_to"].to_numpy(), "right")
        seen = pa.table({v: mine[f"_p{i}"] for i, v in enumerate(values)})
        asking = pa.table({**{k: wanted[k] for k in keys}, **{c: wanted[n] for c, n in names.items()}})
        made = answer(seen, asking, low, np.maximum(low, high))
        for name, column in made.items():
            asking = asking.append_column(name, pa.array(column, from_pandas=True))
        return table.filter(pa.array(is_point & (group == group[-1]))), asking

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, new, rows = [], [], 0
        for batch in batches:
            new.append(batch)
            rows += batch.num_rows
            if rows >= max(BUFFER, sum(b.num_rows for b in kept)):
                last, out = step(pa.Table.from_batches(kept + new))
                kept, new, rows = last.to_batches(), [], 0
                yield from out.to_batches()
        if rows:
            yield from step(pa.Table.from_batches(kept + new))[1].to_batches()

    kinds = ", ".join(f"`{c}` {windows.schema[c].dataType.simpleString()}" for c in (*keys, *own))
    return both.mapInArrow(run, f"{kinds}, {schema}")


def tree(values: np.ndarray, fold: np.ufunc, empty: float) -> np.ndarray:
    """Extremes of pairs, of pairs of pairs and so on; the values are the second half, node k's children are 2k and 2k + 1."""
    size = 1 << max(0, int(len(values) - 1).bit_length())
    out = np.full(2 * size, empty)
    out[size : size + len(values)] = values
    while size > 1:
        out[size // 2 : size] = fold(out[size : 2 * size : 2], out[size + 1 : 2 * size : 2])
        size //= 2
    return out


def over(nodes: np.ndarray, low: np.ndarray, high: np.ndarray, fold: np.ufunc, empty: float) -> np.ndarray:
    """The extreme of the values from each `low` to before each `high`."""
    out, left, right = np.full(len(low), empty), low + len(nodes) // 2, high + len(nodes) // 2
    while (left < right).any():
        odd = (left & 1 == 1) & (left < right)
        out[odd] = fold(out[odd], nodes[left[odd]])
        left = left + odd
        odd = (right & 1 == 1) & (left < right)
        right = right - odd
        out[odd] = fold(out[odd], nodes[right[odd]])
        left, right = left >> 1, right >> 1
    return out


def first_outside(most: np.ndarray, least: np.ndarray, low: np.ndarray, above: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Place of the first value from `low` on that is at least `above` or at most `below`; the tree's width where there is none."""
    size = len(most) // 2
    hit = lambda n, q: (most[n] >= above[q]) | (least[n] <= below[q])
    out = np.full(len(low), size)
    open_ = np.flatnonzero(low < size)
    node, found = low[open_] + size, []
    while len(open_):
        node = node // (node & -node)  # up to the widest node that starts here
        yes = hit(node, open_)
        found.append((open_[yes], node[yes]))
        open_, node = open_[~yes], node[~yes] + 1
        more = node & (node - 1) != 0  # a power of two: past the end of its level
        open_, node = open_[more], node[more]
    if found:
        which, node = (np.concatenate(x) for x in zip(*found, strict=True))
        while (deep := node < size).any():
            left = node[deep] * 2
            node[deep] = np.where(hit(left, which[deep]), left, left + 1)
        out[which] = node - size
    return out


def _numbers(column: pa.ChunkedArray, missing: float) -> np.ndarray:
    return np.array(pc.fill_null(column, missing).to_numpy(), "float64")


def summed(points: DataFrame, windows: DataFrame, keys: list[str], time: str, start: str, end: str, width: int, value: str, by: list[str]) -> DataFrame:
    """Number of points, and largest and smallest value, in the windows of each `by` that have points. A NaN is larger than all."""

    def answer(seen, asking, low, high):
        v = seen[value]
        whole = np.concatenate([[0], np.cumsum(pc.is_valid(v).to_numpy())])
        some = whole[high] > whole[low]
        most = over(tree(_numbers(v, -np.inf), np.maximum, -np.inf), low, high, np.maximum, -np.inf)
        smallest = _numbers(v, np.inf)
        real = np.concatenate([[0], np.cumsum(~np.isnan(_numbers(v, np.nan)))])
        least = over(tree(np.where(np.isnan(smallest), np.inf, smallest), np.minimum, np.inf), low, high, np.minimum, np.inf)
        least[real[high] == real[low]] = np.nan
        return {"_n": high - low, "_most": pa.array(most, mask=~some), "_least": pa.array(least, mask=~some)}

    pieces = in_cells(points.select(*keys, time, F.col(value).cast("double").alias(value)), windows, keys, time, start, end, width, [], answer, "_n long, _most double, _least double").filter("_n > 0")
    return pieces.groupBy(*by).agg(F.sum("_n").alias("n_points"), F.max("_most").alias("max_value"), F.min("_least").alias("min_value"))


def end_ticks(ticks: DataFrame, windows: DataFrame, slack: int, width: int) -> DataFrame:
    """Ticks of each window (symbol, window_id) within `slack` of its start and of its end; windows without any are left out."""
    entry = F.struct(F.lit(True).alias("is_entry"), F.col("window_start").alias("a"), F.least("window_end", F.col("window_start") + slack).alias("b"))
    leave = F.struct(F.lit(False).alias("is_entry"), F.greatest("window_start", F.col("window_end") - slack).alias("a"), F.col("window_end").alias("b"))
    parts = windows.select("symbol", "window_id", F.explode(F.array(entry, leave)).alias("_e")).select("symbol", "window_id", "_e.*")
    pieces = in_cells(ticks.select("symbol", "time_msc"), parts, ["symbol"], "time_msc", "a", "b", width, [], lambda seen, asking, low, high: {"_n": high - low}, "_n long").filter("_n > 0")
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0))
    return pieces.groupBy("symbol", "window_id").agg(of(F.col("is_entry")).alias("entry_ticks"), of(~F.col("is_entry")).alias("exit_ticks"))


def first_hits(points: DataFrame, windows: DataFrame, keys: list[str], time: str, start: str, end: str, width: int, ties: list[str], value: str, above: str, below: str) -> DataFrame:
    """Pieces of windows with the first point whose value is at least `above` or at most `below`: hit_time and is_above.

    `is_above` tells whether the point reaches `above`. A piece comes later than another one if its hit_time does.
    """

    def answer(seen, asking, low, high):
        up, down = _numbers(seen[value], -np.inf), _numbers(seen[value], np.inf)
        up[np.isnan(up)] = down[np.isnan(down)] = np.inf
        a, b = _numbers(asking[above], np.nan), _numbers(asking[below], np.nan)
        place = first_outside(tree(up, np.maximum, -np.inf), tree(down, np.minimum, np.inf), low, a, b)
        none = place >= high
        at = np.where(none, 0, place) if len(up) else np.zeros(len(low), "int64")
        times = seen["_time"].to_numpy() if len(up) else np.zeros(1, "int64")
        is_above = (up if len(up) else np.zeros(1))[at] >= a
        return {"hit_time": pa.array(times[at], mask=none), "is_above": pa.array(is_above, mask=none)}

    shown = points.select(*keys, time, *ties, F.col(value).cast("double").alias(value), F.col(time).alias("_time"))
    return in_cells(shown, windows, keys, time, start, end, width, ties, answer, "hit_time long, is_above boolean").filter("hit_time is not null")

"""As-of and range joins.

An as-of join is a union of both sides and a running last value, so that neither side is compared with all of the
other. Time buckets keep a long series from one task: inside a bucket the running value decides, and what earlier
buckets carry in comes from one row for each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.frames import BAR_RANGE, in_blocks, with_row_index

_KEEP = "_row"


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, payload: list[str], bucket: int, tolerance: int | None = None, forward: bool = False, ties: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Each left row with the payload of the last right row at or before its time (or the first at or after it).

    Times are whole numbers. Right rows at the left time count. Among right rows of one time the last by `ties`
    counts (the first, forward). A payload farther than `tolerance` away is NULL; no left row is lost. A right row whose
    payload is NULL still counts, so it resets what is carried.
    """
    sign = -1 if forward else 1
    l_time, r_time = F.col(left_time) * sign, F.col(right_time) * sign
    out_time = f"{prefix}{right_time}" if prefix or right_time not in left.columns else f"matched_{right_time}"
    columns = F.struct(F.col(right_time).alias("_t"), *(F.col(p).alias(p) for p in payload))
    order = [F.col(t) * sign if right.schema[t].dataType.typeName() in ("long", "integer") else F.col(t) for t in ties or []]
    tie = F.struct(*order) if order else F.struct(F.lit(0))
    rights = right.select(*keys, r_time.alias("_time"), F.lit(0).alias("_side"), tie.alias("_tie"), columns.alias("_payload"), F.lit(None).cast(left.select(F.struct("*").alias("x")).schema["x"].dataType).alias(_KEEP))
    lefts = left.select(*keys, l_time.alias("_time"), F.lit(1).alias("_side"), F.lit(None).cast(rights.schema["_tie"].dataType).alias("_tie"), F.lit(None).cast(rights.schema["_payload"].dataType).alias("_payload"), F.struct("*").alias(_KEEP))
    both = rights.unionByName(lefts).withColumn("_bucket", F.floor(F.col("_time") / bucket))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_time", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    marked = both.withColumn("_here", F.last("_payload", ignorenulls=True).over(inside))
    ends = both.groupBy(*keys, "_bucket").agg(F.max_by("_payload", F.when(F.col("_side") == 0, F.struct("_time", "_tie"))).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_before", F.last("_end", ignorenulls=True).over(earlier)).select(*keys, "_bucket", "_before")
    joined = marked.filter("_side = 1").join(carried, [*keys, "_bucket"]).withColumn("_p", F.coalesce("_here", "_before"))
    near = F.lit(True) if tolerance is None else F.abs(F.col("_time") * sign - F.col("_p._t")) <= tolerance
    return joined.select(f"{_KEEP}.*", F.when(near, F.col("_p._t")).alias(out_time), *(F.when(near, F.col(f"_p.{p}")).alias(f"{prefix}{p}") for p in payload))


def asof_slow(left: DataFrame, slow: DataFrame, left_time: str, slow_time: str, payload: list[str], cell: int = BAR_RANGE, ties: list[str] | None = None) -> DataFrame:
    """Each left row with the last row at or before its time of a slow series that all left rows share, whatever their keys.

    A cell of time (few slow rows lie in one) is one row: the slow rows in it, in order, and the last one before it. Left
    rows meet their cell in an equi-join, small enough for a broadcast or split where a cell is crowded, and take the last
    entry that is not later. So left rows are neither sorted nor gathered by time. Of slow rows of one time the last by
    `ties` counts; one with a missing payload resets what is carried. No left row is lost; a null time takes nothing.
    """
    row = F.struct(F.col(slow_time).alias(slow_time), *payload)
    tie = F.struct(*ties) if ties else F.struct(F.lit(0))
    known = slow.filter(F.col(slow_time).isNotNull())
    one = known.groupBy(F.col(slow_time).alias("_t")).agg(F.max_by(row, tie).alias("_row"))
    place = lambda c: F.floor(F.col(c) / cell)
    cells = one.groupBy(place("_t").alias("_cell")).agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    wanted = left.select(place(left_time).alias("_cell")).filter("_cell is not null").distinct()
    every = wanted.join(cells, "_cell", "full")
    before = F.last(F.element_at("_rows", -1), ignorenulls=True).over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))  # a row a cell
    table = every.withColumn("_before", before).select("_cell", "_rows", "_before")
    joined = left.withColumn("_cell", place(left_time)).join(table, "_cell", "left")
    inside = F.filter(F.coalesce("_rows", F.array().cast(table.schema["_rows"].dataType)), lambda r: r[slow_time] <= F.col(left_time))
    found = joined.withColumn("_p", F.when(F.size(inside) > 0, F.element_at(inside, -1)).otherwise(F.col("_before")))
    return found.select(*left.columns, *(F.col(f"_p.{c}").alias(c) for c in (slow_time, *payload)))


def in_windows(points: DataFrame, windows: DataFrame, keys: list[str], time: str, start: str, end: str, bucket: int) -> DataFrame:
    """Points with start <= time <= end of each window: an equi-join on keys and time buckets, then the exact bounds.

    A long window lies in many buckets; choose `bucket` near the usual width.
    """
    grid = windows.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    dealt = points.withColumn("_bucket", F.floor(F.col(time) / bucket))
    return dealt.join(grid, [*keys, "_bucket"]).filter(F.col(time).between(F.col(start), F.col(end))).drop("_bucket")


def exogenous(bars: DataFrame, events: DataFrame, keys: list[str], most_age: int | None, most_bars: int | None, exact: bool, bucket: int) -> DataFrame:
    """Value of the last event usable at a bar's close, with limits on its age in time and in bars.

    `bars` has close_time, `events` has usable_time and value; a missing value resets. `exact` keeps a value only on
    the first bar that can use it.
    """
    # ages are differences of row numbers, so that no window holds all bars after an event
    joined = with_row_index(asof(bars, events, keys, "close_time", "usable_time", ["value"], bucket), keys, "close_time", bucket, "_i")
    first = joined.filter("usable_time is not null").groupBy(*keys, "usable_time").agg(F.min("_i").alias("_first"))
    joined = joined.join(first, [*keys, "usable_time"], "left").withColumn("age_bars", F.col("_i") - F.col("_first"))
    ok = F.col("usable_time").isNotNull()
    if exact:
        ok = ok & (F.col("age_bars") == 0)
    if most_age is not None:
        ok = ok & (F.col("close_time") - F.col("usable_time") <= most_age)
    if most_bars is not None:
        ok = ok & (F.col("age_bars") <= most_bars)
    return joined.withColumn("value", F.when(ok, F.col("value"))).select(*bars.columns, "usable_time", "value", "age_bars")


def first_tick_after(targets: DataFrame, ticks: DataFrame, coverage: DataFrame, tolerance: int, bucket: int) -> DataFrame:
    """The first tick at or after each target within the tolerance, none where the target lies in a data gap.

    `coverage` has symbol, start_msc, end_msc of each run of ticks; a gap begins at a run's end, that instant included,
    and ends before the next run's start.
    """
    w = Window.partitionBy("symbol").orderBy("start_msc")
    gaps = coverage.select("symbol", F.col("end_msc").alias("gap_start"), F.lead("start_msc").over(w).alias("gap_end"))
    found = asof(targets, ticks, ["symbol"], "target_msc", "time_msc", ["bid", "ask"], bucket, tolerance, forward=True, ties=["event_id"])
    placed = asof(found, gaps, ["symbol"], "target_msc", "gap_start", ["gap_end"], bucket)
    inside = F.col("gap_start").isNotNull() & (F.col("gap_end").isNull() | (F.col("target_msc") < F.col("gap_end")))
    blank = lambda c: F.when(~inside, F.col(c)).alias(c)
    return placed.select(*targets.columns, *(blank(c) for c in ("time_msc", "bid", "ask")), inside.alias("in_gap"))


def covered(windows: DataFrame, coverage: DataFrame, slack: int, bucket: int) -> DataFrame:
    """Whether one run of ticks, widened by the slack, holds the whole window (so the window meets no gap)."""
    at = asof(windows, coverage.withColumn("run_start", F.col("start_msc") - slack), ["symbol"], "window_start", "run_start", ["end_msc"], bucket)
    return at.withColumn("is_covered", F.coalesce(F.col("window_end") <= F.col("end_msc") + slack, F.lit(False)))


def coverage_class(trades: DataFrame) -> Column:
    """From entry_ticks, exit_ticks and is_covered."""
    return F.when((F.col("entry_ticks") == 0) & (F.col("exit_ticks") == 0), "NO_TICK_COVERAGE").when(F.col("is_covered"), "FULL").when((F.col("entry_ticks") > 0) & (F.col("exit_ticks") > 0), "GAP_CROSSED").otherwise("PARTIAL")


def reconcile(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer join of two ledgers by signal time and direction, with the first difference of each pair."""
    key = [F.date_trunc("second", "signal_time").alias("signal_time"), "direction", "trade_id"]
    left = a.select(*key, F.col("net_pnl").alias("a_pnl"), F.col("exit_reason").alias("a_reason"))
    right = b.select(*key, F.col("net_pnl").alias("b_pnl"), F.col("exit_reason").alias("b_reason"))
    both = left.join(right, ["signal_time", "direction", "trade_id"], "full_outer")
    kind = (
        F.when(F.col("b_pnl").isNull(), "MISSING_IN_B")
        .when(F.col("a_pnl").isNull(), "MISSING_IN_A")
        .when(F.col("a_reason") != F.col("b_reason"), "EXIT_REASON")
        .when(F.abs(F.col("a_pnl") - F.col("b_pnl")) > 1e-9, "PNL")
        .otherwise("EQUAL")
    )
    return both.withColumn("difference", kind)


def reconcile_positions(internal: DataFrame, external: DataFrame, contract: float, tolerance: float = 1e-3) -> DataFrame:
    """Positions by symbol; external ones are in lots."""
    net = lambda df, q: df.groupBy("symbol").agg(F.sum(F.when(F.col("side") == "BUY", F.col(q)).otherwise(-F.col(q))).alias("net"), F.array_join(F.array_sort(F.collect_set("side")), "+").alias("sides"))
    left = net(internal, "units").select("symbol", F.col("net").alias("internal_units"), F.col("sides").alias("internal_sides"))
    right = net(external, "lots").select("symbol", (F.col("net") * contract).alias("external_units"), F.col("sides").alias("external_sides"))
    both = left.join(right, "symbol", "full_outer")
    status = (
        F.when(F.col("external_units").isNull(), "MISSING_EXTERNAL")
        .when(F.col("internal_units").isNull(), "MISSING_INTERNAL")
        .when(F.col("internal_sides") != F.col("external_sides"), "SIDE_MISMATCH")
        .when(F.abs(F.col("internal_units") - F.col("external_units")) > tolerance, "QUANTITY_MISMATCH")
        .otherwise("MATCHED")
    )
    return both.withColumn("status", status)


def calendar(series: DataFrame, start: str, end: str, names: list[str]) -> DataFrame:
    """Business-day spine, carried values, spread, five-row change, and what each day misses."""
    spine = series.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("d")).filter(F.weekday("d") < 5)
    joined = spine.join(series, "d", "left")
    a, b = (F.col(n) for n in names)
    missing = F.when(a.isNull() & b.isNull(), "BOTH").when(a.isNull(), names[0]).when(b.isNull(), names[1]).otherwise("NONE")
    # a calendar has a few thousand days a decade, so one ordered partition is small whatever the number of series points
    w = Window.partitionBy(F.lit(0)).orderBy("d")
    carried = joined.withColumn("missing", missing).withColumns({f"{n}_filled": F.last(n, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for n in names})
    spread = carried.withColumn("spread", F.col(f"{names[0]}_filled") - F.col(f"{names[1]}_filled"))
    return spread.withColumn("change_5", F.col("spread") - F.lag("spread", 5).over(w))


def barrier_outcomes(bars: DataFrame, take: float, stop: float, most_bars: int) -> DataFrame:
    """For every bar as a LONG signal: enter at the next open, leave at the first bar that touches stop or target.

    The stop wins in a bar that touches both; a bar that opens beyond a level fills at its open; without a touch the last
    bar's close counts. Signals without a whole path are left out.
    """
    path = lambda df, f: df.withColumn("path", F.collect_list(F.struct("open", "high", "low", "close")).over(f.w.rowsBetween(1, most_bars)))
    indexed = with_row_index(bars, ["symbol"], "time", BAR_RANGE)
    staged = in_blocks(indexed, ["symbol"], path, 0, most_bars, max(4096, most_bars)).drop("bar_idx").filter(F.size("path") == most_bars).withColumn("entry", F.element_at("path", 1)["open"])
    staged = staged.withColumn("stop", F.col("entry") * (1 - stop)).withColumn("target", F.col("entry") * (1 + take))
    held = F.transform(
        "path",
        lambda b, i: F.struct(
            (i + 1).cast("int").alias("bars"),
            F.when(b["open"] <= F.col("stop"), F.struct(F.lit("STOP_LOSS").alias("reason"), b["open"].alias("price")))
            .when(b["open"] >= F.col("target"), F.struct(F.lit("TAKE_PROFIT").alias("reason"), b["open"].alias("price")))
            .when(b["low"] <= F.col("stop"), F.struct(F.lit("STOP_LOSS").alias("reason"), F.col("stop").alias("price")))
            .when(b["high"] >= F.col("target"), F.struct(F.lit("TAKE_PROFIT").alias("reason"), F.col("target").alias("price")))
            .alias("hit"),
        ),
    )
    first = F.get(F.filter(held, lambda h: h["hit"].isNotNull()), F.lit(0))
    out = staged.withColumn("first", first)
    return out.select(
        "symbol",
        "time",
        "entry",
        F.coalesce("first.hit.reason", F.lit("MAX_HOLD")).alias("exit_reason"),
        F.coalesce("first.hit.price", F.element_at("path", -1)["close"]).alias("exit_price"),
        F.coalesce("first.bars", F.lit(most_bars)).alias("holding_bars"),
    ).withColumn("gross_return", F.col("exit_price") / F.col("entry") - 1)


def event_study(events: DataFrame, bars: DataFrame, windows: tuple[int, ...], step: int, bucket: int) -> DataFrame:
    """Per event and window (seconds): bar before, bar after, move, and extremes between."""
    before = asof(events, bars, ["symbol"], "event_time", "time", ["close"], bucket, prefix="before_")
    wide = before.withColumn("window", F.explode(F.array(*map(F.lit, windows)))).withColumn("due_time", F.col("event_time") + F.greatest("window", F.lit(step)))
    after = asof(wide, bars, ["symbol"], "due_time", "time", ["close"], bucket, forward=True, prefix="after_")
    usable = after.filter("before_close is not null and after_close is not null").withColumn("until", F.col("after_time"))
    spans = usable.select("symbol", "event_id", "window", "event_time", "until")
    between = in_windows(bars.select("symbol", "time", "high", "low"), spans, ["symbol"], "time", "event_time", "until", bucket)
    extremes = between.groupBy("symbol", "event_id", "window").agg(F.max("high").alias("highest"), F.min("low").alias("lowest"), F.count("*").alias("n_bars"))
    out = usable.join(extremes, ["symbol", "event_id", "window"], "left")
    return out.select("symbol", "event_id", "window", (F.col("after_close") - F.col("before_close")).alias("move"), (F.col("highest") - F.col("before_close")).alias("up_excursion"), (F.col("lowest") - F.col("before_close")).alias("down_excursion"), F.coalesce("n_bars", F.lit(0)).alias("n_bars"))

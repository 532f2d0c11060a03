"""Building blocks: exponential filters, row index, halo blocks, and freedom from look-ahead."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import asof, features, labels, splits, stats
from tickloom.operators.frames import Frame, exponential, running_sum, with_previous, with_row_index
from tickloom.sources import readers
from tickloom.sources.adapters import M15, bars

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def walk(spark):
    rng = random.Random(3)
    rows, price, time = [], 1.1, 1_700_000_000 // M15 * M15
    for i in range(1000):
        opened = price
        price = max(0.5, price + rng.gauss(0, 0.001))
        high, low = max(opened, price) + rng.random() * 1e-3, min(opened, price) - rng.random() * 1e-3
        time += M15 * (1 if rng.random() < 0.97 else rng.randint(2, 300))
        rows.append(("A", time, opened, high, low, price, rng.randint(1, 900), float(rng.randint(1, 40)), 0))
    return spark.createDataFrame(rows, "symbol string, time long, open double, high double, low double, close double, tick_volume long, spread double, real_volume long").cache()


def test_filters_equal_the_recursion(walk):
    for alpha in (2 / 11, 2 / 81, 1 / 14):
        out = exponential(with_row_index(walk, ["symbol"], "time", 86_400), ["symbol"], {"y": (F.col("close"), alpha, 0), "late": (F.col("close"), alpha, 1)}).orderBy("time").collect()
        y = late = None
        for i, r in enumerate(out):
            y = r["close"] if y is None else alpha * r["close"] + (1 - alpha) * y
            assert r["y"] == pytest.approx(y, rel=1e-12)
            if i:
                late = r["close"] if late is None else alpha * r["close"] + (1 - alpha) * late
                assert r["late"] == pytest.approx(late, rel=1e-12)
        assert out[0]["late"] is None


NAMES = ["price", "trend", "momentum", "volatility", "activity", "gaps", "extended", "regime"]


def collected(df):
    return {r["time"]: r for r in df.collect()}


@pytest.mark.parametrize("name", NAMES)
def test_block_size_does_not_matter(walk, name):
    whole, parts = collected(features.build(walk, [name])), collected(features.build(walk, [name], 256))
    assert set(whole) == set(parts)
    for t, r in whole.items():
        for a, b in zip(r, parts[t], strict=True):
            assert a == b or (a is not None and b is not None and a == pytest.approx(b, rel=1e-9, abs=1e-9))


@pytest.mark.parametrize("name", NAMES)
def test_the_future_does_not_matter(walk, name):
    cut = sorted(r["time"] for r in walk.select("time").collect())[700]
    changed = walk.withColumns({c: F.when(F.col("time") > cut, F.col(c) * 1.5).otherwise(F.col(c)) for c in ("open", "high", "low", "close")})
    a, b, c = (collected(features.build(x, [name])) for x in (walk, changed, walk.filter(F.col("time") <= cut)))
    for t in c:
        assert all(x == y == z or (x is not None and x == pytest.approx(y, rel=1e-9, abs=1e-9) == z) for x, y, z in zip(a[t], b[t], c[t], strict=True))


def test_labels_look_ahead(walk):
    rows = labels.label(walk, labels.returns).orderBy("time").collect()
    close = [r["close"] for r in walk.orderBy("time").collect()]
    assert rows[10]["future_return_4"] == pytest.approx(close[14] / close[10] - 1)
    assert all(r["future_return_16"] is None for r in rows[-16:])


def test_split_accounts_for_every_row(walk):
    data = splits.usable(labels.label(walk, labels.returns), ["future_return_4", "future_vol_adj_return_4"])
    out = splits.split(data, 0.7, 0.15, 4, 3).groupBy("split").count().collect()
    counts = {r["split"]: r["count"] for r in out}
    n = sum(counts.values())
    a, b = int(n * 0.7), int(n * 0.15)
    assert counts == {"train": a - 4, "validation": b - 7, "test": n - a - b - 3, None: 14}


def test_run_of_directions(walk):
    out = features.build(walk, ["extended"]).orderBy("time").collect()
    sign = [(r["close"] > r["open"]) - (r["close"] < r["open"]) for r in walk.orderBy("time").collect()]
    run = 0.0
    assert out[0]["consecutive_direction_run"] == 0
    for i in range(1, len(sign)):
        run = 0.0 if sign[i] == 0 else (max(-5.0, min(5.0, run + sign[i])) if sign[i] == sign[i - 1] else sign[i])
        assert out[i]["consecutive_direction_run"] == run


def test_asof_against_a_scan(spark):
    rng = random.Random(5)
    left = [("A" if rng.random() < 0.5 else "B", rng.randint(0, 5000), i) for i in range(300)]
    right = [("A" if rng.random() < 0.5 else "B", rng.randint(0, 5000), i, None if i % 7 == 0 else float(i)) for i in range(80)]
    l, r = spark.createDataFrame(left, "k string, t long, id long"), spark.createDataFrame(right, "k string, u long, n long, v double")
    for forward in (False, True):
        for bucket in (100, 100_000):
            out = {x["id"]: (x["u"], x["v"]) for x in asof.asof(l, r, ["k"], "t", "u", ["v"], bucket, 400, forward, ["n"]).collect()}
            assert len(out) == len(left)
            for k, t, i in left:
                those = [(u, n, v) for kk, u, n, v in right if kk == k and (u >= t if forward else u <= t)]
                best = (min(those, key=lambda x: (x[0], x[1])) if forward else max(those, key=lambda x: (x[0], x[1]))) if those else None
                assert out[i] == ((best[0], best[2]) if best and abs(best[0] - t) <= 400 else (None, None))


def test_flat_prices_have_no_range_volatility(spark):
    flat = spark.createDataFrame([("A", 900, 1.0, 1.0, 1.0, 1.0)], "symbol string, time long, open double, high double, low double, close double")
    row = flat.select(*(c.alias(n) for n, c in features.range_estimators().items())).first()
    assert list(row) == [0.0, 0.0, 0.0]


def test_p_values():
    assert stats.t_p_value(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert stats.t_p_value(0.0, 5) == pytest.approx(1.0)
    assert stats.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-6)


def test_signed_rank(spark):
    values = [1.1, -0.3, 2.5, 0.7, -1.9, 0.7, 3.3, -0.7, 0.0]
    df = spark.createDataFrame([("a", v) for v in values], "k string, v double")
    row = stats.with_signed_rank_p(stats.signed_rank(df, ["k"], "v")).first()
    assert (row["n"], row["w_plus"], row["w_minus"]) == (8, 25.0, 11.0) or row["w_plus"] + row["w_minus"] == 36
    assert 0 < row["p_value"] <= 1


def test_readers(spark, tmp_path):
    (tmp_path / "us.csv").write_text("DATE,DGS2\n2024-01-02,4.33\n2024-01-03,.\n")
    assert [tuple(r)[1] for r in readers.read_series(spark, str(tmp_path / "us.csv")).orderBy("d").collect()] == [4.33, None]
    (tmp_path / "de.csv").write_text("Title;x\nunit;y\n2024-01-02;2,41;k\n2024-01-03;.;\n")
    assert [r["value"] for r in readers.read_semicolon_series(spark, str(tmp_path / "de.csv")).orderBy("d").collect()] == [2.41, None]
    (tmp_path / "cot.csv").write_text(' "Market" , Report Date ,Code,Open_Interest (All)\nEUR,2024-01-02,099741,100\nEUR,2024-01-09,099741,x\nJPY,2024-01-02,097741,5\n')
    rows = readers.read_position_reports(spark, str(tmp_path / "cot.csv"), "code", "099741", {"report_date": "report date", "open_interest": "open interest all"}).collect()
    assert [r["open_interest"] for r in rows] == [100]
    path = str(tmp_path / "bars")
    readers.write_bars(bars(spark, SF), path)
    assert spark.read.parquet(path).count() == bars(spark, SF).count()
    assert readers.manifest(spark, str(tmp_path / "us.csv")).first()["n_bytes"] == (tmp_path / "us.csv").stat().st_size
    with pytest.raises(ValueError):
        readers.read_bars(spark, "x.xlsx")


def test_registry_can_grow(walk):
    features.register(features.FeatureSpec("double_return", lambda f: {"double_return": 2 * (F.col("close") / f.lag("close") - 1)}, 1))
    try:
        assert "double_return" in features.build(walk, ["double_return"]).columns
    finally:
        del features.REGISTRY["double_return"]


def test_frames_wait_for_their_rows(walk):
    out = walk.select("time", Frame("symbol").mean("close", 20).alias("m")).orderBy("time").collect()
    assert all(r["m"] is None for r in out[:19]) and not math.isnan(out[19]["m"])


def test_ranges_give_what_one_window_gives(spark):
    """Rows look back across ranges, empty ranges between them included; sums run on; a null place sorts first."""
    rng = random.Random(11)
    places = sorted(rng.sample(range(400), 60)) + [5000, 5003, 9999]
    rows = [(s, t, None if rng.random() < 0.1 else rng.randint(0, 9)) for s in "AB" for t in places] + [("A", None, 4)]
    df = spark.createDataFrame(rows, "symbol string, time long, x int").withColumn("one", F.lit(1))
    w = Frame("symbol").w
    want = df.withColumns({"before": F.lag("time").over(w), "x_before": F.lag("x").over(w), "total": F.sum("one").over(w)})
    got = running_sum(with_previous(df, ["symbol"], ["time"], {"before": "time", "x_before": "x"}, 7), ["symbol"], "time", "one", "total", 7)
    columns = ["symbol", "time", "x", "before", "x_before", "total"]
    assert sorted(map(repr, got.select(*columns).collect())) == sorted(map(repr, want.select(*columns).collect()))
    empty = with_previous(df.filter("x > 99"), ["symbol"], ["time"], {"before": "time"}, 7)
    assert empty.count() == 0 and empty.columns == [*df.columns, "before"]


def test_labels_do_not_depend_on_blocks(walk):
    for blocks in ([], [labels.swing_targets]):
        whole, parts = collected(labels.label(walk, *blocks, block_rows=None)), collected(labels.label(walk, *blocks, block_rows=64))
        assert set(whole) == set(parts)
        for t, r in whole.items():
            for a, b in zip(r, parts[t], strict=True):
                assert a == b or (a is not None and b is not None and a == pytest.approx(b, rel=1e-9, abs=1e-9))


def test_running_folds_equal_one_window(spark):
    """Sums and maxima across ranges, with null keys, places and values, ties and a range without values."""
    from pyspark.sql import Window

    from tickloom.operators.frames import running

    rng = random.Random(3)
    days = sorted(rng.sample(range(900), 70)) + [None, 4000]
    rows = [(k, d, i, None if rng.random() < 0.2 or (k == "A" and d is not None and d < 60) else rng.randint(-9, 9)) for k in ("A", "B", None) for d in days for i in range(2)]
    df = spark.createDataFrame(rows, "k string, d int, i int, x int").select("k", F.date_add(F.lit("2000-01-01").cast("date"), F.col("d")).alias("day"), "i", "x")
    w = Window.partitionBy("k").orderBy("day", "i").rowsBetween(Window.unboundedPreceding, 0)
    for fold in (F.sum, F.max):
        want = df.withColumn("v", fold("x").over(w)).collect()
        got = running(df, ["k"], ["day", "i"], fold, "x", "v", 30 * 86_400).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert running(df.filter("x > 99"), ["k"], ["day", "i"], F.max, "x", "v", 86_400).count() == 0


def test_percentiles_equal_those_of_one_buffer(spark):
    """Many distinct values, ties, null values, a null key, a key of one row and a key of nulls only."""
    from tickloom.operators.frames import with_percentiles

    rng = random.Random(8)
    rows = [("many", rng.gauss(0, 3)) for _ in range(5000)] + [("ties", float(rng.randint(0, 3))) for _ in range(400)] + [(None, rng.random()) for _ in range(7)] + [("one", 2.5), ("none", None), ("many", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    names = {"low": 0.0, "p05": 0.05, "mid": 0.5, "p99": 0.99, "high": 1.0}
    per = df.groupBy("k").agg(F.count("v").alias("n"), F.percentile("v", F.array(*map(F.lit, names.values()))).alias("want"))
    got = {r["k"]: r for r in with_percentiles(per, df, ["k"], "v", names).collect()}
    assert set(got) == {"many", "ties", None, "one", "none"}
    for k, r in got.items():
        assert [r[n] for n in names] == ([None] * 5 if k == "none" else pytest.approx(r["want"], abs=1e-12))
    assert with_percentiles(df.limit(0).groupBy("k").count(), df.limit(0), ["k"], "v", names).count() == 0
    assert with_percentiles(df.agg(F.count("*").alias("n")), df, [], "v", {"mid": 0.5}).first()["mid"] is not None


def test_slow_series_on_rows_of_all_keys(spark):
    """As-of by cells against a plain loop: rows before the first value, ties, missing payloads, long silences."""
    import random

    from tickloom.operators.asof import asof_slow

    rng = random.Random(2)
    slow = [(rng.randrange(-50, 400), rng.choice([None, 1.0, 2.0, 3.0]), k) for k in range(40)] + [(5000, 9.0, 99), (None, 4.0, 100)]
    left = [(s, rng.choice([rng.randrange(-100, 600), rng.randrange(4000, 9000)])) for s in "abc" for _ in range(60)] + [("a", None)]
    rows = asof_slow(spark.createDataFrame(left, "s string, time long"), spark.createDataFrame(slow, "t long, v double, k long"), "time", "t", ["v"], 30, ["k"]).collect()

    def plain(time):
        known = [x for x in slow if time is not None and x[0] is not None and x[0] <= time]
        return max(known, key=lambda x: (x[0], x[2]))[:2] if known else (None, None)

    assert sorted(((r["s"], r["time"], r["t"], r["v"]) for r in rows), key=repr) == sorted(((s, t, *plain(t)) for s, t in left), key=repr)
    none = asof_slow(spark.createDataFrame(left, "s string, time long"), spark.createDataFrame([], "t long, v double"), "time", "t", ["v"])
    assert none.count() == len(left) and none.filter("t is not null or v is not null").count() == 0

"""Hard negatives against plain loops: ties, near copies, several groups of anchors, odd rows, numbers of any size."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tickloom.llm import hard_negatives, queries

SCHEMA = "vec_id long, embedding array<double>, label int, c int, row string, place int"


def plain(rows, is_anchor, n_positives=5, n_negatives=10):
    kept = {}
    for i, x, y in rows:
        if i is not None and y is not None and x is not None and all(v is not None and math.isfinite(v) for v in x):
            c = [math.floor(v * 256) for v in x]
            kept[i] = min(kept.get(i, (y, c)), (y, c))
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for a, (label, c) in kept.items():
        if not is_anchor(a):
            continue
        others = sorted((-score(c, v), i, y) for i, (y, v) in kept.items() if i != a)
        for s, p, _ in [o for o in others if o[2] == label][:n_positives]:
            inside = [o for o in others if o[2] != label and -30 * s <= -100 * o[0] <= -90 * s][:n_negatives]
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i, _) in enumerate(inside)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, x, y, 1, "x", 2) for i, x, y in rows], SCHEMA)


def sample(seed, n=300, d=6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(5)]
    rows = []
    for i in range(n):
        kind = rng.randrange(4)
        x = [rng.gauss(0, 1) for _ in range(d)] if kind == 0 else [v + rng.gauss(0, 0.02) for v in rng.choice(centres)] if kind == 1 else [rng.choice([-1.0, 0.0, 0.5]) for _ in range(d)]
        rows.append((i * 3 - 100, x, rng.randrange(4)))
    return rows


@pytest.mark.parametrize(("seed", "group"), [(1, 2048), (2, 3)])
def test_equals_plain_loops(spark, monkeypatch, seed, group):
    monkeypatch.setattr(hard_negatives, "GROUP", group)
    rows = sample(seed)
    got = hard_negatives.mine(hard_negatives.rows_of(frame(spark, rows)), F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, got.collect())) == plain(rows, lambda i: i % 5 == 0) != []


def test_bounds_spare_scores(spark):
    """In tight clusters most rows are never scored."""
    import pyarrow as pa

    rng = random.Random(4)
    rows = [(i, [math.floor(900 * (i % 40 == k)) + rng.randrange(3) for k in range(40)], i % 3) for i in range(1200)]
    table = pa.table({"vec_id": [r[0] for r in rows], "label": [r[2] for r in rows], "c": pa.array([[float(v) for v in r[1]] for r in rows], pa.list_(pa.float64())), "group": [0] * len(rows)})
    tree = hard_negatives._tree((0,), table.filter(pa.array([i % 10 == 0 and i % 40 < 20 for i in range(1200)])))
    seen = []
    hard_negatives._sweep(table, tree, lambda k, other, low, high: high >= 500_000, lambda k, ids, other, scores: seen.append((k, dict(zip(ids.tolist(), scores.tolist(), strict=True)))))
    assert sum(len(s) for _, s in seen) < 0.3 * len(table) * len(tree)
    c = {r[0]: r[1] for r in rows}
    best = {}
    for k, s in seen:
        best.setdefault(k, {}).update(s)
    for k, a in enumerate(tree.column("vec_id").to_pylist()):
        assert {i for i in c if sum(x * y for x, y in zip(c[i], c[a], strict=True)) >= 500_000} <= set(best[k])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (0, [0.5, 2.0], 2), (1, [1.0, 2.0], 1), (2, [1.0], 1), (3, [], 1), (4, None, 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [None, 1.0], 1), (8, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (9, [0.7, 0.8], 2), (10, [0.7, 0.8], 2), (11, [0.001, -0.001], 3)]
    rows += [(20, [0.0, 0.0], 5), (21, [0.0, 0.0], 5), (22, [0.0, 0.0], 6)]  # a window of one score
    got = hard_negatives.mine(hard_negatives.rows_of(frame(spark, rows)), F.col("vec_id") % 5 == 0)
    want = plain(rows, lambda i: i % 5 == 0)
    assert sorted(map(tuple, got.collect())) == want and any(r[0] == 20 for r in want)
    large = [(i, [float(1 << (20 + i % 3)), 3.0 * i], i % 2) for i in range(12)]
    got = hard_negatives.mine(hard_negatives.rows_of(frame(spark, large)), F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, got.collect())) == plain(large, lambda i: i % 5 == 0)
    for none in ([], [(1, [1.0], 1)], [(0, [1.0], 1)]):
        assert hard_negatives.mine(hard_negatives.rows_of(frame(spark, none)), F.col("vec_id") % 5 == 0).collect() == []


def test_the_query_equals_plain_loops(spark, sf):
    rows = [(r["vec_id"], list(r["embedding"]), (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op13_hard_negatives(spark, sf).collect())) == plain(rows, lambda i: i % 100 == 0)

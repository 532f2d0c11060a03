"""Forests grown level by level from histograms.

At each level tasks count rows by (tree, node, feature, bin) over Arrow batches (so they shuffle cells, not rows), Spark adds the counts up as a table,
running sums over the bins give each split's gain, and the best split of each node stays. So a level is one scan for
all trees, and what reaches the driver is the model: one row a node. Trees differ by Poisson draws of the rows and by
the features that a node may use, both from seeded hashes, so that a task that runs again counts the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.frames import with_percentiles

#: Trees that grow together: a task holds their counts of one level.
TREES_AT_ONCE = 100
_POISSON = np.cumsum([np.exp(-1.0) / float(np.prod(np.arange(1, k + 1))) for k in range(16)])


@dataclass
class Forest:
    """Nodes are numbered from 1, the children of n are 2n and 2n + 1; rows up to the threshold go to 2n."""

    features: list[str]
    classes: list[float]
    thresholds: list[np.ndarray]
    class_weights: np.ndarray
    splits: list[dict[int, tuple[int, int, float]]] = field(default_factory=list)  # tree -> node -> feature, bin, gain
    counts: list[dict[int, np.ndarray]] = field(default_factory=list)  # tree -> node -> rows of each class

    def table(self, spark: SparkSession) -> DataFrame:
        """One row a node: its rows of each class, and its split if it has one."""
        rows = []
        for t, nodes in enumerate(self.counts):
            for n, c in sorted(nodes.items()):
                f, b, gain = self.splits[t].get(n, (None, None, None))
                rows.append((t, n, None if f is None else self.features[f], None if f is None else float(self.thresholds[f][b]), gain, [int(x) for x in c]))
        return spark.createDataFrame(rows, "tree int, node int, feature string, threshold double, gain double, counts array<bigint>")

    def importances(self, spark: SparkSession) -> DataFrame:
        """Each feature's share of its tree's gains, the mean over trees; rank 1 is the largest."""
        shares = np.zeros(len(self.features))
        for nodes in self.splits:
            own = np.zeros(len(self.features))
            for f, _, gain in nodes.values():
                own[f] += gain
            shares += own / own.sum() if own.sum() else 0.0
        total = shares.sum() or 1.0
        order = sorted(((n, float(v / total)) for n, v in zip(self.features, shares, strict=True)), key=lambda x: (-x[1], x[0]))
        return spark.createDataFrame([(n, v, i + 1) for i, (n, v) in enumerate(order)], "feature string, importance double, rank int")


def _bins(batch: pa.RecordBatch, features: list[str], thresholds: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(t, batch.column(f).to_numpy(zero_copy_only=False), side="left") for f, t in zip(features, thresholds, strict=True)]).astype(np.int32)


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _draws(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Poisson draws with mean 1 of each row, from its key."""
    h = _mixed(_mixed(keys.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (tree + 1) % 2**64)) + np.uint64(seed))
    return np.searchsorted(_POISSON, h / 2.0**64, side="right")


def _walk(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """The node of each row after at most `depth` splits; feature[n] is negative where a node has none."""
    node = np.ones(len(bins), dtype=np.int64)
    for _ in range(depth):
        f = feature[node]
        go = f >= 0
        if not go.any():
            break
        right = bins[np.arange(len(bins)), np.maximum(f, 0)] > cut[node]
        node = np.where(go, 2 * node + right, node)
    return node


def _arrays(splits: dict[int, tuple[int, int, float]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    feature, cut = np.full(2 << depth, -1, dtype=np.int64), np.zeros(2 << depth, dtype=np.int64)
    for n, (f, b, _) in splits.items():
        feature[n], cut[n] = f, b
    return feature, cut


def thresholds_of(table: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Exact percentiles of each feature, equal ones once."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features)))
    long = table.select(pairs.alias("p")).select("p.*")
    per = table.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    names = {f"q{i}": i / bins for i in range(1, bins)}
    found = {r["feature"]: np.unique([r[n] for n in names if r[n] is not None]) for r in with_percentiles(per, long, ["feature"], "value", names).collect()}
    return [found[f] for f in features]


def fit(table: DataFrame, features: list[str], label: str = "label", keys: list[str] | None = None, trees: int = 100, depth: int = 10, least_leaf: int = 20, bins: int = 32, seed: int = 42, balanced: bool = False, draw: bool = True, subset: int | None = None) -> Forest:
    """`trees` trees of at most `depth` levels of splits by Gini gain; leaves hold `least_leaf` drawn rows at least.

    `keys` name a row (all its features otherwise), so that it draws alike wherever it lies. A node may use `subset`
    features (the square root of their number by default, all without `draw`). Of equal gains the first feature, then
    the lowest threshold wins. Rows with a missing value take no part.
    """
    data = table.select(*(F.col(f).cast("double").alias(f) for f in features), F.col(label).cast("double").alias("_label"), F.xxhash64(*(keys or features)).alias("_key")).dropna()
    n_of = {r["_label"]: r["count"] for r in data.groupBy("_label").count().collect()}  # a few classes
    classes, d = sorted(n_of), len(features)
    k = len(classes)
    weights = np.array([sum(n_of.values()) / (k * n_of[c]) for c in classes]) if balanced else np.ones(k)
    model = Forest(list(features), classes, thresholds_of(data, features, bins), weights)
    if not k:
        return model
    subset = d if not draw else subset or max(1, round(d**0.5))
    for first in range(0, trees, TREES_AT_ONCE):
        _grow(model, data, range(first, min(first + TREES_AT_ONCE, trees)), depth, least_leaf, seed, draw, subset)
    return model


def _grow(model: Forest, data: DataFrame, trees: range, depth: int, least_leaf: int, seed: int, draw: bool, subset: int) -> None:
    features, thresholds, classes = model.features, model.thresholds, model.classes
    d, k = len(features), len(classes)
    width = max((len(t) for t in thresholds), default=0) + 1
    model.splits += [{} for _ in trees]
    model.counts += [{} for _ in trees]
    live = {t: [1] for t in trees}
    names = [f"c{j}" for j in range(k)]
    for level in range(depth):
        # places of the level's live nodes, and which features each may use
        slots = {(t, n): i for i, (t, n) in enumerate((t, n) for t, nodes in live.items() for n in nodes)}
        if not slots:
            return
        chosen = np.zeros((len(slots), d), dtype=bool)
        for (t, n), i in slots.items():
            chosen[i, np.random.default_rng([seed, t, n]).permutation(d)[:subset] if subset < d else np.arange(d)] = True
        walks = {t: _arrays(model.splits[t], level) for t in live}
        where = {t: np.full(2 << level, -1, dtype=np.int64) for t in live}
        for (t, n), i in slots.items():
            where[t][n] = i
        owners = np.array(list(slots), dtype=np.int64)

        def count(batches: Iterator[pa.RecordBatch], walks=walks, where=where, chosen=chosen, owners=owners, level=level) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(owners), d, width, k), dtype=np.int64)
            flat = total.reshape(-1)
            for batch in batches:
                b = _bins(batch, features, thresholds)
                y = np.searchsorted(classes, batch.column("_label").to_numpy(zero_copy_only=False))
                keys = batch.column("_key").to_numpy(zero_copy_only=False)
                for t, (feature, cut) in walks.items():
                    slot = where[t][_walk(b, feature, cut, level)]
                    n = _draws(keys, t, seed) if draw else np.ones(len(keys), dtype=np.int64)
                    mine = np.flatnonzero((slot >= 0) & (n > 0))
                    for f in range(d):
                        use = mine[chosen[slot[mine], f]]
                        np.add.at(flat, ((slot[use] * d + f) * width + b[use, f]) * k + y[use], n[use])
            at = np.nonzero(total.any(axis=3))
            cells = total[at]
            columns = [owners[at[0], 0], owners[at[0], 1], at[1], at[2], *(cells[:, j] for j in range(k))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["tree", "node", "feature", "bin", *names])

        counted = data.mapInArrow(count, "tree bigint, node bigint, feature bigint, bin bigint, " + ", ".join(f"{c} bigint" for c in names))
        for r in best_splits(counted.repartition("tree", "node").groupBy("tree", "node", "feature", "bin").agg(*(F.sum(c).alias(c) for c in names)), names, [float(w) for w in model.class_weights], least_leaf).collect():  # the level's nodes
            t, n = r["tree"], r["node"]
            whole = np.array(r["whole"])
            model.counts[t][n] = whole
            live[t].remove(n)
            if r["best"] is not None:
                left = np.array(r["best"]["left"])
                model.splits[t][n] = (r["best"]["feature"], r["best"]["bin"], r["best"]["gain"])
                model.counts[t][2 * n], model.counts[t][2 * n + 1] = left, whole - left
                live[t] += [2 * n, 2 * n + 1]
        # nodes too small for two leaves, or of one class, are leaves; so are those that drew no rows
        live = {t: [n for n in nodes if n >> (level + 1) and model.counts[t][n].sum() >= 2 * least_leaf and np.count_nonzero(model.counts[t][n]) > 1] for t, nodes in live.items()}


def best_splits(cells: DataFrame, names: list[str], weights: list[float], least_leaf: int) -> DataFrame:
    """tree, node, whole (rows of each class) and the best split (gain, feature, bin, left), null without one.

    `cells` counts each class by (tree, node, feature, bin). The gain is the fall of the node's weighted Gini impurity.
    """
    upto = Window.partitionBy("tree", "node", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    over = Window.partitionBy("tree", "node", "feature")
    run = cells.select("tree", "node", "feature", "bin", *(F.sum(c).over(upto).alias(f"l_{c}") for c in names), *(F.sum(c).over(over).alias(f"a_{c}") for c in names))
    total = lambda p: sum((F.col(f"{p}_{c}") for c in names), F.lit(0))
    inside = {"l": lambda c: F.col(f"l_{c}"), "r": lambda c: F.col(f"a_{c}") - F.col(f"l_{c}"), "a": lambda c: F.col(f"a_{c}")}

    def purity(side: str) -> F.Column:
        mine = [inside[side](c) * F.lit(w) for c, w in zip(names, weights, strict=True)]
        weight = sum(mine, F.lit(0.0))
        return sum((m * m for m in mine), F.lit(0.0)) / F.nullif(weight, F.lit(0.0))

    gain = purity("l") + purity("r") - purity("a")
    sound = (total("l") >= least_leaf) & (total("a") - total("l") >= least_leaf) & (gain > 1e-9)
    marked = run.withColumn("gain", F.when(sound, F.round(gain, 9)))  # equal gains are equal numbers
    best = F.max(F.when(F.col("gain").isNotNull(), F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), F.array(*(F.col(f"l_{c}") for c in names)).alias("left"))))
    out = marked.groupBy("tree", "node").agg(best.alias("top"), F.first(F.array(*(F.col(f"a_{c}") for c in names))).alias("whole"))
    made = F.struct(F.col("top.gain").alias("gain"), (-F.col("top.f")).alias("feature"), (-F.col("top.b")).alias("bin"), F.col("top.left").alias("left"))
    return out.select("tree", "node", "whole", F.when(F.col("top").isNotNull(), made).alias("best"))


def predict(model: Forest, df: DataFrame, keep: list[str], label: str = "label") -> DataFrame:
    """`keep`, label, prediction and the array of probabilities: the mean of the leaves' class shares over trees. A row with a missing value has none."""
    features, thresholds, classes = model.features, model.thresholds, model.classes
    leaves = []
    for t, nodes in enumerate(model.counts):
        depth = max((n.bit_length() for n in nodes), default=1)
        shares = np.zeros((2 << depth, len(classes)))
        for n, c in nodes.items():
            w = c * model.class_weights
            shares[n] = w / w.sum() if w.sum() else 1.0 / len(classes)
        leaves.append((*_arrays(model.splits[t], depth), shares, depth))
    kept = df.select(*keep, F.col(label).cast("double").alias("label"), *(F.col(f).cast("double").alias(f"_f_{f}") for f in features))
    schema = T.StructType([*kept.select(*keep, "label").schema.fields, T.StructField("prediction", T.DoubleType()), T.StructField("probability", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(f"_f_{f}").to_numpy(zero_copy_only=False).astype(np.float64) for f in features])
            b = np.column_stack([np.searchsorted(t, x[:, j], side="left") for j, t in enumerate(thresholds)])
            p = sum(shares[_walk(b, feature, cut, depth)] for feature, cut, shares, depth in leaves) / max(len(leaves), 1)
            none = np.isnan(x).any(axis=1)
            called = np.array(classes)[p.argmax(axis=1)]
            arrays = [*(batch.column(c) for c in (*keep, "label")), pa.array(called, mask=none), pa.array([None if n else r for n, r in zip(none, p.tolist(), strict=True)], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "label", "prediction", "probability"])

    return kept.mapInArrow(run, schema)

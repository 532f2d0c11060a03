"""Multinomial logistic models by Newton steps (iterated weighted least squares), each one scan of the table.

A step's loss, gradient and X'WX are sums over rows: tasks add them up over Arrow batches and give one row for each
fold; rows merge in two steps. All folds of a walk-forward are fitted in the same scans, by masks. What a task gives has
(classes * (features + 1))^2 numbers, whatever the rows; only that reaches the driver, which solves for the step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tasks' sums merge in so many groups; these merge on the driver where they have at most so many bytes, else in one more step.
MERGE, DRIVER_BYTES = 32, 16 << 20


@dataclass(frozen=True)
class Logistic:
    """Coefficients on z-scaled features: coef[k][j] for class k; `loss` is that of the last scan, `steps` its number."""

    features: list[str]
    classes: list[float]
    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray
    intercept: np.ndarray
    loss: float
    steps: int

    def probabilities(self) -> Column:
        """An array with the probability of each class, in columns of the table."""
        z = [(F.col(f).cast("double") - float(m)) / float(s) for f, m, s in zip(self.features, self.mean, self.scale, strict=True)]
        scores = [sum((float(w) * x for w, x in zip(row, z, strict=True)), F.lit(float(b))) for row, b in zip(self.coef, self.intercept, strict=True)]
        return softmax(F.array(*scores))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    powers = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, b: a + b)
    return F.transform(powers, lambda p: p / total)


def _summed(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, np.ndarray]]], numbers: int) -> dict[int, np.ndarray]:
    """Sums of the arrays that tasks give for each fold; all folds' arrays together have so many numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(work(batches))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([v.tobytes() for _, v in rows], pa.binary())], ["fold", "sums"])

    def merge(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(v, dtype=np.float64) for v in table.column("sums").to_pylist()], axis=0)
        return pa.table({"fold": table.column("fold").slice(0, 1).cast(pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    parts = df.mapInArrow(run, "fold int, sums binary").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGE)))
    some = parts.groupBy("fold", "part").applyInArrow(merge, "fold int, sums binary")
    if MERGE * numbers * 8 > DRIVER_BYTES:
        some = some.groupBy("fold").applyInArrow(merge, "fold int, sums binary")
    out: dict[int, np.ndarray] = {}
    for r in some.collect():
        out[r["fold"]] = out.get(r["fold"], 0.0) + np.frombuffer(bytes(r["sums"]), dtype=np.float64)
    return out


def _rows(batch: pa.RecordBatch, features: list[str], classes: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False).astype(np.float64) for f in features])
    y = np.searchsorted(classes, batch.column("_label").to_numpy(zero_copy_only=False))
    return x, y, batch.column("_folds").to_numpy(zero_copy_only=False)


def fit_folds(table: DataFrame, features: list[str], label: str = "label", folds: Column | None = None, n_folds: int = 1, c: float = 1.0, balanced: bool = False, steps: int = 50, tolerance: float = 1e-9) -> dict[int, Logistic]:
    """A model for each fold; `folds` is an array with the folds (below 63) that train on a row, None for one fit of all rows.

    Minimises the weighted log loss plus the squared coefficients (not intercepts) over 2 c. Features are z-scaled by
    the fold's train rows (population deviation; a constant one counts as 1). `balanced` weights classes by their
    inverse frequency. Ends when no number moves by more than `tolerance`, or after `steps` scans. Rows with a missing
    label or feature take no part; a class without rows in a fold gets what the penalty and the others leave to it.
    """
    bits = F.lit(1).cast("long") if folds is None else F.aggregate(folds, F.lit(0).cast("long"), lambda a, k: a.bitwiseOR(F.expr("1L") * F.pow(F.lit(2.0), k).cast("long")))
    data = table.select(*(F.col(f).cast("double").alias(f) for f in features), F.col(label).cast("double").alias("_label"), bits.alias("_folds")).filter("_folds != 0").dropna()
    counts = data.groupBy("_label").count().collect()  # a few classes
    classes = sorted(r["_label"] for r in counts)
    d, k = len(features), len(classes)
    if not classes:
        return {}
    start = np.array(data.limit(1).first()[:d], dtype=np.float64)  # sums about a row of the table keep their digits

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        total = {f: np.zeros(k + 2 * d) for f in range(n_folds)}
        for batch in batches:
            x, y, of = _rows(batch, features, classes)
            for f, s in total.items():
                mine = (of >> f) & 1 == 1
                s[:k] += np.bincount(y[mine], minlength=k)
                s[k : k + d] += (x[mine] - start).sum(0)
                s[k + d :] += ((x[mine] - start) ** 2).sum(0)
        yield from total.items()

    state = {}
    for f, s in _summed(data, moments, n_folds * (k + 2 * d)).items():
        n = s[:k].sum()
        if n:
            shift = s[k : k + d] / n
            scale = np.sqrt(np.maximum(s[k + d :] / n - shift**2, 0.0))
            weights = np.where(s[:k] > 0, n / (np.count_nonzero(s[:k]) * np.maximum(s[:k], 1)), 0.0) if balanced else np.ones(k)
            state[f] = (start + shift, np.where(scale > 1e-12 * np.maximum(np.abs(start + shift), 1e-300), scale, 1.0), weights)
    theta = {f: np.zeros((k, d + 1)) for f in state}  # intercept first
    penalty = np.tile(np.concatenate([[0.0], np.full(d, 1.0 / c)]), k)

    def scan(at: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
            size = k * (d + 1)
            total = {f: np.zeros(1 + size + size * size) for f in at}
            for batch in batches:
                x, y, of = _rows(batch, features, classes)
                for f, t in at.items():
                    mine = (of >> f) & 1 == 1
                    mean, scale, weights = state[f]
                    z = np.column_stack([np.ones(int(mine.sum())), (x[mine] - mean) / scale])
                    s = z @ t.T
                    s -= s.max(1, keepdims=True)
                    log_p = s - np.log(np.exp(s).sum(1, keepdims=True))
                    p, w, own = np.exp(log_p), weights[y[mine]], y[mine]
                    hot = np.eye(k)[own]
                    second = np.empty((k, d + 1, k, d + 1))
                    for a in range(k):
                        for b in range(k):
                            second[a, :, b, :] = z.T @ (z * (w * p[:, a] * ((a == b) - p[:, b]))[:, None])
                    total[f] += np.concatenate([[-(w * log_p[np.arange(len(own)), own]).sum()], ((p - hot) * w[:, None]).T.dot(z).ravel(), second.ravel()])
            yield from total.items()

        size = k * (d + 1)
        out = {}
        for f, s in _summed(data, sums, len(at) * (1 + size + size * size)).items():
            v = at[f].ravel()
            out[f] = (s[0] + 0.5 * (penalty * v**2).sum(), s[1 : 1 + size] + penalty * v, s[1 + size :].reshape(size, size) + np.diag(penalty))
        return out

    live, best, step, done = set(state), {}, {}, {}
    trial = dict(theta)
    for number in range(1, steps + 1):
        for f, (loss, gradient, second) in scan({f: trial[f] for f in live}).items():
            if f in best and loss > best[f] + 1e-12 * abs(best[f]):  # too far: half the way
                step[f] = step[f] / 2
            else:
                best[f], theta[f] = loss, trial[f]
                # the intercepts may all move together without any change: the smallest step
                step[f] = -np.linalg.lstsq(second, gradient, rcond=1e-12)[0].reshape(k, d + 1)
            trial[f] = theta[f] + step[f]
            done[f] = number
            if np.abs(step[f]).max() <= tolerance:
                theta[f] = trial[f]
                live.discard(f)
        if not live:
            break
    for f in live:  # the last step of a fixed number of steps
        theta[f] = trial[f]
    return {f: Logistic(list(features), classes, *state[f][:2], theta[f][:, 1:], theta[f][:, 0], float(best[f]), done[f]) for f in state}


def fit(table: DataFrame, features: list[str], **options) -> Logistic:
    """M03 on all rows of a table."""
    return fit_folds(table, features, **options)[0]


def predict(model: Logistic, df: DataFrame, keep: list[str], label: str = "label") -> DataFrame:
    """`keep`, label, prediction and the array of probabilities."""
    return _called(df.withColumn("probability", model.probabilities()), model.classes).select(*keep, F.col(label).cast("double").alias("label"), "prediction", "probability")


def _called(df: DataFrame, classes: list[float]) -> DataFrame:
    """Adds the class of the largest probability, the first of equal ones."""
    names = F.array(*map(F.lit, classes))
    return df.withColumn("prediction", F.get(names, (F.array_position("probability", F.array_max("probability")) - 1).cast("int")))


def predict_folds(models: dict[int, Logistic], df: DataFrame, fold: str, keep: list[str], label: str = "label") -> DataFrame:
    """Each row scored by its fold's model, in one pass; a row without a fold is left out."""
    spark = df.sparkSession
    rows = [(f, [float(x) for x in m.mean], [float(x) for x in m.scale], [[float(x) for x in r] for r in m.coef], [float(x) for x in m.intercept]) for f, m in models.items()]
    table = spark.createDataFrame(rows, f"{fold} int, _mean array<double>, _scale array<double>, _coef array<array<double>>, _intercept array<double>")  # one row a fold
    first = next(iter(models.values()))
    x = F.array(*(F.col(f).cast("double") for f in first.features))
    scaled = df.withColumn(fold, F.col(fold).cast("int")).join(F.broadcast(table), fold).withColumn("_z", F.transform(F.arrays_zip(x.alias("x"), F.col("_mean"), F.col("_scale")), lambda v: (v["x"] - v["_mean"]) / v["_scale"]))
    scores = F.zip_with("_coef", "_intercept", lambda row, b: F.aggregate(F.zip_with(row, "_z", lambda w, v: w * v), b, lambda s, v: s + v))
    return _called(scaled.withColumn("probability", softmax(scores)), first.classes).select(*keep, fold, F.col(label).cast("double").alias("label"), "prediction", "probability")


def save(model: Logistic, spark: SparkSession, folder: str, version: str) -> None:
    """A model under a version: one row for each class and feature (and intercept), with the scaling."""
    rows = [(version, k, cls, j, f, float(m), float(s), float(w)) for k, cls in enumerate(model.classes) for j, (f, m, s, w) in enumerate(zip(["", *model.features], [0.0, *model.mean], [1.0, *model.scale], [model.intercept[k], *model.coef[k]], strict=True))]
    spark.createDataFrame(rows, "version string, k int, class double, j int, feature string, mean double, scale double, weight double").coalesce(1).write.mode("overwrite").parquet(f"{folder}/{version}")


def load(spark: SparkSession, folder: str, version: str) -> Logistic:
    rows = spark.read.parquet(f"{folder}/{version}").orderBy("k", "j").collect()  # as many as the model has numbers
    classes = sorted({r["class"] for r in rows})
    first = [r for r in rows if r["k"] == 0 and r["j"]]
    weights = np.array([r["weight"] for r in rows]).reshape(len(classes), -1)
    return Logistic([r["feature"] for r in first], classes, np.array([r["mean"] for r in first]), np.array([r["scale"] for r in first]), weights[:, 1:], weights[:, 0], float("nan"), 0)


def importances(model: Logistic, spark: SparkSession) -> DataFrame:
    """Mean absolute coefficient of each feature over the classes; rank 1 is the largest."""
    values = np.abs(model.coef).mean(axis=0)
    order = sorted(zip(model.features, map(float, values), strict=True), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame([(n, v, i + 1) for i, (n, v) in enumerate(order)], "feature string, importance double, rank int")

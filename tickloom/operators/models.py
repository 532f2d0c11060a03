"""Model fits: MLlib pipelines beside the Newton fits (linear) and forests (trees), walk-forward evaluation, importances."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators import linear, trees


def _weighted(df: DataFrame, balanced: bool) -> DataFrame:
    """Adds `weight`: 1, or inverse class frequency."""
    if not balanced:
        return df.withColumn("weight", F.lit(1.0))
    counts = df.groupBy("label").agg(F.count("*").alias("_n"))
    both = counts.crossJoin(F.broadcast(counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))))  # a few classes
    return df.join(F.broadcast(both.select("label", (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))), "label")


def logistic(train: DataFrame, features: list[str], c: float = 1.0, balanced: bool = False, iterations: int = 50) -> PipelineModel:
    """Scaled on the train rows only, multinomial, L2 with strength 1 / (C n), at most so many iterations."""
    n = train.count()
    stages = [
        VectorAssembler(inputCols=features, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
        LogisticRegression(family="multinomial", regParam=1.0 / (c * max(n, 1)), weightCol="weight", maxIter=iterations),
    ]
    return Pipeline(stages=stages).fit(_weighted(train, balanced))


def forest(train: DataFrame, features: list[str], trees: int = 100, depth: int = 10, least_leaf: int = 20, seed: int = 42, balanced: bool = False) -> PipelineModel:
    """M04."""
    stages = [VectorAssembler(inputCols=features, outputCol="features"), RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=least_leaf, weightCol="weight", seed=seed)]
    return Pipeline(stages=stages).fit(_weighted(train, balanced))


def predict(model: PipelineModel | linear.Logistic | trees.Forest, df: DataFrame, keep: list[str]) -> DataFrame:
    """One batch transform; probabilities as an array."""
    if isinstance(model, linear.Logistic):
        return linear.predict(model, df, keep)
    if isinstance(model, trees.Forest):
        return trees.predict(model, df, keep)
    return model.transform(df.withColumn("weight", F.lit(1.0))).select(*keep, "label", "prediction", vector_to_array("probability").alias("probability"))


def walk_forward(folded: DataFrame, features: list[str], n_folds: int, fits: dict) -> DataFrame:
    """Out-of-fold predictions of several models: (model, fold_idx, label, prediction). `fits` maps a name to a fit.

    The loop is over a few folds; each fit and each prediction is distributed.
    """
    parts = []
    for k in range(n_folds):
        fold = folded.filter(F.col("fold_idx") == k)
        train, valid = fold.filter("role = 'train'"), fold.filter("role = 'validation'")
        for name, fit in fits.items():
            parts.append(predict(fit(train, features), valid, ["symbol", "time", "fold_idx"]).withColumn("model", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def walk_forward_logistic(masked: DataFrame, subsets: dict[str, list[str]], n_folds: int, **options) -> DataFrame:
    """Out-of-fold predictions (model, fold_idx, label, prediction) of logistic models on named feature sets.

    `masked` has train_of and valid_of (splits.fold_masks): the folds of a set are fitted in the same scans.
    """
    parts = []
    for name, features in subsets.items():
        fits = linear.fit_folds(masked, features, folds=F.col("train_of"), n_folds=n_folds, **options)
        called = linear.predict_folds(fits, masked.filter("valid_of is not null").withColumnRenamed("valid_of", "fold_idx"), "fold_idx", ["symbol", "time"])
        parts.append(called.withColumn("model", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def fold_metrics(oof: DataFrame) -> DataFrame:
    """Accuracy and balanced accuracy of each model and fold, and the fall from the fold before."""
    hit = (F.col("label") == F.col("prediction")).cast("double")
    per_class = oof.groupBy("model", "fold_idx", "label").agg(F.avg(hit).alias("_r"), F.sum(hit).alias("_h"), F.count("*").alias("_n"))
    out = per_class.groupBy("model", "fold_idx").agg((F.sum("_h") / F.sum("_n")).alias("accuracy"), F.avg("_r").alias("balanced_accuracy"), F.sum("_n").alias("n_rows"))
    before = F.lag("balanced_accuracy").over(Window.partitionBy("model").orderBy("fold_idx"))
    return out.withColumn("fall", before - F.col("balanced_accuracy"))


def importances(model: PipelineModel | linear.Logistic | trees.Forest, features: list[str]) -> DataFrame:
    """A row for each feature: forest importance, or mean absolute coefficient; 1 is the largest."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    if isinstance(model, linear.Logistic):
        return linear.importances(model, spark)
    if isinstance(model, trees.Forest):
        return model.importances(spark)
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficientMatrix.toArray()).mean(axis=0)
    order = sorted(zip(features, map(float, values), strict=True), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame([(n, v, i + 1) for i, (n, v) in enumerate(order)], "feature string, importance double, rank int")

"""Classifiers over (sample_id, label, features vector): a stack on MLlib, and what MLlib lacks.

Fitting k models is k jobs, each spread over the cluster; nothing is collected but fitted coefficients.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml import classification as C
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import MinMaxScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Estimators by name. regParam is about 1 / (C n) of other libraries.
STACK: dict[str, Callable[[], Estimator]] = {
    "elastic_net": lambda: C.LogisticRegression(elasticNetParam=0.5, regParam=0.01),
    "naive_bayes": lambda: C.NaiveBayes(modelType="multinomial"),
    "linear_svc": lambda: C.LinearSVC(regParam=0.01),
    "gradient_boosting": lambda: C.GBTClassifier(maxIter=10, seed=42),
    "random_forest": lambda: C.RandomForestClassifier(numTrees=20, seed=42),
    "mlp": lambda: C.MultilayerPerceptronClassifier(seed=42, maxIter=50),
}


def fit(train: DataFrame, name: str, estimator: Estimator | None = None, scale: bool = True) -> Model:
    """Fits a model of the stack, on features scaled to [0, 1] by the training rows (a constant column gives 0.5)."""
    est = estimator or STACK[name]()
    if isinstance(est, C.MultilayerPerceptronClassifier) and not est.isSet("layers"):
        width = len(train.select("features").first().features)
        est.setLayers([width, 10, 2])
    column = "scaled" if scale else "features"
    est.setFeaturesCol(column)
    stages = [MinMaxScaler(inputCol="features", outputCol="scaled")] if scale else []
    return Pipeline(stages=[*stages, est]).fit(train)


def transformed(model: Model, df: DataFrame) -> DataFrame:
    """df with the model's columns. Naive Bayes counts, so it takes a value below the range of the training rows as the lowest of these."""
    if not isinstance(model.stages[-1], C.NaiveBayesModel):
        return model.transform(df)
    for stage in model.stages[:-1]:
        df = stage.transform(df)
    column = model.stages[-1].getFeaturesCol()
    lifted = array_to_vector(F.transform(vector_to_array(column), lambda x: F.greatest(x, F.lit(0.0))))
    return model.stages[-1].transform(df.withColumn(column, lifted))


def predict(model: Model, df: DataFrame) -> DataFrame:
    """Adds y_pred: the probability of class 1; a model without probabilities gives its hard label."""
    out = transformed(model, df)
    p = F.get(vector_to_array("probability"), F.lit(1)) if "probability" in out.columns else F.col("prediction")
    return out.withColumn("y_pred", p).select(*df.columns, "y_pred")


def importances(model: Model, names: list[str]) -> list[tuple[str, float]] | None:
    """Importance of each feature, largest first: coefficients, tree importances, or log odds of naive Bayes; None for other models."""
    last = model.stages[-1]
    if isinstance(last, C.NaiveBayesModel):
        theta = last.theta.toArray()
        values = theta[1] - theta[0]
    elif hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    elif hasattr(last, "coefficients"):
        values = last.coefficients.toArray()
    else:
        return None
    return sorted(zip(names, map(float, values), strict=True), key=lambda x: -x[1])


def search(train: DataFrame, n: int = 10, folds: int = 10, seed: int = 42, low: float = 1e-4, high: float = 1.0) -> Model:
    """Elastic net by random search over log-uniform penalties, scored by the area under the ROC curve in cross-validation."""
    rng, est = random.Random(seed), C.LogisticRegression()
    grid = [ParamGridBuilder().baseOn({est.regParam: math.exp(rng.uniform(math.log(low), math.log(high))), est.elasticNetParam: rng.random()}).build()[0] for _ in range(n)]
    return CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(metricName="areaUnderROC"), numFolds=folds, seed=seed, parallelism=4).fit(train)


def fourier_features(df: DataFrame, gamma: float = 1.0, components: int = 64, seed: int = 42) -> DataFrame:
    """Replaces features by random Fourier features of an RBF kernel: a linear model on them approximates a kernel one."""
    width = len(df.select("features").first().features)
    rng = np.random.Generator(np.random.PCG64(seed))
    w, b = rng.normal(0, math.sqrt(2 * gamma), (width, components)), rng.uniform(0, 2 * math.pi, components)

    @F.pandas_udf("array<double>")
    def lift(x: pd.Series) -> pd.Series:
        return pd.Series(list(math.sqrt(2 / components) * np.cos(np.stack(x) @ w + b)))

    return df.withColumn("features", array_to_vector(lift(vector_to_array("features"))))


def knn(train: DataFrame, test: DataFrame, k: int = 5, vector: str = "embedding", key: str = "id", label: str = "label", block: int = 2000) -> DataFrame:
    """Share of label 1 among the k nearest training rows of each test row (squared distance, ties by id).

    The test set is the smaller side: it goes round in blocks of bounded size, and each training partition keeps only its k
    best for each query before they are merged.
    """
    n = -(-test.count() // block)
    if not n:
        return test.select(key, F.lit(None).cast("double").alias("p1"))
    parts = [_nearest(train, test.where(F.pmod(F.xxhash64(key), F.lit(n)) == i), k, vector, key, label) for i in range(n)]
    return reduce(DataFrame.unionByName, [p for p in parts if p is not None])


def _nearest(train: DataFrame, test: DataFrame, k: int, vector: str, key: str, label: str) -> DataFrame | None:
    """knn of one block of test rows; None if it has none. A task holds the k best of each, and one batch of training rows."""
    queries = test.select(key, vector).collect()
    if not queries:
        return None
    shared = train.sparkSession.sparkContext.broadcast((np.array([r[0] for r in queries]), np.array([r[1] for r in queries], float)))

    def best(found: list[np.ndarray]) -> list[np.ndarray]:
        order = np.lexsort((found[1], found[0]))[:, :k]
        return [np.take_along_axis(x, order, 1) for x in found]

    def nearest(frames):
        ids, q = shared.value
        kept = None
        for f in frames:
            x = np.stack(f[vector].to_numpy()).astype(float)
            d = np.round((q**2).sum(1)[:, None] - 2 * q @ x.T + (x**2).sum(1), 9)
            found = best([d, *(np.broadcast_to(f[c].to_numpy(), d.shape) for c in (key, label))])
            kept = found if kept is None else best([np.concatenate(pair, 1) for pair in zip(kept, found, strict=True)])
        if kept is not None:
            yield pd.DataFrame({"q": ids.repeat(kept[0].shape[1]), **{c: x.ravel() for c, x in zip("dny", kept, strict=True)}})

    kind = dict(train.dtypes)[key]
    near = train.select(key, vector, label).mapInPandas(nearest, f"q {kind}, d double, n {kind}, y double")
    top = near.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy("d", "n"))).where(F.col("r") <= k)
    return top.groupBy(F.col("q").alias(key)).agg(F.avg("y").alias("p1"))

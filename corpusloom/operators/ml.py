"""Class-balanced logistic regression on standardised features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import metrics


class Scaler:
    """Means and population deviations of the training rows; a constant feature is left at 0."""

    def __init__(self, train: DataFrame, features: Sequence[str]):
        one = train.agg(*[f(F.col(c)).alias(f"{k}{i}") for i, c in enumerate(features) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        self.columns = [((F.col(c) - F.lit(one[f"m{i}"] or 0.0)) / F.lit(one[f"s{i}"] or 1.0)).alias(c) for i, c in enumerate(features)]

    def apply(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        return df.select(*keep, *self.columns)


def fit(train: DataFrame, label: str, features: Sequence[str], c: float = 1.0) -> tuple[Scaler, list[float], float]:
    """Scaler, coefficients and intercept of a model whose labels weigh the same in sum; ``c`` is the inverse strength of the L2 penalty."""
    n = {r[0]: r["n"] for r in train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    whole = sum(n.values())
    weight = F.when(F.col(label) == 1, whole / (2 * n.get(1, 1))).otherwise(whole / (2 * n.get(0, 1)))
    scaler = Scaler(train, features)
    rows = scaler.apply(train, [F.col(label).alias("__label"), weight.alias("__weight")])
    assembled = VectorAssembler(inputCols=list(features), outputCol="__features").transform(rows)
    lr = LogisticRegression(featuresCol="__features", labelCol="__label", weightCol="__weight", regParam=1 / (c * whole), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9)
    model = lr.fit(assembled)
    return scaler, [float(x) for x in model.coefficients], float(model.intercept)


def score(model: tuple[Scaler, list[float], float], df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` and ``score``, the probability of class 1, as a plain expression."""
    scaler, weights, intercept = model
    z = F.lit(intercept)
    for w, x in zip(weights, scaler.columns):
        z = z + F.lit(w) * x
    return df.select(*keep, (1 / (1 + F.exp(-z))).alias("score"))


def baseline(df: DataFrame, split: str, label: str, features: Sequence[str]) -> DataFrame:
    """Fit on train, choose the threshold on val, measure val and test."""
    model = fit(df.where(F.col(split) == "train"), label, features)
    scored = score(model, df.where(F.col(split).isin("val", "test")), [split, label]).withColumnRenamed(label, "label")
    t = metrics.best_threshold(metrics.curve(scored.where(F.col(split) == "val"), []), []).first()["threshold"]
    return metrics.summary(scored, [split], t).withColumn("threshold", F.lit(t))


def score_vectors(df: DataFrame, vector: str, scaling: Sequence[tuple[float, float]], weights: Sequence[float], intercept: float) -> DataFrame:
    """``df`` with ``score``, the probability of class 1 from an array column: means and deviations, weights and intercept are a model's own.

    An array that is null or of another length has a null score.
    """
    mean, deviation, w = (F.array(*[F.lit(float(x)) for x in xs]) for xs in ([m for m, _ in scaling], [s or 1.0 for _, s in scaling], weights))
    x = F.zip_with(F.zip_with(F.col(vector).cast("array<double>"), mean, lambda a, m: a - m), deviation, lambda a, s: a / s)
    z = F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(float(intercept)), lambda t, v: t + v)
    return df.withColumn("score", F.when(F.size(vector) == len(weights), 1 / (1 + F.exp(-z))))


def fit_vectors(train: DataFrame, label: str, vector: str, length: int, c: float = 1.0) -> tuple[list[tuple[float, float]], list[float], float]:
    """Scaling, weights and intercept of ``fit`` over the entries of an array column, as ``score_vectors`` takes them."""
    names = [f"x{k}" for k in range(length)]
    rows = train.select(F.col(label).alias("label"), *[F.col(vector)[k].cast("double").alias(n) for k, n in enumerate(names)])
    one = rows.agg(*[f(n).alias(f"{k}_{n}") for n in names for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    _, weights, intercept = fit(rows, "label", names, c)
    return [(one[f"m_{n}"] or 0.0, one[f"s_{n}"] or 1.0) for n in names], weights, intercept

"""Aggregation of runs over seeds and the choice between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def aggregate_seeds(runs: DataFrame, name: str, seed: str, values: Sequence[str]) -> DataFrame:
    """Mean, sample deviation (null for one run), runs and seeds of each ``name``; a seed that comes twice raises."""
    n = F.count(F.lit(1))
    seeds = F.array_join(F.transform(F.array_sort(F.collect_list(seed)), lambda s: s.cast("string")), ",")
    a = runs.groupBy(name).agg(*[f(v).alias(f"{k}_{v}") for v in values for k, f in (("mean", F.avg), ("std", F.stddev_samp))], n.alias("runs"), F.count_distinct(seed).alias("__d"), seeds.alias("seeds"))
    return a.withColumn("runs", F.when(F.col("__d") == F.col("runs"), F.col("runs")).otherwise(F.raise_error(F.lit("a seed comes twice")))).drop("__d")


def choose(means: DataFrame, name: str, by: Sequence[str]) -> DataFrame:
    """The row with the greatest values in order, then the first name; NaN and null come last."""
    order = [F.when(F.isnan(F.col(c)), None).otherwise(F.col(c)).desc_nulls_last() for c in by]
    return means.orderBy(*order, F.col(name)).limit(1)


def macro_and_worst(metrics: DataFrame, keys: Sequence[str], scope: str) -> DataFrame:
    """Means over scopes and the scope of the lowest balanced accuracy (the first name among equals, NaN last)."""
    worst = F.min(F.struct(F.round("balanced_accuracy", 9).alias("b"), F.col(scope).alias("s")))
    return metrics.groupBy(*keys).agg(
        F.avg("balanced_accuracy").alias("macro_balanced_accuracy"), F.avg("roc_auc").alias("macro_roc_auc"), worst.alias("w"), F.min("balanced_accuracy").alias("worst_balanced_accuracy")
    ).select(*keys, "macro_balanced_accuracy", "macro_roc_auc", F.col("w.s").alias("worst_scope"), "worst_balanced_accuracy")


def protocol_complete(runs: DataFrame, name: str, seed: str, required: Sequence[int]) -> DataFrame:
    """``(name, complete)``: whether the seeds of each name are exactly those required."""
    want = F.array(*[F.lit(s) for s in sorted(required)])
    return runs.groupBy(name).agg((F.array_sort(F.collect_set(F.col(seed).cast("int"))) == want).alias("complete"))

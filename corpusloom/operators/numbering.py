"""Names as numbers, so that joins and minima work on longs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.scratch import Scratch


def number(seed: int, name: Column) -> Column:
    """A name's number; null for null."""
    return F.when(name.isNotNull(), F.xxhash64(F.lit(seed), name))


def separating_seed(names: DataFrame) -> int:
    """The first seed under which no two of the names (one column) have the same ``number``."""
    distinct = names.toDF("name").where("name is not null").distinct()
    for seed in range(100):
        if distinct.groupBy(number(seed, F.col("name")).alias("n")).count().where("count > 1").isEmpty():
            return seed
    raise RuntimeError("no seed keeps the names apart")


def numbered(names: DataFrame, scratch: Scratch) -> tuple[int, DataFrame]:
    """A seed that keeps the names apart, and ``(name, number)`` of every different one; nulls have none."""
    distinct = scratch.save(names.toDF("name").where("name is not null").distinct(), "names")
    seed = separating_seed(distinct)
    return seed, distinct.withColumn("number", number(seed, F.col("name")))

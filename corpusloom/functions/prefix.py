"""Running sums without sorting a whole key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, sums: dict[str, str]) -> DataFrame:
    """``df`` with the inclusive running sums ``sums`` (new name: column) a key in ``order``.

    ``bucket`` must not fall along the order.  Sums a (key, bucket) give every
    bucket its start, so a task sorts one bucket of one key, and what is joined
    back is a row a bucket.
    """
    rows = df.withColumn("__b", bucket)
    part = rows.groupBy(*keys, "__b").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    over = Window.partitionBy(*keys).orderBy("__b")
    start = part.select(*keys, "__b", *[(F.sum(f"__{n}").over(over) - F.col(f"__{n}")).alias(f"__{n}") for n in sums])
    inside = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(start, [*keys, "__b"])
    return joined.select(*df.columns, *[(F.col(f"__{n}") + F.sum(c).over(inside)).alias(n) for n, c in sums.items()])


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, name: str = "rank") -> DataFrame:
    """``df`` with the 1-based rank ``name`` a key in ``order``; see ``running``."""
    return running(df.withColumn("__one", F.lit(1)), keys, order, bucket, {name: "__one"}).drop("__one")


def hash_bucket(hex_hash: Column, digits: int = 3) -> Column:
    """The first hexadecimal digits of a hash: a bucket that follows the order of the hashes."""
    return F.substring(hex_hash, 1, digits)

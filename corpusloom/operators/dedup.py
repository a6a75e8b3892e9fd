"""Exact and near duplicates by content and perceptual hashes."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import hamming64


def exact_matches(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str) -> DataFrame:
    """``(left_id, right_id, key)`` of equal keys; no rows where one side lacks the column."""
    if key not in left.columns or key not in right.columns:
        return left.sparkSession.createDataFrame([], f"left_id string, right_id string, {key} string")
    a = left.select(F.col(left_id).alias("left_id"), key).where(F.col(key).isNotNull())
    return a.join(right.select(F.col(right_id).alias("right_id"), key), key)


def exact_classes(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str) -> DataFrame:
    """``(key, left_first, left_records, right_first, right_records)`` of the keys that both sides have: a row stands for all pairs of ``exact_matches`` with that key."""
    side = lambda df, i, name: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(i).alias(f"{name}_first"), F.count_distinct(i).alias(f"{name}_records"))
    return side(left, left_id, "left").join(side(right, right_id, "right"), key)


def piece_plan(distance: int, left: int, right: int, bits: int = 64) -> list[tuple[int, int, int]]:
    """``(shift, width, radius)`` of the pieces of a hash, for sides of ``left`` and ``right`` values.

    Two hashes within ``distance`` agree on one of the pieces up to its radius, since the radii and one each sum to
    more than the distance.  Of the plans with 2 to ``distance + 1`` pieces the one that writes and compares the fewest rows is taken.
    """

    def cost(plan: list[tuple[int, int, int]]) -> float:
        rows = pairs = 0.0
        for _, w, r in plan:
            rows += (left * _spellings(w, r // 2)) + right * _spellings(w, r - r // 2)
            pairs += left * right * _spellings(w, r) / 2.0**w * (1 + r // 2)
        return rows + pairs / 4

    plans = []
    for m in range(2, max(3, distance + 2)):
        widths = [bits // m + (k >= m - bits % m) for k in range(m)]
        spare = max(0, distance + 1 - m)
        radii = [spare // m + (k < spare % m) for k in range(m)]
        # The piece with the larger radius should be the wider one.
        widths.sort(reverse=True)
        shift, plan = 0, []
        for w, r in zip(widths, radii):
            plan.append((shift, w, r))
            shift += w
        plans.append(plan)
    return min(plans, key=cost)


def _spellings(width: int, radius: int) -> int:
    return sum(math.comb(width, k) for k in range(radius + 1))


def _masks(width: int, radius: int) -> list[int]:
    out = [0]
    rim = [0]
    for _ in range(radius):
        rim = sorted({m | 1 << k for m in rim for k in range(width) if not m >> k & 1})
        out += rim
    return out


def near_values(values: DataFrame, distance: int, left: int, right: int) -> DataFrame:
    """``(tv, ev, differing)``: pairs of longs from ``values(x, in_train, in_eval)`` that differ in at most ``distance`` bits, equal ones too.

    The join is a merge by hint: Spark's size estimates count a value once, not
    its dozens of spellings, and would broadcast sides that the driver can't hold.
    """
    plan = piece_plan(distance, max(1, left), max(1, right))

    def spelled(k: int, shift: int, width: int, radius: int) -> Column:
        piece = F.shiftrightunsigned("x", shift).bitwiseAND((1 << width) - 1).bitwiseOR(k << 56)
        return F.transform(F.array(*[F.lit(m).cast("long") for m in _masks(width, radius)]), piece.bitwiseXOR)

    def side(flag: str, name: str, radius: Callable[[int], int]) -> DataFrame:
        pieces = [spelled(k, shift, width, radius(r)) for k, (shift, width, r) in enumerate(plan)]
        return values.where(flag).select(F.col("x").alias(name), F.explode(F.concat(*pieces)).alias("piece"))

    train = side("in_train", "tv", lambda r: r // 2)
    other = side("in_eval", "ev", lambda r: r - r // 2)
    near = train.join(other.hint("merge"), "piece").withColumn("differing", hamming64(F.col("tv"), F.col("ev"))).where(F.col("differing") <= distance)
    return near.select("tv", "ev", "differing").distinct()


def near_links(df: DataFrame, record_id: str, group: str, value: str, distance: int = 4) -> DataFrame:
    """``(left_id, right_id, differing)`` of records of different groups whose 64-bit values (longs) differ in at most ``distance`` bits.

    ``left_id < right_id``.  Distinct values are compared, not records: values
    that agree on a piece meet once, and only near values meet their records,
    so copies cost nothing before the result.  Null values and ids match nothing.

    Only an id of several rows can give a pair twice, so the pairs of all other
    ids leave the last join as they are.  Rows are joined by a merge by hint,
    too: estimates from compressed files are a fraction of their size in memory.
    """
    rows = df.select(F.col(record_id).alias("id"), F.col(group).alias("g"), F.col(value).alias("x")).where("x is not null")
    values = rows.select("x").distinct()
    n = values.count()
    both = values.select("x", F.lit(True).alias("in_train"), F.lit(True).alias("in_eval"))
    near = near_values(both, distance, n, n).where("tv <= ev")
    records = rows.where("id is not null").distinct().withColumn("one", F.count(F.lit(1)).over(Window.partitionBy("id")) == 1)
    single, several = records.where("one").drop("one"), records.where("not one").drop("one")

    def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
        met = near.join(left.toDF("ia", "ga", "tv").hint("merge"), "tv").join(right.toDF("ib", "gb", "ev").hint("merge"), "ev")
        # Equal values meet both ways round.
        met = met.where("ia != ib and not (ga <=> gb) and (tv < ev or ia < ib)")
        return met.select(F.least("ia", "ib").alias("left_id"), F.greatest("ia", "ib").alias("right_id"), "differing")

    repeated = pairs(single, several).union(pairs(several, single)).union(pairs(several, several))
    return pairs(single, single).union(repeated.distinct())


def near_classes(df: DataFrame, record_id: str, group: str, value: str, distance: int = 4) -> tuple[DataFrame, DataFrame]:
    """``near_links`` without its pairs of copies: the near pairs of classes, and every record's class.

    A class holds the records of one group and value and is named by the least
    of them.  ``links(left_class, right_class, differing, pairs)`` has a row for
    two classes of different groups within ``distance``, with the number of
    pairs of records behind it; ``members(id, class, records)`` a row a record.
    """
    rows = df.select(F.col(record_id).alias("id"), F.col(group).alias("g"), F.col(value).alias("x")).where("x is not null").distinct()
    classes = rows.groupBy("g", "x").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("records"))
    values = classes.select("x").distinct()
    n = values.count()
    near = near_values(values.select("x", F.lit(True).alias("in_train"), F.lit(True).alias("in_eval")), distance, n, n).where("tv <= ev")
    left, right = classes.toDF("ga", "tv", "ca", "na"), classes.toDF("gb", "ev", "cb", "nb")
    pairs = near.join(left, "tv").join(right, "ev").where("not (ga <=> gb)").select(F.least("ca", "cb").alias("left_class"), F.greatest("ca", "cb").alias("right_class"), "differing", (F.col("na") * F.col("nb")).alias("pairs"))
    members = rows.join(classes, (rows["x"] == classes["x"]) & rows["g"].eqNullSafe(classes["g"])).select("id", "class", "records")
    return pairs.distinct(), members

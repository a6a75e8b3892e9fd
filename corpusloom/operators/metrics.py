"""Evaluation of binary scores: confusion, calibration, curves, thresholds, ranking, scopes.

Every function takes predictions with the columns ``label`` (0 or 1) and
``score`` and gives a row for each combination of ``keys``.  Curves work on the
counts of distinct scores; running sums go by score bucket, so no task sorts
all scores of a key.  Buckets are the finer the nearer a score is to 0 or 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.prefix import running

def ratio(a: Column, b: Column) -> Column:
    """``a / b``, NaN where ``b`` is 0."""
    return F.when(b != 0, a / b).otherwise(float("nan"))


def score_bucket(score: Column, bits: int = 9) -> Column:
    """A bucket that falls as the score (0 to 1) rises: from either end, 2 to the ``bits`` buckets for each halving of the distance down to 2 to the -60."""
    near = F.least(score, 1 - score)
    half = F.least(F.floor(-F.log2(F.greatest(near, F.lit(2.0**-60)))), F.lit(60))
    # 0 at the end, rising to the middle: the halving, then the place within it.
    at = (60 - half) * (1 << bits) + F.least(F.floor((near * F.pow(F.lit(2.0), half + 1) - 1) * (1 << bits)), F.lit((1 << bits) - 1))
    return F.when(score <= 0.5, -at).otherwise(at - (1 << 40)).cast("long")


def ranged(df: DataFrame, column: str, cuts: Sequence[float], name: str) -> DataFrame:
    """``df`` with the number of its range between ascending ``cuts``; a cut belongs to the range above it."""
    if not cuts:
        return df.withColumn(name, F.lit(0))
    edges = [-float("inf"), *map(float, cuts), float("inf")]
    return Bucketizer(splits=edges, inputCol=column, outputCol=name).transform(df).withColumn(name, F.col(name).cast("int"))


def confusion(df: DataFrame, keys: Sequence[str], threshold: float | Column) -> DataFrame:
    """Counts at a threshold (predicted 1 from it upwards) and what follows from them; NaN where a class is absent."""
    hit = F.col("score") >= threshold
    one = F.col("label") == 1
    a = df.groupBy(*keys).agg(
        F.count_if(one & hit).alias("tp"), F.count_if(~one & hit).alias("fp"), F.count_if(one & ~hit).alias("fn"), F.count_if(~one & ~hit).alias("tn"),
        F.avg(F.pow(F.col("score") - F.col("label"), 2)).alias("brier"),
    )
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    f1 = lambda t, x, y: ratio(2 * t, 2 * t + x + y)
    return a.withColumns(
        {
            "accuracy": ratio(tp + tn, tp + fp + fn + tn),
            "recall1": ratio(tp, tp + fn),
            "recall0": ratio(tn, tn + fp),
            "balanced_accuracy": (ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2,
            "precision": F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0),
            "macro_f1": (f1(tp, fp, fn) + f1(tn, fn, fp)) / 2,
        }
    )


def calibration_error(df: DataFrame, keys: Sequence[str], bins: int = 15) -> DataFrame:
    """Expected calibration error over equal bins, ``[lo, hi)`` but the last, which holds 1 too."""
    s = F.col("score")
    guess = F.floor(s * bins)
    k = F.least(F.when(s < guess / bins, guess - 1).when(s >= (guess + 1) / bins, guess + 1).otherwise(guess), F.lit(bins - 1))
    per = df.groupBy(*keys, k.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("y"), F.avg("score").alias("p"))
    return per.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("y") - F.col("p"))) / F.sum("n")).alias("ece"))


def curve(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, score, p, n, tp, fp, positives, negatives)``: a row a distinct score with the counts at it and from it upwards."""
    per = df.groupBy(*keys, "score").agg(F.sum(F.col("label").cast("long")).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    run = running(per, keys, [F.col("score").desc()], score_bucket(F.col("score")), {"tp": "p", "fp": "n"})
    sums = per.groupBy(*keys).agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"))
    return run.join(sums, list(keys)) if keys else run.crossJoin(F.broadcast(sums))  # one row


def roc_auc(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area under the ROC curve, ties half; NaN for one class."""
    won = F.sum(F.col("p") * (F.col("negatives") - F.col("fp") + F.col("n") / 2))
    return points.groupBy(*keys).agg(ratio(won, F.first("positives") * F.first("negatives")).alias("roc_auc"))


def average_precision(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area under the precision-recall curve as a step sum; NaN without positives."""
    return points.groupBy(*keys).agg(ratio(F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.first("positives")).alias("pr_auc"))


def fpr_at_tpr(points: DataFrame, keys: Sequence[str], tpr: float = 0.95) -> DataFrame:
    """False positive rate at the first corner of the ROC curve whose true positive rate reaches ``tpr``; points on a straight stretch are no corners."""
    rows = points.withColumn("__b", score_bucket(F.col("score")))
    step = F.struct("p", "n")
    inside = Window.partitionBy(*keys, "__b").orderBy(F.col("score").desc())
    heads = rows.groupBy(*keys, "__b").agg(F.max_by(step, "score").alias("head"))
    after = heads.select(*keys, "__b", F.lead("head").over(Window.partitionBy(*keys).orderBy("__b")).alias("next_head"))
    nxt = rows.withColumn("next", F.lead(step).over(inside)).join(after, [*keys, "__b"]).withColumn("next", F.coalesce("next", "next_head"))
    corner = nxt.where((F.col("next").isNull() | (F.col("next.p") != F.col("p")) | (F.col("next.n") != F.col("n"))) & (F.col("tp") >= tpr * F.col("positives")))
    return corner.groupBy(*keys).agg(ratio(F.min("fp"), F.first("negatives")).alias("fpr_at_tpr"))


def best_threshold(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The least of 0, 1 and the scores with the greatest balanced accuracy, and that accuracy."""
    at = points.select(*keys, F.col("score").alias("t"), F.round((F.col("tp") / F.col("positives") + 1 - F.col("fp") / F.col("negatives")) / 2, 12).alias("b"))
    ends = points.groupBy(*keys).agg(F.first("positives").alias("pos")).select(*keys, F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t"), F.lit(0.5).alias("b"))
    whole = at.unionByName(ends).groupBy(*keys, "t").agg(F.max("b").alias("b"))
    return whole.groupBy(*keys).agg(F.max(F.struct("b", (-F.col("t")).alias("m"))).alias("x")).select(*keys, (-F.col("x.m")).alias("threshold"), F.col("x.b").alias("balanced_accuracy"))


def log_loss(df: DataFrame, keys: Sequence[str], eps: float = 1e-7) -> DataFrame:
    p = F.greatest(F.least(F.col("score"), F.lit(1 - eps)), F.lit(eps))
    return df.groupBy(*keys).agg(F.avg(-(F.col("label") * F.log(p) + (1 - F.col("label")) * F.log(1 - p))).alias("log_loss"))


def group_ranking(df: DataFrame, keys: Sequence[str], group: str) -> DataFrame:
    """How often a group's positive outscores its negative, ties half: the mean of the groups' rates, the rate over all pairs, pairs and groups.

    Pairs are counted from running sums, never formed.  Groups without both labels, and null groups, count for nothing.
    """
    c = curve(df.where(F.col(group).isNotNull()), [*keys, group])
    won = F.sum(F.col("p") * (F.col("negatives") - F.col("fp") + F.col("n") / 2))
    per = c.groupBy(*keys, group).agg(won.alias("won"), (F.first("positives") * F.first("negatives")).alias("pairs")).where("pairs > 0")
    return per.groupBy(*keys).agg(F.avg(F.col("won") / F.col("pairs")).alias("macro_rate"), (F.sum("won") / F.sum("pairs")).alias("micro_rate"), F.sum("pairs").alias("pairs"), F.count(F.lit(1)).alias("groups"))


def label_weights(df: DataFrame) -> DataFrame:
    """``(label, weight)``: one over the rows of a label."""
    return df.groupBy("label").agg((1 / F.count(F.lit(1))).alias("weight"))


def scopes(df: DataFrame, generator: str, names: Sequence[str], whole: str = "all") -> DataFrame:
    """``df`` with ``scope``: every row in ``all``, a positive in its generator's scope, a negative in each generator's."""
    own = F.when(F.col("label") == 1, F.array(F.lit(whole), F.concat(F.lit("real_vs_"), generator))).otherwise(F.array(F.lit(whole), *[F.lit(f"real_vs_{n}") for n in names]))
    return df.withColumn("scope", F.explode(own))


def sibling_slices(df: DataFrame, generator: str, group: str) -> DataFrame:
    """``df`` with ``slice``: a positive in its generator's, a negative in those of the generators that its group holds."""
    fakes = df.where("label = 1")
    held = fakes.select(F.col(group), F.col(generator).alias("slice")).distinct()
    reals = df.where("label = 0").join(held, group)
    return fakes.withColumn("slice", F.col(generator)).unionByName(reals)


def summary(df: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """The metrics of each key: the confusion counts' own, both areas and the counts of both labels."""
    points = curve(df, keys)
    base = confusion(df, keys, threshold).select(*keys, (F.col("tn") + F.col("fp")).alias("n_real"), (F.col("tp") + F.col("fn")).alias("n_ai"), "balanced_accuracy", "macro_f1")
    return base.join(roc_auc(points, keys), list(keys)).join(average_precision(points, keys), list(keys))

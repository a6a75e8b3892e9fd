"""Bootstrap intervals over resampled clusters, without writing a row a replicate.

A cluster's weight in a replicate is a Poisson draw of mean 1 from a hash of
(cluster, replicate).  The draws need no order of the clusters, no shuffle and
no state, and come out alike on every run and partitioning.

Predictions are spread over ranges of scores.  A task draws the weights of its
clusters for all replicates as one matrix and reduces its range to a few sums a
replicate; running sums over the ranges, a matrix of at most ``RANGES`` rows a
key, give every replicate's metrics.  Where a replicate's curve reaches a
true positive rate is looked up in the one range that holds the point.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import hex64
from corpusloom.operators import metrics
from corpusloom.scratch import Scratch

#: Cumulative Poisson probabilities of mean 1: a draw is the number of them that a uniform number reaches.
POISSON = tuple(math.fsum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(18))
#: Increment and multipliers of the mixer splitmix64.
STEP, MIX = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Ranges of scores a key, and cells of a weight matrix that a task holds at once.
RANGES, CELLS = 512, 1 << 22
#: The metrics that the reference study draws intervals of.
SURVEYED = ("roc_auc", "balanced_accuracy", "macro_f1", "fpr_at_tpr_95")


def cluster_number(c: Column) -> Column:
    """The first 64 bits of the SHA-256 of a cluster's name; a null cluster raises, as its rows belong together with nothing."""
    name = F.when(c.isNull(), F.raise_error(F.lit("a row has no cluster"))).otherwise(c.cast("string"))
    return hex64(F.substring(F.sha2(name, 256), 1, 16))


def weights(clusters: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """The draws of clusters (their numbers as unsigned longs) in replicates, a row a cluster."""
    different, at = np.unique(clusters, return_inverse=True)
    with np.errstate(over="ignore"):
        z = different[:, None] + (replicates.astype(np.uint64)[None, :] + np.uint64(1)) * np.uint64(STEP)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX[0])
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX[1])
        z ^= z >> np.uint64(31)
    return np.searchsorted(POISSON, (z >> np.uint64(11)) / float(1 << 53), side="right").astype(np.int64)[at]


def _steps(table: pa.Table, replicates: np.ndarray):
    """Positives and negatives of each score of a range, the highest score first, as matrices of bounded size; with the scores."""
    score = table["score"].to_numpy()
    order = np.argsort(-score, kind="stable")
    score, label = score[order], table["label"].to_numpy()[order]
    cluster = table["cluster"].to_numpy().view(np.uint64)[order]
    heads = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
    most = max(1, CELLS // max(1, len(replicates)))
    k = 0
    while k < len(heads):
        stop = k + 1
        while stop < len(heads) and (heads[stop + 1] if stop + 1 < len(heads) else len(score)) - heads[k] <= most:
            stop += 1
        lo, hi = heads[k], heads[stop] if stop < len(heads) else len(score)
        w = weights(cluster[lo:hi], replicates)
        cut = heads[k:stop] - lo
        yield score[heads[k:stop]], np.add.reduceat(w * label[lo:hi, None], cut, 0), np.add.reduceat(w * (1 - label[lo:hi, None]), cut, 0)
        k = stop


def _sums(threshold: float, repeats: int, keys: Sequence[str]):
    """A range's row: positives, negatives, positives times the negatives above them in the range (ties half), and both labels' rows from the threshold up."""

    def each(table: pa.Table) -> pa.Table:
        p, n, lost, tp, fp = (np.zeros(repeats) for _ in range(5))
        for score, ps, ns in _steps(table, np.arange(repeats)):
            lost += (ps * (n + np.cumsum(ns, 0) - ns / 2)).sum(0)
            hit = score >= threshold
            tp, fp = tp + ps[hit].sum(0), fp + ns[hit].sum(0)
            p, n = p + ps.sum(0), n + ns.sum(0)
        of = lambda x: pa.array([x], pa.list_(pa.float64()))
        return pa.table({**{k: table[k].slice(0, 1) for k in (*keys, "range")}, "p": of(p), "n": of(n), "lost": of(lost), "tp": of(tp), "fp": of(fp)})

    return each


def _whole(repeats: int, tpr: float, keys: Sequence[str]):
    """The metrics of every replicate of a key from its ranges' rows, and for the false positive rate the range in which ``tpr`` is reached."""

    def each(table: pa.Table) -> pa.Table:
        table = table.sort_by([("range", "descending")])
        m = {c: np.stack(table[c].to_pylist()) for c in ("p", "n", "lost", "tp", "fp")}
        pos, neg, tp, fp = (m[c].sum(0) for c in ("p", "n", "tp", "fp"))
        above_p, above_n = np.cumsum(m["p"], 0) - m["p"], np.cumsum(m["n"], 0) - m["n"]
        with np.errstate(divide="ignore", invalid="ignore"):
            auc = (m["p"] * (neg - above_n) - m["lost"]).sum(0) / (pos * neg)
            accuracy = (tp / pos + (neg - fp) / neg) / 2
            f1 = (2 * tp / (pos + tp + fp) + 2 * (neg - fp) / (neg + (neg - fp) + (pos - tp))) / 2
        reached = above_p + m["p"] >= tpr * pos
        at = reached.argmax(0)
        every = np.arange(repeats)
        rows = {k: pa.array(table[k].to_pylist()[:1] * repeats, table[k].type) for k in keys}
        rows |= {"replicate": pa.array(every, pa.int32()), "range": pa.array(np.array(table["range"].to_pylist())[at], pa.int32())}
        return pa.table(rows | {"roc_auc": auc, "balanced_accuracy": accuracy, "macro_f1": f1, "above_p": above_p[at, every], "above_n": above_n[at, every], "pos": pos, "neg": neg})

    return each


def _reached(tpr: float, keys: Sequence[str]):
    """The false positive rate of the replicates whose point lies in a range."""

    def each(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        replicates, pos = wanted["replicate"].to_numpy(), wanted["pos"].to_numpy()
        p, n, out = wanted["above_p"].to_numpy(), wanted["above_n"].to_numpy(), np.full(len(replicates), np.nan)
        if len(replicates) and rows.num_rows:
            for _, ps, ns in _steps(rows, replicates):
                tp, fp = p + np.cumsum(ps, 0), n + np.cumsum(ns, 0)
                there = tp >= tpr * pos
                found = there.any(0) & np.isnan(out)
                out[found] = fp[there.argmax(0), np.arange(len(replicates))][found]
                p, n = tp[-1], fp[-1]
        neg = wanted["neg"].to_numpy()
        with np.errstate(divide="ignore", invalid="ignore"):
            fpr = np.where((pos > 0) & (neg > 0), out / neg, np.nan)
        return pa.table({**{k: wanted[k] for k in keys}, "replicate": wanted["replicate"], "fpr": fpr})

    return each


def replicate_values(df: DataFrame, keys: Sequence[str], cluster: str, threshold: float, scratch: Scratch, repeats: int = 2000, tpr: float = 0.95) -> DataFrame:
    """``(keys, metric, replicate, value)`` of the surveyed metrics; a draw that lacks a class has no value.

    The false positive rate is that of the first point of the replicate's curve
    that reaches ``tpr``.  Scores lie in 0 to 1; rows without a score or label count for nothing.
    """
    rows = df.where("score is not null and label in (0, 1)").select(*keys, cluster_number(F.col(cluster)).alias("cluster"), F.col("score").cast("double").alias("score"), F.col("label").cast("int").alias("label"))
    # Ranges of about as many rows each, from the scores' quantiles over all keys.
    cuts = sorted({c for c in (rows.agg(F.percentile_approx("score", [k / RANGES for k in range(1, RANGES)], 10_000)).first()[0] or [])})
    spread = scratch.save(metrics.ranged(rows, "score", cuts, "range"), "ranged")
    at = spread.schema
    kinds = "".join(f"`{k}` {at[k].dataType.simpleString()}, " for k in keys)
    sums = scratch.save(spread.groupBy(*keys, "range").applyInArrow(_sums(threshold, repeats, keys), kinds + "range int, p array<double>, n array<double>, lost array<double>, tp array<double>, fp array<double>"), "sums")
    whole_schema = kinds + "replicate int, range int, roc_auc double, balanced_accuracy double, macro_f1 double, above_p double, above_n double, pos double, neg double"
    per = scratch.save(sums.groupBy(*keys).applyInArrow(_whole(repeats, tpr, keys), whole_schema), "whole")
    per_range = [*keys, "range"]
    points = spread.groupBy(*per_range).cogroup(per.groupBy(*per_range)).applyInArrow(_reached(tpr, keys), kinds + "replicate int, fpr double")
    three = per.where("pos > 0 and neg > 0").select(*keys, "replicate", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in SURVEYED[:3]])).alias("x")).select(*keys, "x.metric", "replicate", "x.value")
    fpr = points.select(*keys, F.lit(SURVEYED[3]).alias("metric"), "replicate", F.col("fpr").alias("value"))
    return three.unionByName(fpr).withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def interval(values: DataFrame, keys: Sequence[str], level: float = 0.95) -> DataFrame:
    """``(keys, lower, upper, repeats)``: percentiles of the values that are not null."""
    a = (1 - level) / 2
    return values.where("value is not null").groupBy(*keys).agg(F.percentile("value", F.lit(a)).alias("lower"), F.percentile("value", F.lit(1 - a)).alias("upper"), F.count(F.lit(1)).alias("repeats"))


def estimates(df: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """``(keys, metric, estimate)`` of the surveyed metrics over all rows."""
    points = metrics.curve(df, keys)
    parts = [metrics.confusion(df, keys, threshold).select(*keys, "balanced_accuracy", "macro_f1"), metrics.roc_auc(points, keys), metrics.fpr_at_tpr(points, keys).withColumnRenamed("fpr_at_tpr", SURVEYED[3])]
    one = parts[0]
    for p in parts[1:]:
        one = one.join(p, list(keys)) if keys else one.crossJoin(p)  # one row
    return one.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("estimate")) for m in SURVEYED])).alias("x")).select(*keys, "x.*")


def cluster_intervals(df: DataFrame, keys: Sequence[str], cluster: str, threshold: float, scratch: Scratch, repeats: int = 2000) -> DataFrame:
    """``(keys, metric, estimate, lower, upper, repeats)`` over resampled clusters."""
    return estimates(df, keys, threshold).join(interval(replicate_values(df, keys, cluster, threshold, scratch, repeats), [*keys, "metric"]), [*keys, "metric"], "left")


def alignment_problems(left: DataFrame, right: DataFrame, key: str, label: str, group: str) -> DataFrame:
    """``(check, rows)``: what keeps two prediction tables from being compared row by row."""
    sides = [df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(label).alias("label"), F.min(group).alias("grp")) for df in (left, right)]
    j = sides[0].select(key, *[F.col(c).alias(f"l_{c}") for c in ("n", "label", "grp")]).join(sides[1].select(key, *[F.col(c).alias(f"r_{c}") for c in ("n", "label", "grp")]), key, "full")
    both = F.col("l_n").isNotNull() & F.col("r_n").isNotNull()
    checks = {
        "left keys repeated": F.coalesce("l_n", F.lit(0)) > 1, "right keys repeated": F.coalesce("r_n", F.lit(0)) > 1, "only left": F.col("r_n").isNull(), "only right": F.col("l_n").isNull(),
        "labels differ": both & ~F.col("l_label").eqNullSafe(F.col("r_label")), "groups differ": both & ~F.col("l_grp").eqNullSafe(F.col("r_grp")),
    }
    one = j.agg(*[F.count_if(c).alias(f"c{k}") for k, c in enumerate(checks.values())])
    return one.select(F.explode(F.array(*[F.struct(F.lit(name).alias("check"), F.col(f"c{k}").alias("rows")) for k, name in enumerate(checks)])).alias("x")).select("x.*")


def paired_intervals(left: DataFrame, right: DataFrame, key: str, cluster: str, thresholds: tuple[float, float], scratch: Scratch, repeats: int = 2000) -> DataFrame:
    """``(metric, estimate, lower, upper, repeats)`` of left minus right, both over the same draws of clusters; tables that don't agree on their keys, labels and clusters raise."""
    bad = [f"{r['check']}: {r['rows']}" for r in alignment_problems(left, right, key, "label", cluster).collect() if r["rows"]]  # six rows
    if bad:
        raise ValueError("predictions can't be paired: " + "; ".join(bad))
    a, b = replicate_values(left, [], cluster, thresholds[0], scratch, repeats), replicate_values(right, [], cluster, thresholds[1], scratch, repeats)
    moved = a.join(b.withColumnRenamed("value", "other"), ["metric", "replicate"]).select("metric", "replicate", (F.col("value") - F.col("other")).alias("value"))
    point = estimates(left, [], thresholds[0]).join(estimates(right, [], thresholds[1]).withColumnRenamed("estimate", "other"), "metric").select("metric", (F.col("estimate") - F.col("other")).alias("estimate"))
    return point.join(interval(moved, ["metric"]), "metric", "left")


def flattened(intervals: DataFrame, keys: Sequence[str], names: Sequence[str] = SURVEYED) -> DataFrame:
    """``cluster_intervals`` with a row a key: ``<metric>_ci_lower``, ``<metric>_ci_upper`` and ``<metric>_bootstrap_repeats``."""
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    return intervals.groupBy(*keys).agg(*[pick(m, c).alias(f"{m}_{n}") for m in names for c, n in (("lower", "ci_lower"), ("upper", "ci_upper"), ("repeats", "bootstrap_repeats"))])


def statistic_values(df: DataFrame, unit: str, sums: Mapping[str, Column], values: Mapping[str, Column], repeats: int = 2000) -> DataFrame:
    """``(metric, replicate, value)`` of metrics given as expressions over weighted sums.

    ``sums`` names a number of every row, ``values`` a metric over these names;
    a mean is the ratio of two sums.  ``unit`` is what is drawn, a cluster or a
    row's own number.  A task multiplies its rows by their weights in all
    replicates and sends one row a replicate; nulls count as 0, values that
    aren't finite are null.
    """
    names = list(sums)
    rows = df.select(cluster_number(F.col(unit)).alias("cluster"), *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"s{k}") for k, c in enumerate(sums.values())])
    most = max(1, CELLS // repeats)

    def weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((repeats, len(names)))
        for b in batches:
            for k in range(0, b.num_rows, most):
                part = b.slice(k, most)
                total += weights(part.column(0).to_numpy().view(np.uint64), np.arange(repeats)).T @ np.stack([c.to_numpy() for c in part.columns[1:]], 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(repeats), pa.int32()), *(pa.array(total[:, k]) for k in range(len(names)))], ["replicate", *(f"s{k}" for k in range(len(names)))])

    parts = rows.mapInArrow(weighted, "replicate int, " + ", ".join(f"s{k} double" for k in range(len(names))))
    per = parts.groupBy("replicate").agg(*[F.sum(f"s{k}").alias(n) for k, n in enumerate(names)])
    out = per.select("replicate", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in values.items()])).alias("x"))
    return out.select("x.metric", "replicate", F.when(~F.isnan("x.value") & (F.abs("x.value") < float("inf")), F.col("x.value")).alias("value"))


def statistic_intervals(df: DataFrame, unit: str, sums: Mapping[str, Column], values: Mapping[str, Column], repeats: int = 2000) -> DataFrame:
    """``(metric, lower, upper, repeats)`` over resampled units; see ``statistic_values``."""
    return interval(statistic_values(df, unit, sums, values, repeats), ["metric"])

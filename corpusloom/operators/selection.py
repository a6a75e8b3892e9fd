"""Deterministic selection: hash-ranked first rows, stratified splits, round robin, running budgets, range packing."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.prefix import hash_bucket, ranked, running
from corpusloom.operators.metrics import ranged


def first_by_hash(df: DataFrame, keys: Sequence[str], rank: Column, tie: Column) -> DataFrame:
    """The row of each key with the least ``(rank, tie)``: an aggregate, so a hot key is reduced before the shuffle."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*[F.col(k) for k in keys]).agg(F.min_by(row, F.struct(rank, tie)).alias("__row")).select("__row.*")


def complete_groups(df: DataFrame, keys: Sequence[str], cell: str, required: Sequence[str]) -> DataFrame:
    """``(keys, cells, complete)``: how many of the required cells each group has, and whether it has all."""
    have = [F.max(F.when(F.col(cell) == c, 1).otherwise(0)) for c in required]
    return df.groupBy(*keys).agg(sum(have[1:], have[0]).alias("cells")).withColumn("complete", F.col("cells") == len(required))


def largest_remainder_split(df: DataFrame, stratum: str, rank: Column, tie: str, shares: Sequence[tuple[str, float]]) -> DataFrame:
    """``df`` with ``split``: within each stratum the rows in the order of ``rank`` (a hexadecimal hash) fill quotas by largest remainder.

    Equal remainders go to the split named first.
    """
    rows = df.withColumn("__h", rank)
    placed = ranked(rows, [stratum], [F.col("__h"), F.col(tie)], hash_bucket(F.col("__h")), "__r")
    n = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("__n"))
    exact = [(s, F.col("__n") * w) for s, w in shares]
    base = [(s, F.floor(e + 1e-9)) for s, e in exact]
    spare = F.col("__n") - sum((b for _, b in base[1:]), base[0][1])
    order = F.array_sort(F.array(*[F.struct((-F.round(e - b, 9)).alias("f"), F.lit(k).alias("k")) for k, ((_, e), (_, b)) in enumerate(zip(exact, base))]))
    quotas = n.withColumn("__spare", spare).withColumn("__order", F.transform(order, lambda x: x["k"]))
    run, ends = F.lit(0), []
    for k, (s, b) in enumerate(base):
        run = run + b + F.when(F.array_position("__order", F.lit(k)) <= F.col("__spare"), 1).otherwise(0)
        ends.append(run.alias(f"__e{k}"))
    ends = quotas.select(stratum, *ends)
    pick = F.lit(shares[-1][0])
    for k in reversed(range(len(shares) - 1)):
        pick = F.when(F.col("__r") <= F.col(f"__e{k}"), shares[k][0]).otherwise(pick)
    return placed.join(ends, stratum).select(*df.columns, pick.alias("split"))


def round_robin(groups: DataFrame, rank: Column, tie: str, names: Sequence[str]) -> DataFrame:
    """``groups`` with ``position`` (from 0 in the order of a hexadecimal hash) and ``assigned``, the names in turn."""
    rows = groups.withColumn("__h", rank)
    out = ranked(rows, [], [F.col("__h"), F.col(tie)], hash_bucket(F.col("__h")), "__r").withColumn("position", F.col("__r") - 1)
    return out.withColumn("assigned", F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("position") % len(names) + 1).cast("int"))).select(*groups.columns, "position", "assigned")


def running_budget(df: DataFrame, size: str, tie: str, cap: float, levels: int = 1024) -> DataFrame:
    """``df`` with ``processing_order`` (1, 2, ... the largest sizes first), ``before`` and ``peak`` (before plus twice the size), and whether the running total is within ``cap``.

    Sizes are spread over ranges of about as many rows each, whatever their
    distribution; equal sizes share a range.  A null size counts as 0.
    """
    rows = df.withColumn("__size", F.coalesce(F.col(size), F.lit(0)))
    cuts = sorted(set(rows.agg(F.percentile_approx("__size", [k / levels for k in range(1, levels)], 10 * levels)).first()[0] or []))
    placed = ranged(rows.withColumn("__s", F.col("__size").cast("double")), "__s", cuts, "__range")
    out = running(placed.withColumn("__one", F.lit(1)), [], [F.col("__size").desc(), F.col(tie)], -F.col("__range"), {"total": "__size", "processing_order": "__one"})
    return out.select(*df.columns, "processing_order", (F.col("total") - F.col("__size")).alias("before"), (F.col("total") + F.col("__size")).alias("peak"), (F.col("total") <= cap).alias("within"))


def stride_groups(df: DataFrame, group: str, index: str, rows: int, stride: int) -> DataFrame:
    """``(group, last)``: groups of exactly ``rows`` distinct indexes that lie ``stride`` apart, with the greatest of them."""
    steps = Window.partitionBy(group).orderBy(index)
    gaps = df.select(group, index, (F.col(index) - F.lag(index).over(steps)).alias("gap"))
    return gaps.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gap") != stride).alias("bad"), F.max(index).alias("last")).where((F.col("n") == rows) & (F.col("bad") == 0)).select(group, "last")


def pack_ranges(df: DataFrame, group: str, index: str, longest: int, blocks: int = 4096) -> DataFrame:
    """``(group, first, length)``: each group's distinct indexes covered by ranges of at most ``longest``, greedily from the least.

    Where a range begins depends on all before it, so this is a scan of maps: a
    group is cut into chunks of ``blocks * longest`` indexes, and a task finds
    for its chunk, for each of the ``longest`` ways in which a range may reach
    into it, how far one reaches out.  These maps, a row a chunk, are chained,
    and every chunk then knows where its first range begins.  No task holds more
    rows than a chunk.  Null indexes and groups have no ranges.
    """
    kind = df.schema[group].dataType.simpleString()
    span = blocks * longest
    rows = df.where(F.col(group).isNotNull() & F.col(index).isNotNull()).select(F.col(group).alias("g"), F.col(index).cast("long").alias("i")).distinct().withColumn("chunk", F.floor(F.col("i") / span))

    def reach(table: pa.Table) -> pa.Table:
        at, chunk = np.sort(table["i"].to_numpy()), table["chunk"][0].as_py()
        following = np.searchsorted(at, at + longest)
        last = np.arange(len(at))
        for k in range(len(at) - 1, -1, -1):
            if following[k] < len(at):
                last[k] = last[following[k]]
        entered = np.searchsorted(at, chunk * span + np.arange(longest))
        # Past the last index nothing begins, and what reaches in ends within the chunk.
        out = np.where(entered < len(at), np.maximum(0, at[last[np.minimum(entered, len(at) - 1)]] + longest - (chunk + 1) * span), 0)
        return pa.table({"g": table["g"].slice(0, 1), "chunk": table["chunk"].slice(0, 1), "out": pa.array([out], pa.list_(pa.int64()))})

    def chained(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        entry, before = [], None
        for chunk, out in zip(table["chunk"].to_pylist(), table["out"]):
            entry.append(before[1][entry[-1]].as_py() if before and before[0] == chunk - 1 else 0)
            before = (chunk, out)
        return pa.table({"g": table["g"], "chunk": table["chunk"], "entry": pa.array(entry, pa.int64())})

    def ranges(rows: pa.Table, entries: pa.Table) -> pa.Table:
        at, chunk, entry = np.sort(rows["i"].to_numpy()), rows["chunk"][0].as_py(), entries["entry"][0].as_py()
        start = chunk * span + entry
        k = int(np.searchsorted(at, start))
        out = [(start - longest, at[k - 1])] if k else []
        while k < len(at):
            end = int(np.searchsorted(at, at[k] + longest))
            out.append((at[k], at[end - 1]))
            k = end
        return pa.table({"g": pa.array(rows["g"].to_pylist()[:1] * len(out), rows["g"].type), "first": pa.array([a for a, _ in out], pa.int64()), "last": pa.array([b for _, b in out], pa.int64())})

    maps = rows.groupBy("g", "chunk").applyInArrow(reach, f"g {kind}, chunk long, out array<long>")
    entries = maps.groupBy("g").applyInArrow(chained, f"g {kind}, chunk long, entry long")
    parts = rows.groupBy("g", "chunk").cogroup(entries.groupBy("g", "chunk")).applyInArrow(ranges, f"g {kind}, first long, last long")
    # A range that reaches into the next chunk has a part in each.
    return parts.groupBy("g", "first").agg(F.max("last").alias("last")).select(F.col("g").alias(group), "first", (F.col("last") - F.col("first") + 1).alias("length"))


def missing_rows(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def paired_sampler(df: DataFrame, group: str, label: str, kind: str, rank: Column) -> DataFrame:
    """``(group, real, fake, kind)``: one hash-ranked real and fake row number a group that has both; see the rank for ties."""
    return (
        df.groupBy(group)
        .agg(F.min_by("row", F.when(F.col(label) == 0, rank)).alias("real"), F.min_by("row", F.when(F.col(label) == 1, rank)).alias("fake"), F.min_by(kind, F.when(F.col(label) == 1, rank)).alias("kind"))
        .where("real is not null and fake is not null")
    )


def balanced_pairs(df: DataFrame, group: str, label: str, kind: str, names: Sequence[str], group_rank: Column, rank: Column) -> DataFrame:
    """``(group, real, fake, kind)``: one pair a group, its kind of fake dealt from the cycle of ``names`` over the hash-ranked groups.

    Each kind comes floor(n/k) or ceil(n/k) times, however common it is; real and
    fake are the hash-least rows of the group and of its assigned kind.  A group
    without a real row or without one of the kinds raises, as does a null group.
    """
    g = F.when(F.col(group).isNull(), F.raise_error(F.lit("a row has no group"))).otherwise(F.col(group))
    rows = df.select(g.alias("__g"), F.col("row"), F.when(F.col(label) == 1, F.col(kind)).when(F.col(label) == 0, "").alias("__kind"), rank.alias("__rank"))
    best = rows.groupBy("__g", "__kind").agg(F.min_by("row", "__rank").alias("row"))
    wanted = lambda n: F.max(F.when(F.col("__kind") == n, F.col("row")))
    per = best.groupBy("__g").agg(wanted("").alias("real"), F.create_map(*[x for n in names for x in (F.lit(n), wanted(n))]).alias("__fakes"))
    lacks = F.col("real").isNull() | F.exists(F.map_values("__fakes"), lambda v: v.isNull())
    checked = per.withColumn("real", F.when(lacks, F.raise_error(F.concat(F.lit("group cannot form a pair: "), F.col("__g").cast("string")))).otherwise(F.col("real")))
    dealt = round_robin(checked.withColumnRenamed("__g", group), group_rank, group, names)
    return dealt.select(group, "real", F.element_at("__fakes", F.col("assigned")).alias("fake"), F.col("assigned").alias("kind"))


def complete_pairs(df: DataFrame, parent: str, pair: str, cell: str, required: Sequence[str], rank: Column) -> DataFrame:
    """``(parent, pair)``: of each parent's pairs that have every required cell the one of least ``rank`` (the lesser pair among equals); parents without one have no row."""
    whole = complete_groups(df, [parent, pair], cell, required).where("complete")
    return whole.groupBy(parent).agg(F.min_by(pair, F.struct(rank, F.col(pair))).alias(pair))


def lowest_complete(df: DataFrame, parent: str, cell: str, required: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The rows of the least parent that has every required cell, in the order of the cells; of several rows of a cell the least."""
    first = complete_groups(df.where(F.col(parent).isNotNull()), [parent], cell, required).where("complete").orderBy(parent).limit(1).select(parent)
    place = F.array_position(F.array(*[F.lit(c) for c in required]), F.col(cell))
    rows = df.join(F.broadcast(first), parent, "left_semi").where(F.col(cell).isin(*required))
    return rows.groupBy(parent, cell).agg(F.min(F.struct(*columns)).alias("r")).select(parent, cell, place.alias("position"), "r.*").orderBy("position")


def in_named_order(df: DataFrame, orders: Sequence[tuple[str, Sequence[str] | None]]) -> DataFrame:
    """``df`` sorted by columns, those with a list of names by their place in it; other names and nulls come last."""
    place = lambda c, names: F.col(c).asc_nulls_last() if names is None else F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c)), F.lit(0)), F.lit(len(names) + 1))
    return df.orderBy(*[place(c, names) for c, names in orders])


def first_shards(df: DataFrame, shard: str, limit: int | None) -> tuple[DataFrame, dict]:
    """The rows of the first ``limit`` shards by name and the scope to record with them: a prefix is partial even if it holds all shards."""
    names = df.select(shard).where(F.col(shard).isNotNull()).distinct()
    if limit is None:
        return df, {"limit": None, "partial": False}
    return df.join(F.broadcast(names.orderBy(shard).limit(limit)), shard, "left_semi"), {"limit": limit, "partial": True}


def epoch_pairs(df: DataFrame, unit: str, label: str, kind: str, epoch: int, seed: int = 0) -> DataFrame:
    """``(unit, real, fake, kind, position)``: one real and one fake row of every unit that has both, drawn anew each epoch, and the unit's place in the epoch's order.

    Draws and order are hashes of seed, epoch and row or unit, so an epoch is the same on every run and partitioning.
    """
    key = lambda c: F.sha2(F.concat_ws(":", F.lit(seed), F.lit(epoch), F.col(c).cast("string")), 256)
    pairs = paired_sampler(df.where(F.col(unit).isNotNull()), unit, label, kind, key("row"))
    rows = pairs.withColumn("__h", key(unit))
    return ranked(rows, [], [F.col("__h"), F.col(unit)], hash_bucket(F.col("__h")), "position").drop("__h")


def weighted_draws(df: DataFrame, label: str, draws: int, epoch: int, seed: int = 0) -> DataFrame:
    """``df`` with ``times``: how often each row comes in an epoch of about ``draws`` rows drawn with replacement, both labels being as likely in sum.

    The number is the whole part of the row's expectation and a Poisson draw of
    the rest from a hash of seed, epoch and ``row``, so rows are drawn where
    they lie; null labels never come.
    """
    n = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    labels = n.agg(F.count(F.lit(1)).alias("__k"))  # one row
    rows = df.join(F.broadcast(n), label).crossJoin(F.broadcast(labels)).withColumn("__mean", F.lit(draws) / F.col("__k") / F.col("__n"))
    rest = F.col("__mean") - F.floor("__mean")
    u = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.lit(epoch), F.col("row").cast("string")), 256), 1, 13), 16, 10).cast("double") / float(2**52)
    # The number of terms of the cumulative distribution that the uniform number reaches; the rest is below 1, where 20 terms exhaust a double.
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(20)), F.struct(F.exp(-rest).alias("term"), F.exp(-rest).alias("sum"), F.floor("__mean").cast("int").alias("times")),
        lambda a, k: F.struct((a["term"] * rest / k).alias("term"), (a["sum"] + a["term"] * rest / k).alias("sum"), (a["times"] + F.when(u >= a["sum"], 1).otherwise(0)).alias("times")),
    )
    return rows.withColumn("times", steps["times"]).select(*df.columns, "times")

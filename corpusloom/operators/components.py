"""Leakage components: edges of shared keys, connected components, stable names, exclusion, allocation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from corpusloom.operators.numbering import numbered
from corpusloom.operators.selection import largest_remainder_split
from corpusloom.scratch import Scratch


def key_edges(df: DataFrame, record_id: str, keys: Sequence[str]) -> DataFrame:
    """``(u, v)``: each record with the least record of each value it holds; nulls tie nothing together, and a value of n records gives n edges."""
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).cast("string").alias("value")) for k in keys]))
    rows = df.select(F.col(record_id).alias("u"), cells.alias("x")).where("x.value is not null").select("u", "x.k", "x.value")
    first = rows.groupBy("k", "value").agg(F.min("u").alias("v"))
    return rows.join(first, ["k", "value"]).where("u != v").select("u", "v").distinct()


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, root)``: the least vertex (a number) of the component of every vertex of an edge, by alternating large and small stars.

    A large star ties a vertex's greater neighbours to the least one around
    it, a small star its lesser ones; edges only move towards the root, and
    both steps are aggregates, so hot vertices are reduced before the shuffle.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        around = e.union(e.select("v", "u")) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        joined = around.join(least, "u")
        if large:
            return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).where("u != v").distinct()

    seen = edges.select("u", "v").where("u is not null and v is not null and u != v").distinct()
    now, before = scratch.save(seen, "edges"), None
    while True:
        sums = Observation()
        nxt = star(star(now, True), False).observe(sums, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        saved = scratch.save(nxt, "edges")
        state = (sums.get["n"], sums.get["h"])
        scratch.drop(now)
        now = saved
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def components(df: DataFrame, record_id: str, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, root)`` of every record, the root being the least id of its component; one without an edge is its own root.

    The ends of the edges must be ids of ``df``; the rounds work on their numbers.
    """
    seed, names = numbered(df.select(record_id), scratch)
    found = connected(edges.select(F.xxhash64(F.lit(seed), "u").alias("u"), F.xxhash64(F.lit(seed), "v").alias("v")), scratch)
    placed = names.join(found.withColumnRenamed("id", "number"), "number", "left").select(F.col("name").alias("id"), F.coalesce("root", "number").alias("r"))
    least = placed.groupBy("r").agg(F.min("id").alias("root"))
    return placed.join(least, "r").select("id", "root")


def member_names(members: DataFrame, prefix: str, most: int = 100_000) -> DataFrame:
    """``(root, component, members)``: the prefix and the first 24 digits of the SHA-256 of the sorted members' lines.

    A component of up to ``most`` members is hashed as one row.  A larger one is
    sorted on disk by its task and run through one digest batch by batch, so its
    members are never held together; the name is the same either way.
    """
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    lines = F.concat_ws("\n", F.array_sort(F.collect_list(F.col("id").cast("string"))))
    name = lambda c: F.concat(F.lit(prefix), F.substring(c, 1, 24)).alias("component")
    small = members.join(sizes.where(F.col("members") <= most), "root").groupBy("root").agg(name(F.sha2(lines, 256)), F.count(F.lit(1)).alias("members"))
    kind = members.schema["root"].dataType.simpleString()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, digest, n = None, None, 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([root], of), pa.array([digest.hexdigest()]), pa.array([n], pa.int64())], ["root", "digest", "members"])
        for b in batches:
            of = b.column(0).type
            for r, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if digest is None or r != root:
                    if digest is not None:
                        yield row()
                    root, digest, n = r, hashlib.sha256(), 0
                # Nulls are left out, as collect_list leaves them out.
                if i is not None:
                    digest.update(("\n" + i if n else i).encode())
                    n += 1
        if digest is not None:
            yield row()

    big = members.join(sizes.where(F.col("members") > most).select("root"), "root").select("root", F.col("id").cast("string").alias("id"))
    large = big.repartition("root").sortWithinPartitions("root", "id").mapInArrow(digests, f"root {kind}, digest string, members long")
    return small.unionByName(large.select("root", name(F.col("digest")), "members"))


def crossings(members: DataFrame, records: DataFrame, record_id: str, split: str) -> DataFrame:
    """``(root, rows, splits)`` of components whose rows stand in more than one split."""
    stood = records.select(F.col(record_id).alias("id"), F.col(split).alias("s")).join(members, "id")
    return stood.groupBy("root").agg(F.count(F.lit(1)).alias("rows"), F.array_join(F.array_sort(F.collect_set("s")), "+").alias("splits"), F.count_distinct("s").alias("n")).where("n > 1").drop("n")


def excluded_components(members: DataFrame, records: DataFrame, record_id: str, split: str, caption: str) -> DataFrame:
    """``(root, rows, captions, splits)`` of the components that stand in more than one split and must be left out."""
    stood = records.select(F.col(record_id).alias("id"), F.col(split).alias("s"), F.col(caption).alias("c")).join(members, "id")
    return stood.groupBy("root").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("c").alias("captions"), F.array_join(F.array_sort(F.collect_set("s")), "+").alias("splits"), F.count_distinct("s").alias("n")).where("n > 1").drop("n")


def sizes_by_split(members: DataFrame, records: DataFrame, record_id: str, split: str) -> DataFrame:
    """``(split, components, rows, largest)``: components and rows that stand in each split, and the most rows of one component there."""
    stood = records.select(F.col(record_id).alias("id"), F.col(split).alias("split")).join(members, "id").groupBy("split", "root").agg(F.count(F.lit(1)).alias("n"))
    return stood.groupBy("split").agg(F.count(F.lit(1)).alias("components"), F.sum("n").alias("rows"), F.max("n").alias("largest"))


def allocate(members: DataFrame, records: DataFrame, record_id: str, kind: str, shares: Sequence[tuple[str, float]], pooled: int = 20) -> DataFrame:
    """``(root, stratum, split)``: every component in one split, the kinds spread over the splits by their shares.

    Components of the same numbers of rows by kind form a stratum; within it the
    splits are filled by largest remainder in the order of the roots' hashes, so
    each split gets its share of every kind up to one component a stratum.
    Strata of fewer than ``pooled`` components, whose remainders would all go to
    the largest split, are dealt together by size (powers of two).
    """
    counted = records.select(F.col(record_id).alias("id"), F.coalesce(F.col(kind).cast("string"), F.lit("")).alias("k")).join(members, "id").groupBy("root", "k").agg(F.count(F.lit(1)).alias("n"))
    vectors = counted.groupBy("root").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "k", "n"))), "|").alias("vector"))
    often = vectors.groupBy("vector").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= pooled)
    band = F.concat(F.lit("size "), F.floor(F.log2(F.col("n").cast("double"))).cast("string"))
    placed = vectors.join(often, "vector", "left").select("root", F.when(F.col("c").isNotNull(), F.col("vector")).otherwise(band).alias("stratum"))
    return largest_remainder_split(placed, "stratum", F.sha2(F.col("root").cast("string"), 256), "root", shares)

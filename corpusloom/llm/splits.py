"""Splits that keep related records together.

A vertex is one *key* (a group name or a parent number); a record that carries
several keys is an edge between them.  Borůvka rounds contract the graph: each
component takes its edge of least weight, the chosen edges join the persisted
spanning forest, and the trees they form become the components of the next
round.  The roots are then stratified by size band and dealt to the splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import folded
from corpusloom.llm.graph import compose, follow, save_counting
from corpusloom.operators.numbering import number, separating_seed
from corpusloom.scratch import Scratch

#: Group names that say nothing.
EMPTY_GROUPS = ("", "unknown", "n/a")
#: The splits that count.
SPLITS = ("train", "val", "test")


def spanning_forest(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Components of an undirected graph by minimum-edge contraction.

    ``edges(u, v)``: longs; repeated and mirrored rows and loops are allowed,
    rows with a null end count for nothing.  Returns ``labels(c, p)``, the root
    of every vertex of an edge that is no loop, and ``forest(u, v)``, one
    spanning tree a component, both persisted.  Weights are hashes of the edge
    under the first seed that gives no two edges the same one, so the forest is
    the same on every run and partitioning.  No edges give two empty tables.

    A round sends one minimum a component and partition over the network, so a
    vertex with a third of all edges costs no more than any other, and at least
    halves the components that still have edges.  Everything is a long, so
    minima are hash-aggregated.
    """
    ends = edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    ends = ends.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    for seed in range(100):
        live, left = save_counting(ends.select("a", "b", F.xxhash64(F.lit(seed), "a", "b").alias("w"), F.col("a").alias("u"), F.col("b").alias("v"), F.lit(True).alias("left")), "left", scratch, "edges")
        if live.groupBy("w").count().where("count > 1").isEmpty():
            break
        scratch.drop(live)
    maps: list[DataFrame] = []
    trees: list[DataFrame] = []
    least = [F.min("w").alias("w"), *[F.min_by(x, "w").alias(x) for x in ("u", "v")]]
    while left:
        both = live.select(F.col("a").alias("c"), F.col("b").alias("to"), "w", "u", "v").union(live.select("b", "a", "w", "u", "v"))
        chosen = scratch.save(both.groupBy("c").agg(F.min_by("to", "w").alias("to"), *least), "chosen")
        trees.append(chosen)
        back = chosen.select(F.col("c").alias("to"), F.col("w").alias("back"))
        # Two components that chose each other chose the same edge; the smaller name is the root.
        parent = chosen.join(back.hint("shuffle_hash"), "to").select("c", F.when((F.col("back") == F.col("w")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("p"))
        root = follow(scratch.save(parent, "parent"), scratch)
        maps.append(root)
        following, left = save_counting(
            live.join(root.toDF("a", "ra").hint("shuffle_hash"), "a")
            .join(root.toDF("b", "rb").hint("shuffle_hash"), "b")
            .where("ra != rb")
            .groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .agg(*least)
            .withColumn("left", F.lit(True)),
            "left",
            scratch,
            "edges",
        )
        scratch.drop(live)
        live = following
    if not maps:
        nothing = live.select(F.col("a").alias("c"), F.col("b").alias("p"))
        return nothing, nothing.toDF("u", "v")
    forest = trees[0].select("u", "v")
    for t in trees[1:]:
        forest = forest.union(t.select("u", "v"))
    labels, forest = compose(maps, scratch), scratch.save(forest.distinct(), "forest")
    scratch.drop(*trees, *maps)
    return labels, forest


def key_graph(records: DataFrame, record_id: str, group: str, parent: str, split: Column, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Every record's least and greatest key as numbers and its least and greatest split by place in ``SPLITS``, ``(id, lo, hi, first, last)``, and the edges ``(u, v)`` between keys.

    The table is read once.  A record's keys are its group (white space around it and case ignored; null,
    blank and placeholder names are none) and its parent number if above 0; rows
    with the same id are one record, rows with a null id are none.
    """
    name = folded(F.col(group))
    rows = records.where(F.col(record_id).isNotNull()).select(
        F.col(record_id).alias("id"),
        F.when(~name.isin(*EMPTY_GROUPS), F.concat(F.lit("g:"), name)).alias("g"),
        F.when(F.col(parent) > 0, F.concat(F.lit("p:"), F.col(parent).cast("string"))).alias("p"),
        F.nullif(F.array_position(F.array(*[F.lit(n) for n in SPLITS]), split), F.lit(0)).cast("int").alias("s"),
    )
    rows = scratch.save(rows.distinct(), "keys")
    seed = separating_seed(rows.select(F.explode(F.array("g", "p"))))
    rows = rows.select("id", number(seed, F.col("g")).alias("g"), number(seed, F.col("p")).alias("p"), "s")
    ends = rows.groupBy("id").agg(F.min(F.least("g", "p")).alias("lo"), F.max(F.greatest("g", "p")).alias("hi"), F.min("s").alias("first"), F.max("s").alias("last"))
    both = rows.where("g is not null and p is not null").select(F.col("g").alias("u"), F.col("p").alias("v"))
    # A record delivered with different keys ties them together by its smallest one.
    several = rows.join(ends.where("lo < hi"), "id").select("lo", F.explode(F.array_compact(F.array("g", "p"))).alias("k")).where("lo != k")
    return ends, both.union(several)


def placed_records(records: DataFrame, record_id: str, group: str, parent: str, split: Column, scratch: Scratch) -> DataFrame:
    """``(id, root, first, last)`` of every record with an id, persisted: the number of its related set, null for one without a key, and its least and greatest split.

    Records are related if they share a key of ``key_graph``, directly or through other records; other columns are not looked at, whatever their names.
    """
    ends, edges = key_graph(records, record_id, group, parent, split, scratch)
    labels, _ = spanning_forest(edges, scratch)
    return scratch.save(ends.join(labels.select(F.col("c").alias("lo"), "p").hint("shuffle_hash"), "lo", "left").select("id", F.coalesce("p", "lo").alias("root"), "first", "last"), "sets")


def record_sets(records: DataFrame, record_id: str, group: str, parent: str, scratch: Scratch) -> DataFrame:
    """``(id, set_id)``: the related set of every record with an id; a record without a key is a set of its own."""
    placed = placed_records(records, record_id, group, parent, F.lit(None).cast("string"), scratch)
    return placed.select("id", F.coalesce(F.concat(F.lit("k:"), F.col("root").cast("string")), F.concat(F.lit("r:"), "id")).alias("set_id"))


def forest_summary(records: DataFrame, record_id: str, group: str, parent: str, scratch: Scratch) -> DataFrame:
    """``(keys, trees, edges)``: the keys that an edge reaches, their spanning trees, and the edges of these; one row."""
    _, edges = key_graph(records, record_id, group, parent, F.lit(None).cast("string"), scratch)
    labels, forest = spanning_forest(edges, scratch)
    return labels.agg(F.count(F.lit(1)).alias("keys"), F.count_distinct("p").alias("trees")).crossJoin(forest.agg(F.count(F.lit(1)).alias("edges")))  # one row each


def split_name(c: Column) -> Column:
    """``train``, ``val`` or ``test`` without surrounding white space and case; null for all else."""
    s = folded(c)
    return F.when(s.isin(*SPLITS), s)


def crossing_records(records: DataFrame, record_id: str, group: str, parent: str, split: str, scratch: Scratch) -> DataFrame:
    """``(id)``: all records of the related sets whose rows stand in two or more splits."""
    placed = placed_records(records, record_id, group, parent, split_name(F.col(split)), scratch)
    crossing = placed.where("root is not null").groupBy("root").agg(F.min("first").alias("lo"), F.max("last").alias("hi")).where("lo < hi").select("root")
    return placed.join(crossing, "root", "left_semi").select("id").union(placed.where("root is null and first < last").select("id"))


def deal(sizes: DataFrame, targets: Sequence[tuple[str, float]], bits: int = 10) -> DataFrame:
    """``(root, split)``: deal ``sizes(root, n)`` so that the splits hold their shares of the sum of ``n``.

    Roots are stratified by band (powers of two).  Within a band they stand in
    the order of their hashes and are dealt systematically: the band is cut
    where the splits' parts of its length end.  Bands go from the largest roots
    to the smallest, and each is cut by what the splits still lack, so it makes
    up for what the rounding of those before left; a root that outweighs a
    split's lack stands alone in its band and goes where its middle falls.

    Cuts fall between hash prefixes of ``bits`` bits, in the last band between
    single roots: the prefix that holds a cut is counted by further bits, level
    by level.  At most ``64 * 2 ** bits`` counts reach the driver in a step,
    and no rows are ordered anywhere.  No targets, or targets that sum to nothing, raise
    ``ValueError``; no roots give no rows.  Equal hashes go together.
    """
    wanted = {k: float(v) for k, v in targets if v and v > 0}
    if not wanted:
        raise ValueError("no split has a positive share")
    names, whole = list(wanted), sum(wanted.values())
    cells = sizes.select("root", "n", F.floor(F.log2(F.col("n").cast("double"))).cast("int").alias("band"), F.shiftrightunsigned(F.xxhash64("root"), 1).alias("h"))

    def counts(rows: DataFrame, level: int) -> dict[int, list[tuple[int, int, int]]]:
        """Of each band the prefixes in order, with the sum of ``n`` and the roots."""
        at = F.shiftrightunsigned("h", 63 - bits * level)
        out: dict[int, list[tuple[int, int, int]]] = {}
        for r in rows.groupBy("band", at.alias("prefix")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("roots")).collect():
            out.setdefault(r["band"], []).append((r["prefix"], r["n"], r["roots"]))
        return {b: sorted(v) for b, v in out.items()}

    by_band = counts(cells, 1)
    total = sum(n for v in by_band.values() for _, n, _ in v)
    lack = {k: v / whole * total for k, v in wanted.items()}
    ends: dict[int, list[int]] = {}  # of each band the hashes below which the splits but the last end
    for band in sorted(by_band, reverse=True):
        parts = [max(0.0, lack[k]) for k in names]
        length, run, start, found = sum(n for _, n, _ in by_band[band]), 0.0, 0, []
        for k, part in zip(names[:-1], parts):
            run += part / (sum(parts) or 1.0) * length
            at, hold = _cut(by_band[band], run, 63 - bits)
            level, lo = 1, 0
            while band == min(by_band) and hold is not None and hold[2] > 1 and (level + 1) * bits <= 60:
                # The last band makes up for all the others: look into the prefix that the cut falls into.
                lo += sum(n for p, n, _ in inner if p < hold[0]) if level > 1 else sum(n for p, n, _ in by_band[band] if p < hold[0])
                level += 1
                inner = counts(cells.where((F.col("band") == band) & (F.shiftrightunsigned("h", 63 - bits * (level - 1)) == hold[0])), level)[band]
                at, hold = _cut(inner, run - lo, 63 - bits * level)
            found.append(at)
        ends[band] = found
        for k, a, b in zip(names, [0, *found], [*found, 1 << 63]):
            lack[k] -= sum(n for p, n, _ in by_band[band] if a <= p << (63 - bits) < b)
    pick = F.lit(names[-1])
    for band, found in ends.items():
        one = F.lit(names[-1])
        for k, a in reversed(list(zip(names, found))):
            one = F.when(F.col("h") < F.lit(str(a)).cast("decimal(20,0)"), k).otherwise(one)
        pick = F.when(F.col("band") == band, one).otherwise(pick)
    return cells.select("root", pick.alias("split"))


def _cut(prefixes: Sequence[tuple[int, int, int]], at: float, shift: int) -> tuple[int, tuple[int, int, int] | None]:
    """The hash between two prefixes that lies nearest to the position ``at`` of the band, and the prefix that holds the position."""
    run = 0
    for p, n, roots in prefixes:
        if run + n > at:
            return ((p if at - run <= n / 2 else p + 1) << shift), (p, n, roots)
        run += n
    return 1 << 63, None


def split_records(records: DataFrame, record_id: str, group: str, parent: str, targets: Sequence[tuple[str, float]], scratch: Scratch) -> DataFrame:
    """``(id, set_id, split)``: every record's split, one for all records of a related set."""
    sets = scratch.save(record_sets(records, record_id, group, parent, scratch), "sets")
    sizes = scratch.save(sets.groupBy(F.col("set_id").alias("root")).agg(F.count(F.lit(1)).alias("n")), "sizes")
    return sets.join(deal(sizes, targets).withColumnRenamed("root", "set_id"), "set_id").select("id", "set_id", "split")

"""Consolidating pairwise matches into groups by low-diameter decomposition.

Clusters grow from exponentially shifted start times: a vertex that starts
early spreads its name over its neighbours before they start themselves.
Clusters contract to super-vertices, the edges between clusters are decomposed
again, and the assignments of all levels are composed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import folded, strip
from corpusloom.llm.graph import compose, save_counting
from corpusloom.operators.numbering import numbered
from corpusloom.scratch import Scratch


def low_diameter_groups(edges: DataFrame, scratch: Scratch, beta: float = 0.4, radius: int = 4) -> DataFrame:
    """``(c, p)``: a number shared by all vertices that ``edges(u, v)`` connects, for every vertex of an edge.

    Vertices are longs.  Repeated and mirrored rows and loops are allowed; rows
    with a null end count for nothing, and a vertex that only has loops is left
    out.  At level ``k`` vertex ``x`` starts ``s(x)`` early, exponential with rate
    ``beta`` and drawn from a hash of ``(k, x)``.  It holds the greatest of
    ``s(y) - distance(x, y)`` and that ``y``; a round passes ``held - 1`` to the
    neighbours.  After ``radius`` rounds every vertex goes over into the cluster
    whose name it holds, which lies in its own group whether or not growth has
    ended, and the edges between clusters are decomposed again.  An edge stays
    with a chance of about ``beta`` or less, so the edges shrink geometrically
    from level to level, also along one long path.

    All rounds of a level are one job: a round joins one row a vertex to its
    edges, whose shuffle is reused, and reduces what goes to one vertex before
    the next shuffle; adaptive execution splits the edges of a hot vertex.
    """
    ends = edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).select("u", "v")
    live, left = _save_edges(ends.union(ends.select("v", "u")), scratch)
    maps: list[DataFrame] = []
    while left:
        draw = (F.xxhash64(F.lit(len(maps)), F.col("u")).bitwiseAND((1 << 52) - 1).cast("double") + 1) / float(1 << 52)
        held = live.where("d = 0").select(F.col("u").alias("c"), (-F.log(draw) / beta).alias("s"), F.col("u").alias("p"))
        for _ in range(radius):
            held = (
                live.join(held.withColumnRenamed("c", "u").hint("shuffle_hash"), "u")
                .select(F.col("v").alias("c"), (F.col("s") - F.col("d")).alias("s"), "p")
                .where("s > 0")
                .groupBy("c")
                .agg(F.max("s").alias("s"), F.max_by("p", "s").alias("p"))
            )
        label = scratch.save(held.select("c", "p"), "held")
        maps.append(label)
        crossing = (
            live.where("d = 1")
            .join(label.toDF("u", "a").hint("shuffle_hash"), "u")
            .join(label.toDF("v", "b").hint("shuffle_hash"), "v")
            .where("a != b")
            .select(F.col("a").alias("u"), F.col("b").alias("v"))
        )
        following, left = _save_edges(crossing, scratch)
        scratch.drop(live)
        live = following
    if not maps:
        return live.select(F.col("u").alias("c"), F.col("v").alias("p"))
    whole = compose(maps, scratch)
    scratch.drop(*maps)
    return whole


def _save_edges(both_ways: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """Distinct directed edges of length 1, and of length 0 from every vertex to itself; how many there are."""
    steps = F.explode(F.array(F.struct(F.col("v").alias("v"), F.lit(1).alias("d")), F.struct(F.col("u").alias("v"), F.lit(0).alias("d"))))
    rows = both_ways.distinct().select("u", steps.alias("to")).select("u", "to.v", "to.d").distinct()
    return save_counting(rows.withColumn("left", F.lit(True)), "left", scratch, "edges")


def match_id(c: Column) -> Column:
    """An id in lower case without surrounding white space; null where nothing is left."""
    s = folded(c)
    return F.when(s != "", s)


def match_groups(links: DataFrame, left: str, right: str, distance: str, members: DataFrame, member_id: str, component: str, scratch: Scratch, max_distance: int = 4) -> DataFrame:
    """``(id, group_first_id)``: each id in a group of two or more, and the smallest id of its group.

    A link counts if both ids are non-blank and differ and its distance is 0 to
    ``max_distance`` (null never).  Members with the same component of an
    earlier run (white space around it ignored; null and blank never) are
    linked too, each by one edge to the component's own vertex, so that a
    component of a third of all rows gives no pairs.
    """
    pairs = links.where(F.col(distance).between(0, max_distance)).select(F.concat(F.lit("i"), match_id(F.col(left))).alias("u"), F.concat(F.lit("i"), match_id(F.col(right))).alias("v")).where("u != v")
    earlier = strip(F.col(component))
    stars = members.where(earlier != "").select(F.concat(F.lit("i"), match_id(F.col(member_id))).alias("u"), F.concat(F.lit("c"), earlier).alias("v")).where("u is not null")
    ends = scratch.save(pairs.union(stars).distinct(), "named")
    seed, ids = numbered(ends.select(F.explode(F.array("u", "v"))), scratch)
    edges = ends.select(F.xxhash64(F.lit(seed), "u").alias("u"), F.xxhash64(F.lit(seed), "v").alias("v"))
    groups = low_diameter_groups(edges, scratch)
    found = ids.where(F.col("name").startswith("i")).join(groups, ids["number"] == groups["c"]).select(F.expr("substr(name, 2)").alias("id"), "p")
    first = found.groupBy("p").agg(F.min("id").alias("group_first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.join(first, "p").select("id", "group_first_id")

"""Steps that the graph operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from corpusloom.scratch import Scratch


def save_counting(df: DataFrame, flag: str, scratch: Scratch, name: str) -> tuple[DataFrame, int]:
    """Write ``df`` without the column ``flag``; return it and how many rows had the flag set.

    The number is gathered while the rows are written, so convergence costs no second job.
    """
    seen = Observation()
    out = df.observe(seen, F.sum(F.col(flag).cast("long")).alias("n")).drop(flag)
    saved = scratch.save(out, name)
    return saved, int(seen.get["n"] or 0)


def follow(parent: DataFrame, scratch: Scratch) -> DataFrame:
    """``parent(c, p)``: replace every ``p`` by the root it leads to; a round goes eight times as far as the one before."""
    while True:
        two = _twice(_twice(parent))
        far = two.join(two.select(F.col("c").alias("p"), F.col("p").alias("pp")).hint("shuffle_hash"), "p").select("c", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved"))
        nxt, moved = save_counting(far, "moved", scratch, "jump")
        scratch.drop(parent)
        parent = nxt
        if not moved:
            return parent


def _twice(parent: DataFrame) -> DataFrame:
    return parent.join(parent.select(F.col("c").alias("p"), F.col("p").alias("pp")).hint("shuffle_hash"), "p").select("c", F.col("pp").alias("p"))


def compose(maps: list[DataFrame], scratch: Scratch) -> DataFrame:
    """Maps ``(c, p)`` of successive contractions as one map from the first vertices to the last.

    A vertex that a later map doesn't know keeps its place.  The maps shrink from round to round and are joined from
    the last to the first, so the work is about that of the first map.
    """
    whole = maps[-1]
    for m in reversed(maps[:-1]):
        later = whole.select(F.col("c").alias("p"), F.col("p").alias("q"))
        whole = m.join(later.hint("shuffle_hash"), "p", "left").select("c", F.coalesce("q", "p").alias("p"))
    return scratch.save(whole, "labels")

"""Filling fixed-capacity containers with items by conflict-constrained best fit.

Bins lie ordered by their residual capacity and carry bitmaps of the sources
and duplicate clusters that may not enter them again.  An item looks for the
tightest bin that it fits; where that one conflicts, the search goes on to its
successors, and where all do, a new bin is opened.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import collapse
from corpusloom.llm.tokens import encode
from corpusloom.scratch import Scratch

#: Items that one task packs, how full a container must be to be closed before the last round, and the least share of its containers that a round must free for another to follow.
SHARD_ITEMS, FULL, GAIN = 20_000, 0.98, 0.002

#: Size, source, cluster, how many tokens of the source and how often the cluster may stand in a bin.
Item = tuple[int, object, object, int, int]


class Bins:
    """Open containers by residual capacity, with bitmaps of the sources and clusters that each holds."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]  # residual -> bins
        self.filled = 0  # bit r is set where a bin has residual r
        self.sources: list[int] = []
        self.clusters: list[int] = []  # those that may not enter again
        self.tokens: Counter[tuple[int, int]] = Counter()  # of a bin and source
        self.copies: Counter[tuple[int, int]] = Counter()  # of a bin and a cluster that may enter more than once

    def put(self, size: int, source: int, cluster: int, room: int, most: int) -> int:
        """The bin that takes the item, whose source and cluster are single bits or 0: the tightest that holds neither, else the tightest whose source has ``room`` left, else a new one."""
        second = (-1, -1)
        rest = self.filled >> size
        r = size
        while rest:
            step = (rest & -rest).bit_length() - 1
            r += step
            rest >>= step
            here = self.at[r]
            for k in range(len(here) - 1, -1, -1):
                b = here[k]
                if self.clusters[b] & cluster:
                    continue
                if not self.sources[b] & source:
                    return self._take(r, k, size, source, cluster, most)
                if second[0] < 0 and self.tokens[b, source] + size <= room:
                    second = (r, k)
            rest >>= 1
            r += 1
        if second[0] < 0:
            self.sources.append(0)
            self.clusters.append(0)
            self.at[self.capacity].append(len(self.sources) - 1)
            second = (self.capacity, len(self.at[self.capacity]) - 1)
        return self._take(*second, size, source, cluster, most)

    def _take(self, r: int, k: int, size: int, source: int, cluster: int, most: int) -> int:
        b = self.at[r].pop(k)
        if not self.at[r]:
            self.filled &= ~(1 << r)
        left = r - size
        self.at[left].append(b)
        self.filled |= 1 << left
        self.sources[b] |= source
        if source:
            self.tokens[b, source] += size
        if most > 1:
            self.copies[b, cluster] += 1
        if most <= 1 or self.copies[b, cluster] >= most:
            self.clusters[b] |= cluster
        return b


def pack(items: Sequence[Item], capacity: int) -> list[int]:
    """The bin of each item, in the order given; sizes are 1 to ``capacity``.  Null sources and clusters conflict with nothing."""
    bits: list[dict[object, int]] = []
    for k in (1, 2):
        often = [v for v, n in Counter(x[k] for x in items).items() if v is not None and n > 1]
        bits.append({v: 1 << i for i, v in enumerate(often)})
    bins = Bins(capacity)
    return [bins.put(size, bits[0].get(source, 0), bits[1].get(cluster, 0), room, most) for size, source, cluster, room, most in items]


def in_order(rows: list[dict]) -> list[dict]:
    """Copies first, those of the largest clusters before others, then by size, the largest first; what is left of ties goes by id.

    Copies must not share a bin, so they are spread while bins are few and empty; placed last, each would open a bin of its own.
    """
    copies = Counter(r["cluster"] for r in rows)
    count = lambda r: 0 if r["cluster"] is None or copies[r["cluster"]] == 1 else copies[r["cluster"]]
    return sorted(rows, key=lambda r: (-count(r), -r["tokens"], r["cluster"] or 0, r["id"] or "", r["piece"], r["source"] or ""))


def measured(df: DataFrame, record_id: str, text: str, source: str, path: str | None = None) -> DataFrame:
    """``(id, source, cluster, size)``: the ids a text has, and a hash of the text in lower case with its white space collapsed; texts of no ids are left out."""
    rows = df.where(F.col(text) != "").select(F.col(record_id).cast("string").alias("id"), F.col(source).cast("string").alias("source"), F.xxhash64(collapse(F.col(text))).alias("cluster"), F.col(text).alias("text"))
    return encode(rows, ["id", "source", "cluster"], "text", path, count_only=True)


_PACKED = "container string, id string, piece int, tokens long, source string, cluster long, room long, most int, used long"


def _packer(capacity: int, turn: int) -> Callable[[pa.Table], pa.Table]:
    """Packs the items of one shard; the containers are named by round, shard and bin."""

    def each(table: pa.Table) -> pa.Table:
        rows = in_order(table.to_pylist())
        at = pack([(r["tokens"], r["source"], r["cluster"], r["room"], r["most"]) for r in rows], capacity)
        used: Counter[int] = Counter()
        for r, b in zip(rows, at):
            used[b] += r["tokens"]
        shard = table["shard"][0].as_py()
        kinds = (("id", pa.string()), ("piece", pa.int32()), ("tokens", pa.int64()), ("source", pa.string()), ("cluster", pa.int64()), ("room", pa.int64()), ("most", pa.int32()))
        named = {k: pa.array([r[k] for r in rows], t) for k, t in kinds}
        return pa.table({"container": pa.array([f"{turn}-{shard}-{b}" for b in at]), **named, "used": pa.array([used[b] for b in at], pa.int64())})

    return each


def with_limits(items: DataFrame, capacity: int) -> DataFrame:
    """``items`` with ``room``, the tokens that the item's source may have in one container with it, and ``most``, how often its cluster may stand in one.

    A cluster stands there once, unless it has more items than the containers
    that all sizes need at least; then some container must hold two, and the
    limit is the least that opens none for it.  A source, which may hold a third
    of all items, is kept apart only where that costs no room; it may fill half
    of a container, or twice its share of all tokens if that is more.  An item
    takes room, so at most ``capacity`` clusters have more items than
    containers are needed, and at most 4 sources a quarter of the tokens:
    both lists may be broadcast.
    """
    whole = items.agg(F.sum("tokens")).first()[0] or 1
    needed = -(-whole // capacity)
    hot = items.where("source is not null").groupBy("source").agg(F.sum("tokens").alias("t")).where(F.col("t") * 4 > whole)
    copied = items.where("cluster is not null").groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > needed)
    return (
        items.join(F.broadcast(hot.select("source", F.least(F.ceil(F.col("t") * 2 * capacity / whole), F.lit(capacity)).alias("room"))), "source", "left")
        .join(F.broadcast(copied.select("cluster", F.ceil(F.col("n") / needed).cast("int").alias("most"))), "cluster", "left")
        .withColumns({"room": F.coalesce("room", F.lit(capacity // 2)), "most": F.coalesce("most", F.lit(1))})
    )


def fill(items: DataFrame, scratch: Scratch, capacity: int = 2048, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``(container, id, piece, tokens, used, source, cluster)`` for ``items(id, source, size, cluster)``.

    An item longer than ``capacity`` is cut into full pieces, a container each,
    and a rest that is packed like any item; no other is cut.  Items of size 0
    or less, or null, take no room and have no row.  In a round items are spread
    over tasks by a hash of their id, about ``shard_items`` each however many
    there are, and each task packs its own (copies first, then best-fit
    decreasing).  Containers that are full, or too full for the least item of
    those that are not, are closed; what lies in the others is packed again,
    until one task holds it or a round frees less than ``GAIN`` of them.
    See ``with_limits`` for what may share a container.  The result depends on the rows only.
    """
    items = items.where("size > 0")
    names = ["container", "id", "piece", "tokens", "used", "source", "cluster"]
    full = items.where(F.col("size") >= capacity).select("id", "source", "cluster", F.explode(F.sequence(F.lit(0), F.floor(F.col("size") / capacity).cast("int") - 1)).alias("piece"))
    out = full.withColumns({"container": F.concat_ws("-", F.lit("full"), F.coalesce("id", F.lit("null")), "piece"), "tokens": F.lit(capacity).cast("long"), "used": F.lit(capacity).cast("long")}).select(names)
    rest = items.select("id", F.floor(F.col("size") / capacity).cast("int").alias("piece"), (F.col("size") % capacity).alias("tokens"), "source", "cluster").where("tokens > 0")
    left = scratch.save(with_limits(rest, capacity), "rest")
    n, turn, before = left.count(), 0, None
    open_ = F.col("used") < FULL * capacity
    while n:
        shards = -(-n // shard_items)
        spread = left.select("id", "piece", "tokens", "source", "cluster", "room", "most", F.pmod(F.xxhash64(F.lit(turn), "id", "piece"), F.lit(shards)).cast("int").alias("shard"))
        packed = scratch.save(spread.groupBy("shard").applyInArrow(_packer(capacity, turn), _PACKED), "packed")
        if shards == 1:
            return out.union(packed.select(names))
        least = packed.where(open_).agg(F.min("tokens")).first()[0] or 0
        still = open_ & (capacity - F.col("used") >= least)
        now = packed.agg(F.count_distinct("container").alias("all"), F.count_distinct(F.when(still, F.col("container"))).alias("open"), F.count_if(still).alias("n")).first()
        if before is not None and now["all"] > before * (1 - GAIN):
            return out.union(packed.select(names))
        out = out.union(packed.where(~still).select(names))
        left, n, before, turn = packed.where(still), now["n"], now["open"], turn + 1
    return out


def audit(placed: DataFrame, items: DataFrame, documents: DataFrame, record_id: str, text: str, capacity: int = 2048, waste: float = 0.02) -> DataFrame:
    """``(check, rows)``: documents that take room and those that don't, and how many documents, containers or pairs of them break each rule of ``fill``.

    ``placed`` is what ``fill`` made of ``items``; sources and copies are held against ``with_limits``.
    """
    room = items.where("size > 0")
    doc = documents.agg(F.count_if(F.coalesce(F.length(text), F.lit(0)) > 0).alias("with"), F.count_if(F.coalesce(F.length(text), F.lit(0)) == 0).alias("without"))
    per_id = placed.groupBy("id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("pieces"))
    lost = room.select("id", "size").join(per_id, "id", "full")
    bins = placed.groupBy("container").agg(F.sum("tokens").alias("t"), F.max("used").alias("u"), F.min("used").alias("v"))
    n = bins.agg(F.count_if((F.col("t") != F.col("u")) | (F.col("u") != F.col("v")) | (F.col("t") > capacity)).alias("bad"), F.count(F.lit(1)).alias("n"), F.sum("t").alias("t"))
    limits = with_limits(placed.where(F.col("tokens") < capacity), capacity)
    in_bin = lambda k: limits.where(F.col(k).isNotNull()).groupBy("container", k)
    copies = in_bin("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("most").alias("most")).where("n > most")
    sources = in_bin("source").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"), F.max("room").alias("room")).where("n > 1 and t > room")
    one = (
        doc.crossJoin(lost.agg(F.count_if(~F.col("size").eqNullSafe(F.col("t"))).alias("lost"), F.count_if((F.col("pieces") > 1) & (F.col("size") <= capacity)).alias("cut")))
        .crossJoin(n)
        .crossJoin(copies.agg(F.count(F.lit(1)).alias("copies")))
        .crossJoin(sources.agg(F.count(F.lit(1)).alias("sources")))
    )  # one row each
    checks = {
        "documents with text": F.col("with"), "documents without text": F.col("without"), "tokens not placed once": F.col("lost"), "short texts cut": F.col("cut"), "containers over capacity or misstated": F.col("bad"),
        "copies together": F.col("copies"), "sources above their limit": F.col("sources"), "room wasted beyond the limit": (F.coalesce(n["n"] * capacity - n["t"], F.lit(0)) > waste * n["n"] * capacity + capacity).cast("long"),
    }
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), c.cast("long").alias("rows")) for k, c in checks.items()])).alias("x")).select("x.*")

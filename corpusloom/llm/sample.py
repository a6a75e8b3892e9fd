"""A reproducible sample that keeps what it has while its table grows.

A ledger is a folder of generations, one for every delivery.  It holds every
key ever seen with its batch, its priority (a hash of the key alone) and
whether it was taken.  A delivery reads the earlier generations, keeps all
their keys by an anti-join, fills the growth of the quota from the unseen keys
with the lowest priorities, and appends what is new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import folded, strip

#: Hexadecimal digits by which a step narrows down where a quota ends, and the rows of a batch that one task may then order.
DIGITS, BORDER_ROWS = 3, 1000


def first_seen(records: DataFrame, key: str, source_hash: str, batch: str) -> DataFrame:
    """``(key, batch, source_index_hash)``: every distinct key of a delivery with its first batch.

    A key is the stripped id; rows with a null or blank id are no records, a
    null batch counts as batch 0, and repeated rows are one record, known by the
    smallest non-blank source hash (lower case, stripped) that its first batch
    gives: what a later batch spells differently changes nothing.
    """
    k, h = strip(F.col(key)), folded(F.col(source_hash))
    rows = records.select(F.when(k != "", k).alias("key"), F.coalesce(F.col(batch).cast("int"), F.lit(0)).alias("batch"), F.when(h != "", h).alias("h")).where("key is not null")
    return rows.groupBy("key").agg(F.min(F.struct("batch", F.col("h").isNull().alias("none"), "h")).alias("m")).select("key", "m.batch", F.col("m.h").alias("source_index_hash"))


class Ledger:
    """The ledger in a folder that all executors share; a folder that isn't there is an empty ledger."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._at = lambda name: place(f"{self.path}/{name}")
        self._fs = place(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def generations(self) -> list[int]:
        """The numbers of the deliveries that were written to their end; what a lost run left half written is none, and is written anew."""
        if not self._fs.exists(self._at(".")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("."))]
        return sorted(int(n[4:]) for n in names if n.startswith("gen-") and self._fs.exists(self._at(f"{n}/_SUCCESS")))

    def rows(self) -> DataFrame | None:
        """``(key, source_index_hash, batch, priority, taken, generation)`` of all deliveries; None of an empty ledger."""
        there = self.generations()
        if not there:
            return None
        kept = self.spark.read.schema("key string, source_index_hash string, batch int, priority string, taken boolean, generation int")
        return kept.parquet(*[f"{self.path}/gen-{g:06d}" for g in there])

    def sample(self) -> DataFrame:
        """The rows taken."""
        return self.rows().where("taken").drop("taken")

    def extend(self, delivery: DataFrame, share: float = 0.1, seed: str = "sample") -> DataFrame:
        """Append the unseen keys of ``delivery`` (rows of ``first_seen``) and return all rows.

        After each batch ``floor(share * keys seen)`` keys are taken; what the
        quota grew by is filled from the keys that came with that batch, lowest
        priority first (SHA-256 of seed and key; the key breaks ties).  Keys that
        arrive late, under a batch that the ledger has passed, compete together
        in the ledger's last batch, before those of newer ones.  The result
        depends on the rows only: not on their order, their partitioning, or,
        while none is late, on how many batches are added at a time.  A delivery
        without unseen keys appends an empty generation.

        Where a quota ends is found from counts by hash prefix, three digits at
        a time among the rows of the prefix that holds it, until few are left
        (4,096 counts a batch reach the driver in a step); only those are ordered.
        """
        was, there = self.rows(), self.generations()
        seen, taken, last = 0, 0, None
        if was is not None:
            one = was.agg(F.count(F.lit(1)).alias("n"), F.count_if("taken").alias("t"), F.max("batch").alias("b")).first()
            seen, taken, last = one["n"], one["t"], one["b"]
            delivery = delivery.join(was.select("key"), "key", "left_anti")
        turn = F.col("batch") if last is None else F.greatest("batch", F.lit(last))
        path = f"{self.path}/new-{len(there):06d}"
        delivery.select("key", "source_index_hash", "batch", F.sha2(F.concat_ws(":", F.lit(seed), "key"), 256).alias("priority"), turn.alias("turn")).write.mode("overwrite").parquet(path)
        new = self.spark.read.schema("key string, source_index_hash string, batch int, priority string, turn int").parquet(path)

        ends: dict[int, tuple[str, int]] = {}  # of each batch the prefix in which its quota ends, and the places left there
        for r in new.groupBy("turn").agg(F.count(F.lit(1)).alias("n")).orderBy("turn").collect():  # a row a batch
            seen += r["n"]
            grow = max(0, int(share * seen + 1e-9) - taken)
            taken += min(grow, r["n"])
            # No digit is below "-" or above "g".
            ends[r["turn"]] = ("-", 0) if not grow else ("g", 0) if grow >= r["n"] else ("", grow)
        narrow = {t: "" for t, e in ends.items() if not e[0]}
        while narrow:
            size = DIGITS + len(next(iter(narrow.values())))
            counts = self._marked(new, narrow, "upto").where(F.substring("priority", 1, size - DIGITS) == F.col("upto")).groupBy("turn", F.substring("priority", 1, size).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
            by: dict[int, list] = {}
            for r in counts.collect():
                by.setdefault(r["turn"], []).append((r["prefix"], r["n"]))
            for t in list(narrow):
                left = ends[t][1]
                for prefix, n in sorted(by[t]):
                    if left < n:
                        break
                    left -= n
                ends[t] = (prefix, left)
                narrow[t] = prefix
                if n <= BORDER_ROWS or size >= 60:
                    del narrow[t]
        at = self._marked(new, {t: e[0] for t, e in ends.items()}, "border").withColumn("prefix", F.expr("substring(priority, 1, length(border))"))
        places = F.create_map(*[F.lit(x) for t, e in ends.items() for x in (t, e[1])]) if ends else F.create_map(F.lit(0), F.lit(0))
        ranked = at.where("prefix = border").withColumn("taken", F.row_number().over(Window.partitionBy("turn").orderBy("priority", "key")) <= places[F.col("turn")])
        whole = at.where("prefix != border").withColumn("taken", F.col("prefix") < F.col("border")).unionByName(ranked)
        generation = there[-1] + 1 if there else 0
        whole.select("key", "source_index_hash", "batch", "priority", "taken", F.lit(generation).alias("generation")).write.mode("overwrite").parquet(f"{self.path}/gen-{generation:06d}")
        self._fs.delete(self._at(f"new-{len(there):06d}"), True)
        return self.rows()

    def _marked(self, new: DataFrame, by_turn: dict[int, str], name: str) -> DataFrame:
        """``new`` with what ``by_turn`` has for its batch; a row a batch is broadcast."""
        return new.join(F.broadcast(self.spark.createDataFrame(sorted(by_turn.items()), f"turn int, {name} string")), "turn")

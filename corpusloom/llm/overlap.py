"""Same or nearly same records across splits.

Normalised records are cut where a rolling hash of the last characters says
so, chunk digests are joined across the splits, and the lengths of shared
chunks are summed into overlap fractions.  Which pairs of pictures are the same
or nearly the same is decided by their hashes: content hashes are joined as
they are, since a chunk of a digest says nothing unless all of it is shared,
and perceptual hashes, which may differ in single bits anywhere, are cut at
fixed places into pieces short enough that two hashes within the distance must
agree on one of them up to a few bits; pieces are joined by all their spellings
within those bits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import hex64, informative_hash, perceptual_hash
from corpusloom.llm.splits import split_name as split_role
from corpusloom.operators.dedup import near_values
from corpusloom.scratch import Scratch

#: Characters that the rolling hash looks at.
WINDOW = 8


def chunk_ends(text: bytes, least: int, mean: int, most: int) -> list[int]:
    """Ends of the content-defined chunks of ``text``: a cut needs ``least`` bytes since the last and comes after ``most`` at the latest.

    A cut lies where a polynomial hash of the last ``WINDOW`` bytes is 0 modulo ``mean - least + 1``.  A tail shorter
    than ``least`` joins the chunk before it.  No bytes give no chunks.
    """
    n = len(text)
    if n == 0:
        return []
    b = np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)
    h = np.zeros(n, np.uint64)
    factor = np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(min(WINDOW, n)):
            h[k:] += b[: n - k] * factor
            factor = factor * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    may = (np.nonzero(h % np.uint64(max(1, mean - least + 1)) == 0)[0] + 1).tolist()
    ends, last, k = [], 0, 0
    while last < n:
        while k < len(may) and may[k] < last + least:
            k += 1
        end = min(may[k] if k < len(may) else n, last + most, n)
        if n - end < least:
            end = n
        ends.append(end)
        last = end
    return ends


def chunks(values: DataFrame, value: str, keep: Sequence[str], least: int, mean: int, most: int) -> DataFrame:
    """``(keep..., chunk, size)``: the distinct chunks of each row's value with their sizes in bytes; null and empty values have none."""
    at = {f.name: f for f in values.schema.fields}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, texts, sizes = [], [], []
            for i, v in enumerate(b.column(len(keep)).to_pylist()):
                if v:
                    raw, last = v.encode(), 0
                    for end in chunk_ends(raw, least, mean, most):
                        rows.append(i)
                        texts.append(raw[last:end])
                        sizes.append(end - last)
                        last = end
            take = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(take) for k in range(len(keep))), pa.array(texts, pa.binary()), pa.array(sizes, pa.int64())], [*keep, "chunk", "size"])

    schema = ", ".join(f"`{k}` {at[k].dataType.simpleString()}" for k in keep) + ", chunk binary, size long"
    return values.select(*keep, value).mapInArrow(cut, schema).groupBy(*keep, F.md5("chunk").alias("chunk")).agg(F.sum("size").alias("size"))


def record_values(records: DataFrame, record_id: str, split: str, hashes: Sequence[str], perceptual: str) -> DataFrame:
    """``(id, role, field, value, x)``: what each record shows; ``x`` is the perceptual hash as a long, ``value`` any other hash.

    Rows with the same id are one record, which stands in every split that one of its rows names; rows with a null id or
    another split than train, val and test are left out, and so are hashes that say nothing.
    """
    shown = F.array(
        *[F.struct(F.lit(h).alias("field"), informative_hash(F.col(h)).alias("value"), F.lit(None).cast("long").alias("x")) for h in hashes],
        F.struct(F.lit(perceptual).alias("field"), F.lit(None).cast("string").alias("value"), hex64(perceptual_hash(F.col(perceptual))).alias("x")),
    )
    return (
        records.where(F.col(record_id).isNotNull())
        .select(F.col(record_id).alias("id"), split_role(F.col(split)).alias("role"), F.explode(shown).alias("s"))
        .where("role is not null and (s.value is not null or s.x is not null)")
        .select("id", "role", "s.field", "s.value", "s.x")
        .distinct()
    )


def value_links(rows: DataFrame, scratch: Scratch, distance: int) -> DataFrame:
    """``(field, tv, ev, tx, ex, differing)``: every pair of a value that train shows and an equal or near one that val or test shows, once each whatever the number of their copies.

    ``rows`` are those of ``record_values``; equal content hashes are in ``tv``
    and ``ev``, near perceptual ones in ``tx`` and ``ex``.
    """
    by = rows.groupBy("field", "value", "x").agg(F.bool_or(F.col("role") == "train").alias("in_train"), F.bool_or(F.col("role") != "train").alias("in_eval"))
    values = scratch.save(by, "values")
    same = values.where("value is not null and in_train and in_eval").select("field", F.col("value").alias("tv"), F.col("value").alias("ev"), F.lit(None).cast("long").alias("tx"), F.lit(None).cast("long").alias("ex"), F.lit(0).alias("differing"))
    pictures = values.where("x is not null")
    n = pictures.agg(F.count_if("in_train"), F.count_if("in_eval"), F.first("field")).first()
    close = near_values(pictures, distance, n[0], n[1]).select(F.lit(n[2]).alias("field"), F.lit(None).cast("string").alias("tv"), F.lit(None).cast("string").alias("ev"), F.col("tv").alias("tx"), F.col("ev").alias("ex"), "differing")
    return scratch.save(same.union(close), "links")


def cross_split_pairs(records: DataFrame, record_id: str, split: str, hashes: Sequence[str], perceptual: str, scratch: Scratch, distance: int = 8) -> DataFrame:
    """``(train_id, eval_id)``: distinct pairs of a train record and another val or test record that show the same or nearly the same.

    Values are matched once each, whatever the number of their copies; only
    matching values meet their records again.  The result holds every pair of
    copies; ``split_classes`` says the same without them.
    """
    rows = scratch.save(record_values(records, record_id, split, hashes, perceptual), "shown")
    links = value_links(rows, scratch, distance)
    t, e = rows.where("role = 'train'"), rows.where("role != 'train'")

    def meet(links: DataFrame, kind: str, value: str) -> DataFrame:
        left = t.select("field", F.col(value).alias(f"t{kind}"), F.col("id").alias("train_id"))
        right = e.select("field", F.col(value).alias(f"e{kind}"), F.col("id").alias("eval_id"))
        return links.join(left, ["field", f"t{kind}"]).join(right, ["field", f"e{kind}"]).select("train_id", "eval_id")

    pairs = meet(links.where("tv is not null"), "v", "value").union(meet(links.where("tx is not null"), "x", "x"))
    return scratch.save(pairs.where("train_id != eval_id").distinct(), "pairs")


def split_classes(records: DataFrame, record_id: str, split: str, hashes: Sequence[str], perceptual: str, scratch: Scratch, distance: int = 8) -> DataFrame:
    """``(field, train_first, eval_first, differing, train_records, eval_records)``: the pairs of values behind ``cross_split_pairs``, a class of copies being named by its least record.

    A row stands for all pairs of its ``train_records`` and ``eval_records``, so
    a value that a third of all records share gives one row with each value near it.
    """
    rows = scratch.save(record_values(records, record_id, split, hashes, perceptual), "shown")
    links = value_links(rows, scratch, distance)
    members = rows.groupBy("field", "value", "x", (F.col("role") == "train").alias("train")).agg(F.min("id").alias("first"), F.count_distinct("id").alias("n"))
    side = lambda k, train: members.where(F.col("train") == F.lit(train)).select("field", F.coalesce("value", F.col("x").cast("string")).alias(f"{k}_key"), F.col("first").alias(f"{k}_first"), F.col("n").alias(f"{k}_n"))
    keyed = links.withColumns({"t_key": F.coalesce("tv", F.col("tx").cast("string")), "e_key": F.coalesce("ev", F.col("ex").cast("string"))})
    return (
        keyed.join(side("t", True), ["field", "t_key"]).join(side("e", False), ["field", "e_key"])
        .select("field", F.col("t_first").alias("train_first"), F.col("e_first").alias("eval_first"), "differing", F.col("t_n").alias("train_records"), F.col("e_n").alias("eval_records"))
    )


def overlap_fractions(records: DataFrame, record_id: str, split: str, fields: Sequence[Column], scratch: Scratch, perceptual: str | None = None, distance: int = 8, least: int = 16, mean: int = 24, most: int = 40) -> DataFrame:
    """``(id, split, size, shared, overlap)`` of every val and test record: the share of its normalised record that train holds too.

    The normalised record is the sequence of ``fields``, each cut on its own; a
    field that is null or empty has no part in it, and a record without any has
    size 0 and overlap 0.  A chunk's digest is looked up among the distinct
    digests of train, so copies never meet in pairs.  With ``perceptual`` the
    record also holds its picture, as large as the hash's 16 digits, which is
    shared if a train picture lies within ``distance``.  A record delivered with
    several texts holds them all.
    """
    parts = F.array(*[F.struct(F.lit(k).alias("f"), c.alias("v")) for k, c in enumerate(fields)])
    base = records.where(F.col(record_id).isNotNull()).withColumn("__role", split_role(F.col(split))).where("__role is not null")
    rows = scratch.save(base.select(F.col(record_id).alias("id"), F.col("__role").alias("role"), F.explode(parts).alias("p")).select("id", "role", "p.f", "p.v").distinct(), "fields")
    known = chunks(rows.where("role = 'train'").select("f", "v").distinct(), "v", ["f"], least, mean, most).select("f", "chunk").withColumn("known", F.lit(True))
    cut = chunks(rows.where("role != 'train'"), "v", ["id", "role", "f"], least, mean, most).join(known, ["f", "chunk"], "left")
    sized = cut.select("id", "role", "size", F.when(F.col("known"), F.col("size")).otherwise(F.lit(0)).alias("shared"))
    if perceptual is not None:
        shown = scratch.save(record_values(base.drop("role").withColumnRenamed("__role", "role"), record_id, "role", [], perceptual), "pictures")
        near = value_links(shown, scratch, distance).select(F.col("ex").alias("x")).distinct().withColumn("near", F.lit(True))
        pictures = shown.where("role != 'train'").join(near, "x", "left").select("id", "role", F.lit(16).cast("long").alias("size"), F.when(F.col("near"), F.lit(16)).otherwise(F.lit(0)).cast("long").alias("shared"))
        sized = sized.union(pictures)
    sums = sized.groupBy("id", "role").agg(F.sum("size").alias("size"), F.sum("shared").alias("shared"))
    return (
        rows.where("role != 'train'").select("id", "role").distinct().join(sums, ["id", "role"], "left")
        .select("id", F.col("role").alias("split"), F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("shared", F.lit(0)).alias("shared"))
        .withColumn("overlap", F.when(F.col("size") > 0, F.round(F.col("shared") / F.col("size"), 6)).otherwise(0.0))
    )

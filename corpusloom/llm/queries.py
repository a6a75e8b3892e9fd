"""The queries of this subpackage for the driver contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import collapse, informative_hash
from corpusloom.llm import grouping, overlap, packing, sample, spam, splits, tokens
from corpusloom.scratch import Scratch
from corpusloom.sources.tables import table

SELECTION = ("selection_id", "leakage_group", "parent_coco_image_id")
CONTENT = ("pixel_sha256", "source_sha256")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Records of related sets that stand in two or more splits."""
    return splits.crossing_records(table(spark, d, "selection_catalog"), *SELECTION, "split", Scratch(spark, "p1")).select(F.col("id").alias("selection_id"))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    """A split for every record, one for each related set."""
    targets = [(r["split_name"], r["target_share"]) for r in table(spark, d, "split_targets").collect()]  # three rows
    return splits.split_records(table(spark, d, "selection_catalog"), *SELECTION, targets, Scratch(spark, "p1")).withColumnRenamed("id", "selection_id")


def p1_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of ``p1_splits``: how many records and sets break it."""
    targets = table(spark, d, "split_targets")
    dealt = p1_splits(spark, d)
    per = dealt.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    whole = per.agg(F.sum("n").alias("all"))  # one row
    off = targets.select(F.col("split_name").alias("split"), "target_share").join(per, "split", "full").crossJoin(F.broadcast(whole)).where(F.abs(F.coalesce("n", F.lit(0)) / F.col("all") - F.coalesce("target_share", F.lit(0.0))) > 0.005)
    torn = dealt.groupBy("set_id").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).where("lo != hi")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("check"), "rows")
    return n(dealt, "records dealt").union(n(dealt.where("split is null"), "records without a split")).union(n(torn, "sets torn apart")).union(n(off, "shares off by more than 0.005"))


def p1_forest(spark: SparkSession, d: str) -> DataFrame:
    """Keys, trees and edges of the spanning forest."""
    return splits.forest_summary(table(spark, d, "selection_catalog"), *SELECTION, Scratch(spark, "p1"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every linked record with the first id of its group."""
    return grouping.match_groups(
        table(spark, d, "near_phash_links"), "left_selection_id", "right_selection_id", "phash_distance", table(spark, d, "training_manifest"), "selection_id", "integrity_component", Scratch(spark, "p3")
    ).select(F.col("id").alias("selection_id"), "group_first_id")


def _ledger(spark: SparkSession, d: str) -> sample.Ledger:
    """A ledger that the last batch was added to after all others, by a second opening of its folder; the table is read once."""
    s = Scratch(spark, "p4")
    seen = s.save(sample.first_seen(table(spark, d, "selection_catalog"), "selection_id", "source_index_hash", "batch_no"), "seen")
    last = seen.agg(F.max("batch")).first()[0] or 0
    sample.Ledger(spark, f"{s.root}/ledger").extend(seen.where(F.col("batch") < last))
    ledger = sample.Ledger(spark, f"{s.root}/ledger")
    ledger.extend(seen.where(F.col("batch") == last))
    return ledger


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    """The sample after the last batch."""
    return _ledger(spark, d).sample().select(F.col("key").alias("selection_id"), "source_index_hash", F.col("batch").alias("first_batch"))


def p4_growth(spark: SparkSession, d: str) -> DataFrame:
    """What the ledger holds of each batch: keys seen and taken."""
    return _ledger(spark, d).rows().groupBy(F.col("batch").alias("first_batch")).agg(F.count(F.lit(1)).alias("seen"), F.count_if("taken").alias("taken"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a train record and a val or test record that show the same or nearly the same picture."""
    pairs = overlap.cross_split_pairs(table(spark, d, "highres_manifest"), "source_id", "split", CONTENT, "phash", Scratch(spark, "p5"))
    return pairs.select(F.least("train_id", "eval_id").alias("source_id_a"), F.greatest("train_id", "eval_id").alias("source_id_b")).distinct()


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """The values behind these pairs, copies counted instead of written out."""
    return overlap.split_classes(table(spark, d, "highres_manifest"), "source_id", "split", CONTENT, "phash", Scratch(spark, "p5"))


def p5_overlap(spark: SparkSession, d: str) -> DataFrame:
    """The part of every val and test record (caption, content hashes, picture) that train holds too."""
    fields = [collapse(F.col("caption")), *[informative_hash(F.col(c)) for c in CONTENT]]
    return overlap.overlap_fractions(table(spark, d, "highres_manifest"), "source_id", "split", fields, Scratch(spark, "p5"), perceptual="phash").withColumnRenamed("id", "source_id")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping val and test records a split, generator and source, with their train partners."""
    rows = table(spark, d, "highres_manifest")
    pairs = overlap.cross_split_pairs(rows, "source_id", "split", CONTENT, "phash", Scratch(spark, "p5"))
    partners = pairs.groupBy(F.col("eval_id").alias("source_id")).agg(F.count(F.lit(1)).alias("partners"))
    kind = rows.groupBy("source_id").agg(F.min("generator").alias("generator"), F.min("source_repository_id").alias("source"))
    stood = rows.select("source_id", splits.split_name(F.col("split")).alias("split")).where("split in ('val', 'test') and source_id is not null").distinct()
    return (
        stood.join(partners, "source_id", "left").join(kind, "source_id")
        .groupBy("split", "generator", "source")
        .agg(F.count(F.lit(1)).alias("records"), F.count("partners").alias("overlapping"), F.coalesce(F.sum("partners"), F.lit(0)).alias("partners"))
    )


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode(table(spark, d, "documents"), ["doc_id"], "text")


def _packed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, Scratch]:
    s = Scratch(spark, "p7")
    items = s.save(packing.measured(table(spark, d, "documents"), "doc_id", "text", "source"), "items")
    return packing.fill(items, s), items, s


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Documents assigned to containers of 2,048 tokens."""
    return _packed(spark, d)[0].select("container", F.col("id").cast("long").alias("doc_id"), "piece", "tokens", "used")


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers: how many documents, containers and pairs break it."""
    placed, items, s = _packed(spark, d)
    return packing.audit(s.save(placed, "placed"), items, table(spark, d, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents most of whose words stand outside sentences."""
    return spam.stuffed_pages(table(spark, d, "documents"), "doc_id", "text", Scratch(spark, "p8")).withColumnRenamed("id", "doc_id")


def p8_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every document's words, those outside sentences, and the mean PMI of its neighbouring words."""
    return spam.page_shares(table(spark, d, "documents"), "doc_id", "text", Scratch(spark, "p8")).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_splits, p1_invariants, p1_forest, p3_found, p4_sample, p4_growth, p5_found, p5_classes, p5_overlap, p5_report, p6_ids, p7_containers, p7_invariants, p8_found, p8_pages)}


def oracle_sql() -> dict[str, str]:
    from corpusloom.llm.sql import SQL

    return SQL

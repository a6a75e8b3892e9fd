"""Whole audits made of the operators: gates, evidence and what passes them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import scalars
from corpusloom.functions.text import hex64, informative_hash, perceptual_hash, stable_hash
from corpusloom.operators import catalog, components, dedup, evidence, gates, manifests, selection
from corpusloom.scratch import Scratch


def integrity_audit(rows: DataFrame, scratch: Scratch, distance: int = 4) -> tuple[dict, DataFrame | None]:
    """The leakage audit of a materialised manifest, and the training rows if every gate passes.

    ``rows`` holds ``selection_id, split, label, parent, encoded_sha256,
    pixel_sha256, phash, format, mode``.  Records of one parent, of equal hashes
    or of perceptual hashes within ``distance`` are one component; a component
    in several splits, or a format or mode that one label has and the other
    lacks, blocks the manifest.
    """
    keys = ("parent", "encoded_sha256", "pixel_sha256")
    near = dedup.near_links(rows.withColumn("x", hex64(perceptual_hash(F.col("phash")))), "selection_id", "parent", "x", distance)
    edges = components.key_edges(rows, "selection_id", keys).union(near.select(F.col("right_id"), F.col("left_id")))
    members = scratch.save(components.components(rows, "selection_id", edges, scratch), "members")
    crossing = components.crossings(members, rows, "selection_id", "split")
    support = catalog.support_sets(rows, "label", ["format", "mode"])
    gates = [
        evidence.gate("no component crosses splits", crossing.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("components").alias("check"), "rows")),
        evidence.gate("labels share formats and modes", support.groupBy("column_name").agg(F.count_if(~F.col("same")).alias("rows"))),
        evidence.gate("ids are unique", rows.groupBy("selection_id").count().agg(F.count_if(F.col("count") > 1).alias("rows")).select(F.lit("selection_id").alias("check"), "rows")),
    ]
    passed = all(g["passed"] for g in gates)
    record = {"schema_version": "integrity-audit-v1", "gates": gates, "components": members.select("root").distinct().count(), "near_links": near.count(), "passed": passed}
    if not passed:
        return record, None
    named = members.join(components.member_names(members, "integrity:"), "root").select(F.col("id").alias("selection_id"), F.col("component").alias("leakage_group"))
    return record, rows.join(named, "selection_id")


def single_role(rows: DataFrame, members: DataFrame, record_id: str, split: str) -> tuple[DataFrame, DataFrame]:
    """The rows of components of one split, and the components left out with their rows and splits."""
    out = components.crossings(members, rows, record_id, split)
    left = members.join(out, "root", "left_anti").select(F.col("id").alias(record_id), "root")
    return rows.join(left, record_id), out


def corpus_build(rows: DataFrame, names: Sequence[str], scratch: Scratch, short_side: int = 512, crop: int = 384, seed: str = "7", distance: int = 8) -> tuple[DataFrame, DataFrame, dict]:
    """A paired corpus with the splits its source gave: the rows kept, the components left out, and a record of both.

    ``rows`` holds a row a record: ``source_id, group_id, label, generator,
    official_split, source_width, source_height, pixel_sha256, source_sha256,
    phash``.  Of the groups that hold a large enough real picture and one of
    every named generator, each gives its real row and a row of one generator,
    dealt in turn over the hash-ranked groups, rows being the hash-least of their
    role.  Records of one group, of equal content hashes, or of perceptual
    hashes within ``distance`` are one component; a component that stands in
    several source splits is left out.  The record names the strata (split and
    generator) that this leaves empty; a caller decides whether it may go on.
    """
    large = manifests.large_enough(rows, F.col("source_width"), F.col("source_height"), short_side, "generator", ["real", *names])
    large = large.withColumn("role", F.when((F.col("label") == 0) & (F.col("generator") == "real"), "real").when((F.col("label") == 1) & (F.col("generator") != "real"), F.col("generator"))).where("role is not null and group_id is not null")
    whole = selection.complete_groups(large, ["group_id"], "role", ["real", *names]).where("complete").select("group_id")
    dealt = selection.round_robin(whole, stable_hash(F.lit(seed), F.lit("allocation"), F.col("group_id")), "group_id", names).select("group_id", "assigned")
    wanted = large.join(dealt, "group_id").where("role = 'real' or role = assigned").drop("assigned")
    chosen = selection.first_by_hash(wanted, ["group_id", "role"], stable_hash(F.lit(seed), F.lit("row"), F.col("group_id"), F.col("role"), F.col("source_id")), F.col("source_id"))
    at = {f"crop_{side}": scalars.crop_offset(F.lit(f"{seed}:crop"), F.col("group_id"), part, F.col(f"source_{of}") - crop) for part, side, of in ((0, "left", "width"), (1, "top", "height"))}
    hashes = ("pixel_sha256", "source_sha256")
    chosen = scratch.save(chosen.withColumns(at | {c: informative_hash(F.col(c)) for c in hashes}), "chosen")
    near = dedup.near_links(chosen.withColumn("x", hex64(perceptual_hash(F.col("phash")))), "source_id", "group_id", "x", distance)
    edges = components.key_edges(chosen, "source_id", ("group_id", *hashes)).union(near.select("right_id", "left_id"))
    members = scratch.save(components.components(chosen, "source_id", edges, scratch), "members")
    left_out = components.excluded_components(members, chosen, "source_id", "official_split", "group_id")
    kept, _ = single_role(chosen, members, "source_id", "official_split")
    kept = scratch.save(kept.join(components.member_names(members, "corpus:").select("root", "component"), "root").drop("root").withColumn("split", F.col("official_split")), "kept")
    strata = {(r["split"], r["generator"]): r["n"] for r in kept.groupBy("split", "generator").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a split and generator
    n = left_out.agg(F.count(F.lit(1)).alias("c"), F.coalesce(F.sum("rows"), F.lit(0)).alias("r")).first()
    record = {
        "schema_version": "corpus-build-v1", "rows": sum(strata.values()), "groups": dealt.count(), "left_out": {"components": n["c"], "rows": n["r"]},
        "strata": {f"{s}/{g}": v for (s, g), v in sorted(strata.items())}, "empty": [f"{s}/{g}" for s in ("train", "val", "test") for g in ("real", *names) if (s, g) not in strata],
    }
    return kept, left_out, record


def corpus_problems(rows: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """``(check, rows)`` of a finished corpus: keys, labels, splits, extents, hashes and the isolation of its keys, and with ``found(path, size, sha256)`` whether its files are those it names."""
    sha = lambda c: F.col(c).rlike("^[0-9a-f]{64}\\z")
    out = catalog.violations(
        rows,
        {
            "label": F.col("label").isin(0, 1),
            "real has label 0": (F.col("generator") == "real") == (F.col("label") == 0),
            "split": F.col("split").isin("train", "val", "test"),
            "extent": (F.col("width") == F.col("crop_size")) & (F.col("height") == F.col("crop_size")),
            "crop lies inside": (F.col("crop_left") >= 0) & (F.col("crop_top") >= 0) & (F.col("crop_left") + F.col("crop_size") <= F.col("source_width")) & (F.col("crop_top") + F.col("crop_size") <= F.col("source_height")),
            "file hash": sha("sha256"),
            "pixel hash": sha("pixel_sha256"),
            "perceptual hash": F.col("phash").rlike("^[0-9a-f]{16}\\z"),
        },
    )
    again = lambda c: rows.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rows")).select(F.lit(f"{c} again").alias("check"), "rows")
    out = out.union(again("source_id")).union(again("path"))
    isolation = gates.isolation_gate(rows, "split", ("leakage_group", "group_id"), ("sha256", "pixel_sha256"))
    out = out.union(isolation.select(F.concat_ws(" ", "key", "problem").alias("check"), "rows"))
    if found is not None:
        j = rows.select("path", "file_bytes", F.col("sha256").alias("want")).join(found.select("path", "size", F.col("sha256").alias("have")), "path", "left")
        out = out.union(catalog.violations(j, {"file there": F.col("size").isNotNull(), "file size": F.col("size") == F.col("file_bytes"), "file bytes": F.col("have") == F.col("want")}))
    return out

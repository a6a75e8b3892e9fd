"""Readers: strict CSV, projected Parquet, exact rows, nested JSON, archives, file listings."""

from __future__ import annotations

import hashlib
import json
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.contracts import ContractError, TableContract


def text_csv(spark: SparkSession, path: str, columns: Sequence[str], nulls_as_empty: bool = True) -> DataFrame:
    """A CSV of strings, nothing inferred; empty fields come as empty strings unless told otherwise."""
    df = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    return df.na.fill("") if nulls_as_empty else df


def header(spark: SparkSession, path: str) -> list[str]:
    """The names in the first line of a CSV file."""
    import csv

    first = spark.read.text(path).limit(1).first()
    return next(csv.reader([first[0]])) if first else []


def locked_csv(spark: SparkSession, path: str, contract: TableContract) -> DataFrame:
    """A CSV whose header must be what the contract says; longer, shorter or ill-typed rows raise when they are read."""
    problems = contract.header_problems(header(spark, path))
    if problems:
        raise ContractError("; ".join(problems))
    if contract.exact:
        return spark.read.schema(contract.schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    names = header(spark, path)
    rows = text_csv(spark, path, names, nulls_as_empty=False)
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in contract.schema.fields], *[F.col(c) for c in names if c not in contract.schema.fieldNames()])


def projected(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Parquet columns and nested leaves (``image.path``) by name; nothing else is read from the files."""
    return spark.read.parquet(path).select(*[F.col(c).alias(c.replace(".", "_")) for c in columns])


def _place(path: str):
    """The file system of a path and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def leaf_problems(spark: SparkSession, path: str, leaves: Sequence[str]) -> list[str]:
    """Which of the leaves (``image.path``) a Parquet table's footer lacks, and which are no leaves."""
    schema, out = spark.read.parquet(path).schema, []
    for leaf in leaves:
        at: T.DataType | None = schema
        for name in leaf.split("."):
            at = at[name].dataType if isinstance(at, T.StructType) and name in at.fieldNames() else None
        if at is None:
            out.append(f"missing {leaf}")
        elif isinstance(at, T.StructType):
            out.append(f"{leaf} is no leaf")
    return out


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """``(file, group, first, rows)`` of the row groups of a Parquet file or folder, from the footers alone; a task reads its files' footers."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path).select("path")

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p in b.column(0).to_pylist():
                fs, where = _place(p)
                with fs.open_input_file(where) as f:
                    meta, first = pq.ParquetFile(f).metadata, 0
                for g in range(meta.num_row_groups):
                    rows.append((p, g, first, meta.row_group(g).num_rows))
                    first += rows[-1][3]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["file", "group", "first", "rows"])

    return listed.mapInArrow(footers, "file string, group int, first long, rows long")


def exact_rows(spark: SparkSession, path: str, wanted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(row_index, columns)`` of the rows whose numbers within the file are in ``wanted(row_index)``; raises when read if a number isn't there.

    Only row groups that hold a wanted row are opened, and of them only the
    columns asked for.  ``path`` is one file, or a folder of one; a task takes a
    group.  A row group's bounds are a row each and are broadcast only if Spark finds them small.
    """
    found = spark.read.parquet(path)
    kinds = ", ".join(f"`{c}` {found.schema[c].dataType.simpleString()}" for c in columns)
    groups = row_groups(spark, path)
    numbers = wanted.select(F.col("row_index").cast("long").alias("row_index")).where("row_index is not null").distinct()
    inside = (F.col("row_index") >= F.col("first")) & (F.col("row_index") < F.col("first") + F.col("rows"))
    placed = numbers.join(groups, inside, "left").withColumn("file", F.when(F.col("file").isNull(), F.raise_error(F.lit("a wanted row is not in the file"))).otherwise(F.col("file")))

    def read(table: pa.Table) -> pa.Table:
        fs, where = _place(table["file"][0].as_py())
        at = pa.compute.subtract(table["row_index"], table["first"])
        with fs.open_input_file(where) as f:
            rows = pq.ParquetFile(f).read_row_group(table["group"][0].as_py(), columns=list(columns)).select(list(columns)).take(at)
        return pa.table({"row_index": table["row_index"], **{c: rows[c] for c in columns}})

    return placed.groupBy("file", "group").applyInArrow(read, f"row_index long, {kinds}")


MAPPING = "map<string, struct<image_id: bigint, image_name: string, captions: array<struct<caption_id: bigint, caption: string>>>>"


def caption_mapping(lines: DataFrame, column: str = "value") -> DataFrame:
    """``(parent, image_id, image_name, caption_id, caption)`` from JSON objects that map a parent number to its image and captions."""
    parents = lines.select(F.explode(F.from_json(column, MAPPING)).alias("parent", "m"))
    return parents.select(F.col("parent").try_cast("long").alias("parent"), "m.image_id", "m.image_name", F.explode("m.captions").alias("c")).select("parent", "image_id", "image_name", "c.caption_id", "c.caption")


def mapping_problems(mapping: DataFrame) -> DataFrame:
    """One row: parents that aren't whole numbers, captions that come twice, captions without text."""
    per = mapping.groupBy("caption_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("parent").isNull()).alias("bad"), F.count_if(F.coalesce(F.trim("caption"), F.lit("")) == "").alias("blank"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per.agg(zero(F.col("bad")).alias("bad_parents"), F.count_if(F.col("n") > 1).alias("repeated_captions"), zero(F.col("blank")).alias("blank_captions"))


def archive_members(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """``(archive, member, content)``: the text members of zip files, each archive opened by one task where it lies and read a member at a time, its checksums verified."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for where in b["path"]:
                fs, at = _place(where)
                with fs.open_input_file(at) as f, zipfile.ZipFile(f) as z:
                    for name in z.namelist():
                        if name.endswith(suffix):
                            yield pd.DataFrame({"archive": [where], "member": [name], "content": [z.read(name).decode()]})

    return spark.read.format("binaryFile").load(path).select("path").mapInPandas(unpack, "archive string, member string, content string")


ANNOTATIONS = "struct<licenses: array<struct<id: int, name: string, url: string>>, images: array<struct<id: bigint, file_name: string, license: int>>, annotations: array<struct<id: bigint, image_id: bigint, caption: string>>>"


def annotations(members: DataFrame) -> dict[str, DataFrame]:
    """``licenses``, ``images`` and ``annotations`` of archive members as tables with the member's name."""
    parsed = members.select("member", F.from_json("content", ANNOTATIONS).alias("a"))
    return {k: parsed.select("member", F.explode(f"a.{k}").alias("x")).select("member", "x.*") for k in ("licenses", "images", "annotations")}


def files(spark: SparkSession, path: str, glob: str = "*", hashes: bool = False, chunk: int = 8 << 20) -> DataFrame:
    """``(path, size, modified)`` of files below a folder, with ``sha256`` and ``md5`` of their bytes if asked for.

    Bytes are read ``chunk`` by ``chunk`` where the file lies, so a file may be of
    any size.  Files without bytes are not listed.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    if not hashes:
        return rows

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: list[tuple[str, str]] = []
            for p in b.column(0).to_pylist():
                fs, where = _place(p)
                both = hashlib.sha256(), hashlib.md5()
                with fs.open_input_stream(where) as f:
                    while part := f.read(chunk):
                        for d in both:
                            d.update(part)
                sums.append(tuple(d.hexdigest() for d in both))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([x[k] for x in sums], pa.string()) for k in (0, 1))], ["path", "size", "modified", "sha256", "md5"])

    return rows.mapInArrow(digest, "path string, size long, modified timestamp, sha256 string, md5 string")


def missing_files(rows: DataFrame, path: str, found: DataFrame) -> DataFrame:
    """The rows whose path no listed file has."""
    return rows.join(found.select(F.col("path").alias("__found")), F.col(path) == F.col("__found"), "left_anti")


def verified(found: DataFrame, lock: DataFrame) -> DataFrame:
    """Files of a lock ``(path, size, sha256)`` that are missing or differ, with the reason."""
    j = lock.select("path", F.col("size").alias("want_size"), F.col("sha256").alias("want")).join(found.select("path", "size", "sha256"), "path", "left")
    why = F.when(F.col("size").isNull(), "missing").when(F.col("size") != F.col("want_size"), "size").when(F.col("sha256") != F.col("want"), "sha256")
    return j.select("path", why.alias("reason")).where("reason is not null")


def load_json(path: str, version: str) -> dict:
    """A driver-side evidence object; raises unless it is an object of that ``schema_version``."""
    with open(path, encoding="utf-8") as f:
        value = json.load(f)
    if not isinstance(value, dict) or value.get("schema_version") != version:
        raise ContractError(f"{path}: not a {version} object")
    return value


def images(spark: SparkSession, path: str, aliases: DataFrame, most_bytes: int = 12_000_000) -> DataFrame:
    """``(path, generator, source_id, bytes, sha256, oversized)`` of the image files below a folder of generator folders.

    A folder's name is reduced to its letters and digits and looked up in
    ``aliases(key, generator)``; files of unknown folders have a null generator.
    A file above ``most_bytes`` has a row, marked, but its bytes are not read.
    """
    from corpusloom.functions.scalars import alias_key

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{png,jpg,jpeg,webp,tif,tiff,bmp}").load(path)
    small = rows.where(F.col("length") <= most_bytes).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = rows.where(F.col("length") > most_bytes).select("path", "length", F.lit(None).cast("string").alias("sha256"))
    folder = F.element_at(F.split("path", "/"), -2)
    named = small.union(large).select("path", alias_key(folder).alias("key"), F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1).alias("source_id"), F.col("length").alias("bytes"), "sha256", (F.col("length") > most_bytes).alias("oversized"))
    return named.join(aliases.select("key", "generator"), "key", "left").select("path", "generator", "source_id", "bytes", "sha256", "oversized")


def completed_run(spark: SparkSession, folder: str, group: str = "leakage_group") -> tuple[DataFrame, float]:
    """The predictions of a finished run (``predictions.csv``) and its threshold (``threshold.json``); raises unless every prediction has a group."""
    names = header(spark, f"{folder}/predictions.csv")
    lacking = [c for c in ("path", "label", "score", group) if c not in names]
    if lacking:
        raise ContractError(f"predictions lack {lacking}")
    rows = text_csv(spark, f"{folder}/predictions.csv", names, nulls_as_empty=False)
    rows = rows.withColumns({"label": F.col("label").try_cast("int"), "score": F.col("score").try_cast("double")})
    bad = rows.where(F.col(group).isNull() | (F.trim(group) == "") | F.col("label").isNull() | F.col("score").isNull())
    if not bad.isEmpty():
        raise ContractError("a prediction has no group, label or score")
    with open(f"{folder.removeprefix('file://')}/threshold.json", encoding="utf-8") as f:
        return rows, float(json.load(f)["threshold"])

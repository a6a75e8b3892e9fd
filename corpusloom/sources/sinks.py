"""Writers: locked columns, no overwriting, canonical JSON, resumable appends."""

from __future__ import annotations

import hashlib
import json
import math
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from corpusloom.operators.contracts import ContractError


def write_locked(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str], fmt: str = "csv") -> None:
    """Exactly these columns, sorted (by ranges, so several files keep the order), to a folder that must not exist; an unknown column raises."""
    unknown = [c for c in df.columns if c not in columns]
    if unknown or any(c not in df.columns for c in columns):
        raise ContractError(f"columns {df.columns} are not {list(columns)}")
    df.select(*columns).orderBy(*order).write.mode("errorifexists").option("header", True).format(fmt).save(path)


def canonical(value: object) -> str:
    """JSON with sorted keys, two blanks of indent, a line end, and null for numbers that are not finite."""

    def clean(v):
        if isinstance(v, dict):
            return {str(k): clean(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [clean(x) for x in v]
        return None if isinstance(v, float) and not math.isfinite(v) else v

    return json.dumps(clean(value), sort_keys=True, indent=2, ensure_ascii=False, allow_nan=False) + "\n"


def write_evidence(value: dict, path: str) -> str:
    """Write an evidence object to a file that must not exist; returns its SHA-256."""
    text = canonical(value).encode()
    fd = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL)
    with os.fdopen(fd, "wb") as f:
        f.write(text)
    return hashlib.sha256(text).hexdigest()


def file_sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def append_missing(spark: SparkSession, wanted: DataFrame, path: str, key: str) -> int:
    """Append the rows of ``wanted`` whose key the Parquet table at ``path`` lacks; returns how many.  A rerun appends nothing."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    before = spark.read.parquet(path).count() if there else 0
    rows = wanted.dropDuplicates([key])
    if there:
        rows = rows.join(spark.read.parquet(path).select(key), key, "left_anti").select(*wanted.columns)
    rows.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def promote(spark: SparkSession, partial: str, final: str, wanted: DataFrame, key: str, columns: Sequence[str], order: Sequence[str]) -> int:
    """Write a table that ``append_missing`` filled to its final folder, sorted, once it holds every wanted key and no other; returns how many keys it still lacks.

    Nothing is written before that, and a final folder that is there already raises.
    """
    have = spark.read.parquet(partial)
    lacking = wanted.select(key).distinct().join(have.select(key), key, "left_anti").count()
    if lacking:
        return lacking
    if not have.select(key).join(wanted.select(key).distinct(), key, "left_anti").isEmpty():
        raise ContractError("the partial table holds keys that nobody asked for")
    write_locked(have.select(*columns), final, columns, order, "parquet")
    return 0


def write_evaluation(predictions: DataFrame, metrics: DataFrame, protocol: dict, folder: str) -> str:
    """Predictions as CSV, a metric table and a protocol as canonical JSON, in a folder that must not exist; returns the protocol's SHA-256.

    The metric table is a row a condition and scope, short by nature.
    """
    local = folder.removeprefix("file://")
    os.makedirs(local)
    predictions.write.mode("errorifexists").option("header", True).csv(f"file://{local}/predictions")
    write_evidence({"rows": [r.asDict(True) for r in metrics.collect()]}, f"{local}/metrics.json")
    return write_evidence(protocol, f"{local}/protocol.json")

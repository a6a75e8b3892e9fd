"""Fail-closed evidence: locks, summaries and their chain of hashes, on the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from corpusloom.operators.contracts import ContractError
from corpusloom.operators.gates import check_record
from corpusloom.sources.sinks import file_sha256


def source_lock(files: DataFrame, repository: str, revision: str) -> dict:
    """The identity of a source: its files in order with sizes and hashes.  Files are the shards of a source, a list by nature short of its rows."""
    rows = [r.asDict() for r in files.select("path", "size", "sha256").orderBy("path").collect()]
    if len({r["path"] for r in rows}) != len(rows):
        raise ContractError("a path comes twice")
    return {"schema_version": "source-lock-v1", "repository": repository, "revision": revision, "shards": rows, "bytes": sum(r["size"] for r in rows)}


def chain(inputs: Mapping[str, str]) -> dict[str, str]:
    """SHA-256 of each named input file."""
    return {k: file_sha256(p) for k, p in sorted(inputs.items())}


def verify_chain(recorded: Mapping[str, str], inputs: Mapping[str, str]) -> None:
    """Raise unless the files are those of the record, no more and no fewer."""
    now = chain(inputs)
    if now != dict(recorded):
        raise ContractError("inputs differ: " + ", ".join(sorted(k for k in {*now, *recorded} if now.get(k) != recorded.get(k))))


def gate(name: str, problems: DataFrame, count: str = "rows") -> dict:
    """A gate over a violation table: passed if all counts are 0; the counts are part of the record."""
    rows = {r[0]: r[1] for r in problems.select(problems.columns[0], count).collect()}  # a row a check
    return {"gate": name, "passed": not any(rows.values()), "violations": rows}


def require(gates: Sequence[dict]) -> None:
    failed = [g["gate"] for g in gates if not g["passed"]]
    if failed:
        raise ContractError("gates failed: " + ", ".join(failed))


def same_signature(runs: Sequence[Mapping], fields: Sequence[str]) -> None:
    """Raise unless all runs agree on the fields."""
    for f in fields:
        if len({repr(r.get(f)) for r in runs}) > 1:
            raise ContractError(f"runs differ in {f}")


def archive_record(files: DataFrame, name: str, expected_sha256: str | None = None, expected_bytes: int | None = None) -> dict:
    """What is known of one archive of a hashed listing: size, both hashes, and whether they are those expected (None where nothing is)."""
    rows = files.where(files["path"].endswith("/" + name)).select("path", "size", "sha256", "md5").collect()
    if len(rows) != 1:
        raise ContractError(f"{len(rows)} files are named {name}")
    r = rows[0]
    return {
        "name": name, "bytes": r["size"], "sha256": r["sha256"], "md5": r["md5"], "bytes_match": None if expected_bytes is None else r["size"] == expected_bytes,
        "sha256_matches": None if expected_sha256 is None else r["sha256"] == expected_sha256,
    }


def environment(spark) -> dict:
    """What a run depends on: versions and the session's settings that change plans."""
    import platform

    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.session.timeZone", "spark.sql.ansi.enabled")
    return {"python": platform.python_version(), "spark": spark.version, "master": spark.sparkContext.master, "settings": {n: spark.conf.get(n, None) for n in names}}


def launch_record(path: str, counts: DataFrame, options: Mapping[str, object], resolved: Mapping[str, object]) -> dict:
    """The identity of a manifest file at a launch, its rows a split (``gates.row_counts``), and the options as asked for and as resolved."""
    rows = {r["split"]: r["rows"] for r in counts.collect()}  # a row a split
    total = rows.pop(None, 0)
    return {"schema_version": "launch-v1", "path": path, "sha256": file_sha256(path), "rows": {"total": total, "by_split": rows}, "requested": dict(options), "resolved": dict(resolved)}


def validated_manifest(path: str, summary: Mapping, version: str, rows: int) -> None:
    """Raise ``ContractError`` unless a summary of that version names this very file and its number of rows."""
    import os

    problems = check_record(summary, {"schema_version": version, "artifacts.manifest": os.path.basename(path), "manifest_sha256": file_sha256(path), "counts.rows": rows})
    if problems:
        raise ContractError("; ".join(problems))

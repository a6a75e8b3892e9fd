"""Readers and writers on small files, downloads against an opener that fails."""

import hashlib
import io
import json
import os

import pytest

from corpusloom.operators import evidence
from corpusloom.operators.contracts import ContractError
from corpusloom.sources import download, files, sinks


def test_exact_rows_open_only_the_groups_they_need(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    os.makedirs(tmp_path / "p")
    pq.write_table(pa.table({"id": list(range(100)), "v": [f"v{k}" for k in range(100)], "big": ["x"] * 100}), tmp_path / "p" / "a.parquet", row_group_size=10)
    groups = {(r["group"], r["first"], r["rows"]) for r in files.row_groups(spark, f"{tmp_path}/p").collect()}
    assert groups == {(k, 10 * k, 10) for k in range(10)}
    for path in (f"{tmp_path}/p", f"{tmp_path}/p/a.parquet"):
        want = spark.createDataFrame([(3,), (47,), (47,), (99,), (None,)], "row_index long")
        got = files.exact_rows(spark, path, want, ["v", "id"])
        assert got.columns == ["row_index", "v", "id"] and {tuple(r) for r in got.collect()} == {(k, f"v{k}", k) for k in (3, 47, 99)}
    with pytest.raises(Exception, match="not in the file"):
        files.exact_rows(spark, f"{tmp_path}/p", spark.createDataFrame([(100,)], "row_index long"), ["id"]).collect()
    assert files.leaf_problems(spark, f"{tmp_path}/p", ["id", "gone", "id.x"]) == ["missing gone", "missing id.x"]


def test_hashes_are_taken_chunk_by_chunk(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x" * 100_000)
    (tmp_path / "b.bin").write_bytes(b"")
    found = files.files(spark, str(tmp_path), "*.bin", hashes=True, chunk=1000)
    got = {os.path.basename(r["path"]): (r["size"], r["sha256"], r["md5"]) for r in found.collect()}
    assert got == {n: (len(b), hashlib.sha256(b).hexdigest(), hashlib.md5(b).hexdigest()) for n, b in [("a.bin", b"x" * 100_000)]}
    record = evidence.archive_record(found, "a.bin", got["a.bin"][1], 5)
    assert record["sha256_matches"] is True and record["bytes_match"] is False and record["md5"] == got["a.bin"][2]
    with pytest.raises(ContractError):
        evidence.archive_record(found, "c.bin")
    rows = spark.createDataFrame([(f"file:{tmp_path}/a.bin",), ("file:/nowhere",)], "path string")
    assert [r["path"] for r in files.missing_files(rows, "path", found).collect()] == ["file:/nowhere"]
    assert evidence.environment(spark)["spark"] == spark.version


def test_large_images_have_a_row(spark, tmp_path):
    os.makedirs(tmp_path / "Gen-1")
    (tmp_path / "Gen-1" / "a.png").write_bytes(b"small")
    (tmp_path / "Gen-1" / "b.png").write_bytes(b"l" * 500)
    aliases = spark.createDataFrame([("gen1", "one")], "key string, generator string")
    got = {r["source_id"]: (r["generator"], r["bytes"], r["sha256"], r["oversized"]) for r in files.images(spark, str(tmp_path), aliases, 100).collect()}
    assert got == {"a": ("one", 5, hashlib.sha256(b"small").hexdigest(), False), "b": ("one", 500, None, True)}


BODY = bytes(range(256)) * 40
SUM = hashlib.sha256(BODY).hexdigest()


def flaky(breaks, asked):
    """Serves ranges, but drops the connection after 100 bytes for the first ``breaks`` calls."""

    def open_range(url, first, last):
        asked.append((first, last))
        if len(asked) <= breaks:
            if len(asked) % 2:
                raise OSError("down")
            return io.BytesIO(BODY[first : min(last + 1, first + 100)])
        return io.BytesIO(BODY[first : last + 1])

    return open_range


@pytest.mark.parametrize("workers", [1, 4])
def test_download_resumes_and_verifies(tmp_path, workers):
    target, asked = str(tmp_path / "d" / "file"), []
    assert download.fetch("u", target, len(BODY), SUM, flaky(4, asked), 3000, workers, pause=0) == target
    assert open(target, "rb").read() == BODY and not os.path.exists(target + ".parts")
    n = len(asked)
    assert download.fetch("u", target, len(BODY), SUM, flaky(0, asked), 3000, workers) == target and len(asked) == n
    with pytest.raises(ValueError, match="another file"):
        download.fetch("u", target, len(BODY), "0" * 64, flaky(0, asked), 3000)


def test_download_takes_up_what_is_left(tmp_path):
    target, asked = str(tmp_path / "file"), []
    with pytest.raises(OSError):
        download.fetch("u", target, len(BODY), SUM, flaky(99, asked), 1 << 20, 1, attempts=2, pause=0)
    asked.clear()
    download.fetch("u", target, len(BODY), SUM, flaky(0, asked), 1 << 20, 1)
    assert asked[0][0] == 100 and open(target, "rb").read() == BODY
    with pytest.raises(ValueError, match="size and hash"):
        download.fetch("u", str(tmp_path / "other"), len(BODY), "1" * 64, flaky(0, []), 3000)
    assert not os.path.exists(tmp_path / "other")
    with pytest.raises(ValueError):
        download.fetch("u", target, 0, SUM, flaky(0, []))


def test_partial_tables_are_promoted_when_complete(spark, tmp_path):
    wanted = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    sinks.append_missing(spark, wanted.where("id = 2"), f"{tmp_path}/p", "id")
    assert sinks.promote(spark, f"{tmp_path}/p", f"{tmp_path}/f", wanted, "id", ["id", "v"], ["id"]) == 1
    assert not os.path.exists(tmp_path / "f")
    sinks.append_missing(spark, wanted, f"{tmp_path}/p", "id")
    assert sinks.promote(spark, f"{tmp_path}/p", f"{tmp_path}/f", wanted, "id", ["id", "v"], ["id"]) == 0
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/f").orderBy("id").collect()] == [(1, "a"), (2, "b")]
    with pytest.raises(ContractError):
        sinks.promote(spark, f"{tmp_path}/p", f"{tmp_path}/g", wanted.where("id = 1"), "id", ["id", "v"], ["id"])


def test_runs_are_written_and_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 0.5, "g"), ("b", 0, 0.1, "h")], "path string, label int, score double, leakage_group string")
    digest = sinks.write_evaluation(rows, rows.groupBy("label").count(), {"schema_version": "v"}, f"{tmp_path}/run")
    assert digest == hashlib.sha256((tmp_path / "run" / "protocol.json").read_bytes()).hexdigest() and len(json.loads((tmp_path / "run" / "metrics.json").read_text())["rows"]) == 2
    with pytest.raises(FileExistsError):
        sinks.write_evaluation(rows, rows, {}, f"{tmp_path}/run")
    os.makedirs(tmp_path / "done")
    (tmp_path / "done" / "threshold.json").write_text('{"threshold": 0.25}')
    (tmp_path / "done" / "predictions.csv").write_text("path,label,score,leakage_group\na,1,0.5,g\n")
    got, threshold = files.completed_run(spark, f"file://{tmp_path}/done")
    assert threshold == 0.25 and got.first()["score"] == 0.5
    for text, why in (("path,label,score\na,1,0.5\n", "lack"), ("path,label,score,leakage_group\na,1,0.5,\n", "no group")):
        (tmp_path / "done" / "predictions.csv").write_text(text)
        with pytest.raises(ContractError, match=why):
            files.completed_run(spark, f"file://{tmp_path}/done")

"""Small exact cases, brute force and failure paths of the core operators."""

import hashlib
import json
import random
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import scalars
from corpusloom.operators import bootstrap, catalog, components, contracts, dedup, evidence, experiments, gates, kernels, manifests, metrics, ml, selection
from corpusloom.plans import audits
from corpusloom.scratch import Scratch
from corpusloom.sources import files, paged, sinks
from corpusloom.streaming import increments


def test_contract(spark):
    c = contracts.TableContract(T.StructType().add("path", "string").add("label", "integer"), key=("path",), domains={"label": (0, 1)}, forbidden=("bytes",))
    good = spark.createDataFrame([("a", 0), ("b", 1)], "path string, label int")
    assert c.enforce(good) is good
    for bad in (spark.createDataFrame([("a", 2)], "path string, label int"), spark.createDataFrame([("a", 0), ("a", 1)], "path string, label int"), good.withColumn("bytes", F.lit(1)), good.drop("label"), good.withColumn("label", F.lit(None).cast("int"))):
        with pytest.raises(contracts.ContractError):
            c.enforce(bad)
    assert contracts.TableContract(c.schema, exact=True).header_problems(["label", "path"])


def test_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text("path,label\na,1\nb,\n")
    c = contracts.TableContract(T.StructType().add("path", "string").add("label", "integer"))
    assert files.locked_csv(spark, f"file://{tmp_path}/m.csv", c).count() == 2
    assert files.text_csv(spark, f"file://{tmp_path}/m.csv", ["path", "label"]).collect()[1][1] == ""
    (tmp_path / "n.csv").write_text("path,other\na,1\n")
    with pytest.raises(contracts.ContractError):
        files.locked_csv(spark, f"file://{tmp_path}/n.csv", c)


def test_nested_projection_reads_one_leaf(spark, tmp_path):
    df = spark.createDataFrame([((bytearray(b"x"), "a.jpg"), 1), ((bytearray(b"y"), "b.jpg"), 2)], "image struct<bytes: binary, path: string>, id int")
    df.coalesce(1).write.parquet(f"{tmp_path}/p")
    out = files.projected(spark, f"{tmp_path}/p", ["image.path", "id"])
    assert "bytes" not in out._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    want = spark.createDataFrame([(1,)], "row_index long")
    assert [r["id"] for r in files.exact_rows(spark, f"{tmp_path}/p", want, ["id"]).collect()] == [2]
    with pytest.raises(Exception, match="not in the file"):
        files.exact_rows(spark, f"{tmp_path}/p", spark.createDataFrame([(9,)], "row_index long"), ["id"]).collect()


def test_mapping_and_archive(spark, tmp_path):
    m = {"7": {"image_id": 7, "image_name": "7.jpg", "captions": [{"caption_id": 1, "caption": "cat"}, {"caption_id": 2, "caption": " "}]}, "x": {"image_id": 8, "image_name": "8.jpg", "captions": [{"caption_id": 2, "caption": "d"}]}}
    rows = files.caption_mapping(spark.createDataFrame([(json.dumps(m),)], "value string"))
    assert rows.count() == 3 and tuple(files.mapping_problems(rows).first()) == (1, 1, 1)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("captions.json", json.dumps({"licenses": [{"id": 1, "name": "n", "url": "u"}], "images": [{"id": 7, "file_name": "7.jpg", "license": 1}], "annotations": [{"id": 1, "image_id": 7, "caption": "cat"}]}))
    a = files.annotations(files.archive_members(spark, f"{tmp_path}/a.zip"))
    assert a["images"].join(a["annotations"], a["images"]["id"] == a["annotations"]["image_id"]).count() == 1
    lock = evidence.source_lock(files.files(spark, str(tmp_path), "*.zip", hashes=True), "r", "0" * 40)
    assert len(lock["shards"]) == 1
    gone = spark.createDataFrame([("nowhere", 1, "x")], "path string, size long, sha256 string")
    assert files.verified(files.files(spark, str(tmp_path), "*.zip", hashes=True), gone).first()["reason"] == "missing"


def fetch(offset, length):
    return [{"row_index": k, "content": f"row {k}"} for k in range(offset, offset + length)]


def test_paged_source(spark):
    reader = paged.PagedReader({"total": "250", "page": "100", "source": f"{__name__}:fetch"})
    parts = reader.partitions()
    assert [p.length for p in parts] == [100, 100, 50]
    assert sum(len(list(reader.read(p))) for p in parts) == 250


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "id int, v string")
    sinks.write_locked(df, f"{tmp_path}/o", ["id", "v"], ["id"])
    with pytest.raises(Exception, match="exists"):
        sinks.write_locked(df, f"{tmp_path}/o", ["id", "v"], ["id"])
    with pytest.raises(contracts.ContractError):
        sinks.write_locked(df.withColumn("w", F.lit(1)), f"{tmp_path}/q", ["id", "v"], ["id"])
    assert sinks.append_missing(spark, df, f"{tmp_path}/r", "id") == 2
    assert sinks.append_missing(spark, df.union(spark.createDataFrame([(3, "c")], "id int, v string")), f"{tmp_path}/r", "id") == 1
    assert json.loads(sinks.canonical({"b": float("nan"), "a": [1]})) == {"a": [1], "b": None}
    digest = sinks.write_evidence({"schema_version": "v"}, f"{tmp_path}/e.json")
    assert evidence.chain({"e": f"{tmp_path}/e.json"}) == {"e": digest}
    with pytest.raises(FileExistsError):
        sinks.write_evidence({}, f"{tmp_path}/e.json")
    with pytest.raises(contracts.ContractError):
        evidence.verify_chain({"e": "0"}, {"e": f"{tmp_path}/e.json"})


def test_stream_appends_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, v string")
    df.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        increments.append_new(spark, f"{tmp_path}/in", df.schema, f"{tmp_path}/out", f"{tmp_path}/c", "id").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_scalars(spark):
    df = spark.createDataFrame([(" Cat  A ", "k1", "12_34.jpg"), ("", "k2", "012_3.jpg"), (None, "k3", None)], "t string, k string, f string")
    ends = spark.createDataFrame([("512\n", "5_6.jpg\n")], "n string, f string")
    assert tuple(ends.select(manifests.canonical_integer(F.col("n")), scalars.geometry(F.col("n"), F.col("n")), scalars.pair_of_name(F.col("f"))[0]).first()) == (None, "(invalid)", None)
    h = [r[0] for r in df.select(scalars.text_hash(F.col("t"), F.col("k"))).collect()]
    assert len(set(h)) == 3 and h[0] == spark.sql("select sha2('cat a', 256)").first()[0]
    p, c = scalars.pair_of_name(F.col("f"))
    assert [tuple(r) for r in df.select(p, c).collect()] == [(12, 34), (None, None), (None, None)]
    for part in (0, 1):
        want = []
        for k in ("k1", "k2", "k3"):
            word = int.from_bytes(hashlib.sha256(f"crop:7:{k}".encode()).digest()[8 * part : 8 * part + 8], "big")
            want.append(round(word / (2**64 - 1) * 999))
        assert [r[0] for r in df.select(scalars.crop_offset(F.lit("crop:7"), F.col("k"), part, F.lit(999))).collect()] == want


def test_quotas_of_the_stratified_split(spark):
    df = spark.createDataFrame([(i, 2 if i < 20 else 4) for i in range(40)], "parent int, licence int")
    out = selection.largest_remainder_split(df, "licence", F.sha2(F.col("parent").cast("string"), 256), "parent", [("train", 0.7), ("val", 0.15), ("test", 0.15)])
    assert {tuple(r) for r in out.groupBy("licence", "split").count().collect()} == {(x, s, n) for x in (2, 4) for s, n in (("train", 14), ("val", 3), ("test", 3))}


def test_ranges(spark):
    df = spark.createDataFrame([("a", i) for i in (0, 1, 99, 100, 350, 350)] + [("b", 5), ("b", None)], "g string, i long")
    assert {tuple(r) for r in selection.pack_ranges(df, "g", "i", 100).collect()} == {("a", 0, 100), ("a", 100, 1), ("a", 350, 1), ("b", 5, 1)}


@pytest.mark.parametrize("longest,blocks", [(100, 4096), (7, 1), (10, 3)])
def test_ranges_across_chunks(spark, longest, blocks):
    rng = random.Random(longest)
    rows = {("dense", i) for i in range(-40, 300)} | {("sparse", rng.randrange(2000)) for _ in range(150)} | {("one", 5)}
    want = set()
    for g in {g for g, _ in rows}:
        at = sorted(i for h, i in rows if h == g)
        while at:
            inside = [i for i in at if i < at[0] + longest]
            want.add((g, at[0], inside[-1] - at[0] + 1))
            at = at[len(inside) :]
    got = selection.pack_ranges(spark.createDataFrame(sorted(rows), "g string, i long"), "g", "i", longest, blocks).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_budget_of_skewed_sizes(spark):
    sizes = [10**12] + [k % 7 for k in range(500)] + [None]
    out = selection.running_budget(spark.createDataFrame(list(enumerate(sizes)), "id int, size long"), "size", "id", 10**12 + 100, levels=16).collect()
    order = sorted(enumerate(s or 0 for s in sizes), key=lambda x: (-x[1], x[0]))
    got = {r["id"]: r for r in out}
    total = 0
    for place, (i, s) in enumerate(order, 1):
        assert (got[i]["processing_order"], got[i]["before"], got[i]["peak"]) == (place, total, total + 2 * s)
        total += s
        assert got[i]["within"] is (total <= 10**12 + 100)


def test_epochs_and_weighted_draws(spark):
    rows = [(f"g{g}", y, "x", f"{g}-{y}-{k}") for g in range(60) for y in (0, 1) for k in range(3)] + [(None, 0, "x", "n"), ("lone", 1, "x", "l")]
    df = spark.createDataFrame(rows, "g string, label int, kind string, row string")
    epochs = [selection.epoch_pairs(df, "g", "label", "kind", e).orderBy("position").collect() for e in (0, 1, 0)]
    assert epochs[0] == epochs[2] != epochs[1] and [r["position"] for r in epochs[0]] == list(range(1, 61))
    assert all(r["real"].startswith(r["g"][1:] + "-0-") and r["fake"].startswith(r["g"][1:] + "-1-") for r in epochs[1])
    uneven = spark.range(4000).select(F.col("id").cast("string").alias("row"), (F.col("id") < 400).cast("int").alias("label")).union(spark.createDataFrame([("x", None)], "row string, label int"))
    n = {r["label"]: r["n"] for r in selection.weighted_draws(uneven, "label", 10_000, 0).groupBy("label").agg(F.sum("times").alias("n")).collect()}
    assert set(n) == {0, 1} and abs(n[0] - 5000) < 250 and abs(n[1] - 5000) < 250


@pytest.mark.parametrize("distance", [0, 4, 8])
def test_near_links_equal_brute_force(spark, distance):
    rng = random.Random(distance)
    values = [rng.getrandbits(64) for _ in range(60)]
    values += [v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 10))) for v in values * 3]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    rows = [(i, i % 7, v) for i, v in enumerate(signed)] + [(999, 1, None)]
    got = {tuple(r) for r in dedup.near_links(spark.createDataFrame(rows, "id int, g int, x long"), "id", "g", "x", distance).collect()}
    want = {(i, j, (values[i] ^ values[j]).bit_count()) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= distance and i % 7 != j % 7}
    assert got == {(min(i, j), max(i, j), d) for i, j, d in want}


def test_components_equal_union_find(spark, scratch):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(400 + i, 401 + i) for i in range(60)] + [(0, None)]
    root = {v: v for e in edges for v in e if v is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        if v is not None:
            a, b = sorted((find(u), find(v)))
            root[b] = a
    got = {r["id"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "u int, v int"), scratch).collect()}
    touched = {v for e in edges if None not in e and e[0] != e[1] for v in e}
    assert got == {v: find(v) for v in touched}
    assert components.connected(spark.createDataFrame([], "u int, v int"), scratch).count() == 0


def test_allocation(spark):
    members = spark.createDataFrame([(f"{c}-{k}", f"c{c}") for c in range(200) for k in range(2 + c % 3)], "id string, root string")
    records = members.select("id", F.when(F.col("id").endswith("-0"), "real").otherwise("fake").alias("generator"))
    out = components.allocate(members, records, "id", "generator", (("train", 0.7), ("val", 0.15), ("test", 0.15)))
    got = {r["root"]: r["split"] for r in out.collect()}
    assert len(got) == 200 and got == {r["root"]: r["split"] for r in components.allocate(members.repartition(5), records, "id", "generator", (("train", 0.7), ("val", 0.15), ("test", 0.15))).collect()}
    for kind in ("real", "fake"):
        n = {s: 0 for s in ("train", "val", "test")}
        for r in records.join(members, "id").where(F.col("generator") == kind).collect():
            n[got[r["root"]]] += 1
        assert all(abs(n[s] / sum(n.values()) - w) < 0.02 for s, w in (("train", 0.7), ("val", 0.15), ("test", 0.15)))
    assert components.allocate(members.where("false"), records, "id", "generator", (("train", 1.0),)).count() == 0


def predictions(spark, rows):
    return spark.createDataFrame(rows, "g string, label int, score double")


def test_metrics_of_a_perfect_and_a_single_class_table(spark):
    df = predictions(spark, [("a", 0, 0.05), ("a", 1, 0.8), ("b", 0, 0.2), ("b", 1, 0.95)])
    points = metrics.curve(df, [])
    assert metrics.roc_auc(points, []).first()[0] == 1.0 and metrics.average_precision(points, []).first()[0] == 1.0
    t = metrics.best_threshold(points, []).first()
    assert 0.2 < t["threshold"] <= 0.8 and t["balanced_accuracy"] == 1.0
    r = metrics.group_ranking(df, [], "g").first()
    assert (r["macro_rate"], r["pairs"], r["groups"]) == (1.0, 2, 2)
    one = metrics.summary(df.where("label = 1"), ["label"], 0.5).first()
    assert one["roc_auc"] != one["roc_auc"] and one["balanced_accuracy"] != one["balanced_accuracy"]


def test_intervals_of_a_perfect_score(spark, scratch):
    df = predictions(spark, [(f"{g}{k}", y, s) for k in range(9) for g, y, s in (("a", 0, 0.05), ("a", 1, 0.8), ("b", 0, 0.2), ("b", 1, 0.95))] + [("c", 1, None)])
    got = {r["metric"]: tuple(r)[1:] for r in bootstrap.cluster_intervals(df.na.drop(), [], "g", 0.5, scratch, 30).collect()}
    assert got["roc_auc"] == got["balanced_accuracy"] == got["macro_f1"] == (1.0, 1.0, 1.0, 30) and got["fpr_at_tpr_95"] == (0.0, 0.0, 0.0, 30)
    with pytest.raises(Exception, match="no cluster"):
        bootstrap.cluster_intervals(df.withColumn("g", F.lit(None).cast("string")), [], "g", 0.5, scratch, 3).collect()
    with pytest.raises(ValueError, match="only left: 2"):
        bootstrap.paired_intervals(df.withColumn("k", F.col("g")).limit(3).dropDuplicates(["k"]), df.withColumn("k", F.col("g")).where("false"), "k", "g", (0.5, 0.5), scratch, 3)


def test_score_buckets_follow_the_scores(spark):
    rng = random.Random(4)
    values = sorted({0.0, 1.0, 0.5, 0.25, *(rng.random() for _ in range(300)), *(2.0**-k for k in range(70)), *(1 - 2.0**-k for k in range(50)), *(1e-9 * rng.random() for _ in range(300))})
    got = [r["b"] for r in spark.createDataFrame([(v,) for v in values], "score double").select("score", metrics.score_bucket(F.col("score")).alias("b")).orderBy("score").collect()]
    assert got == sorted(got, reverse=True) and len(set(got)) > 0.8 * len(values)


def test_auc_equals_pair_counting(spark):
    rng = random.Random(2)
    rows = [("x", rng.randint(0, 1), rng.randint(0, 20) / 20) for _ in range(200)]
    p, n = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in p for b in n) / len(p) / len(n)
    assert abs(metrics.roc_auc(metrics.curve(predictions(spark, rows), []), []).first()[0] - want) < 1e-12


def test_choice_and_seeds(spark):
    runs = spark.createDataFrame([("fft", 7, 0.8, 0.9), ("fft", 17, 0.8, 0.9), ("rgb", 7, 0.8, 0.9), ("rgb", 17, 0.8, 0.9), ("one", 7, 0.1, 0.1)], "rep string, seed int, bacc double, auc double")
    a = experiments.aggregate_seeds(runs, "rep", "seed", ["bacc", "auc"])
    assert experiments.choose(a, "rep", ["mean_bacc", "mean_auc"]).first()["rep"] == "fft"
    assert a.where("rep = 'one'").first()["std_bacc"] is None
    assert {tuple(r) for r in experiments.protocol_complete(runs, "rep", "seed", [7, 17]).collect()} == {("fft", True), ("rgb", True), ("one", False)}
    with pytest.raises(Exception, match="a seed comes twice"):
        experiments.aggregate_seeds(runs.union(runs), "rep", "seed", ["bacc"]).collect()


def test_logistic_separates(spark):
    rng = np.random.default_rng(0)
    rows = [(int(y), float(y * 2 + rng.normal()), 1.0) for y in rng.integers(0, 2, 300)]
    df = spark.createDataFrame(rows, "label int, x double, flat double")
    s = ml.score(ml.fit(df, "label", ["x", "flat"]), df, ["label"])
    assert metrics.roc_auc(metrics.curve(s, []), []).first()[0] > 0.85


def test_scores_of_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(int(y), [float(y * 2 + rng.normal()), 1.0, float(rng.normal())]) for y in rng.integers(0, 2, 300)]
    df = spark.createDataFrame(rows + [(1, [1.0]), (0, None)], "label int, v array<double>")
    whole = df.where(F.size("v") == 3)
    scaling, weights, intercept = ml.fit_vectors(whole, "label", "v", 3)
    got = ml.score_vectors(df, "v", scaling, weights, intercept)
    assert got.where("score is null").count() == 2 and metrics.roc_auc(metrics.curve(got.where("score is not null"), []), []).first()[0] > 0.85
    v = rows[0][1]
    z = intercept + sum(w * (x - m) / s for x, w, (m, s) in zip(v, weights, scaling))
    assert abs(got.first()["score"] - 1 / (1 + np.exp(-z))) < 1e-9


def test_external_records_know_their_family(spark):
    families = spark.createDataFrame([("sdxl", "SDXL", "diffusion", "new")], "key string, generator string, family string, relation string")
    listing = spark.createDataFrame([("file:/data/ext/SDXL/a.b.png", "sdxl"), ("file:/data/ext/Other/c.jpg", "other")], "path string, key string")
    got = {tuple(r) for r in manifests.external_records(listing, families, "/data/ext").collect()}
    assert got == {("SDXL/a.b.png", "a.b", "SDXL", "diffusion", "new"), ("Other/c.jpg", "c", None, None, None)}


def test_command_line(spark, tmp_path, capsys):
    from corpusloom.__main__ import main

    assert main([]) == 0 and "p2_profile" in capsys.readouterr().out.split()
    assert main(["no_such_query", "x"]) == 2
    assert main(["catalog_class_balance", "/root/testdata/sf0.001", f"{tmp_path}/out"]) == 0
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1


def test_custom_order_and_scopes(spark):
    df = spark.createDataFrame([("test", 2), ("val", 1), ("train", 3), ("else", 0), (None, 9), ("train", 1)], "split string, n int")
    assert [tuple(r) for r in selection.in_named_order(df, [("split", ["train", "val", "test"]), ("n", None)]).collect()] == [("train", 1), ("train", 3), ("val", 1), ("test", 2), ("else", 0), (None, 9)]
    rows, scope = selection.first_shards(df, "split", None)
    assert rows is df and scope == {"limit": None, "partial": False}


def test_kernels(spark):
    rng = np.random.default_rng(1)
    stack = rng.random((5, 7, 9))
    got = kernels.spectra(np.concatenate([stack, np.zeros((1, 7, 9))]))
    for raster, m in zip(stack, got):
        want = np.log1p(abs(np.fft.fftshift(np.fft.fft2(raster))))
        lo, hi = np.percentile(want, (1, 99))
        assert np.allclose(m, np.clip((want - lo) / (hi - lo), 0, 1), atol=1e-6)
    assert not got[-1].any()
    flat = kernels.ring_weights(6, 6, 4)
    assert flat.shape == (36, 4) and np.allclose(flat.sum(0), 1) and not flat[[0, 5, 30, 35]].any()  # the corners lie in no ring
    assert np.allclose(flat[14], flat[21]) and flat[14, 0] > 0  # the middle lies between the four inner cells
    df = spark.createDataFrame([(1, [float(i) for i in range(16)]), (2, [1.0]), (3, None)], "id int, r array<double>")
    assert [None if r[1] is None else len(r[1]) for r in kernels.radial_features(df, "id", "r", 4, 4, 3).orderBy("id").collect()] == [3, None, None]


def test_near_classes(spark):
    rows = [("a", "g", 7), ("b", "g", 7), ("c", "h", 6), ("d", "h", None), ("e", None, 7), ("f", "k", 1 << 40)]
    links, members = dedup.near_classes(spark.createDataFrame(rows, "id string, g string, x long"), "id", "g", "x", 4)
    assert {tuple(r) for r in links.collect()} == {("a", "c", 1, 2), ("a", "e", 0, 2), ("c", "e", 1, 1), ("c", "f", 3, 1), ("a", "f", 4, 2), ("e", "f", 4, 1)}
    assert {tuple(r) for r in members.collect()} == {("a", "a", 2), ("b", "a", 2), ("c", "c", 1), ("e", "e", 1), ("f", "f", 1)}


def joins_on_pieces(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return set(re.findall(r"(\w+Join) \[piece#", plan))


def test_pieces_of_near_classes_are_not_broadcast(spark):
    rows = spark.range(300).select(F.col("id").cast("string").alias("id"), F.expr("string(id % 7)").alias("g"), F.xxhash64("id").alias("x"))
    links, _ = dedup.near_classes(rows, "id", "g", "x", 4)
    assert joins_on_pieces(links) == {"SortMergeJoin"}  # the estimates are far below any limit, the spellings aren't


def test_pieces_of_near_links_are_not_broadcast(spark):
    rows = spark.range(300).select(F.col("id").alias("id"), (F.col("id") % 7).alias("g"), F.xxhash64(F.col("id") % 100).alias("x"))
    links = dedup.near_links(rows, "id", "g", "x", 4)
    assert joins_on_pieces(links) == {"SortMergeJoin"}
    assert links.count() == 300  # 100 values of 3 records in 3 groups, no others near


def near_by_hand(rows, distance):
    rows = {r for r in rows if r[0] is not None and r[2] is not None}
    near = {(a[0], b[0], (a[2] ^ b[2]).bit_count()) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1]}
    return sorted(x for x in near if x[2] <= distance)


def test_near_links_of_repeated_ids(spark):
    rng = random.Random(5)
    rows = [(rng.choice([f"i{i}" for i in range(60)] + [None]), rng.choice(["g", "h", "k", None]), rng.choice([None, *range(8), 1 << 40, 3 << 39])) for _ in range(160)]
    rows += rows[:40]  # single ids, repeated rows, ids of several groups or values
    assert 10 < sum(1 for i in range(60) if len({r for r in rows if r[0] == f"i{i}" and r[2] is not None}) == 1) < 50
    got = dedup.near_links(spark.createDataFrame(rows, "id string, g string, x long"), "id", "g", "x", 2)
    assert sorted(map(tuple, got.collect())) == near_by_hand(rows, 2)


def test_rows_of_near_links_are_not_broadcast(spark):
    rows = spark.range(300).select(F.col("id").alias("id"), (F.col("id") % 7).alias("g"), F.xxhash64(F.col("id") % 100).alias("x"))
    links = dedup.near_links(rows, "id", "g", "x", 4)
    assert links.count() == 300
    links.collect()
    plan = links._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert set(re.findall(r"(\w+Join) \[[te]v#", plan)) == {"SortMergeJoin"}
    assert "hashpartitioning(left_id" not in plan  # pairs of ids of one row each aren't written once more for a distinct


def test_isolation_gate_fails_closed(spark):
    df = spark.createDataFrame([("a", "g1", "c", "train"), ("b", "g1", None, "val"), ("c", " ", "c", None), ("d", "g2", "e", "test")], "id string, grp string, caption string, split string")
    got = {(r["key"], r["problem"]): r for r in gates.isolation_gate(df, "split", ("id", "grp", "gone"), ("caption", "absent")).collect()}
    assert set(got) == {("gone", "missing"), ("grp", "blank"), ("grp", "crossing"), ("caption", "crossing")}
    assert got["grp", "blank"]["rows"] == 1 and got["grp", "crossing"]["examples"] == "g1" and got["caption", "crossing"]["rows"] == 2
    gates.require_isolation(df.where("id = 'a'"), "split", ("id", "grp"), ("caption",))
    with pytest.raises(contracts.ContractError, match="gone: missing"):
        gates.require_isolation(df, "split", ("id", "gone"))
    assert gates.isolation_gate(df.where("false"), "split", ("id",)).count() == 0


def test_records_are_checked_field_by_field():
    record = {"schema": "v1", "rule": {"test_used": False, "seeds": [7, 17]}, "decision": {"threshold": 0.4, "made": 1}}
    rules = {"schema": "v1", "rule.test_used": False, "rule.seeds": lambda v: v == [7, 17], "decision.threshold": lambda v: isinstance(v, float) and 0 <= v <= 1}
    assert gates.check_record(record, rules) == []
    assert gates.check_record(record, {"decision.made": True, "rule.gone.deeper": 1, "schema": {"v2"}}) == ["decision.made is 1", "rule.gone.deeper is None", "schema is 'v1'"]


def test_manifest_rows(spark):
    df = spark.createDataFrame([("0", "r", None), ("AI-generated", "x", " A  cat "), ("fake", "r", "a CAT"), ("?", "x", "")], "y string, src string, cap string").withColumn("id", F.monotonically_increasing_id().cast("string")).withColumn("split", F.lit("validation"))
    rows = manifests.raw_manifest_rows(df, "y", "src", "cap", "id", "split", {"r": "real"}).collect()
    assert [(r["label"], r["generator"], r["consistent"]) for r in rows] == [(0, "real", True), (1, "unknown_x", True), (1, "real", False), (None, "unknown_x", None)]
    assert rows[1]["group_id"] == rows[2]["group_id"] and rows[0]["group_id"] == rows[0]["id"] and {r["split"] for r in rows} == {"val"}
    assert manifests.found_column(["Image", "LABEL_A"], ("label", "label_a")) == "LABEL_A" and manifests.found_column(["x"], ("y",), required=False) is None
    with pytest.raises(KeyError):
        manifests.found_column(["x"], ("y",))
    one = spark.createDataFrame([("007", " ", "d/i m.parquet", "a" * 40, [4, 5])], "n string, b string, p string, rev string, res array<int>")
    assert one.select(manifests.canonical_integer(F.col("n")), manifests.canonical_integer(F.lit("0"), 1), manifests.canonical_integer(F.lit("12"))).first() == (None, None, 12)
    assert one.select(manifests.shard_url("https://h/", F.lit("o/r"), F.col("rev"), F.col("p"))).first()[0] == f"https://h/o/r/resolve/{'a' * 40}/d/i+m.parquet"
    assert one.select(manifests.resolved(F.col("p"), "/root/"), manifests.resolved(F.lit("s3://x"), "/root")).first() == ("/root/d/i m.parquet", "s3://x")
    assert tuple(manifests.split_resolution(one, "res").select("width", "height").first()) == (4, 5)
    with pytest.raises(Exception, match="b is missing"):
        one.select(manifests.required_text(F.col("b"), "b")).collect()


def test_lineage_pairs_one_to_one(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string"), spark.createDataFrame([(1, 5), (2, 6)], "id int, w int")
    assert {tuple(r) for r in catalog.lineage(a, b, "id", {"u": "w"}).collect()} == {(1, "x", 5), (2, "y", 6)}
    for other in (b.union(b), b.where("id = 1")):
        with pytest.raises(Exception, match="pair one to one"):
            catalog.lineage(a, other, "id", {"u": "w"}).collect()


def test_corpus_build_records_what_it_lacks(spark, scratch):
    sha = lambda k: hashlib.sha256(str(k).encode()).hexdigest()
    rows = []
    for g in range(12):
        for y, name in ((0, "real"), (1, "a"), (1, "b")):
            k = 3 * g + "rab".index(name[0])
            rows.append((f"s{k:02}", f"g{g}", y, name, ("train", "val", "test")[g % 3], 600, 700, sha("shared" if k in (0, 3) else k), None, f"{k * 0x9E3779B97F4A7C15 % 2**64:016x}"))
    rows += [("small", "g0", 0, "real", "train", 100, 700, None, None, None), ("lone", "x", 1, "a", "train", 600, 600, None, None, None)]
    df = spark.createDataFrame(rows, "source_id string, group_id string, label int, generator string, official_split string, source_width int, source_height int, pixel_sha256 string, source_sha256 string, phash string")
    kept, out, record = audits.corpus_build(df, ["a", "b"], scratch)
    # The real rows of the groups 0 (train) and 1 (val) show the same picture.
    assert record["groups"] == 12 and record["left_out"] == {"components": 1, "rows": 4} and record["rows"] == 20 and record["empty"] == []
    assert {r["splits"] for r in out.collect()} == {"train+val"}
    got = kept.collect()
    assert {r["role"] for r in got} == {"real", "a", "b"} and len({r["component"] for r in got}) == 10 and all(r["split"] == r["official_split"] and 0 <= r["crop_left"] <= 216 for r in got)
    assert audits.corpus_build(df.where("generator != 'b'"), ["a", "b"], Scratch(spark, "empty"))[2]["rows"] == 0


def test_launches_and_summaries(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("x")
    df = spark.createDataFrame([("train",), ("val",), ("val",)], "split string")
    record = evidence.launch_record(str(path), gates.row_counts(df, "split"), {"seed": 7}, {"seed": 7, "sampler": "pairs"})
    digest = hashlib.sha256(b"x").hexdigest()
    assert record["sha256"] == digest and record["rows"] == {"total": 3, "by_split": {"train": 1, "val": 2}}
    summary = {"schema_version": "v", "artifacts": {"manifest": "m.csv"}, "manifest_sha256": digest, "counts": {"rows": 3}}
    evidence.validated_manifest(str(path), summary, "v", 3)
    path.write_text("y")
    with pytest.raises(contracts.ContractError, match="manifest_sha256"):
        evidence.validated_manifest(str(path), summary, "v", 3)


def test_corpus_files_are_checked(spark):
    sha = "a" * 64
    rows = spark.createDataFrame([("p", "s", 0, "real", "train", "g", "l", 10, 10, 10, 0, 0, 20, 20, sha, sha, "0" * 15 + "1", 5), ("q", "s", 1, "real", "test", "g", "k", 10, 9, 10, 15, 0, 20, 20, "x", sha, "1", 5)], "path string, source_id string, label int, generator string, split string, group_id string, leakage_group string, width int, height int, crop_size int, crop_left int, crop_top int, source_width int, source_height int, sha256 string, pixel_sha256 string, phash string, file_bytes long")
    found = spark.createDataFrame([("p", 5, sha)], "path string, size long, sha256 string")
    got = {r["check"]: r["rows"] for r in audits.corpus_problems(rows, found).collect()}
    assert got == {"label": 0, "real has label 0": 1, "split": 0, "extent": 1, "crop lies inside": 1, "file hash": 1, "pixel hash": 0, "perceptual hash": 1, "source_id again": 1, "path again": 0, "group_id crossing": 2, "pixel_sha256 crossing": 2, "file there": 1, "file size": 1, "file bytes": 1}


def test_windows_count_late_rows(spark, tmp_path):
    df = spark.sql("select * from values (timestamp_ntz'2024-01-01 10:59:59', 'a'), (timestamp_ntz'2024-01-01 10:00:00', 'a'), (timestamp_ntz'2023-01-01 00:00:00', 'b'), (null, 'a') as t(ts, k)")
    df.write.parquet(f"{tmp_path}/e")
    assert {(str(r[0]), r[1], r[2]) for r in increments.counted_windows(spark, f"{tmp_path}/e", "ts", "k", "1 hour").collect()} == {("2024-01-01 10:00:00", "a", 2), ("2023-01-01 00:00:00", "b", 1)}
    stream = increments.windowed_counts(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/e"), "ts", "k", "1 hour", "10 minutes")
    q = stream.writeStream.outputMode("append").format("memory").queryName("late").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(str(r["start"]), r["k"]) for r in spark.table("late").collect()} <= {("2024-01-01 10:00:00", "a"), ("2023-01-01 00:00:00", "b")}


def test_catalog_of_an_empty_table(spark):
    df = spark.createDataFrame([], "k string, label int, split string")
    assert catalog.class_balance(df, "label").first()["share0"] is None
    assert catalog.duplicate_statistics(df, "k", "label").first()["largest_group"] == 0
    assert catalog.isolation_report(df, ["k"], "split").first()["crossing_values"] == 0


@pytest.mark.parametrize("leaks", [False, True])
def test_integrity_audit(spark, scratch, leaks):
    rows = [(f"s{i}", "train" if i < 4 else "test", i % 2, f"p{i // 2}", f"e{i}", f"x{i}", h, "PNG", "RGB") for i, h in enumerate(["0000000000000f0f", "00ff00ff00ff00ff", "ffff0000ffff0000", "ff00ff00ff00ff00", "0f0f0f0f0f0f0f0f", "0000000000000f0e" if leaks else "123456789abcdef0"])]
    df = spark.createDataFrame(rows, "selection_id string, split string, label int, parent string, encoded_sha256 string, pixel_sha256 string, phash string, format string, mode string")
    record, training = audits.integrity_audit(df, scratch)
    assert record["passed"] is not leaks and (training is None) is leaks
    if not leaks:
        assert training.count() == 6 and record["components"] == 3
        evidence.require(record["gates"])
    else:
        with pytest.raises(contracts.ContractError):
            evidence.require(record["gates"])


def test_identity_ranges_and_differences(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 5), (3, "z", 6)], "id int, v string, w int")
    b = spark.createDataFrame([(1, "x", None), (2, "q", 5)], "id int, v string, w int")
    assert {tuple(r) for r in catalog.verified_identity(a, b, "id", ["v", "w"]).collect()} == {("found", 1), ("v", 1), ("w", 0)}
    assert {(r["id"], r["column_name"]) for r in catalog.frame_differences(a, b, "id").collect()} == {(2, "v"), (3, "v"), (3, "w")}
    r = spark.createDataFrame([(5, 0, 10), (10, 0, 10), (None, 0, 10)], "i int, o int, l int")
    assert catalog.outside_requests(r, "i", "o", "l").count() == 2


def test_images_by_folder(spark, tmp_path):
    for name in ("Dalle-3/a.png", "other/b.jpg", "Dalle-3/big.png", "Dalle-3/c.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * (50 if "big" in name else 5))
    aliases = spark.createDataFrame([("dalle3", "dalle3")], "key string, generator string")
    got = {(r["source_id"], r["generator"], r["oversized"]) for r in files.images(spark, str(tmp_path), aliases, 20).collect()}
    assert got == {("a", "dalle3", False), ("b", None, False), ("big", "dalle3", True)}


def test_large_components_are_named_by_their_members(spark):
    import hashlib

    ids = [f"m{k}é" for k in range(500)]
    m = spark.createDataFrame([(i, "m0é") for i in ids] + [("x", "x"), ("z", "y"), ("y", "y")], "id string, root string").repartition(7)
    name = lambda i: ("p:" + hashlib.sha256("\n".join(sorted(i, key=str.encode)).encode()).hexdigest()[:24], len(i))
    want = {"m0é": name(ids), "x": name(["x"]), "y": name(["y", "z"])}
    for most in (0, 1, 100, 100_000):
        assert {r["root"]: (r["component"], r["members"]) for r in components.member_names(m, "p:", most).collect()} == want


def splitmix(number, replicate):
    m = (1 << 64) - 1
    z = (number + (replicate + 1) * bootstrap.STEP) & m
    for shift, by in ((30, bootstrap.MIX[0]), (27, bootstrap.MIX[1])):
        z = (z ^ z >> shift) * by & m
    return z ^ z >> 31


@pytest.mark.parametrize("ranges,cells", [(3, 1), (50, 1 << 22)])
def test_bootstrap_of_four_metrics(spark, scratch, monkeypatch, ranges, cells):
    monkeypatch.setattr(bootstrap, "RANGES", ranges)
    monkeypatch.setattr(bootstrap, "CELLS", cells)
    rows = [(k, k % 9, int(k * 7 % 5 < 2), round(((k * 37) % 41) / 41 * 0.7 + 0.3 * (k * 7 % 5 < 2), 2)) for k in range(60)]
    got = {r["metric"]: r for r in bootstrap.cluster_intervals(spark.createDataFrame(rows, "row long, g long, label int, score double"), [], "g", 0.5, scratch, 40).collect()}
    want = {}
    for rep in range(40):
        w = {g: sum((splitmix(int(hashlib.sha256(str(g).encode()).hexdigest()[:16], 16), rep) >> 11) / 2**53 >= p for p in bootstrap.POISSON) for g in range(9)}
        x = [r for r in rows for _ in range(w[r[1]])]
        pos, neg = [s for *_, y, s in x if y], [s for *_, y, s in x if not y]
        tp, fp = sum(s >= 0.5 for s in pos), sum(s >= 0.5 for s in neg)
        fn, tn = len(pos) - tp, len(neg) - fp
        want.setdefault("roc_auc", []).append(np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg]))
        want.setdefault("balanced_accuracy", []).append((tp / len(pos) + tn / len(neg)) / 2)
        want.setdefault("macro_f1", []).append((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2)
        want.setdefault("fpr_at_tpr_95", []).append(min(sum(n >= t for n in neg) / len(neg) for t in pos if sum(p >= t for p in pos) >= 0.95 * len(pos)))
    for name, values in want.items():
        assert got[name]["repeats"] == 40
        assert abs(got[name]["lower"] - np.quantile(values, 0.025)) < 1e-9 and abs(got[name]["upper"] - np.quantile(values, 0.975)) < 1e-9


@pytest.mark.parametrize("unit,cells", [("g", 1 << 22), ("row", 100)])
def test_bootstrap_of_any_statistic(spark, monkeypatch, unit, cells):
    monkeypatch.setattr(bootstrap, "CELLS", cells)
    rows = [(k, k % 9, (k * 37 % 41) / 41 if k % 10 else None) for k in range(70)]
    df = spark.createDataFrame(rows, "row long, g long, x double")
    got = {r["metric"]: r for r in bootstrap.statistic_intervals(df, unit, {"n": F.col("x").isNotNull().cast("int"), "x": F.col("x")}, {"mean": F.try_divide("x", "n"), "none": F.try_divide("x", F.lit(0))}, 40).collect()}
    values = []
    for rep in range(40):
        w = lambda u: sum((splitmix(int(hashlib.sha256(str(u).encode()).hexdigest()[:16], 16), rep) >> 11) / 2**53 >= p for p in bootstrap.POISSON)
        x = [(w(r[1] if unit == "g" else r[0]), r[2]) for r in rows if r[2] is not None]
        values.append(sum(a * b for a, b in x) / sum(a for a, _ in x))
    assert set(got) == {"mean"} and got["mean"]["repeats"] == 40
    assert abs(got["mean"]["lower"] - np.quantile(values, 0.025)) < 1e-9 and abs(got["mean"]["upper"] - np.quantile(values, 0.975)) < 1e-9
    assert bootstrap.statistic_intervals(df.where("false"), unit, {"n": F.lit(1)}, {"m": F.try_divide("n", "n")}, 3).count() == 0


def test_balanced_pairs(spark):
    from collections import Counter

    from corpusloom.functions.text import stable_hash
    from corpusloom.operators import selection

    # One generator holds most fakes of every group.
    rows = [(f"g{g}", 0, "real", f"r{g}-{k}") for g in range(17) for k in range(2)] + [(f"g{g}", 1, n, f"{n}{g}-{k}") for g in range(17) for n, m in (("a", 20), ("b", 1), ("c", 1)) for k in range(m)]
    df = spark.createDataFrame(rows, "grp string, label int, kind string, row string")
    pairs = lambda x: selection.balanced_pairs(x, "grp", "label", "kind", ["a", "b", "c"], stable_hash(F.lit("7"), F.col("grp")), stable_hash(F.lit("7"), F.col("row"))).collect()
    out = pairs(df)
    assert len(out) == 17 and set(Counter(r["kind"] for r in out).values()) == {5, 6}
    held = {(r[0], r[3]): r[2] for r in rows}
    assert all(held[r["grp"], r["real"]] == "real" and held[r["grp"], r["fake"]] == r["kind"] for r in out)
    assert sorted(map(str, pairs(df.repartition(5)))) == sorted(map(str, out))
    with pytest.raises(Exception, match="cannot form a pair"):
        pairs(df.where("grp != 'g3' or kind != 'b'"))

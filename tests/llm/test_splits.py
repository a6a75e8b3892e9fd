import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import grouping, splits
from corpusloom.scratch import Scratch

ROWS = "selection_id string, leakage_group string, parent_coco_image_id long, split string, root string, n long"


def records(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], ROWS)


def unions(edges):
    root = {v: v for e in edges for v in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    return {v: find(v) for v in root}


def graph(seed, n=250):
    rng = random.Random(seed)
    path = [(f"p{k:03}", f"p{k + 1:03}") for k in range(120)]
    star = [("hub", f"s{k}") for k in range(80)]
    some = [(f"v{rng.randrange(n)}", f"v{rng.randrange(n)}") for _ in range(n // 2)]
    return path + star + some + [("x", "x")] + star[:5] + [(b, a) for a, b in path[:5]]


def in_numbers(seed):
    number = {v: k - 100 for k, v in enumerate(sorted({v for e in graph(seed) for v in e}))}
    return [(number[a], number[b]) for a, b in graph(seed)]


@pytest.mark.parametrize("seed", [1, 2])
def test_forest_equals_union_find(spark, scratch, seed):
    edges = in_numbers(seed)
    labels, forest = splits.spanning_forest(spark.createDataFrame(edges + [(None, 1), (1, None)], "u long, v long"), scratch)
    got = {r["c"]: r["p"] for r in labels.collect()}
    want = unions([e for e in edges if e[0] != e[1]])
    assert set(got) == set(want)
    assert len({(got[v], want[v]) for v in want}) == len(set(got.values())) == len(set(want.values()))
    kept = [(r["u"], r["v"]) for r in forest.collect()]
    assert len(kept) == len(want) - len(set(want.values())) and set(unions(kept)) == set(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_decomposition_equals_union_find(spark, scratch, seed):
    edges = in_numbers(seed)
    got = {r["c"]: r["p"] for r in grouping.low_diameter_groups(spark.createDataFrame(edges, "u long, v long"), scratch).collect()}
    want = unions([e for e in edges if e[0] != e[1]])
    assert set(got) == set(want)
    assert len({(got[v], want[v]) for v in want}) == len(set(got.values())) == len(set(want.values()))


def test_no_edges(spark, scratch):
    labels, forest = splits.spanning_forest(spark.createDataFrame([], "u long, v long"), scratch)
    assert labels.count() == forest.count() == 0
    assert grouping.low_diameter_groups(spark.createDataFrame([(1, 1), (None, 2)], "u long, v long"), scratch).count() == 0


def test_found(spark, scratch):
    rows = [
        ("a", " G1\t", None, "train"), ("b", "g1", 7, "TRAIN "), ("c", None, 7, "val"),  # one set in train and val
        ("d", "unknown", 0, "train"), ("e", "N/A ", -1, "val"), ("f", "", None, "test"), ("g", "UNKNOWN", None, "val"),  # nothing relates these
        ("h", "g2", 9, "train"), ("i", "g2", 9, "external"), ("j", "g2", None, None),  # one split only
        ("k", "g3", None, "train"), ("k", "g4", None, "train"), ("l", "g4", None, "test"),  # k ties g3 to g4
        ("m", None, None, "train"), ("m", None, None, "test"), (None, "g2", 9, "test"),  # one record in two splits; no record
    ]
    out = splits.crossing_records(records(spark, rows), "selection_id", "leakage_group", "parent_coco_image_id", "split", scratch)
    assert sorted(r["id"] for r in out.collect()) == ["a", "b", "c", "k", "l", "m"]
    assert splits.crossing_records(records(spark, []), "selection_id", "leakage_group", "parent_coco_image_id", "split", scratch).count() == 0


def test_shares_and_sets_stay_whole(spark, scratch):
    rng = random.Random(4)
    rows = [(f"r{k}", "hot" if k < 400 else f"g{rng.randrange(300)}" if k < 1000 else None, None, "train") for k in range(1400)]
    df = records(spark, rows)
    out = splits.split_records(df, "selection_id", "leakage_group", "parent_coco_image_id", [("train", 0.7), ("val", 0.15), ("test", 0.15)], scratch)
    got = out.collect()
    assert len(got) == 1400 and len({(r["set_id"], r["split"]) for r in got}) == len({r["set_id"] for r in got})
    n = {s: sum(r["split"] == s for r in got) for s in ("train", "val", "test")}
    assert abs(n["train"] - 980) <= 2 and abs(n["val"] - 210) <= 2 and abs(n["test"] - 210) <= 2
    again = splits.split_records(df.repartition(7), "selection_id", "leakage_group", "parent_coco_image_id", [("train", 0.7), ("val", 0.15), ("test", 0.15)], Scratch(spark, "again"))
    assert sorted(again.collect()) == sorted(got)
    with pytest.raises(ValueError):
        splits.deal(spark.createDataFrame([("a", 1)], "root string, n long"), [("train", 0.0)])


@pytest.mark.parametrize("bits", [5, 10])
def test_dealing_comes_as_near_as_the_roots_allow(spark, bits):
    rng = random.Random(bits)
    targets = [("train", 0.7), ("val", 0.15), ("test", 0.15), ("none", 0.0)]
    sizes = {f"r{k}": rng.choice([1, 1, 1, 2, 3, 9, 40, 700]) for k in range(3000)} | {"giant": 40_000}
    df = spark.createDataFrame(list(sizes.items()), "root string, n long")
    got = {r["root"]: r["split"] for r in splits.deal(df, targets, bits).collect()}
    assert set(got) == set(sizes) and set(got.values()) == {"train", "val", "test"}
    whole = sum(sizes.values())
    for name, share in targets[:3]:
        assert abs(sum(n for r, n in sizes.items() if got[r] == name) - share * whole) <= 3
    few = {r["root"]: r["split"] for r in splits.deal(spark.createDataFrame([("a", 50), ("b", 50)], "root string, n long"), targets).collect()}
    assert set(few) == {"a", "b"} and splits.deal(df.where("false"), targets).count() == 0


def test_groups(spark, scratch):
    links = spark.createDataFrame([(" A", "b", 1, 0), ("b", "C\t", 4, 0), ("c", "d", 5, 0), ("e", "E ", 0, 0), ("f", "", 1, 0), (None, "f", 1, 0), ("g", "h", None, 0), ("i", "j", -1, 0), ("b", "a", 0, 0)], "l string, r string, d int, p int")
    members = spark.createDataFrame([("x", " k1 "), ("Y", "k1"), ("z", " "), ("w", None), ("q", "lone"), (None, "k1"), ("d", "k2"), ("y", "k2")], "id string, c string")
    got = {r["id"]: r["group_first_id"] for r in grouping.match_groups(links, "l", "r", "d", members, "id", "c", scratch).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "d", "y": "d", "d": "d"}
    empty = grouping.match_groups(links.where("false"), "l", "r", "d", members.where("false"), "id", "c", Scratch(spark, "e"))
    assert empty.count() == 0
    assert F is not None

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import overlap, sample
from corpusloom.scratch import Scratch

COLUMNS = ("selection_id", "source_index_hash", "batch_no")


def rows(spark, n=900):
    rng = random.Random(3)
    out = [(f"k{i}", f"h{i}", 1 if i < n // 3 else 1 + rng.randrange(4), "x") for i in range(n)]
    out += [(f" k{i} ", f"H{i} ", 5, "y") for i in range(40)] + [(None, "h", 1, "z"), ("  ", "h", 1, "z"), ("lone", None, None, "z")]
    return spark.createDataFrame(out, "selection_id string, source_index_hash string, batch_no int, taken string")


def seen(df):
    return sample.first_seen(df, *COLUMNS)


def keys(df):
    return {r["key"] for r in df.collect()}


def test_sample_is_stable(spark, tmp_path):
    df = rows(spark)
    whole = sample.Ledger(spark, f"file://{tmp_path}/whole")
    assert whole.rows() is None
    whole.extend(seen(df))
    assert whole.rows().count() == 901 and whole.sample().count() == 90
    before = set()
    for b in (1, 2, 3, 4, 5):
        part = df.where(F.coalesce("batch_no", F.lit(0)) == b) if b > 1 else df.where("batch_no is null or batch_no = 1")
        step = sample.Ledger(spark, f"file://{tmp_path}/step")  # opened anew each time
        step.extend(seen(part.repartition(b)))
        assert before <= keys(step.sample())
        before = keys(step.sample())
    assert step.generations() == [0, 1, 2, 3, 4]
    columns = ["key", "source_index_hash", "batch", "priority", "taken"]
    assert sorted(step.rows().select(columns).collect()) == sorted(whole.rows().select(columns).collect())
    step.extend(seen(df))
    assert step.rows().count() == 901 and keys(step.sample()) == before


def test_late_keys_compete_when_they_arrive(spark, tmp_path):
    ledger = sample.Ledger(spark, f"file://{tmp_path}/l")
    new = lambda name, n, batch: spark.createDataFrame([(f"{name}{k}", "h", batch) for k in range(n)], "selection_id string, source_index_hash string, batch_no int")
    ledger.extend(seen(new("a", 100, 5)))
    first = keys(ledger.sample())
    ledger.extend(seen(new("late", 30, 2).union(new("null", 30, None)).union(new("b", 40, 6))))
    got = ledger.sample()
    assert len(first) == 10 and first <= keys(got) and got.count() == 20
    assert sum(k.startswith("b") for k in keys(got)) == 4  # what 40 keys of batch 6 add to the quota
    assert {r["batch"] for r in ledger.rows().where("key like 'late%'").collect()} == {2}


def test_a_lost_delivery_is_written_anew(spark, tmp_path):
    import os

    ledger = sample.Ledger(spark, f"file://{tmp_path}/l")
    ledger.extend(seen(rows(spark).where("batch_no = 1")))
    n = ledger.rows().count()
    ledger.extend(seen(rows(spark)))
    os.remove(f"{tmp_path}/l/gen-000001/_SUCCESS")
    assert ledger.generations() == [0] and ledger.rows().count() == n
    assert ledger.extend(seen(rows(spark))).count() == 901


@pytest.mark.parametrize("digits,border", [(1, 1), (3, 1000)])
def test_sample_takes_the_lowest_priorities(spark, tmp_path, monkeypatch, digits, border):
    monkeypatch.setattr(sample, "DIGITS", digits)
    monkeypatch.setattr(sample, "BORDER_ROWS", border)
    ledger = sample.Ledger(spark, f"file://{tmp_path}/l")
    order = sorted(ledger.extend(seen(rows(spark).where("batch_no = 1"))).collect(), key=lambda r: r["priority"])
    assert [r["taken"] for r in order] == [True] * (len(order) // 10) + [False] * (len(order) - len(order) // 10)
    assert sample.Ledger(spark, f"file://{tmp_path}/none").extend(seen(rows(spark).where("false"))).count() == 0


def test_chunks_cover_and_survive_an_insertion():
    rng = random.Random(1)
    text = bytes(rng.choices(b"abcdefgh ", k=5000))
    ends = overlap.chunk_ends(text, 16, 48, 128)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(text) and min(sizes) >= 16 and max(sizes) <= 128 + 16

    def cut(t):
        ends = overlap.chunk_ends(t, 16, 48, 128)
        return {t[a:b] for a, b in zip([0, *ends], ends)}

    changed = text[:2500] + b"something new" + text[2500:]
    assert len(cut(text) & cut(changed)) > 0.9 * len(cut(text))
    assert overlap.chunk_ends(b"", 16, 48, 128) == [] and overlap.chunk_ends(b"ab", 16, 48, 128) == [2]


SCHEMA = "source_id string, split string, pixel_sha256 string, source_sha256 string, phash string, value string"
SHA = ["%064x" % (random.Random(k).getrandbits(256)) for k in range(8)]


def pairs(spark, scratch, records):
    df = spark.createDataFrame([(*r, "clash") for r in records], SCHEMA)
    return {tuple(r) for r in overlap.cross_split_pairs(df, "source_id", "split", ("pixel_sha256", "source_sha256"), "phash", scratch).collect()}


def test_pairs(spark, scratch):
    got = pairs(spark, scratch, [
        ("a", " TRAIN", SHA[0], None, "00000000000000f1"), ("b", "val", SHA[0].upper() + " ", None, None), ("c", "test", None, None, "f1"), ("d", "Test", None, None, "1000000000000ff1 "),
        ("e", "train", "0" * 64, SHA[1], "0"), ("f", "val", "0" * 64, SHA[2], "0000000000000000"), ("g", "external", SHA[0], None, "f1"), ("h", "train", "", SHA[2], "ffffffffffffffff"),
        ("a", "val", SHA[0], None, None), ("i", "train", SHA[0], None, None), (None, "val", SHA[0], None, None), ("j", "val", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", None, "zz"),
    ])
    # a stands in train and val: it pairs with i as val, and with others as train.
    assert got == {("a", "b"), ("a", "c"), ("a", "d"), ("h", "f"), ("i", "b"), ("i", "a")}
    assert pairs(spark, scratch, []) == set()


def test_classes_stand_for_all_pairs(spark, scratch):
    records = [(f"t{k}", "train", SHA[0], None, None) for k in range(30)] + [(f"v{k}", "val", SHA[0], None, "f1") for k in range(20)] + [("x", "train", None, None, "f0"), ("w", "test", SHA[3], None, "zz")]
    df = spark.createDataFrame([(*r, "clash") for r in records], SCHEMA)
    got = sorted(tuple(r) for r in overlap.split_classes(df, "source_id", "split", ("pixel_sha256", "source_sha256"), "phash", scratch).collect())
    assert got == [("phash", "x", "v0", 1, 1, 20), ("pixel_sha256", "t0", "v0", 0, 30, 20)]
    assert overlap.split_classes(df.where("false"), "source_id", "split", ("pixel_sha256", "source_sha256"), "phash", Scratch(spark, "e")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_near_pairs_equal_brute_force(spark, scratch, seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) | 1 << 60 for _ in range(80)]
    values = base + [v ^ sum(1 << b for b in rng.sample(range(60), rng.randint(0, 11))) for v in base * 2]
    records = [(f"r{k}", rng.choice(["train", "val", "test"]), None, None, f"{v:x}") for k, v in enumerate(values)]
    want = {(a[0], b[0]) for a, x in zip(records, values) for b, y in zip(records, values) if a[1] == "train" and b[1] != "train" and (x ^ y).bit_count() <= 8}
    assert pairs(spark, scratch, records) == want


def test_overlap_fractions(spark, scratch):
    df = spark.createDataFrame([("a", "train", "t" * 10 + "".join(random.Random(1).choices("abcdef ", k=400))), ("b", "val", "t" * 10 + "".join(random.Random(1).choices("abcdef ", k=400))), ("c", "test", "nothing in common with the others"), ("d", "val", None), ("e", "other", "t")], "id string, split string, size string")
    got = {r["id"]: r for r in overlap.overlap_fractions(df, "id", "split", [F.col("size")], scratch).collect()}
    assert got["b"]["overlap"] == 1.0 and got["c"]["overlap"] == 0.0 and got["d"]["size"] == 0 and set(got) == {"b", "c", "d"}


def test_overlap_counts_near_pictures(spark, scratch):
    text = "".join(random.Random(1).choices("abcdef ", k=400))
    df = spark.createDataFrame([("a", "train", text, "00000000000000f1"), ("b", "val", text, "1f1"), ("c", "test", "another text altogether, of which nothing is known", "00000000000000f0"), ("d", "val", text[:200] + "".join(random.Random(2).choices("ghijk ", k=200)), "ffff0000ffff0000")], "id string, split string, role string, phash string")
    got = {r["id"]: r for r in overlap.overlap_fractions(df, "id", "split", [F.col("role")], scratch, perceptual="phash").collect()}
    assert got["b"]["overlap"] == 1.0 and got["c"]["shared"] == 16 and 0.3 < got["d"]["overlap"] < 0.6

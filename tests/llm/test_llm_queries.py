"""The queries of this subpackage against DuckDB or, without an oracle, by what must hold of their rows."""

import pytest

import oracle
from corpusloom.llm import queries, tokens
from corpusloom.llm.sql import SQL

D = "/root/testdata/sf0.001"
#: The smallest tables hold no cases of these.
MAY_BE_EMPTY = {"p5_found", "p5_classes"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_oracle(spark, name):
    said = oracle.compare(spark, oracle.connect(D), name, queries.queries()[name], SQL[name], D)
    assert not said or said == "no rows" and name in MAY_BE_EMPTY, said


def rows(spark, name):
    return queries.queries()[name](spark, D).toPandas()


def test_a_split_for_every_record(spark):
    got = rows(spark, "p1_splits")
    assert got["selection_id"].is_unique and set(got["split"]) == {"train", "val", "test"} and got.groupby("set_id")["split"].nunique().max() == 1


def test_ids_of_every_document(spark):
    got = rows(spark, "p6_ids")
    c = tokens.codec(tokens.vocabulary())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    assert {i: list(x) for i, x in zip(got["doc_id"], got["ids"])} == {i: c.plain(t) if t else [] for i, t in texts.items()}


def test_containers_are_full(spark):
    got = rows(spark, "p7_containers")
    assert got["container"].nunique() <= got["tokens"].sum() / 2048 * 1.03 + 1 and got.groupby("container")["tokens"].sum().max() <= 2048


def test_pages_and_overlaps_have_sane_shares(spark):
    pages, found = rows(spark, "p8_pages"), rows(spark, "p8_found")
    assert len(pages) == spark.read.parquet(f"{D}/documents.parquet").count() and (pages["outside"] <= pages["words"]).all()
    assert 0 < len(found) < 0.2 * len(pages)
    share = rows(spark, "p5_overlap")
    assert len(share) and share["overlap"].between(0, 1).all() and (share["shared"] <= share["size"]).all() and share["overlap"].nunique() > 5

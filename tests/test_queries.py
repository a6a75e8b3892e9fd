"""Every core query with an oracle against DuckDB on the smallest tables; the others must give rows."""

import pytest

import oracle
from corpusloom.plans import registry

D = "/root/testdata/sf0.001"
#: The smallest tables hold no cases of these.
MAY_BE_EMPTY = {"corpus_build", "corpus_left_out", "one_to_one_equal", "shard_reconcile", "row_index_gaps", "exact_hash_matches", "near_hash_links", "p2_found"}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(D)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_oracle(spark, con, name):
    said = oracle.compare(spark, con, name, registry.queries()[name], registry.oracle_sql()[name], D)
    assert not said or said == "no rows" and name in MAY_BE_EMPTY, said


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_gives_rows(spark, name):
    assert registry.queries()[name](spark, D).count() > 0

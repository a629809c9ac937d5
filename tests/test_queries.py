"""Every registered query against its SQL, and the driver contract."""

import pytest
from checking import compare, oracle

import __spark_entry__ as contract
from tidemark.plans import registry

SF = "/root/testdata/sf0.001"
TEXTS = contract.oracle_sql()
# The corpus operators have tests of their own.
RUNS = {name: run for name, run in contract.queries().items() if name in registry.QUERIES}


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", sorted(RUNS))
def test_query_matches_sql(spark, con, name):
    if name not in TEXTS:
        assert RUNS[name](spark, SF).columns
        return
    problem = compare(spark, con, RUNS[name], TEXTS[name], SF)
    assert problem is None


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_names_are_plain():
    assert not [n for n in RUNS if "pipeline" in n or n.startswith("op")]

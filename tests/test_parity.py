import parity
import pytest

import __spark_entry__ as entry
from textsentry.plans import oracle
from textsentry.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return parity.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    ok, note = parity.compare(spark, con, name, SF)
    assert ok, note


def test_every_query_has_an_oracle():
    """The library's own queries; operators SQL cannot express are tested beside them."""
    assert set(QUERIES) == set(oracle.statements())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0

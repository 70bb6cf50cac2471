"""Every named query against its SQL on the smallest data set."""

import os

import pytest

import __spark_entry__ as entry
from rolesift.plans.oracles import ORACLES
from rolesift.plans.queries import QUERIES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
MAY_BE_EMPTY = {"ingest_boards_rejects"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    verdict = compare(spark, duck, SF, name)
    assert verdict is None or (verdict == "both empty" and name in MAY_BE_EMPTY)

"""Every registered query against its SQL on the smallest supplied tables."""

import pytest

from kinweave.plans.catalog import QUERIES
from kinweave.plans.oracle import ORACLE
from tests.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, con, name):
    assert difference(spark, con, name, SF_DIR, QUERIES[name], ORACLE[name]) is None

import os

import pytest

from checks.compare import compare, connect
from checks.oracle import ORACLE
from checks.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("query", QUERIES, ids=lambda q: q.__name__)
def test_query_equals_sql(spark, con, query):
    equal, _, difference = compare(spark, con, query, ORACLE.get(query.__name__), FOLDER)
    assert equal, difference


def test_every_query_has_sql():
    assert {q.__name__ for q in QUERIES} == set(ORACLE)

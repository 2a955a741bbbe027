"""Every registered query against its SQL on the smallest tables; PLUMBLINE_TEST_DIR picks another folder."""

import os

import pytest

from plumbline import queries
from tests.oracle import compare, connect

FOLDER = os.environ.get("PLUMBLINE_TEST_DIR", "/root/testdata/sf0.001")
queries.load()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(name, spark, con):
    rows, problem, _, _ = compare(spark, con, queries.QUERIES[name], queries.ORACLE.get(name), FOLDER)
    assert problem is None, problem

"""Every registered query against its SQL twin on the smallest tables."""

import os

import compare
import pytest

from portmesh import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
registry.load()


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


def test_every_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    problem = compare.check(
        spark, con, name, registry.QUERIES[name], registry.SQL.get(name), FOLDER
    )
    assert problem is None or problem.startswith("EMPTY"), problem

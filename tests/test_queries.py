"""Every named query against its SQL, on the smallest tables."""

import pytest
from compare import check, connect

from loomgrid.plans.catalogue import IDS, QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    check(QUERIES[name](spark, FOLDER), SQL[name], duck)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_ids_named():
    assert set(IDS) == set(QUERIES)

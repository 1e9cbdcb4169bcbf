"""Every query against its SQL twin at the smallest scale."""

import pytest

import __spark_entry__ as entry
import check
from leafgrid.plans.oracle import ORACLE
from leafgrid.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.duck(SF)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "page", "tables", "charts", "figures"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert check.compare(spark, con, name, QUERIES[name], ORACLE[name], SF) is None

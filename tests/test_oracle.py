"""Every registered query against its DuckDB statement over the whole tables."""

from __future__ import annotations

import pytest
from compare import connect, difference

import __spark_entry__ as entry
from headwater.plans.queries import QUERIES
from oracle import ORACLE

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert difference(entry.queries()[name](spark, SF), duck, entry.oracle_sql()[name]) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["tbl", "influence", "connectivity_loss", "usage", "score"]

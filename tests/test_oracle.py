"""Every query with oracle text against DuckDB on the smallest data set.

``PAGEGRID_SF`` picks another data set. The card-page queries and zone cron checks take longest;
``PAGEGRID_QUICK=1`` leaves them out.
"""
import os

import oracle
import pytest

from pagegrid.plans import registry

SF = f"{oracle.DATA}/{os.environ.get('PAGEGRID_SF', 'sf0.001')}"
SLOW = ("a26_", "a27_", "a28_", "t05_", "j11_", "d04_", "s18_") if os.environ.get("PAGEGRID_QUICK") else ()
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", [n for n in sorted(ORACLES) if not n.startswith(SLOW or ("-",))])
def test_query_equals_oracle(spark, con, name):
    problems = oracle.compare(QUERIES[name](spark, SF), con, ORACLES[name])
    assert [p for p in problems if not p.startswith("note")] == []


def test_queries_without_oracle_give_rows(spark):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, SF).limit(1).count() == 1, name


def test_entry_contract(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).limit(1).count() == 1
    assert set(contract.oracle_sql()) <= set(contract.queries())

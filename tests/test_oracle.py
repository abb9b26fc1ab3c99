"""Every registered query against its DuckDB oracle.

Runs at ``$DESKLINE_TEST_SF`` (default sf0.001, so the suite stays quick; the driver checks sf0.01).
"""

import pytest

import __spark_entry__ as E
from deskline.plans import QUERIES
from tests.oracle_harness import compare, duck

NAMES = sorted(QUERIES)
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, sf_dir, con, name):
    res = compare(spark, name, sf_dir, con)
    if name in ORACLE:
        assert res["status"] == "match", res
    else:
        assert res["status"] == "rows-only" and res["spark_rows"] >= 0


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(ORACLE)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["companyID", "ticket_id", "title", "points", "sla_missed", "result_data"]
    assert df.count() > 0

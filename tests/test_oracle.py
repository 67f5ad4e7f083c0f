"""Every registered key against its DuckDB oracle, at sf0.001
and, for the headline keys, at sf0.01."""

import pytest

import __spark_entry__ as E
from farmspark.registry import oracle_queries, spark_queries
from tests.conftest import SF_ORACLE, SF_SMALL
from tools.check_oracle import compare

KEYS = sorted(spark_queries())
HEADLINE = ["qty_monthly", "sales_report", "purchased_items", "pond_averages", "stock_issue", "order_status_notice",
            "reminder_batch", "register_accounts_rejects", "outbox"]


def test_every_key_has_oracle():
    missing = set(spark_queries()) - set(oracle_queries())
    assert not missing, missing


@pytest.mark.parametrize("name", KEYS)
def test_key_matches_oracle_small(spark, name):
    res = compare(spark, SF_SMALL, [name], verbose=False)[name]
    assert res[0] == "OK", res


@pytest.mark.parametrize("name", HEADLINE)
def test_headline_matches_oracle(spark, name):
    res = compare(spark, SF_ORACLE, [name], verbose=False)[name]
    assert res[0] == "OK", res


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "Order ID" in df.columns

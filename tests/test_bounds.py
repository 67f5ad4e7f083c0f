"""The plans that large key sets take, beside the broadcast ones: every change,
notice and lookup key with broadcast bounds of 0 against its oracle."""

import pytest

from farmspark.keys import changes_keys, lookups_keys, notices_keys  # noqa: F401
from farmspark.operators import notices, reads
from farmspark.plans import broadcast as B
from farmspark.registry import oracle_queries
from tests.conftest import SF_SMALL
from tools.check_oracle import compare

PREFIXES = ("insert_", "place_", "stock_", "set_", "update_", "delete_", "complete_", "register_", "chained_")
LOOKUPS = ("account_lookup", "find_by_email", "find_by_mobile", "order_items", "order_status", "order_status_not_found",
           "order_receipt_ref", "customer_orders", "order_detail", "order_customer", "order_contact", "order_message_rows",
           "supply_order_detail", "supplier_orders", "exists_check", "worker_tasks", "outbox")
KEYS = sorted(k for k in oracle_queries() if k.startswith(PREFIXES) or k in LOOKUPS or k.endswith(("_notice", "_message")))


@pytest.mark.parametrize("name", KEYS)
def test_key_without_broadcasts(spark, monkeypatch, name):
    for module in (B, reads):
        monkeypatch.setattr(module, "KEYS_BROADCAST_BYTES", 0)
    for module in (B, notices):
        monkeypatch.setattr(module, "UPDATE_BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        res = compare(spark, SF_SMALL, [name], verbose=False)[name]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert res[0] == "OK", res

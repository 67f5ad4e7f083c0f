"""Keys for P-15 … P-17."""

from __future__ import annotations

from farmspark.operators import lookups as LK
from farmspark.registry import query
from farmspark.sources import feeds

ACCOUNTS = """SELECT 'customer' AS kind, customer_id AS id, customer_name AS name, email FROM cu
              UNION ALL SELECT 'worker', id, name, email FROM wk
              UNION ALL SELECT 'supplier', supplier_id, name, email FROM su"""

query("account_lookup", """
    SELECT h.handle, a.kind, a.id, a.name, a.email
    FROM (SELECT DISTINCT trim(handle) AS handle FROM login_handles) h
    JOIN accounts a ON a.name = h.handle OR a.email = h.handle""",
      feeds=("login_handles",), extra={"accounts": ACCOUNTS})(
    lambda t: LK.account_lookup(t, feeds.login_handles(t)))
query("find_by_email", """
    SELECT kind, id, email FROM accounts WHERE email IN (SELECT email FROM customer_emails)""",
      feeds=("customer_emails",), extra={"accounts": ACCOUNTS})(
    lambda t: LK.find_by_email(t, feeds.customer_emails(t)))
query("find_by_mobile", """
    SELECT id, name, email, mobile_no FROM wk WHERE mobile_no IN (SELECT mobile_no FROM worker_mobiles)""",
      feeds=("worker_mobiles",))(lambda t: LK.find_by_mobile(t, feeds.worker_mobiles(t)))

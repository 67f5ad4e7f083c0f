"""Keys for C-1 … C-16: ``<rule>`` is the new snapshot, ``<rule>_rejects``
the rejected requests (seq, reason)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farmspark.operators import changes as C
from farmspark.registry import query
from farmspark.sources import change_feeds as CF
from farmspark.sources.change_feeds import CHANGE_SQL


def money_out(df: DataFrame) -> DataFrame:
    """Decimals leave as JSON numbers (double)."""
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType)
                       else F.col(f.name) for f in df.schema.fields])


def blank(c: str) -> str:
    return f"({c} IS NULL OR {c} = '')"


def falsy(c: str) -> str:
    return f"({c} IS NULL OR {c} = 0)"


NUM = r"'^\s*[+-]?[0-9]+(\.[0-9]+)?\s*$'"


def parsed(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, {NUM}) THEN trunc(TRY_CAST(trim({c}) AS DOUBLE)) END"


def too_big(qty: str = "quantity", price: str = "price") -> str:
    return f"(abs(CAST({qty} AS DOUBLE)) > 2147483647 OR {price} IS NOT NULL AND TRY_CAST({price} AS DECIMAL(12,2)) IS NULL)"


CO_COLS = ["order_id", "customer_id", "prawn_type", "quantity", "price", "status", "approved_or_rejected",
           "payment_receipt", "address", "assigned_by", "created_at", "updated_at"]
SO_COLS = ["supply_order_id", "supplier_id", "item_id", "quantity", "price", "status", "order_date"]


def _cols(cols, alias="", money=("price",)):
    return ", ".join(f"CAST({alias}{c} AS DOUBLE) AS {c}" if c in money else f"{alias}{c}" for c in cols)


# per rule: the CTEs (feed + validated changes ``chk``) its SQL is built on;
# the notice keys reuse them
RULE_CTES: dict[str, dict[str, str]] = {}


def register_pair(name: str, spark_fn, table_sql: str, chk_sql: str | None, feed: str,
                  extra: dict[str, str] | None = None) -> None:
    """Register ``name`` (new table) and ``name_rejects`` from one rule."""
    ctes = {feed: CHANGE_SQL[feed]}
    if chk_sql is not None:
        ctes["chk"] = chk_sql
    ctes.update(extra or {})
    RULE_CTES[name] = ctes
    query(name, table_sql, extra=ctes)(lambda t: money_out(spark_fn(t).table))
    if chk_sql is not None:
        query(f"{name}_rejects", "SELECT seq, reason FROM chk WHERE reason IS NOT NULL", extra=ctes)(
            lambda t: spark_fn(t).rejects)


def _new_id(table: str, col: str) -> str:
    return f"(SELECT max({col}) FROM {table}) + row_number() OVER (ORDER BY seq)"


# C-1 --------------------------------------------------------------------------
register_pair(
    "insert_orders", lambda t: C.insert_orders(t, CF.orders_form(t)),
    f"""SELECT {_cols(CO_COLS)} FROM co UNION ALL
        SELECT {_new_id('co', 'order_id')}, customer_id, prawn_type, CAST(quantity AS INTEGER), CAST(price AS DOUBLE),
               coalesce(nullif(status, ''), 'Processing'), NULL, NULL, NULL, NULL, created_at, NULL
        FROM chk WHERE reason IS NULL""",
    f"""SELECT *, CASE WHEN {falsy('customer_id')} OR {blank('prawn_type')} OR {falsy('quantity')}
                          OR {falsy('price')} THEN 'Missing required fields'
                        WHEN {too_big()} THEN 'Error adding order' END AS reason
        FROM orders_form""", "orders_form")

# C-2 --------------------------------------------------------------------------
register_pair(
    "place_orders", lambda t: C.place_orders(t, CF.app_orders(t)),
    f"""SELECT {_cols(CO_COLS)} FROM co UNION ALL
        SELECT {_new_id('co', 'order_id')}, customer_id, prawn_type, CAST(quantity AS INTEGER), CAST(price AS DOUBLE), 'New',
               NULL, 'uploads/' || receipt, location, NULL, created_at, NULL
        FROM chk WHERE reason IS NULL""",
    f"""SELECT c.*, CASE WHEN {blank('prawn_type')} OR {falsy('quantity')} OR {falsy('price')} OR {blank('location')}
                           THEN 'Missing required fields'
                         WHEN {blank('receipt')} THEN 'Payment receipt is required'
                         WHEN NOT EXISTS (SELECT 1 FROM cu WHERE cu.customer_id = c.customer_id)
                           THEN 'Customer not found'
                         WHEN {too_big()} THEN 'Error adding order' END AS reason
        FROM app_orders c""", "app_orders")

# C-3 --------------------------------------------------------------------------
register_pair(
    "insert_supply_orders", lambda t: C.insert_supply_orders(t, CF.purchase_form(t)),
    f"""SELECT {_cols(SO_COLS)} FROM so UNION ALL
        SELECT {_new_id('so', 'supply_order_id')}, supplier_id, item_id, CAST(quantity AS INTEGER), CAST(price AS DOUBLE), 'New',
               order_date
        FROM chk WHERE reason IS NULL""",
    f"""SELECT *, CASE WHEN {falsy('supplier_id')} OR {falsy('item_id')} OR {falsy('quantity')} OR {falsy('price')}
                       THEN 'Missing required fields'
                       WHEN {too_big()} THEN 'Error adding purchase item' END AS reason
        FROM purchase_form""", "purchase_form")

# C-4 --------------------------------------------------------------------------
register_pair(
    "insert_inventory", lambda t: C.insert_inventory(t, CF.item_form(t)),
    f"""SELECT item_id, name, type, quantity, threshold, date FROM inv UNION ALL
        SELECT {_new_id('inv', 'item_id')}, name, type, CAST(q AS INTEGER), NULL, NULL
        FROM chk WHERE reason IS NULL""",
    f"""SELECT *, CASE WHEN {blank('name')} OR {blank('type')} OR {blank('qty')} THEN 'All fields are required'
                       WHEN q IS NULL OR q < 0 THEN 'Quantity must be a positive number'
                       WHEN q > 2147483647 THEN 'Database error occurred while adding item' END AS reason
        FROM (SELECT *, {parsed('qty')} AS q FROM item_form)""", "item_form")

# C-5 --------------------------------------------------------------------------
query("insert_tasks", f"""
    SELECT task_id, title, description, worker_id, status, created_date FROM tk UNION ALL
    SELECT {_new_id('tk', 'task_id')}, title, description, worker_id, 'pending', created_date FROM task_form""",
      extra={"task_form": CHANGE_SQL["task_form"]})(lambda t: C.insert_tasks(t, CF.task_form(t)).table)

# C-6 / C-7 --------------------------------------------------------------------


def _stock_sql(kinds: tuple[str, ...]) -> tuple[str, str]:
    k = ", ".join(f"'{x}'" for x in kinds)
    chk = f"""
        SELECT c.*, CASE WHEN it IS NULL THEN 'Valid item ID is required'
                         WHEN {blank('qty')} OR q IS NULL OR q < 0
                           THEN 'Valid quantity is required (must be a positive number)'
                         WHEN {blank('date')} THEN 'Date is required'
                         WHEN q > 2147483647 OR TRY_CAST(date AS DATE) IS NULL
                           THEN 'Database error occurred while updating item'
                         WHEN NOT EXISTS (SELECT 1 FROM inv WHERE inv.item_id = c.it) THEN 'Item not found' END AS reason
        FROM (SELECT *, TRY_CAST(nullif(regexp_extract(item_id, '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT) AS it,
                     {parsed('qty')} AS q
              FROM stock_moves WHERE kind IN ({k})) c"""
    table = """
        SELECT i.item_id, i.name, i.type,
               CASE WHEN r.item_id IS NOT NULL THEN CAST(i.quantity + r.delta AS INTEGER) ELSE i.quantity END
                 AS quantity,
               i.threshold,
               CASE WHEN r.item_id IS NOT NULL THEN r.d ELSE i.date END AS date
        FROM inv i LEFT JOIN (
            SELECT it AS item_id, sum(CAST(CASE WHEN kind = 'issue' THEN -q ELSE q END AS BIGINT)) AS delta,
                   arg_max(TRY_CAST(date AS DATE), seq) AS d
            FROM chk WHERE reason IS NULL GROUP BY it) r ON i.item_id = r.item_id"""
    return table, chk


for _name, _kinds in [("stock_issue", ("issue",)), ("stock_receive", ("receive",)),
                      ("stock_apply", ("issue", "receive"))]:
    _t, _c = _stock_sql(_kinds)
    register_pair(_name, (lambda kinds: lambda t: C.stock_changes(t, CF.stock_moves(t, kinds)))(_kinds),
                  _t, _c, "stock_moves")


# C-8 … C-12: last-writer updates ------------------------------------------------
def _update_sql(base: str, cols: list[str], keys: list[str], values: list[str]) -> str:
    red = (f"SELECT {', '.join(keys)}, " + ", ".join(f"arg_max({v}, seq) AS new_{v}" for v in values)
           + f" FROM chk WHERE reason IS NULL GROUP BY {', '.join(keys)}")
    on = " AND ".join(f"b.{k} = r.{k}" for k in keys)
    sel = []
    for c in cols:
        if c in values:
            expr = f"CASE WHEN r.{keys[0]} IS NOT NULL THEN r.new_{c} ELSE b.{c} END"
        else:
            expr = f"b.{c}"
        if c == "price":
            expr = f"CAST({expr} AS DOUBLE)"
        sel.append(f"{expr} AS {c}")
    return f"SELECT {', '.join(sel)} FROM {base} b LEFT JOIN ({red}) r ON {on}"


register_pair(
    "set_approval", lambda t: C.set_approval(t, CF.approvals(t)),
    _update_sql("co", CO_COLS, ["order_id"], ["approved_or_rejected"]),
    """SELECT c.*, upper(substr(action, 1, 1)) || substr(action, 2) AS approved_or_rejected,
              CASE WHEN action IS NULL OR action NOT IN ('approved', 'rejected') THEN 'Invalid action'
                   WHEN NOT EXISTS (SELECT 1 FROM co WHERE co.order_id = c.order_id) THEN 'Order not found' END AS reason
       FROM approvals c""", "approvals")
register_pair(
    "set_order_status", lambda t: C.set_order_status(t, CF.status_changes(t)),
    _update_sql("co", CO_COLS, ["order_id"], ["status"]),
    f"""SELECT c.*, CASE WHEN {blank('status')} THEN 'Status is required'
                         WHEN NOT EXISTS (SELECT 1 FROM co WHERE co.order_id = c.order_id) THEN 'Order not found' END
                      AS reason
        FROM status_changes c""", "status_changes")
register_pair(
    "set_order_status_worker", lambda t: C.set_order_status(t, CF.status_changes(t), worker_app=True),
    _update_sql("co", CO_COLS, ["order_id"], ["status"]),
    f"""SELECT c.*, CASE WHEN {falsy('order_id')} OR {blank('status')} THEN 'Order ID and status are required' END
                      AS reason
        FROM status_changes c""", "status_changes")
register_pair(
    "set_assigned_by", lambda t: C.set_assigned_by(t, CF.assignments(t)),
    _update_sql("co", CO_COLS, ["order_id"], ["assigned_by"]),
    f"""SELECT c.*, CASE WHEN {blank('assigned_by')} THEN 'Assigned By field is required'
                         WHEN NOT EXISTS (SELECT 1 FROM co WHERE co.order_id = c.order_id) THEN 'Order not found' END
                      AS reason
        FROM assignments c""", "assignments")
register_pair(
    "set_supply_status", lambda t: C.set_supply_status(t, CF.supply_status(t)),
    _update_sql("so", SO_COLS, ["supply_order_id"], ["status"]),
    f"""SELECT c.*, CASE WHEN {falsy('supply_order_id')} OR {blank('status')}
                         THEN 'Order ID and status are required' END AS reason
        FROM supply_status c""", "supply_status")
register_pair(
    "set_supply_status_owned", lambda t: C.set_supply_status_owned(t, CF.supply_status_owned(t)),
    _update_sql("so", SO_COLS, ["supply_order_id", "supplier_id"], ["status"]),
    f"""SELECT c.*, CASE WHEN {falsy('supplier_id')} OR {falsy('supply_order_id')} OR {blank('status')}
                           THEN 'Supplier ID, Order ID, and status are required'
                         WHEN NOT EXISTS (SELECT 1 FROM so WHERE so.supply_order_id = c.supply_order_id
                                                            AND so.supplier_id = c.supplier_id)
                           THEN 'Order not found or not owned by this supplier' END AS reason
        FROM supply_status_owned c""", "supply_status_owned")

# C-13 / C-14 / C-15 -------------------------------------------------------------
WK_COLS = ["id", "name", "email", "mobile_no"]
register_pair(
    "update_workers", lambda t: C.update_workers(t, CF.worker_updates(t)),
    _update_sql("wk", WK_COLS, ["id"], ["name", "email", "mobile_no"]),
    f"""SELECT c.*, CASE WHEN {blank('name')} OR {blank('email')} OR {blank('mobile_no')}
                           THEN 'Name, email, and mobile_no are required'
                         WHEN NOT EXISTS (SELECT 1 FROM wk WHERE wk.id = c.id) THEN 'Worker not found' END AS reason
        FROM worker_updates c""", "worker_updates")
register_pair(
    "delete_workers", lambda t: C.delete_workers(t, CF.worker_deletes(t)),
    "SELECT id, name, email, mobile_no FROM wk WHERE id NOT IN (SELECT id FROM chk WHERE reason IS NULL)",
    """SELECT c.*, CASE WHEN NOT EXISTS (SELECT 1 FROM wk WHERE wk.id = c.id)
                          OR c.seq <> (SELECT min(seq) FROM worker_deletes d WHERE d.id = c.id)
                        THEN 'Worker not found' END AS reason
       FROM worker_deletes c""", "worker_deletes")
register_pair(
    "complete_tasks", lambda t: C.complete_tasks(t, CF.task_completions(t)),
    """SELECT tk.task_id, tk.title, tk.description, tk.worker_id,
              CASE WHEN h.task_id IS NOT NULL THEN 'completed' ELSE tk.status END AS status, tk.created_date
       FROM tk LEFT JOIN (SELECT DISTINCT task_id, worker_id FROM chk WHERE reason IS NULL) h
         ON tk.task_id = h.task_id AND tk.worker_id = h.worker_id""",
    """SELECT c.*, CASE WHEN task_id IS NULL THEN 'Task ID is required'
                        WHEN worker_id IS NULL THEN 'Worker not found'
                        WHEN NOT EXISTS (SELECT 1 FROM tk WHERE tk.task_id = c.task_id AND tk.worker_id = c.worker_id)
                          THEN 'Task not found or not assigned to this worker' END AS reason
       FROM (SELECT f.*, w.worker_id FROM task_completions f
             LEFT JOIN (SELECT email, min(id) AS worker_id FROM wk WHERE email IS NOT NULL GROUP BY email) w
               ON f.email = w.email) c""", "task_completions")

# C-16 ---------------------------------------------------------------------------
_REQ = f"NOT ({blank('name')} OR {blank('email')} OR {blank('mobile_no')})"
_SIGN = {
    "sg": "SELECT seq, kind, trim(name) AS name, trim(email) AS email, trim(mobile_no) AS mobile_no FROM signups",
}


def _email_kind_ctes(kind: str, table: str, email_col: str, p: str) -> dict[str, str]:
    return {
        f"{p}0": f"""SELECT s.*, EXISTS (SELECT 1 FROM {table} x WHERE x.{email_col} = s.email) AS found
                     FROM sg s WHERE kind = '{kind}'""",
        f"{p}1": f"""SELECT email AS first_email, min(seq) AS first_seq FROM {p}0
                     WHERE {_REQ} AND NOT found AND email IS NOT NULL GROUP BY email""",
        f"{p}chk": f"""SELECT a.*, CASE WHEN NOT ({_REQ}) THEN 'All fields are required'
                                        WHEN found OR a.seq <> b.first_seq THEN 'Email already exists' END AS reason
                       FROM {p}0 a LEFT JOIN {p}1 b ON a.email = b.first_email""",
    }


_WORKER = {
    "w0": """SELECT s.*, EXISTS (SELECT 1 FROM wk WHERE wk.mobile_no = s.mobile_no) AS mob,
                    EXISTS (SELECT 1 FROM wk WHERE wk.email = s.email) AS mail
             FROM sg s WHERE kind = 'worker'""",
    # one sign-up after the other: taken mobile numbers, taken e-mails, accepted seqs
    "wacc": """SELECT unnest(list_reduce(
                   list({'m': CASE WHEN mobile_no IS NULL THEN []::VARCHAR[] ELSE [mobile_no] END,
                         'e': CASE WHEN email IS NULL THEN []::VARCHAR[] ELSE [email] END, 's': [seq]} ORDER BY seq),
                   lambda a, r: CASE WHEN list_has_any(a.m, r.m) OR list_has_any(a.e, r.e) THEN a
                                     ELSE {'m': a.m || r.m, 'e': a.e || r.e, 's': a.s || r.s} END).s) AS seq
               FROM w0 WHERE NOT mob AND NOT mail""",
    "wchk": """SELECT a.*, CASE WHEN mob OR EXISTS (SELECT 1 FROM w0 b JOIN wacc USING (seq)
                                                    WHERE b.mobile_no = a.mobile_no AND b.seq < a.seq)
                                  THEN 'Mobile number already exists'
                                WHEN a.seq NOT IN (SELECT seq FROM wacc)
                                  THEN 'Email already registered as a user' END AS reason
               FROM w0 a""",
}
_ALL_SIGNUP = {"signups": CHANGE_SQL["signups"], **_SIGN,
               **_email_kind_ctes("customer", "cu", "email", "c"),
               **_email_kind_ctes("supplier", "su", "email", "s"),
               **_email_kind_ctes("user", "us", "email", "u"),
               **_WORKER}


def _signup(t, *kinds):
    return C.register_accounts(t, CF.signups(t), kinds or C.ACCOUNT_KINDS)


query("register_customers", f"""
    SELECT customer_id, customer_name, mobile_no, email FROM cu UNION ALL
    SELECT {_new_id('cu', 'customer_id')}, name, mobile_no, email FROM cchk WHERE reason IS NULL""",
      extra=_ALL_SIGNUP)(lambda t: _signup(t, "customer")["customer"].table)
query("register_suppliers", f"""
    SELECT supplier_id, name, email, mobile_no FROM su UNION ALL
    SELECT {_new_id('su', 'supplier_id')}, name, email, mobile_no FROM schk WHERE reason IS NULL""",
      extra=_ALL_SIGNUP)(lambda t: _signup(t, "supplier")["supplier"].table)
query("register_users", """
    SELECT serviceId, email, phone FROM us UNION ALL
    SELECT name, email, mobile_no FROM uchk WHERE reason IS NULL""",
      extra=_ALL_SIGNUP)(lambda t: _signup(t, "user")["user"].table)
query("register_workers", f"""
    SELECT id, name, email, mobile_no FROM wk UNION ALL
    SELECT {_new_id('wk', 'id')}, name, email, mobile_no FROM wchk WHERE reason IS NULL""",
      extra=_ALL_SIGNUP)(lambda t: _signup(t, "worker")["worker"].table)


def _all_rejects(t):
    r = _signup(t)
    return (r["customer"].rejects.unionByName(r["supplier"].rejects).unionByName(r["user"].rejects)
            .unionByName(r["worker"].rejects))


query("register_accounts_rejects", """
    SELECT seq, reason FROM cchk WHERE reason IS NOT NULL UNION ALL
    SELECT seq, reason FROM schk WHERE reason IS NOT NULL UNION ALL
    SELECT seq, reason FROM uchk WHERE reason IS NOT NULL UNION ALL
    SELECT seq, reason FROM wchk WHERE reason IS NOT NULL""", extra=_ALL_SIGNUP)(_all_rejects)

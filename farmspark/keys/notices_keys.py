"""Keys for N-1 … N-8 and the combined outbox (SNK-5)."""

from __future__ import annotations

import re

from farmspark.keys.changes_keys import _ALL_SIGNUP, RULE_CTES
from farmspark.operators import changes as C
from farmspark.operators import notices as N
from farmspark.plans.broadcast import materialized
from farmspark.plans.sinks import outbox
from farmspark.plans.together import together
from farmspark.registry import query
from farmspark.sources import change_feeds as CF
from farmspark.sources import feeds
from farmspark.sources.feeds import FEED_SQL

CFG = N.DEFAULT


class L(str):
    """A literal text part of a DuckDB template."""


def tpl(*parts) -> str:
    """DuckDB concatenation of literal parts (L) and expressions; NULL
    expressions print 'null'; newlines become chr(10)."""
    out = []
    for p in parts:
        if isinstance(p, L):
            for i, seg in enumerate(p.split("\n")):
                if i:
                    out.append("chr(10)")
                if seg:
                    out.append("'" + seg.replace("'", "''") + "'")
        else:
            out.append(f"coalesce(CAST({p} AS VARCHAR), 'null')")
    return " || ".join(out)


def money(c: str) -> str:
    return f"CAST(CAST({c} AS DECIMAL(38,2)) AS VARCHAR)"


def price(c: str) -> str:
    """The number as given: no trailing zeros."""
    return f"rtrim(rtrim({money(c)}, '0'), '.')"


def stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def row(kind: str, ref: str, recipient: str, subject: str, body: str) -> str:
    return (f"SELECT '{kind}' AS kind, CAST({ref} AS BIGINT) AS ref_id, {recipient} AS recipient, "
            f"{subject} AS subject, {body} AS body")


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ------------------------------------------------------------------ bodies
N1 = row("order_status", "c.order_id", "cu.email", "'Order Status Update'",
         tpl(L("Your order #"), "c.order_id", L(" status has been updated to: "), "c.status",
             L(". Thank you for your business!"))) + """
    FROM chk c JOIN co ON co.order_id = c.order_id JOIN cu ON cu.customer_id = co.customer_id
    WHERE c.reason IS NULL AND cu.email IS NOT NULL AND cu.email <> ''"""
N2 = row("order_approval", "c.order_id", "cu.email", "'Order Approval Update'",
         tpl(L("Your order #"), "c.order_id", L(" has been "), "lower(c.action)",
             L(". Thank you for your business!"))) + """
    FROM chk c JOIN co ON co.order_id = c.order_id JOIN cu ON cu.customer_id = co.customer_id
    WHERE c.reason IS NULL AND cu.email IS NOT NULL AND cu.email <> ''"""
N3 = row("purchase_order", "a.supply_order_id", "su.email", "'New Purchase Order'",
         tpl(L("Hello "), "su.name", L(",\n\nA new purchase order has been created.\n\nOrder ID: "),
             "a.supply_order_id", L("\nItem ID: "), "a.item_id", L("\nQuantity: "), "a.quantity",
             L("\nPrice: "), price("a.price"), L("\nStatus: New\n\nThank you."))) + """
    FROM (SELECT (SELECT max(supply_order_id) FROM so) + row_number() OVER (ORDER BY seq) AS supply_order_id,
                 supplier_id, item_id, quantity, price
          FROM chk WHERE reason IS NULL) a JOIN su ON su.supplier_id = a.supplier_id"""


def _na(expr: str) -> str:
    return f"CASE WHEN d.supply_order_id IS NULL THEN 'N/A' ELSE coalesce(CAST({expr} AS VARCHAR), 'null') END"


N4_CTES = {
    "acc4": "SELECT * FROM chk WHERE reason IS NULL",
    "det4": """SELECT * FROM (
                 SELECT so.supply_order_id, so.order_date, i.name AS item_name, s.name AS supplier_name,
                        row_number() OVER (PARTITION BY so.supply_order_id
                                           ORDER BY so.supplier_id, so.item_id, so.order_date) AS rn
                 FROM so LEFT JOIN inv i ON so.item_id = i.item_id LEFT JOIN su s ON so.supplier_id = s.supplier_id
                 WHERE so.supply_order_id IN (SELECT supply_order_id FROM acc4)) WHERE rn = 1""",
}
N4 = row("supply_status", "a.supply_order_id", _lit(CFG.manager_email),
         tpl(L("Supply order #"), "a.supply_order_id", L(' status updated to "'), "a.status", L('"')),
         " || ".join([tpl(L("Order ID: "), "a.supply_order_id", L("\nItem: ")), _na("d.item_name"),
                      tpl(L("\nSupplier: ")), _na("d.supplier_name"),
                      tpl(L("\nNew status: "), "a.status", L("\nOrder date: ")),
                      _na(stamp("d.order_date"))])) + """
    FROM acc4 a LEFT JOIN det4 d ON a.supply_order_id = d.supply_order_id"""
N5 = row("new_order", "a.order_id", _lit(CFG.admin_email), "'New Order Placed'",
         tpl(L("New order (ID: "), "a.order_id", L(") from "), "cu.customer_name", L(" ("), "cu.email",
             L("):\nProduct: "), "a.prawn_type", L("\nQuantity: "), "a.quantity", L("\nPrice: "),
             price("a.price"), L("\nLocation: "), "a.location",
             L("\nStatus: New\nApproved/Rejected: Pending\nReceipt filename: "), "a.receipt")) + """
    FROM (SELECT (SELECT max(order_id) FROM co) + row_number() OVER (ORDER BY seq) AS order_id, *
          FROM chk WHERE reason IS NULL) a JOIN cu ON cu.customer_id = a.customer_id"""
N6 = row("order_update", "o.order_id", "c.email", "'Order Update'",
         tpl(L("Dear "), "c.customer_name", L(",\n\nYour order (ID: "), "o.order_id",
             L(") status has been updated.\n\nDetails:\n- Product: "), "o.prawn_type", L("\n- Quantity: "),
             "o.quantity", L("\n- Price: "), money("o.price"), L("\n- Status: "), "o.status",
             L("\n- Approved/Rejected: "), "coalesce(nullif(o.approved_or_rejected, ''), 'N/A')",
             L("\n- Created At: "), stamp("o.created_at"), L("\n- Updated At: "), stamp("o.updated_at"),
             L(f"\n\nThank you for your business!\n\nBest regards,\n{CFG.brand} Team"))) + """
    FROM co o JOIN cu c ON o.customer_id = c.customer_id
    WHERE o.order_id IN (SELECT order_id FROM order_keys)"""
N7_ORDER = row("worker_order", "c.order_id", _lit(CFG.manager_email), "'Order Status Updated'",
               tpl(L("Order ID: "), "c.order_id", L("\nStatus: "), "c.status")) + \
    " FROM chk c WHERE c.reason IS NULL"
N7_TASK = row("worker_task", "c.task_id", _lit(CFG.manager_email), "'Task Status Updated'",
              tpl(L("Task ID: "), "c.task_id", L("\nStatus: completed"))) + " FROM chk c WHERE c.reason IS NULL"
_B = CFG.brand
_I = " " * 20  # indents of the text in the reference's source
N8 = " UNION ALL ".join([
    row("welcome_customer", "a.id", "a.email", _lit(f"Welcome to {_B}!"),
        tpl(L("Hello "), "a.name", L(f",\n\nWelcome to {_B}! Your account has been created successfully.\n\n"
                                     "Username: "), "a.name",
            L(f"\n\nPlease login using your email and password. Keep your credentials safe.\n\n"
              f"Best regards,\n{_B} Team")))
    + " FROM (SELECT (SELECT max(customer_id) FROM cu) + row_number() OVER (ORDER BY seq) AS id, * "
      "FROM cchk WHERE reason IS NULL) a",
    row("welcome_supplier", "a.id", "a.email", _lit(f"Welcome to {_B}!"),
        tpl(L("Hello "), "a.name", L(f",\n\nWelcome to {_B}! Your supplier account has been created "
                                     "successfully.\n\nUsername: "), "a.name",
            L(f"\n\nPlease login using your email and password. Keep your credentials safe.\n\n"
              f"Best regards,\n{_B} Team")))
    + " FROM (SELECT (SELECT max(supplier_id) FROM su) + row_number() OVER (ORDER BY seq) AS id, * "
      "FROM schk WHERE reason IS NULL) a",
    row("welcome_worker", "a.id", "a.email", "'Your Worker Account Details'",
        tpl(L("Hello "), "a.name", L(f",\n\n{_I}Your account has been created successfully.\n\n{_I}Username: "), "a.name",
            L(f"\n{_I}User ID: "), "'PF' || CAST(a.id AS VARCHAR)",
            L(f"\n\n{_I}Please login using this credentials and dont forget these things.\n{_I}")))
    + " FROM (SELECT (SELECT max(id) FROM wk) + row_number() OVER (ORDER BY seq) AS id, * "
      "FROM wchk WHERE reason IS NULL) a",
])


# ------------------------------------------------------------------ spark side
def _written(df):
    """Requests, or the accepted ones of a rule, that several joins read: written
    once instead of being made anew by each."""
    return materialized(df, "requests")[0]


def n1(t):
    res = C.set_order_status(t, CF.status_changes(t))
    return N.order_status_notice(t, _written(res.accepted), res.keys_bounded)


def n2(t):
    res = C.set_approval(t, CF.approvals(t))
    return N.order_approval_notice(t, _written(res.accepted), res.keys_bounded)


def n3(t):
    return N.purchase_order_notice(t, C.insert_supply_orders(t, CF.purchase_form(t)).accepted)


def n4(t):
    # the feed looks up the owner of every supply order
    changes = _written(CF.supply_status_owned(t))
    return N.supply_status_notice(t, _written(C.set_supply_status_owned(t, changes).accepted))


def n5(t):
    return N.new_order_notice(t, C.place_orders(t, CF.app_orders(t)).accepted)


def n6(t):
    return N.order_update_message(t, feeds.order_keys(t))


def n7_order(t):
    return N.worker_order_notice(C.set_order_status(t, CF.status_changes(t), worker_app=True).accepted)


def n7_task(t):
    return N.worker_task_notice(C.complete_tasks(t, CF.task_completions(t)).accepted)


def n7(t):
    order, task = together(t.spark, lambda: n7_order(t), lambda: n7_task(t))
    return order.unionByName(task)


def n8(t):
    r = C.register_accounts(t, CF.signups(t), ("customer", "supplier", "worker"))
    return N.welcome_notice(r["customer"].accepted, r["supplier"].accepted, r["worker"].accepted)


query("order_status_notice", N1, extra=RULE_CTES["set_order_status"])(n1)
query("order_approval_notice", N2, extra=RULE_CTES["set_approval"])(n2)
query("purchase_order_notice", N3, extra=RULE_CTES["insert_supply_orders"])(n3)
query("supply_status_notice", N4, extra={**RULE_CTES["set_supply_status_owned"], **N4_CTES})(n4)
query("new_order_notice", N5, extra=RULE_CTES["place_orders"])(n5)
query("order_update_message", N6, extra={"order_keys": FEED_SQL["order_keys"]})(n6)


def _rename(ctes: dict[str, str], body: str, suffix: str) -> tuple[dict[str, str], str]:
    """Give a rule's ``chk`` CTE a unique name so several rules share one query."""
    sub = lambda s: re.sub(r"\bchk\b", f"chk_{suffix}", s)
    return {(f"chk_{suffix}" if k == "chk" else k): sub(v) for k, v in ctes.items()}, sub(body)


_c7a, _b7a = _rename(RULE_CTES["set_order_status_worker"], N7_ORDER, "w")
_c7b, _b7b = _rename(RULE_CTES["complete_tasks"], N7_TASK, "t")
query("worker_update_notice", f"{_b7a} UNION ALL {_b7b}", extra={**_c7a, **_c7b})(n7)
query("welcome_notice", N8, extra=_ALL_SIGNUP)(n8)

# the whole outbox of one batch ------------------------------------------------
_parts = [("set_order_status", N1, {}), ("set_approval", N2, {}), ("insert_supply_orders", N3, {}),
          ("set_supply_status_owned", N4, N4_CTES), ("place_orders", N5, {})]
_ob_ctes: dict[str, str] = {"order_keys": FEED_SQL["order_keys"], **_ALL_SIGNUP, **_c7a, **_c7b}
_ob_bodies = []
for _i, (_rule, _body, _more) in enumerate(_parts):
    _c, _b = _rename({**RULE_CTES[_rule], **_more}, _body, f"o{_i}")
    _ob_ctes.update(_c)
    _ob_bodies.append(_b)
_ob_bodies += [N6, _b7a, _b7b, N8]


_RULES = (n8, n1, n2, n3, n4, n5, n6, n7_order, n7_task)  # the longest first


def _outbox(t):
    return outbox(*together(t.spark, *[lambda rule=rule: rule(t) for rule in _RULES]))


query("outbox", " UNION ALL ".join(f"({b})" for b in _ob_bodies), extra=_ob_ctes)(_outbox)

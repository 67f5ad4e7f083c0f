"""Account lookups (P-15 … P-17).

The login handler matches a typed handle against ``name OR email``.  An OR
join condition plans as a nested-loop or cartesian join, so it is split
into two equi-joins (O-3): matches on the name, plus matches on the e-mail
that did not already match on the name.  No credential column is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farmspark.plans.broadcast import small_keys
from farmspark.sources.tables import Tables


def accounts(t: Tables) -> DataFrame:
    """Identity part of every account kind (no credentials)."""
    return (t.customer.select(F.lit("customer").alias("kind"), F.col("customer_id").alias("id"),
                              F.col("customer_name").alias("name"), "email")
            .unionByName(t.worker.select(F.lit("worker").alias("kind"), "id", "name", "email"))
            .unionByName(t.supplier.select(F.lit("supplier").alias("kind"), F.col("supplier_id").alias("id"),
                                           "name", "email")))


def _coll(c, collation: str | None):
    return F.collate(c, collation) if collation else c


def account_lookup(t: Tables, handles: DataFrame, collation: str | None = None) -> DataFrame:
    """P-15 accounts whose name or e-mail equals the trimmed handle.  The
    reference keeps the first row of an unordered result; every match is
    returned here (order by id for the first).

    Comparison is binary by default; ``collation`` (e.g. ``"UTF8_LCASE"`` or
    ``"UNICODE_CI_AI"``) gives the case-insensitive match of a MySQL default
    collation.  Collated keys still plan as hash joins."""
    h = small_keys(handles.select(F.trim("handle").alias("handle")), ["handle"])
    h = h.select(F.col("handle"), _coll(F.col("handle"), collation).alias("_h"))
    # one row per account and distinct text it answers to: one scan, one join
    keys = F.array_distinct(F.array(_coll(F.col("name"), collation), _coll(F.col("email"), collation)))
    a = accounts(t).select("kind", "id", "name", "email", F.explode(keys).alias("_k"))
    return h.join(a, h._h == a._k, "inner").select(h.handle, a.kind, a.id, a.name, a.email)


def find_by_email(t: Tables, emails: DataFrame) -> DataFrame:
    """P-16 account ids by exact e-mail (semi-join per account kind)."""
    return accounts(t).join(small_keys(emails, ["email"]), "email", "left_semi").select("kind", "id", "email")


def find_by_mobile(t: Tables, mobiles: DataFrame) -> DataFrame:
    """P-17 workers by mobile number."""
    return (t.worker.join(small_keys(mobiles, ["mobile_no"]), "mobile_no", "left_semi")
            .select("id", "name", "email", "mobile_no"))

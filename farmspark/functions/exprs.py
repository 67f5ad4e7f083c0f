"""Scalar expressions (F-1 … F-20), all built-in Spark functions.

Every helper returns a :class:`~pyspark.sql.Column`, so it stays inside
whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference's for the same output) ------------
# Date display formats, as MySQL DATE_FORMAT patterns -> Spark patterns:
#   '%M'          -> 'MMMM'                (month name)
#   '%Y-%m-%d'    -> 'yyyy-MM-dd'
#   '%Y-%m'       -> 'yyyy-MM'
#   '%W %e %M %Y' -> 'EEEE d MMMM yyyy'    (sales / inventory report)
#   '%W, %d %M %Y'-> 'EEEE, dd MMMM yyyy'  (water report)
#   '%Y/%m/%d'    -> 'yyyy/MM/dd'          (sensor view)
MONTH_NAME = "MMMM"
DAY = "yyyy-MM-dd"
MONTH = "yyyy-MM"
LONG_DATE = "EEEE d MMMM yyyy"
WATER_DATE = "EEEE, dd MMMM yyyy"
SLASH_DATE = "yyyy/MM/dd"
STAMP = "yyyy-MM-dd HH:mm:ss"
# Order statuses that count as a sale; low-stock margin; reminder look-ahead.
SALE_STATUSES = ("Completed", "Delivered")
LOW_STOCK_MARGIN = 25
REMINDER_WINDOW_SEC = 15 * 60
# ---------------------------------------------------------------------------


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def month_name(ts) -> Column:
    """F-1 ``DATE_FORMAT(x, '%M')``."""
    return F.date_format(F.to_date(c(ts)), MONTH_NAME)


_TIME_LETTERS = set("HhKkmsSaA")


def fmt(ts, pattern: str) -> Column:
    """F-2 … F-4 date text.  Date-only patterns format the DATE of the naive
    timestamp, so the session time zone never enters (formatting a
    TIMESTAMP_NTZ directly moves wall-clock times inside a DST gap)."""
    if pattern == STAMP:
        return stamp_text(ts)
    if _TIME_LETTERS & set(pattern.replace("'", "")):
        raise ValueError(f"time fields in {pattern!r}: build them from the clock fields")
    return F.date_format(F.to_date(c(ts)), pattern)


def _two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def stamp_text(ts) -> Column:
    """'yyyy-MM-dd HH:mm:ss' of a naive timestamp from its date and clock
    fields (independent of the session time zone)."""
    x = c(ts)
    return F.concat(F.date_format(F.to_date(x), "yyyy-MM-dd"), F.lit(" "), _two(F.hour(x)), F.lit(":"),
                    _two(F.minute(x)), F.lit(":"), _two(F.floor(F.second(x))))


def mysql_week0(ts) -> Column:
    """F-5 ``WEEK(x)`` in MySQL mode 0: weeks start on Sunday, range 0-53.

    Week 1 starts on the first Sunday of the year; days before it are week 0.
    With dayofweek() 1 = Sunday: floor((dayofyear + 7 - dayofweek) / 7).
    This is *not* ``weekofyear`` (ISO weeks).
    """
    x = c(ts)
    return F.floor((F.dayofyear(x) + 7 - F.dayofweek(x)) / 7).cast("int")


def hour_text(ts) -> Column:
    """F-8 ``CONCAT(LPAD(HOUR(x),2,'0'),'.00')``."""
    return F.concat(F.lpad(F.hour(c(ts)).cast("string"), 2, "0"), F.lit(".00"))


def money_value(x) -> Column:
    """F-12 numeric part of ``Number(x).toFixed(2)``: HALF_UP on a decimal."""
    return c(x).cast("decimal(12,2)")


def money_text(x) -> Column:
    """F-12 text part: '1234.50'.  (``format_number`` would add commas.)"""
    return c(x).cast("decimal(38,2)").cast("string")


def round2(x) -> Column:
    return F.round(c(x), 2)


# F-13: JS parseInt/isNaN on free text.  Plain decimal text only: optional
# sign, digits, optional fraction.  Exponent and hex forms are rejected (a
# documented deviation: JS would take them with odd values).
NUMERIC_TEXT = r"^\s*[+-]?[0-9]+(\.[0-9]+)?\s*$"


def parse_int_text(x) -> Column:
    """Numeric text with its fraction cut off, as a double (exact to 2**53; a
    longer number stays large instead of failing); NULL when not numeric."""
    s = c(x).cast("string")
    v = F.when(s.rlike(NUMERIC_TEXT), F.trim(s).try_cast("double"))
    return v - v % 1


# The INT columns of the business tables: a value beyond them fails its own
# request in the database.
INT_MAX = 2_147_483_647


def beyond_int(x) -> Column:
    """A number that an INT column cannot hold."""
    return F.abs(c(x).cast("double")) > F.lit(float(INT_MAX))


def beyond_money(x) -> Column:
    """A number that a DECIMAL(12,2) column cannot hold."""
    return c(x).isNotNull() & c(x).cast("double").isNotNull() & c(x).try_cast("decimal(12,2)").isNull()


def price_text(x) -> Column:
    """A price as a JS template prints the request's number: 100.00 -> 100, 12.50 -> 12.5."""
    s = money_text(x)
    return F.when(s.contains("."), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)


def blank(x) -> Column:
    """JS falsiness of a text field: NULL or ''."""
    return c(x).isNull() | (c(x).cast("string") == "")


def falsy_number(x) -> Column:
    """JS falsiness of a numeric field: NULL or 0."""
    return c(x).isNull() | (c(x) == 0)


def or_default(x, default) -> Column:
    """F-16 ``x || default`` for text."""
    d = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(c(x), F.lit("")), d)


def cap_first(x) -> Column:
    """F-15 ``s.charAt(0).toUpperCase() + s.slice(1)``."""
    s = c(x)
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30))


def sec_to_time_text(sec) -> Column:
    """Seconds of day -> 'HH:mm:ss' (MySQL TIME text); 24h+ stays > 23."""
    s = c(sec)
    return F.concat_ws(":",
                       F.lpad(F.floor(s / 3600).cast("string"), 2, "0"),
                       F.lpad(F.floor((s % 3600) / 60).cast("string"), 2, "0"),
                       F.lpad((s % 60).cast("string"), 2, "0"))


def minute_text(ts) -> Column:
    """F-18 reminder clock text ``HH:mm:00`` (from the clock fields)."""
    x = c(ts)
    return F.concat(_two(F.hour(x)), F.lit(":"), _two(F.minute(x)), F.lit(":00"))


def year_range(col, years: list[int]) -> Column:
    """O-2: ``YEAR(x) IN (y1, y2)`` rewritten as ranges the Parquet scan can
    use (a function of the column is not pushed down)."""
    x = c(col)
    cond = None
    for y in sorted(set(years)):
        part = (x >= F.lit(f"{y}-01-01 00:00:00").cast("timestamp_ntz")) & \
               (x < F.lit(f"{y + 1}-01-01 00:00:00").cast("timestamp_ntz"))
        cond = part if cond is None else (cond | part)
    return cond


def day_bounds(col, start: str, end: str) -> Column:
    """``DATE(x) BETWEEN start AND end`` as a half-open timestamp range:
    the whole end day is included and the range is pushed to the scan."""
    x = c(col)
    return (x >= F.lit(start).cast("date").cast("timestamp_ntz")) & \
           (x < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))


def stamp_bounds(col, start: str, end: str) -> Column:
    """``x BETWEEN start AND end`` on a DATETIME: the end day is cut at
    00:00 (purchase report, T-6)."""
    x = c(col)
    return x.between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))


# --- partition pruning on our own snapshot layout ----------------------------
# Snapshots written by farmspark.plans.jobs partition the time-series tables
# by ``ym`` = year * 100 + month of their timestamp, so a date-bounded query
# also prunes whole folders (PartitionFilters), not only row groups.
PART_COL = "ym"
PARTITIONED = {"customer_order": "created_at", "supply_orders": "order_date", "sensors_data": "Updated_at"}


def ym_of(ts) -> Column:
    x = c(ts)
    return (F.year(x) * 100 + F.month(x)).cast("int")


def _ym(day: str) -> int:
    return int(day[0:4]) * 100 + int(day[5:7])


def prune_months(df, first_day: str, last_day: str):
    """Add ``ym BETWEEN`` for the months of [first_day, last_day] when the
    frame comes from a partitioned snapshot; otherwise a no-op."""
    if PART_COL not in df.columns:
        return df
    return df.where(F.col(PART_COL).between(_ym(first_day), _ym(last_day)))


# --- naive-timestamp arithmetic, independent of the session time zone --------
# Casting TIMESTAMP_NTZ to TIMESTAMP (and date_trunc / timestamp_diff on NTZ)
# goes through the session zone and moves wall-clock times that fall in a
# DST gap.  These helpers only use the date and clock fields.
DAY_MS = 86_400_000


def ntz_millis(ts) -> Column:
    """Milliseconds since 1970-01-01 00:00 of a naive timestamp."""
    x = c(ts)
    return (F.unix_date(F.to_date(x)).cast("long") * DAY_MS
            + (F.hour(x) * 3600 + F.minute(x) * 60).cast("long") * 1000
            + F.floor(F.extract(F.lit("SECOND"), x) * 1000).cast("long"))


def ntz_from_millis(ms) -> Column:
    return F.timestamp_add("MILLISECOND", c(ms), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def ntz_minute(ts) -> Column:
    """Naive timestamp truncated to the minute."""
    x = c(ts)
    return F.make_timestamp_ntz(F.year(x), F.month(x), F.dayofmonth(x), F.hour(x), F.minute(x), F.lit(0))

"""F-5 week numbers, F-12 money text, F-13 number parsing, F-15, F-18."""

import datetime as dt

from pyspark.sql import functions as F

from farmspark.functions import exprs as X


def test_mysql_week_mode0(spark):
    # T-4: week 0 exists; not ISO weeks
    rows = [(dt.date(2000, 1, 1), 0), (dt.date(2000, 1, 2), 1), (dt.date(2008, 2, 20), 7),
            (dt.date(2008, 12, 31), 52), (dt.date(2017, 1, 1), 1), (dt.date(2016, 12, 31), 52)]
    df = spark.createDataFrame(rows, "d date, expected int")
    got = df.select(X.mysql_week0("d").alias("w"), "expected").collect()
    assert all(r.w == r.expected for r in got)


def test_week_matches_strftime_U_over_years(spark):
    import duckdb
    days = spark.range(0, 365 * 12).select(F.date_add(F.lit("1995-01-01").cast("date"), F.col("id").cast("int"))
                                           .alias("d"))
    ours = {r.d: r.w for r in days.select("d", X.mysql_week0("d").alias("w")).collect()}
    con = duckdb.connect()
    ref = dict(con.execute("SELECT d, CAST(strftime(d, '%U') AS INTEGER) FROM "
                           "(SELECT DATE '1995-01-01' + CAST(i AS INTEGER) AS d FROM range(0, 4380) t(i))").fetchall())
    assert ours == ref


def test_money_text_and_rounding(spark):
    df = spark.createDataFrame([(1234.5,), (0.125,), (None,)], "x double")
    got = [r[0] for r in df.select(X.money_text(F.col("x").cast("decimal(12,2)"))).collect()]
    assert got == ["1234.50", "0.13", None]


def test_parse_int_text(spark):
    vals = ["", "abc", "12abc", "-1", "0", "3.7", None, " 5 ", "1e3", "-0.5"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(X.parse_int_text("s")).collect()]
    assert got == [None, None, None, -1, 0, 3, None, 5, None, 0]


def test_cap_first_and_minute_text(spark):
    df = spark.createDataFrame([("approved", dt.datetime(2024, 1, 1, 7, 5, 33))], "a string, t timestamp_ntz")
    r = df.select(X.cap_first("a").alias("c"), X.minute_text("t").alias("m"),
                  X.hour_text("t").alias("h"), X.sec_to_time_text(F.lit(86700)).alias("late")).first()
    assert (r.c, r.m, r.h, r.late) == ("Approved", "07:05:00", "07.00", "24:05:00")

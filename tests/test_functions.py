"""Column expressions on their own."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from paystrata.functions import calendar, money, text


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_labels(spark):
    year, month = F.lit(2026), F.lit(3)
    assert one(spark, calendar.period_name(year, month), calendar.period_label(year, month),
               calendar.month_name(year, month), calendar.year_month(year, month)) == (
        "March 2026", "Mar 2026", "March", "2026-03")
    moment = F.lit("2026-03-05 10:00:00").cast("timestamp_ntz")
    assert one(spark, calendar.day_label(moment), calendar.day_start("2026-03-05"), calendar.day_end("2026-02-28")) == (
        "Mar 05, 2026", dt.datetime(2026, 3, 5), dt.datetime(2026, 3, 1))


def test_calendar_parts(spark):
    rows = spark.range(1, 13).select(calendar.quarter(F.col("id")), calendar.half_year(F.col("id"))).collect()
    assert [tuple(r) for r in rows] == [((m + 2) // 3, 1 if m <= 6 else 2) for m in range(1, 13)]


def test_text(spark):
    assert one(spark, text.initial(F.lit("ann")), text.amount_text(F.lit(Decimal("1234567.50"))),
               text.action_label(F.lit("RUN_ETL"))) == ("A", "1,234,567.50", "RUN ETL")
    assert [text.given(v) for v in (None, "", "0", 0, "x", 2026)] == [False, False, False, False, True, True]
    values = ["95000.5", " 12 ", "abc", "", None, "-3", "12abc", "\t7\n", "1e3x", ".5", "5.", "-", "1e30"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(text.decimal_or_zero(F.col("v"))).collect()] == [
        Decimal(x) for x in ("95000.50", "12.00", "0.00", "0.00", "0.00", "-3.00", "12.00", "7.00", "1000.00", "0.50", "5.00", "0.00", "0.00")]


def test_rounding_is_half_up_and_once(spark):
    def q(a, b):
        return one(spark, money.quotient(F.lit(Decimal(a)).cast("decimal(22,2)"), F.lit(b).cast("long")))[0]
    assert q("0.01", 2) == Decimal("0.01") and q("-0.01", 2) == Decimal("-0.01")   # 0.005
    assert q("100.00", 3) == Decimal("33.33") and q("1.00", 0) is None
    assert q("44.99", 1000) == Decimal("0.04")                                       # 0.04499, not 0.045
    part, whole = F.lit(Decimal("1.00")).cast("decimal(12,2)"), F.lit(Decimal("800.00")).cast("decimal(12,2)")
    assert one(spark, money.percent(part, whole), money.percent(part, whole, 1)) == (Decimal("0.13"), Decimal("0.10"))


def test_empty_sums(spark):
    none = spark.createDataFrame([], "v decimal(12,2)")
    row = none.agg(money.total("v"), money.total_or_zero("v"), money.mean("v")).first()
    assert tuple(row) == (None, Decimal("0.00"), None)

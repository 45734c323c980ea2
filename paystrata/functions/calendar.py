"""Period labels and calendar parts of a (year, month) pair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_day(year: Column | str, month: Column | str) -> Column:
    return F.make_date(year, month, F.lit(1))


def period_name(year: Column | str = "payroll_year", month: Column | str = "payroll_month") -> Column:
    """``March 2026``."""
    return F.date_format(first_day(year, month), "MMMM yyyy")


def period_label(year: Column | str = "payroll_year", month: Column | str = "payroll_month") -> Column:
    """``Mar 2026``."""
    return F.date_format(first_day(year, month), "MMM yyyy")


def month_name(year: Column | str, month: Column | str) -> Column:
    return F.date_format(first_day(year, month), "MMMM")


def year_month(year: Column | str, month: Column | str) -> Column:
    """``2026-03``."""
    return F.concat(F.col(year) if isinstance(year, str) else year, F.lit("-"),
                    F.lpad((F.col(month) if isinstance(month, str) else month).cast("string"), 2, "0"))


def quarter(month: Column) -> Column:
    return F.ceil(month / F.lit(3)).cast("int")


def half_year(month: Column) -> Column:
    return F.when(month <= 6, 1).otherwise(2)


def day_label(moment: Column) -> Column:
    """``Mar 31, 2026``."""
    return F.date_format(moment, "MMM dd, yyyy")


def day_start(day: str) -> Column:
    """Midnight of an ISO date, comparable with a timestamp column as is."""
    return F.lit(day).cast("date").cast("timestamp_ntz")


def day_end(day: str) -> Column:
    """Midnight after an ISO date: the open end of an inclusive date range."""
    return F.date_add(F.lit(day).cast("date"), 1).cast("timestamp_ntz")

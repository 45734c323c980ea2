"""Filters, projections and listings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paystrata.functions import calendar, text
from paystrata.operators.joins import records_with_employee


def processed_only(rec: DataFrame) -> DataFrame:
    return rec.filter(F.col("payroll_status") == "processed")


def _equals(column: str, value: str, collation: str | None) -> Column:
    """Equality under an optional collation (binary by default)."""
    return text.collated(F.col(column), collation) == text.collated(F.lit(value), collation)


def payroll_history(rec: DataFrame, emp: DataFrame, year=None, month=None, department=None,
                    collation: str | None = None) -> DataFrame:
    """Processed records with their employee, newest period and highest net first."""
    rec = processed_only(rec)
    if text.given(year):
        rec = rec.filter(F.col("payroll_year") == int(year))
    if text.given(month):
        rec = rec.filter(F.col("payroll_month") == int(month))
    if text.given(department):
        emp = emp.filter(_equals("department", department, collation))
    return (
        records_with_employee(rec, emp)
        .select(
            "payroll_id", "payroll_month", "payroll_year", "basic_salary",
            F.col("allowances_amount").alias("allowances"),
            F.col("overtime_amount").alias("overtime"),
            F.col("tax_amount").alias("tax"),
            F.col("sss_amount").alias("sss"),
            F.col("philhealth_amount").alias("philhealth"),
            F.col("pagibig_amount").alias("pagibig"),
            F.col("gross_amount").alias("gross_pay"),
            F.col("total_deductions_amount").alias("total_deductions"),
            F.col("net_amount").alias("net_pay"),
            "processed_at", "employee_id", "employee_code", "first_name", "last_name",
            "department", F.col("emp_position").alias("position"),
        )
        .orderBy(F.desc("payroll_year"), F.desc("payroll_month"), F.desc("net_pay"), "payroll_id")
    )


def payroll_history_detail(rec: DataFrame, emp: DataFrame) -> DataFrame:
    """Records of every status with names and labels."""
    return (
        records_with_employee(rec, emp)
        .select(
            "payroll_id", "employee_id", "employee_code", text.full_name().alias("full_name"),
            "department", "emp_position", "payroll_month", "payroll_year",
            calendar.period_name().alias("period_name"),
            "basic_salary", "allowances_amount", "overtime_amount", "gross_amount",
            "tax_amount", "sss_amount", "philhealth_amount", "pagibig_amount",
            "other_deductions", "total_deductions_amount", "net_amount",
            "payroll_status", "processed_at", "lock_version", "last_name",
        )
        .orderBy(F.desc("payroll_year"), F.desc("payroll_month"), "department", "last_name", "payroll_id")
        .drop("last_name")
    )


def employee_search(emp: DataFrame, search: str | None = None, department: str | None = None,
                    collation: str | None = None) -> DataFrame:
    """Employees whose name, code or e-mail contains the text; newest first."""
    if text.given(search):
        emp = emp.filter(text.contains_like(search, "first_name", "last_name", "employee_code", "email"))
    if text.given(department):
        emp = emp.filter(_equals("department", department, collation))
    return emp.orderBy(F.desc("employee_id"))


def employee_quick_search(emp: DataFrame, search: str = "") -> DataFrame:
    """Name or department contains the text; an empty text matches every value."""
    return emp.filter(text.contains_like(search, "first_name", "last_name", "department"))


def audit_search(log: DataFrame, action: str | None = None, user: str | None = None,
                 date_from: str | None = None, date_to: str | None = None,
                 limit: int | None = None) -> DataFrame:
    """Log rows of an action, a user text and an inclusive date range, newest first.

    All of them, or one page of ``limit`` rows. The dates become a half-open
    timestamp range, which reaches the scan.
    """
    if text.given(action):
        log = log.filter(F.col("action_name") == action)
    if text.given(user):
        log = log.filter(text.contains_like(user, "username"))
    if text.given(date_from):
        log = log.filter(F.col("created_at") >= calendar.day_start(date_from))
    if text.given(date_to):
        log = log.filter(F.col("created_at") < calendar.day_end(date_to))
    newest = log.orderBy(F.desc("created_at"), F.desc("log_id"))
    return newest if limit is None else newest.limit(limit)


def select_payees(emp: DataFrame, mode: str = "all", department: str | None = None,
                  ids: Iterable[int] | DataFrame | None = None,
                  collation: str | None = None) -> DataFrame:
    """Active employees to pay: all, one department, or a set of ids."""
    active = emp.filter(F.col("emp_status") == "active")
    if mode == "all":
        return active
    if mode == "department" and text.given(department):
        return active.filter(_equals("department", department, collation))
    if mode == "specific" and isinstance(ids, DataFrame):
        return active.join(ids.select("employee_id"), "employee_id", "left_semi")
    if mode == "specific" and ids:
        return active.filter(F.col("employee_id").isin([int(i) for i in ids]))
    raise ValueError("no employees selected")


def active_employees(emp: DataFrame) -> DataFrame:
    return (
        emp.filter(F.col("emp_status") == "active")
        .select("employee_id", "employee_code", "first_name", "last_name", "department", "basic_salary")
        .orderBy("department", "first_name", "employee_id")
    )


def employee_roster(emp: DataFrame) -> DataFrame:
    return emp.select(
        "employee_id", "employee_code", "first_name", "last_name", "email", "department",
        "emp_position", "basic_salary", "hire_date", "emp_status",
    ).orderBy("last_name", "employee_id")


def user_roster(users: DataFrame) -> DataFrame:
    return users.select(
        "user_id", "username", "full_name", text.initial(F.col("full_name")).alias("avatar_initial"),
        "email", "user_role", "user_status",
        F.coalesce(calendar.day_label(F.col("last_login")), F.lit("Never")).alias("last_login_label"),
        "created_at",
    ).orderBy("user_id")


def _in_period(year: int, month: int) -> Column:
    return ((F.col("payroll_year") == int(year)) & (F.col("payroll_month") == int(month))
            & (F.col("payroll_status") == "processed"))


def period_records(rec: DataFrame, year: int, month: int) -> DataFrame:
    """The processed records of one period: what ``delete_period`` removes."""
    return rec.filter(_in_period(year, month))


def delete_period(rec: DataFrame, year: int, month: int) -> DataFrame:
    """The table without the processed records of one period; drafts and paid stay."""
    return rec.filter(~F.coalesce(_in_period(year, month), F.lit(False)))

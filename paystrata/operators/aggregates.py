"""Reports by aggregation. Counts and sums are combined before each shuffle."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paystrata.functions import calendar, text
from paystrata.functions.money import mean, percent, quotient, total, total_or_zero
from paystrata.operators.filters import processed_only, select_payees
from paystrata.operators.joins import one_spelling, records_with_employee, star_join
from paystrata.operators.ranking import global_row_number
from paystrata.schema import MONEY, MONEY_SUM, RATIO

_PERIOD = ["payroll_year", "payroll_month"]


def _newest_first(df: DataFrame, *more: Column | str) -> DataFrame:
    return df.orderBy(F.desc("payroll_year"), F.desc("payroll_month"), *more)


def side_by_side(*one_row: DataFrame) -> DataFrame:
    """Put one-row frames with different columns into a single row, without a cross join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), one_row)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def monthly_summary(rec: DataFrame) -> DataFrame:
    summary = processed_only(rec).groupBy(*_PERIOD).agg(
        F.countDistinct("employee_id").alias("employees_paid"),
        F.count("*").alias("total_transactions"),
        total_or_zero("gross_amount").alias("total_gross"),
        total_or_zero("total_deductions_amount").alias("total_deductions"),
        total_or_zero("net_amount").alias("total_net"),
        F.coalesce(mean("net_amount"), F.lit(0)).cast(RATIO).alias("average_net_pay"),
    )
    return _newest_first(summary.select(*_PERIOD, calendar.period_name().alias("period_name"),
                                        *summary.columns[2:]))


def department_summary(rec: DataFrame, emp: DataFrame, collation: str | None = None) -> DataFrame:
    """Per department and period, with the department's active headcount."""
    emp = one_spelling(emp, collation)
    headcount = (
        emp.filter(F.col("emp_status") == "active").groupBy("department")
        .agg(F.count("*").alias("total_dept_employees"))
    )
    summary = (
        records_with_employee(processed_only(rec), emp)
        .groupBy("department", *_PERIOD)
        .agg(F.countDistinct("employee_id").alias("employee_count"),
             total("net_amount").alias("total_net_pay"),
             mean("net_amount").alias("average_net_pay"),
             F.max("net_amount").alias("highest_net_pay"),
             F.min("net_amount").alias("lowest_net_pay"))
    )
    return summary.join(headcount, "department", "left").select(
        F.col("department").alias("department_name"), *_PERIOD,
        calendar.period_name().alias("period_label"), "employee_count",
        F.coalesce("total_dept_employees", F.lit(0)).alias("total_dept_employees"),
        "total_net_pay", "average_net_pay", "highest_net_pay", "lowest_net_pay",
    )


def data_mart_dept_summary(star: dict[str, DataFrame]) -> DataFrame:
    keys = ["department_name", "year_number", "month_number", "month_name_text",
            "year_month_text", "quarter_number"]
    return (
        star_join(star).groupBy(*keys)
        .agg(F.count("fact_id").alias("payroll_count"),
             total("net_pay").alias("total_net_pay"),
             total("gross_pay").alias("total_gross_pay"),
             total("total_deductions").alias("total_deductions"),
             mean("net_pay").alias("avg_net_pay"),
             F.max("net_pay").alias("highest_net_pay"),
             F.min("net_pay").alias("lowest_net_pay"))
        .orderBy(F.desc("year_number"), F.desc("month_number"), F.desc("total_net_pay"), "department_name")
    )


def data_mart_report(star: dict[str, DataFrame]) -> DataFrame:
    return data_mart_dept_summary(star).select(
        "department_name",
        F.concat("month_name_text", F.lit(" "), "year_number").alias("period_name"),
        "year_number", "month_number", "quarter_number",
        F.col("payroll_count").alias("employee_count"),
        F.col("total_net_pay").alias("total_net"),
        "total_gross_pay", "total_deductions", "avg_net_pay", "highest_net_pay", "lowest_net_pay",
    )


def processed_periods(rec: DataFrame) -> DataFrame:
    periods = processed_only(rec).groupBy(*_PERIOD).agg(
        F.count("*").alias("emp_count"), total("net_amount").alias("total_paid"),
        F.max("processed_at").alias("processed_date"))
    return _newest_first(periods.select(
        *_PERIOD, calendar.period_name().alias("period_name"), "emp_count", "total_paid",
        "processed_date", quotient(F.col("total_paid"), F.col("emp_count")).alias("avg_per_employee")))


def payroll_trend(rec: DataFrame) -> DataFrame:
    return (
        processed_only(rec).groupBy(*_PERIOD).agg(total("net_amount").alias("total_pay"))
        .select(*_PERIOD, calendar.period_label().alias("month_label"), "total_pay")
        .orderBy(*_PERIOD)
    )


def history_summary(rec: DataFrame) -> DataFrame:
    zero = F.lit(0)
    return processed_only(rec).agg(
        F.count("*").alias("total_records"),
        total_or_zero("net_amount").alias("total_paid"),
        F.coalesce(mean("net_amount"), zero).cast(RATIO).alias("avg_pay"),
        F.coalesce(F.max("net_amount"), zero).cast(MONEY).alias("highest_pay"),
        F.coalesce(F.min("net_amount"), zero).cast(MONEY).alias("lowest_pay"),
        F.countDistinct("employee_id").alias("unique_employees"),
    )


def history_summary_labels(rec: DataFrame) -> DataFrame:
    """The history summary as it is shown: amounts with thousands separators."""
    amounts = ("total_paid", "avg_pay", "highest_pay", "lowest_pay")
    return history_summary(rec).withColumns({name: text.amount_text(F.col(name)) for name in amounts})


def department_distribution(emp: DataFrame, slots: int | None = None, collation: str | None = None) -> DataFrame:
    """Headcount, share of all employees and position of each department."""
    emp = one_spelling(emp, collation)
    heads = emp.groupBy(F.coalesce("department", F.lit("Unknown")).alias("department")) \
        .agg(F.count("*").alias("emp_count"))
    everyone = emp.agg(F.count("*").alias("all_employees"))
    placed = global_row_number(heads, [F.desc("emp_count"), F.col("department")], "position", slots=slots)
    # The total is one row: an uncorrelated scalar subquery, not a join.
    share = percent(F.col("emp_count").cast("decimal(18,0)"), everyone.scalar(), places=1)
    return placed.select("position", "department", "emp_count", share.alias("percentage")).orderBy("position")


def dashboard_kpis(emp: DataFrame, rec: DataFrame) -> DataFrame:
    people = emp.agg(
        F.count("*").alias("total_employees"),
        F.count_if(F.col("emp_status") == "active").alias("active_employees"),
        F.countDistinct("department").alias("total_departments"))
    # The last payroll is the newest processing time; equal times fall back to the period.
    last = F.max(F.when(F.col("processed_at").isNotNull(), F.struct("processed_at", *_PERIOD)))
    pay = processed_only(rec).agg(
        F.count("*").alias("total_records"), total_or_zero("net_amount").alias("total_paid"),
        last.alias("last"))
    row = side_by_side(people, pay)
    return row.select(
        "total_employees", "active_employees", "total_records", "total_paid", "total_departments",
        F.coalesce(quotient(F.col("total_paid"), F.col("total_employees")), F.lit(0)).cast(RATIO)
        .alias("net_paid_per_employee"),
        F.col("last.processed_at").alias("last_processed_at"),
        F.col("last.payroll_year").alias("last_payroll_year"),
        F.col("last.payroll_month").alias("last_payroll_month"),
    )


def employee_stats(emp: DataFrame) -> DataFrame:
    return emp.agg(
        F.count("*").alias("total_employees"),
        F.count_if(F.col("emp_status") == "active").alias("active_employees"),
        total_or_zero("basic_salary").alias("total_basic_salary"),
        F.coalesce(quotient(total("basic_salary"), F.count("*")), F.lit(0)).cast(RATIO)
        .alias("average_basic_salary"),
        F.countDistinct("department").alias("departments"),
    )


# Fixed value: estimated gross is basic plus 10 % allowances and 5 % overtime.
_GROSS_FACTOR = "1.15"


def payroll_estimate(emp: DataFrame, mode: str = "all", department: str | None = None,
                     ids: Iterable[int] | DataFrame | None = None, collation: str | None = None) -> DataFrame:
    """Headcount and estimated gross of a selection."""
    chosen = select_payees(emp, mode, department, ids, collation)
    return chosen.agg(
        F.count("*").alias("employee_count"),
        F.round(total_or_zero("basic_salary") * F.lit(_GROSS_FACTOR).cast("decimal(3,2)"), 2)
        .cast(MONEY_SUM).alias("estimated_gross"))


def payroll_estimate_by_department(emp: DataFrame, collation: str | None = None) -> DataFrame:
    return (
        select_payees(one_spelling(emp, collation)).groupBy("department")
        .agg(F.count("*").alias("employee_count"), total("basic_salary").alias("basic_salary_sum"))
    )


def warehouse_stats(star: dict[str, DataFrame], rec: DataFrame) -> DataFrame:
    names = {"fact_payroll": "fact_count", "dim_employee": "dim_employee_count",
             "dim_time": "dim_time_count", "dim_department": "dim_department_count"}
    counts = [star[table].agg(F.count("*").alias(column)) for table, column in names.items()]
    pay = processed_only(rec).agg(F.count("*").alias("processed_records"),
                                  total_or_zero("net_amount").alias("total_net"))
    row = side_by_side(*counts, pay)
    dims = F.col("dim_employee_count") + F.col("dim_time_count") + F.col("dim_department_count")
    return row.withColumn("dim_rows", dims)


def audit_stats(log: DataFrame, as_of: str) -> DataFrame:
    moment = F.col("created_at")
    on_day = (moment >= calendar.day_start(as_of)) & (moment < calendar.day_end(as_of))
    return log.agg(
        F.count("*").alias("total_logs"), F.count_if(on_day).alias("day_logs"),
        F.countDistinct("username").alias("unique_users"))


def api_totals(emp: DataFrame, rec: DataFrame) -> DataFrame:
    """Active employees, and records and gross of any status."""
    return side_by_side(
        emp.agg(F.count_if(F.col("emp_status") == "active").alias("total_employees")),
        rec.agg(F.count("*").alias("total_payrolls"), total_or_zero("gross_amount").alias("total_gross_paid")),
    )


def departments(emp: DataFrame, active_only: bool = False, collation: str | None = None) -> DataFrame:
    """Distinct departments in order; a collation merges spellings it holds equal."""
    if active_only:
        emp = emp.filter(F.col("emp_status") == "active")
    named = emp.filter(F.col("department").isNotNull())
    if collation:
        named = named.groupBy(text.collated(F.col("department"), collation).alias("_spelling")) \
            .agg(F.min("department").alias("department"))
    return named.select("department").distinct().orderBy("department")


def audit_actions(log: DataFrame) -> DataFrame:
    return log.select("action_name").distinct().orderBy("action_name")

"""Window analytics: rankings, trends, running totals.

Employee windows are ordinary windows: the pair (employee, period) is unique in
the records, so one employee holds at most one row per month, whatever the size
of the table. Windows over departments, periods or the whole table go through
``ranking``, because those groups grow with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paystrata.functions import calendar, text
from paystrata.functions.money import percent, quotient, total
from paystrata.operators.filters import processed_only
from paystrata.operators.joins import one_spelling, records_with_employee
from paystrata.operators.ranking import Level, ntile_of, ranked
from paystrata.schema import MONEY_SUM, RATIO
from paystrata.sources.staging import staged

_PERIOD = ["payroll_year", "payroll_month"]
_IDENTITY = ["employee_id", *_PERIOD]
_RUNNING = (Window.unboundedPreceding, Window.currentRow)
_THREE = (-2, Window.currentRow)


def _ranked_pay(rec: DataFrame, emp: DataFrame, amounts: list[str], levels: list[Level], slots: int | None) -> DataFrame:
    """Processed records with their department, ranked by net amount; no names, codes or labels.

    Only these narrow rows are range-partitioned. They are written first, as
    sampling the ranges would otherwise evaluate the join a second time. What
    describes the employee is joined to the ranked rows by ``_described``.
    """
    departments = emp.select("employee_id", "department")
    narrow = processed_only(rec).select(*_IDENTITY, *amounts).join(departments, "employee_id")
    return ranked(staged(narrow, "pay-to-rank"), "net_amount", _IDENTITY, levels, slots)


def _described(rows: DataFrame, emp: DataFrame, *columns: str) -> DataFrame:
    """Code, name and other columns of the employee; window rows are already partitioned by the key."""
    people = emp.select("employee_id", "employee_code", text.full_name().alias("full_name"), *columns)
    return rows.join(people, "employee_id")


def employee_payroll_ranking(rec: DataFrame, emp: DataFrame, slots: int | None = None,
                             collation: str | None = None) -> DataFrame:
    """Each processed record ranked in its department and period, its department, and overall."""
    emp = one_spelling(emp, collation)
    placed = _ranked_pay(rec, emp, ["net_amount"], [
        Level(row="overall_rank"),
        Level(("department",), row="dept_row", dense="dense_rank_in_dept", count="dept_rows", total="dept_total"),
        Level(("department", *_PERIOD), rank="rank_in_department"),
    ], slots)
    by_period = Window.partitionBy("employee_id").orderBy(*_PERIOD)
    placed = placed.withColumns({
        "previous_month_pay": F.lag("net_amount").over(by_period),
        "next_month_pay": F.lead("net_amount").over(by_period),
        "highest_pay_ever": F.max("net_amount").over(Window.partitionBy("employee_id")),
    })
    net, previous = F.col("net_amount"), F.col("previous_month_pay")
    rows, dept_total = F.col("dept_rows"), F.col("dept_total")
    return _described(placed, emp).select(
        "employee_id", "employee_code", "full_name", "department", *_PERIOD,
        calendar.period_name().alias("period_name"), "net_amount",
        "rank_in_department", "dense_rank_in_dept",
        quotient(dept_total, rows).alias("dept_avg_pay"),
        # Rounded once, after the subtraction: (net * n - total) / n.
        quotient((net * rows.cast("decimal(12,0)")).cast(MONEY_SUM) - dept_total, rows).alias("diff_from_dept_avg"),
        "previous_month_pay",
        percent(net - previous, previous).alias("mom_change_pct"),
        "next_month_pay", "highest_pay_ever",
        ntile_of(4, F.col("dept_row"), rows).alias("pay_quartile"),
        "overall_rank",
    )


def department_trends(rec: DataFrame, emp: DataFrame, slots: int | None = None,
                      collation: str | None = None) -> DataFrame:
    """Department payroll per period against its own past, and ranked over all.

    The aggregate comes first, so a department's window holds one row per month.
    """
    emp = one_spelling(emp, collation)
    grouped = (
        records_with_employee(processed_only(rec), emp)
        .groupBy("department", *_PERIOD)
        .agg(F.count("*").alias("emp_count"), total("net_amount").alias("total_payroll"),
             F.max("net_amount").alias("highest_pay"), F.min("net_amount").alias("lowest_pay"))
    )
    by_period = Window.partitionBy("department").orderBy(*_PERIOD)
    spent = F.col("total_payroll")
    history = (
        grouped
        .withColumn("previous", F.lag("total_payroll").over(by_period))
        .withColumn("sum_of_three", F.sum(spent).over(by_period.rowsBetween(*_THREE)).cast(MONEY_SUM))
        .withColumn("periods_of_three", F.count(spent).over(by_period.rowsBetween(*_THREE)))
        .withColumn("cumulative_payroll", F.sum(spent).over(by_period.rowsBetween(*_RUNNING)).cast(MONEY_SUM))
    )
    placed = ranked(history, "total_payroll", ["department", *_PERIOD], [Level(rank="department_rank")], slots)
    return placed.select(
        "department", *_PERIOD, calendar.period_name().alias("period"), "emp_count", "total_payroll",
        quotient(spent, F.col("emp_count")).alias("avg_pay"), "highest_pay", "lowest_pay",
        (spent - F.col("previous")).cast(MONEY_SUM).alias("payroll_change"),
        percent(spent - F.col("previous"), F.col("previous")).alias("pct_change"),
        quotient(F.col("sum_of_three"), F.col("periods_of_three")).alias("three_month_moving_avg"),
        "cumulative_payroll", "department_rank",
    )


def employee_payroll_analytics(rec: DataFrame, emp: DataFrame, slots: int | None = None,
                               collation: str | None = None) -> DataFrame:
    """Running total, three-row average, department share and overall rank per record."""
    emp = one_spelling(emp, collation)
    by_period = Window.partitionBy("employee_id").orderBy(*_PERIOD)
    net = F.col("net_amount")
    placed = _ranked_pay(rec, emp, ["net_amount", "gross_amount", "total_deductions_amount"], [
        Level(row="overall_rank"),
        Level(("department", *_PERIOD), total="cell_total"),
    ], slots)
    placed = placed.withColumns({
        "cumulative_earnings": F.sum(net).over(by_period.rowsBetween(*_RUNNING)).cast(MONEY_SUM),
        "rolling_3_month_avg": quotient(F.sum(net).over(by_period.rowsBetween(*_THREE)).cast(MONEY_SUM),
                                        F.count(net).over(by_period.rowsBetween(*_THREE))),
    })
    return _described(placed, emp, "emp_position").select(
        "employee_id", "employee_code", "full_name", "department", "emp_position", *_PERIOD,
        "net_amount", "gross_amount", "total_deductions_amount",
        "cumulative_earnings", "rolling_3_month_avg",
        percent(net, F.col("cell_total")).cast(RATIO).alias("pct_of_dept_total"),
        "overall_rank",
    )

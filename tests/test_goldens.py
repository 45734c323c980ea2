"""Known results on the seed rows."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from paystrata.operators import aggregates as agg
from paystrata.operators import topk, windows
from paystrata.operators.filters import select_payees
from paystrata.plans import etl
from paystrata.plans.jobs import compute_pay
from tests.fixtures import golden, seed

STAMP = "2026-06-01 00:00:00"


@pytest.fixture(scope="module")
def tables(spark):
    emp, rec = seed(spark)
    return emp.cache(), rec.cache()


@pytest.fixture(scope="module")
def star(tables):
    return etl.build_star(*tables, STAMP, slots=4)


def check(df, name, key, columns=None):
    """Every golden cell of the chosen columns, matched on ``key``."""
    want = {tuple(r[k] for k in key): r for r in golden(name)}
    got = {tuple(str(r[k]) for k in key): r for r in df.collect()}
    assert got.keys() == want.keys()
    for k, row in want.items():
        for column in columns or row:
            value = got[k][column]
            assert (None if value is None else str(value)) == row[column], (k, column)


def test_monthly_summary(tables):
    check(agg.monthly_summary(tables[1]), "monthly_summary", ["payroll_year", "payroll_month"])


def test_monthly_summary_is_newest_first(tables):
    assert [r.payroll_month for r in agg.monthly_summary(tables[1]).collect()] == [5, 4, 3]


def test_department_trends(tables):
    columns = list(golden("department_trends")[0])[2:12]
    check(windows.department_trends(tables[1], tables[0], slots=5),
          "department_trends", ["department", "payroll_month"], columns)


def test_department_summary(tables):
    df = agg.department_summary(tables[1], tables[0]).select(
        F.col("department_name").alias("department"), "payroll_month", "total_dept_employees",
        F.col("employee_count").alias("emp_count"), F.col("total_net_pay").alias("total_payroll"),
        F.col("average_net_pay").alias("avg_pay"), F.col("highest_net_pay").alias("highest_pay"),
        F.col("lowest_net_pay").alias("lowest_pay"))
    check(df, "department_trends", ["department", "payroll_month"],
          ["emp_count", "total_payroll", "avg_pay", "highest_pay", "lowest_pay"])
    assert df.filter("emp_count <> total_dept_employees").isEmpty()


def test_data_mart(star):
    df = agg.data_mart_dept_summary(star).select(
        F.col("department_name").alias("department"), F.col("month_number").alias("payroll_month"),
        F.col("payroll_count").alias("emp_count"), F.col("total_net_pay").alias("total_payroll"),
        F.col("avg_net_pay").alias("avg_pay"), F.col("highest_net_pay").alias("highest_pay"),
        F.col("lowest_net_pay").alias("lowest_pay"), "total_gross_pay", "total_deductions")
    check(df, "department_trends", ["department", "payroll_month"],
          ["emp_count", "total_payroll", "avg_pay", "highest_pay", "lowest_pay", "total_gross_pay", "total_deductions"])
    report = agg.data_mart_report(star).first()
    assert (report.period_name, report.department_name) == ("May 2026", "Information Technology")


@pytest.mark.parametrize("slots", [None, 6])
def test_employee_ranking(tables, slots):
    columns = list(golden("employee_windows")[0])[2:13]
    check(windows.employee_payroll_ranking(tables[1], tables[0], slots), "employee_windows",
          ["employee_id", "payroll_month"], columns)


@pytest.mark.parametrize("slots", [None, 6])
def test_employee_analytics(tables, slots):
    columns = ["net_amount", "overall_rank", "cumulative_earnings", "rolling_3_month_avg", "pct_of_dept_total"]
    check(windows.employee_payroll_analytics(tables[1], tables[0], slots), "employee_windows",
          ["employee_id", "payroll_month"], columns)


def test_totals(tables):
    emp, rec = tables
    h = agg.history_summary(rec).first()
    assert tuple(map(str, h)) == ("30", "2411850.00", "80395.00", "108250.00", "54000.00", "10")
    assert tuple(map(str, agg.employee_stats(emp).first())) == ("10", "10", "797000.00", "79700.00", "6")
    assert tuple(map(str, agg.payroll_estimate(emp).first())) == ("10", "916550.00")
    k = agg.dashboard_kpis(emp, rec).first()
    assert (str(k.net_paid_per_employee), k.last_payroll_year, k.last_payroll_month) == ("241185.00", 2026, 5)
    assert [r.month_label for r in agg.payroll_trend(rec).collect()] == ["Mar 2026", "Apr 2026", "May 2026"]


def test_department_distribution(tables):
    rows = [(r.position, r.department, r.emp_count, str(r.percentage))
            for r in agg.department_distribution(tables[0]).collect()]
    assert rows == [
        (1, "Information Technology", 3, "30.00"), (2, "Finance", 2, "20.00"), (3, "Marketing", 2, "20.00"),
        (4, "Administration", 1, "10.00"), (5, "Engineering", 1, "10.00"), (6, "Human Resources", 1, "10.00")]


def test_warehouse(tables, star):
    stats = agg.warehouse_stats(star, tables[1]).first().asDict()
    assert (stats["fact_count"], stats["dim_employee_count"], stats["dim_time_count"],
            stats["dim_department_count"], stats["dim_rows"]) == (30, 10, 3, 6, 19)
    times = [tuple(r) for r in star["dim_time"].orderBy("time_key").drop("time_key").collect()]
    assert times == [(2026, 3, "March", "2026-03", 1, 1), (2026, 4, "April", "2026-04", 2, 1),
                     (2026, 5, "May", "2026-05", 2, 1)]
    assert sorted(r.fact_id for r in star["fact_payroll"].collect()) == list(range(1, 31))
    top = topk.fact_detail(star, 1).first()
    assert (top.full_name, top.period, str(top.net_pay)) == ("Isabella Dizon", "May 2026", "108250.00")


def test_compute_pay_matches_may(tables):
    emp, rec = tables
    pay = {r.employee_id: r for r in compute_pay(select_payees(emp)).collect()}
    for r in rec.filter("payroll_month = 5").collect():
        for column in ("gross_amount", "total_deductions_amount", "net_amount", "overtime_amount"):
            assert pay[r.employee_id][column] == r[column]


def test_components_are_rounded_before_they_are_summed(spark):
    from tests.fixtures import employee, employees
    row = compute_pay(employees(spark, employee(1, basic_salary="100.05"))).first()
    # 10 % is 10.005 -> 10.01, 5 % is 5.0025 -> 5.00
    assert (row.allowances_amount, row.overtime_amount) == (Decimal("10.01"), Decimal("5.00"))
    assert row.gross_amount == Decimal("115.06")
    assert row.net_amount == row.gross_amount - row.total_deductions_amount == Decimal("-1894.95")

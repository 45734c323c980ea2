"""Edge cases of reports, joins, filters and the warehouse load."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from paystrata.operators import aggregates as agg
from paystrata.operators import filters, joins, topk, windows
from paystrata.plans import etl
from paystrata.sources import sinks
from tests.fixtures import employee, employees, log_row, logs, record, records, users

STAMP = "2026-06-01 00:00:00"
ANY_CASE = "UNICODE_CI_AI_RTRIM"


@pytest.fixture(scope="module")
def odd(spark):
    """Departments that differ by case, blanks or NULL; an inactive employee with history."""
    emp = employees(
        spark, employee(1, department=None), employee(2, department=""), employee(3, department=" Finance "),
        employee(4, department="finance"), employee(5, department="Finance"),
        employee(6, department="Finance", emp_status="inactive"), employee(7, department=None, emp_position=None))
    rec = records(
        spark, record(1, 1, 2026, 1, "10.00"), record(2, 2, 2026, 1, "20.00"), record(3, 3, 2026, 1, "30.00"),
        record(4, 5, 2026, 1, "40.00"), record(5, 6, 2026, 1, "40.00"), record(6, 7, 2026, 1, "5.00"),
        record(7, 5, 2026, 2, "0.00"), record(8, 5, 2026, 4, "50.00"),
        record(9, 5, 2026, 3, "99.00", payroll_status="draft", processed_at=None),
        record(10, 6, 2026, 3, "98.00", payroll_status="paid"))
    return emp.cache(), rec.cache()


def test_null_department_is_one_group(odd):
    emp, rec = odd
    rows = {(r.department_name, r.payroll_month): r for r in agg.department_summary(rec, emp).collect()}
    assert rows[(None, 1)].employee_count == 2
    assert rows[(None, 1)].total_dept_employees == 0      # = never matches NULL
    assert rows[("Finance", 1)].total_dept_employees == 1  # the inactive one is not counted
    assert {r.department for r in agg.departments(emp).collect()} == {"", " Finance ", "Finance", "finance"}
    assert [r.department for r in agg.departments(emp, collation="UTF8_LCASE_RTRIM").collect()] == ["", " Finance ", "Finance"]
    shares = {r.department: r.emp_count for r in agg.department_distribution(emp).collect()}
    assert shares["Unknown"] == 2 and shares[""] == 1


@pytest.mark.parametrize("slots", [None, 5])
def test_ties_gaps_and_zero_pay(odd, slots):
    emp, rec = odd
    rows = {(r.employee_id, r.payroll_month): r
            for r in windows.employee_payroll_ranking(rec, emp, slots).collect()}
    assert len(rows) == 8                                   # draft and paid stay out
    assert rows[(5, 1)].rank_in_department == rows[(6, 1)].rank_in_department == 1
    assert rows[(5, 1)].dense_rank_in_dept == rows[(6, 1)].dense_rank_in_dept == 2
    assert rows[(5, 1)].overall_rank + 1 == rows[(6, 1)].overall_rank
    assert rows[(5, 2)].mom_change_pct == Decimal("-100.00")
    assert rows[(5, 4)].previous_month_pay == 0             # the missing month is skipped
    assert rows[(5, 4)].mom_change_pct is None              # division by zero
    assert rows[(1, 1)].dept_avg_pay == Decimal("7.50")     # NULL departments rank together
    assert rows[(1, 1)].rank_in_department == 1 and rows[(7, 1)].rank_in_department == 2


def test_three_row_frames_count_rows_not_months(odd):
    emp, rec = odd
    rows = {(r.department, r.payroll_month): r for r in windows.department_trends(rec, emp, 3).collect()}
    assert rows[("Finance", 4)].three_month_moving_avg == Decimal("43.33")  # (80 + 0 + 50) / 3
    assert rows[("Finance", 4)].pct_change is None
    assert rows[("Finance", 4)].payroll_change == Decimal("50.00")


def test_share_of_a_zero_total_is_null(spark):
    emp, rec = employees(spark, employee(1)), records(spark, record(1, 1, 2026, 1, "0.00"))
    assert windows.employee_payroll_analytics(rec, emp).first().pct_of_dept_total is None


def test_warehouse_keeps_blank_and_fills_null(odd):
    emp, rec = odd
    star = etl.build_star(emp, rec, STAMP, slots=3)
    assert [r.department_name for r in star["dim_department"].orderBy("department_key").collect()] == [
        "", "Finance", "Unknown", "finance"]
    people = {r.employee_id: r for r in star["dim_employee"].collect()}
    assert 6 not in people and people[7].position_title == "Staff" and people[3].department_name == "Finance"
    assert star["fact_payroll"].count() == 7
    rejects = joins.etl_rejects(rec, star).collect()
    assert [(r.employee_id, r.payroll_month) for r in rejects] == [(6, 1)]
    loaded = star["fact_payroll"].agg(F.sum("net_pay")).first()[0]
    assert loaded + sum(r.net_amount for r in rejects) == agg.history_summary(rec).first().total_paid


def test_collation_merges_departments(odd):
    emp, rec = odd
    star = etl.build_star(emp, rec, STAMP, collation=ANY_CASE)
    assert {r.department_name.lower() for r in star["dim_department"].collect()} == {"", "finance", "unknown"}
    assert star["fact_payroll"].count() == 7
    assert filters.payroll_history(rec, emp, department="FINANCE ", collation=ANY_CASE).count() == 4


def test_cascade_keeps_null_keys(odd, spark):
    emp, rec = odd
    star = etl.build_star(emp, rec, STAMP)
    fact = star["fact_payroll"]
    loose = fact.withColumn("time_key", F.when(F.col("fact_id") > 1, F.col("time_key")))
    less = {**star, "dim_department": star["dim_department"].filter("department_name = 'Finance'")}
    kept = joins.cascade_facts(loose, less)
    assert kept.columns == fact.columns
    finance = less["dim_department"].first().department_key
    assert {r.fact_id for r in kept.collect()} == {
        r.fact_id for r in fact.collect() if r.department_key == finance}
    assert joins.cascade_facts(loose, star).count() == 7
    assert joins.star_join({**star, "fact_payroll": loose}).count() == 6   # a NULL key drops out of the mart


def test_recent_payrolls_put_unprocessed_last(odd):
    emp, rec = odd
    rows = topk.recent_payrolls(rec, emp).collect()
    assert rows[0].payroll_id == 8 and rows[-1].payroll_id == 9 and len(rows) == 10
    assert [r.payroll_id for r in topk.recent_payrolls_brief(rec, emp, 2).collect()] == [8, 10]
    assert agg.api_totals(emp, rec).first().total_payrolls == 10


def test_delete_period_spares_other_statuses(odd):
    _, rec = odd
    assert filters.period_records(rec, 2026, 1).count() == 6
    assert {r.payroll_id for r in filters.delete_period(rec, 2026, 3).collect()} == set(range(1, 11))
    assert {r.payroll_id for r in filters.delete_period(rec, 2026, 1).collect()} == {7, 8, 9, 10}


@pytest.mark.parametrize("nothing", [None, "", "0"])
def test_empty_filters_do_not_filter(odd, nothing):
    emp, rec = odd
    assert filters.payroll_history(rec, emp, nothing, nothing, nothing).count() == 8
    assert filters.employee_search(emp, nothing, nothing).count() == 7


def test_search_wildcards_and_case(spark):
    emp = employees(spark, employee(1, first_name="Ann_a"), employee(2, first_name="annxa", email=None),
                    employee(3, first_name="Bob", department=None))
    assert [r.employee_id for r in filters.employee_search(emp, "ANN_A").collect()] == [2, 1]
    assert [r.employee_id for r in filters.employee_search(emp, "A%a").collect()] == [2, 1]   # no text of employee 3 has two a
    assert {r.employee_id for r in filters.employee_quick_search(emp, "finan").collect()} == {1, 2}
    assert filters.employee_quick_search(emp).count() == 3


def test_audit_dates_are_inclusive(spark):
    day = dt.datetime
    log = logs(
        spark, log_row(1, day(2024, 1, 1, 23, 59, 59, 999999)), log_row(2, day(2024, 1, 2)),
        log_row(3, day(2024, 1, 3, 23, 59, 59, 999999)), log_row(4, day(2024, 1, 4)),
        log_row(5, day(2024, 1, 4), username="Zoe_Q", action_name="RUN_ETL"))
    found = filters.audit_search(log, date_from="2024-01-02", date_to="2024-01-03")
    assert [r.log_id for r in found.collect()] == [3, 2]
    assert [r.log_id for r in filters.audit_search(log, limit=2).collect()] == [5, 4]
    assert [r.log_id for r in filters.audit_search(log, action="RUN_ETL", user="oe_").collect()] == [5]
    assert tuple(agg.audit_stats(log, "2024-01-04").first()) == (5, 2, 2)


def test_select_payees_needs_a_choice(odd, spark):
    emp, _ = odd
    assert filters.select_payees(emp, "specific", ids=[5, 6]).count() == 1
    ids = spark.createDataFrame([(5,), (5,), (4,)], "employee_id long")
    assert filters.select_payees(emp, "specific", ids=ids).count() == 2
    for mode, extra in (("department", {}), ("specific", {"ids": []}), ("other", {})):
        with pytest.raises(ValueError):
            filters.select_payees(emp, mode, **extra)


def test_deleted_users_keep_their_name(spark):
    log = logs(spark, log_row(1, dt.datetime(2024, 1, 1)), log_row(2, dt.datetime(2024, 1, 1), user_id=9, username="gone"),
               log_row(3, dt.datetime(2024, 1, 1), user_id=None))
    known = users(spark, dict(user_id=1, username="admin", full_name="ann", last_login=dt.datetime(2024, 3, 5)),
                  dict(user_id=2, username="new", full_name="Bo"))
    rows = {r.log_id: r for r in joins.null_deleted_users(log, known).collect()}
    assert (rows[1].user_id, rows[2].user_id, rows[2].username, rows[3].user_id) == (1, None, "gone", None)
    roster = filters.user_roster(known).collect()
    assert [(r.avatar_initial, r.last_login_label) for r in roster] == [("A", "Mar 05, 2024"), ("B", "Never")]
    actions = spark.createDataFrame(
        [(10, 1, "RUN_ETL", None, None, None, dt.datetime(2024, 5, 1)),
         (11, 9, "LOGIN", "Auth", "d", "1.2.3.4", dt.datetime(2024, 5, 1))],
        "log_id long, user_id long, action_name string, module_name string, details_text string, "
        "ip_address string, created_at timestamp_ntz")
    after = {r.log_id: r for r in sinks.append_activity(log, actions, known).collect()}
    assert (after[10].username, after[10].ip_address) == ("admin", "127.0.0.1")
    assert (after[11].username, after[11].ip_address) == ("Unknown", "1.2.3.4") and len(after) == 5


def test_restricted_deletes(odd, spark):
    emp, rec = odd
    ids = spark.createDataFrame([(4,), (5,), (5,), (77,)], "employee_id long")
    allowed, rejected = joins.deletable_employees(emp, ids, rec)
    assert [r.employee_id for r in allowed.collect()] == [4]
    assert [(r.employee_id, r.record_count) for r in rejected.collect()] == [(5, 4)]


def test_empty_tables(spark):
    emp, rec, log = employees(spark), records(spark), logs(spark)
    assert tuple(map(str, agg.history_summary(rec).first())) == ("0", "0.00", "0.00", "0.00", "0.00", "0")
    k = agg.dashboard_kpis(emp, rec).first()
    assert (k.total_employees, str(k.net_paid_per_employee), k.last_processed_at) == (0, "0.00", None)
    assert tuple(map(str, agg.employee_stats(emp).first())) == ("0", "0", "0.00", "0.00", "0")
    assert tuple(agg.audit_stats(log, "2024-01-01").first()) == (0, 0, 0)
    assert str(agg.payroll_estimate(emp).first().estimated_gross) == "0.00"
    for df in (agg.monthly_summary(rec), agg.department_distribution(emp), windows.department_trends(rec, emp),
               windows.employee_payroll_ranking(rec, emp), windows.employee_payroll_analytics(rec, emp)):
        assert df.isEmpty()
    assert not etl.etl_precheck(rec)
    star = etl.build_star(emp, rec, STAMP)
    assert all(df.isEmpty() for df in star.values())
    assert agg.warehouse_stats(star, rec).first().fact_count == 0

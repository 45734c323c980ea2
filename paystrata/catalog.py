"""The registered queries: every operator over the payroll lens.

Each callable takes ``(spark, folder)`` and reads whole input tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paystrata.operators import aggregates as agg
from paystrata.operators import filters, joins, topk, windows
from paystrata.operators.ranking import global_row_number
from paystrata.plans import activity, etl, jobs
from paystrata.schema import ETL_JOBS, OPERATIONAL
from paystrata.sources import lens, sinks, tables, versions
from paystrata.sources.staging import staged, staging_path

Query = Callable[[SparkSession, str], DataFrame]

# Arguments of the registered queries; the reference SQL uses the same values.
RUN_TS, DONE_TS = "2024-03-01 00:00:00", "2024-03-01 00:05:00"
YEAR, MONTH, DEPARTMENT = 2007, 3, "MACHINERY"
NEW_YEAR, NEW_MONTH = 2026, 5
DAY_FROM, DAY_TO = "2024-01-10", "2024-01-12"
ANY_CASE = "UTF8_LCASE"
PAGE = 200  # rows of one page of the audit screen


class Inputs:
    """The lens tables of one folder, built on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @cached_property
    def emp(self) -> DataFrame:
        return lens.employees(self.spark, self.folder)

    @cached_property
    def rec(self) -> DataFrame:
        return lens.payroll_records(self.spark, self.folder)

    @cached_property
    def stored_rec(self) -> DataFrame:
        """Records written once, for queries that read the table several times."""
        return staged(self.rec, "records")

    @cached_property
    def stored_requests(self) -> DataFrame:
        """Merge requests written once, as the job reads them several times."""
        return staged(self.derived("staged_payroll"), "merge-requests")

    @cached_property
    def users(self) -> DataFrame:
        return lens.users(self.spark, self.folder)

    @cached_property
    def log(self) -> DataFrame:
        return lens.activity_logs(self.spark, self.folder)

    @cached_property
    def jobs(self) -> DataFrame:
        return lens.etl_jobs(self.spark, self.folder)

    @cached_property
    def star(self) -> dict[str, DataFrame]:
        return etl.build_star(self.emp, self.stored_rec, RUN_TS)

    def derived(self, table: str) -> DataFrame:
        return getattr(lens, table)(self.spark, self.folder)


def _load_tables(i: Inputs) -> DataFrame:
    folder = staging_path(i.spark, "tables")
    tables.save_tables(lens.operational(i.spark, i.folder), folder)
    loaded = tables.load_tables(i.spark, folder, tuple(OPERATIONAL))
    parts = [tables.content(df, name) for name, df in loaded.items()]
    first, *rest = parts
    for more in rest:
        first = first.unionByName(more)
    return first


def _write_activity(i: Inputs) -> DataFrame:
    folder = staging_path(i.spark, "log")
    tables.save_tables({"activity_logs": i.log}, folder)
    sinks.write_activity(i.derived("actions"), i.users, folder)
    return tables.load_tables(i.spark, folder, ("activity_logs",))["activity_logs"]


def _stored_days(i: Inputs) -> DataFrame:
    """Whole days of a stored log that has been appended to."""
    folder = staging_path(i.spark, "log")
    tables.save_tables({"activity_logs": i.log}, folder)
    sinks.write_activity(i.derived("actions"), i.users, folder)
    return filters.audit_search(tables.load_log(i.spark, folder, DAY_FROM, DAY_TO), date_from=DAY_FROM, date_to=DAY_TO)


def _export_csv(i: Inputs, action: str | None = None) -> DataFrame:
    path = staging_path(i.spark, "audit-csv")
    sinks.export_audit_csv(filters.audit_search(i.log, action=action), path)
    schema = ", ".join(f"`{name}` string" for name in sinks.AUDIT_COLUMNS)
    return i.spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def _export_json(i: Inputs) -> DataFrame:
    path = staging_path(i.spark, "roster-json")
    roster = filters.employee_roster(i.emp)
    sinks.export_json(roster, path)
    return i.spark.read.schema(roster.schema).json(path)


def _published(i: Inputs) -> str:
    folder = staging_path(i.spark, "warehouse")
    etl.run_etl(i.emp, i.stored_rec, folder, 1, RUN_TS, clock=lambda: DONE_TS)
    return folder


def _cascade(i: Inputs) -> DataFrame:
    """Facts left after the unassigned department and one year are deleted."""
    remaining = {
        **i.star,
        "dim_department": i.star["dim_department"].filter(F.col("department_name") != "Unknown"),
        "dim_time": i.star["dim_time"].filter(F.col("year_number") != YEAR),
    }
    return joins.cascade_facts(i.star["fact_payroll"], remaining)


def _paid(i: Inputs) -> DataFrame:
    return i.rec.filter(F.col("payroll_status") == "paid")


def _two_spellings(emp: DataFrame) -> DataFrame:
    """Every other employee's department in lower case."""
    return emp.withColumn("department", F.when(F.col("employee_id") % 2 == 1, F.lower("department")).otherwise(F.col("department")))


def _staff(i: Inputs) -> DataFrame:
    """Employees with and without payroll records."""
    return i.emp.unionByName(i.derived("recruits"))


def _with_actions(i: Inputs, changed: DataFrame, action: str) -> DataFrame:
    new = activity.employee_actions(changed, action, 1, RUN_TS, first_log_id=jobs.next_id(i.log, "log_id"))
    return sinks.append_activity(i.log, new, i.users)


def _log_edits(i: Inputs) -> DataFrame:
    state, outcome = jobs.update_employees(i.emp, i.derived("edits"), RUN_TS)
    updated = outcome.filter(F.col("outcome") == "updated")
    return _with_actions(i, state.join(updated, "employee_id", "left_semi"), "EDIT_EMPLOYEE")


def _log_deletions(i: Inputs) -> DataFrame:
    staff = _staff(i)
    _, outcome = jobs.delete_employees(staff, i.derived("departures"), i.rec)
    gone = outcome.filter(F.col("outcome") == "deleted")
    return _with_actions(i, staff.join(gone, "employee_id", "left_semi"), "DELETE_EMPLOYEE")


def _log_payroll(i: Inputs) -> DataFrame:
    _, outcome = jobs.run_payroll(i.stored_rec, i.emp, NEW_YEAR, NEW_MONTH, RUN_TS)
    done = activity.payroll_action(outcome, NEW_YEAR, NEW_MONTH, 1, RUN_TS, jobs.next_id(i.log, "log_id"))
    return sinks.append_activity(i.log, done, i.users)


def _log_etl(i: Inputs) -> DataFrame:
    done = activity.etl_action(sinks.read_jobs(i.spark, _published(i)), 1, 1, RUN_TS, jobs.next_id(i.log, "log_id"))
    return sinks.append_activity(i.log, done, i.users)


def _published_job(i: Inputs, job: Callable[[DataFrame, jobs.Reserve], tuple[DataFrame, DataFrame]], years: list[int]) -> DataFrame:
    """Run a job on stored records with reserved ids, publish the years it may change, and read the table again."""
    folder = staging_path(i.spark, "operational")
    tables.save_tables({"payroll_records": i.rec}, folder)
    reserve = lambda count, free: versions.reserve_ids(i.spark, folder, "payroll_id", count, free)
    code, _ = jobs.publish_job(i.spark, folder, years, lambda rec: job(rec, reserve))
    if code != tables.PUBLISHED:
        raise RuntimeError("another writer has replaced the records")
    return tables.load_tables(i.spark, folder, ("payroll_records",))["payroll_records"]


def _period_errors(i: Inputs) -> DataFrame:
    """Merge requests moved back eight years and on by a month, so that some leave the calendar."""
    moved = i.derived("staged_payroll").withColumn("year", F.col("payroll_year")).withColumn("month", F.col("payroll_month")) \
        .withColumn("payroll_month", F.col("month") + 1).withColumn("payroll_year", F.col("year") - 8)
    return jobs.validate_periods(moved).select("request_order", F.col("month").alias("payroll_month"),
                                               F.col("year").alias("payroll_year"), F.concat_ws(", ", "errors").alias("errors"))


def _log_additions(i: Inputs) -> DataFrame:
    state, _ = jobs.add_employees(i.emp, i.derived("candidates"), RUN_TS)
    return _with_actions(i, state.filter(F.col("created_at") == F.lit(RUN_TS).cast("timestamp_ntz")), "ADD_EMPLOYEE")


def _errors_as_text(df: DataFrame) -> DataFrame:
    return df.select("request_order", "employee_code", F.concat_ws(", ", "errors").alias("errors"))


_QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {
    # sources and sinks
    "load_tables": _load_tables,
    "append_activity": lambda i: sinks.append_activity(i.log, i.derived("actions"), i.users),
    "write_activity": _write_activity,
    "export_audit_csv": _export_csv,
    "export_audit_csv_action": lambda i: _export_csv(i, "PURCHASE_EVENT"),
    "export_json": _export_json,
    "run_etl": lambda i: sinks.read_snapshot(i.spark, _published(i))["fact_payroll"],
    "run_etl_job": lambda i: sinks.read_jobs(i.spark, _published(i)).select(ETL_JOBS.names),
    # filters and projections
    "processed_only": lambda i: filters.processed_only(i.rec),
    "payroll_history": lambda i: filters.payroll_history(i.rec, i.emp),
    "payroll_history_by_year": lambda i: filters.payroll_history(i.rec, i.emp, year=YEAR),
    "payroll_history_by_month": lambda i: filters.payroll_history(i.rec, i.emp, month=MONTH),
    "payroll_history_by_department": lambda i: filters.payroll_history(i.rec, i.emp, department=DEPARTMENT),
    "employee_search": lambda i: filters.employee_search(i.emp),
    "employee_search_text": lambda i: filters.employee_search(i.emp, "R#0%7_1"),
    "employee_search_department": lambda i: filters.employee_search(i.emp, "customer", DEPARTMENT),
    "employee_quick_search": lambda i: filters.employee_quick_search(i.emp, "mach"),
    "audit_search": lambda i: filters.audit_search(i.log, limit=PAGE),
    "audit_search_action": lambda i: filters.audit_search(i.log, action="PURCHASE_EVENT", limit=PAGE),
    "audit_search_stored_days": _stored_days,
    "audit_search_user": lambda i: filters.audit_search(i.log, user="USER_1", limit=PAGE),
    "audit_search_date_range": lambda i: filters.audit_search(i.log, date_from=DAY_FROM, date_to=DAY_TO, limit=PAGE),
    "select_payees_all": lambda i: filters.select_payees(i.emp, "all"),
    "select_payees_department": lambda i: filters.select_payees(i.emp, "department", DEPARTMENT),
    "select_payees_specific": lambda i: filters.select_payees(i.emp, "specific", ids=_paid(i)),
    "active_employees": lambda i: filters.active_employees(i.emp),
    "employee_roster": lambda i: filters.employee_roster(i.emp),
    "user_roster": lambda i: filters.user_roster(i.users),
    "payroll_history_detail": lambda i: filters.payroll_history_detail(i.rec, i.emp),
    "period_records": lambda i: filters.period_records(i.rec, YEAR, MONTH),
    "delete_period": lambda i: filters.delete_period(i.rec, YEAR, MONTH),
    # joins and referential rules
    "records_with_employee": lambda i: joins.records_with_employee(i.rec, i.emp),
    "star_join": lambda i: joins.star_join(i.star),
    "deletable_employees": lambda i: joins.deletable_employees(_staff(i), _staff(i), i.rec)[0],
    "undeletable_employees": lambda i: joins.deletable_employees(_staff(i), _staff(i), i.rec)[1],
    "null_deleted_users": lambda i: joins.null_deleted_users(i.log, i.users),
    "cascade_facts": _cascade,
    "etl_rejects": lambda i: joins.etl_rejects(i.stored_rec, i.star),
    # aggregates
    "monthly_summary": lambda i: agg.monthly_summary(i.rec),
    "department_summary": lambda i: agg.department_summary(i.rec, i.emp),
    "data_mart_dept_summary": lambda i: agg.data_mart_dept_summary(i.star),
    "data_mart_report": lambda i: agg.data_mart_report(i.star),
    "processed_periods": lambda i: agg.processed_periods(i.rec),
    "payroll_trend": lambda i: agg.payroll_trend(i.rec),
    "history_summary": lambda i: agg.history_summary(i.rec),
    "history_summary_labels": lambda i: agg.history_summary_labels(i.rec),
    "department_distribution": lambda i: agg.department_distribution(i.emp),
    "dashboard_kpis": lambda i: agg.dashboard_kpis(i.emp, i.rec),
    "employee_stats": lambda i: agg.employee_stats(i.emp),
    "payroll_estimate": lambda i: agg.payroll_estimate(i.emp),
    "payroll_estimate_department": lambda i: agg.payroll_estimate(i.emp, "department", DEPARTMENT),
    "payroll_estimate_specific": lambda i: agg.payroll_estimate(i.emp, "specific", ids=_paid(i)),
    "payroll_estimate_by_department": lambda i: agg.payroll_estimate_by_department(i.emp),
    "warehouse_stats": lambda i: agg.warehouse_stats(i.star, i.stored_rec),
    "audit_stats": lambda i: agg.audit_stats(i.log, DAY_FROM),
    "api_totals": lambda i: agg.api_totals(i.emp, i.rec),
    "departments": lambda i: agg.departments(i.emp),
    "departments_active": lambda i: agg.departments(i.emp, active_only=True),
    "audit_actions": lambda i: agg.audit_actions(i.log),
    # windows
    "employee_payroll_ranking": lambda i: windows.employee_payroll_ranking(i.rec, i.emp),
    "department_trends": lambda i: windows.department_trends(i.rec, i.emp),
    "employee_payroll_analytics": lambda i: windows.employee_payroll_analytics(i.rec, i.emp),
    "global_row_number": lambda i: global_row_number(
        filters.processed_only(i.rec).select("employee_id", "payroll_year", "payroll_month", "net_amount"),
        [F.desc("net_amount"), F.col("employee_id"), F.col("payroll_year"), F.col("payroll_month")],
        "overall_rank"),
    # the same where departments are spelled in two ways, grouped under a collation
    "department_summary_collated": lambda i: agg.department_summary(i.rec, _two_spellings(i.emp), ANY_CASE),
    "department_distribution_collated": lambda i: agg.department_distribution(_two_spellings(i.emp), collation=ANY_CASE),
    "payroll_estimate_department_collated": lambda i: agg.payroll_estimate(
        _two_spellings(i.emp), "department", DEPARTMENT, collation=ANY_CASE),
    "payroll_estimate_by_department_collated": lambda i: agg.payroll_estimate_by_department(_two_spellings(i.emp), ANY_CASE),
    "employee_payroll_ranking_collated": lambda i: windows.employee_payroll_ranking(
        i.rec, _two_spellings(i.emp), collation=ANY_CASE),
    "department_trends_collated": lambda i: windows.department_trends(i.rec, _two_spellings(i.emp), collation=ANY_CASE),
    "employee_payroll_analytics_collated": lambda i: windows.employee_payroll_analytics(
        i.rec, _two_spellings(i.emp), collation=ANY_CASE),
    # top-k listings
    "recent_employees": lambda i: topk.recent_employees(i.emp),
    "fact_detail": lambda i: topk.fact_detail(i.star),
    "etl_history": lambda i: topk.etl_history(i.jobs),
    "latest_job": lambda i: topk.latest_job(i.jobs),
    "recent_payrolls": lambda i: topk.recent_payrolls(i.rec, i.emp),
    "recent_payrolls_brief": lambda i: topk.recent_payrolls_brief(i.rec, i.emp),
    "dim_employee_preview": lambda i: topk.dim_preview(i.star, "dim_employee"),
    "dim_time_preview": lambda i: topk.dim_preview(i.star, "dim_time"),
    "dim_department_preview": lambda i: topk.dim_preview(i.star, "dim_department"),
    "fact_preview": lambda i: topk.fact_preview(i.star),
    # data-changing jobs
    "validate_employees": lambda i: _errors_as_text(jobs.validate_employees(i.derived("candidates"))),
    "add_employees": lambda i: jobs.add_employees(i.emp, i.derived("candidates"), RUN_TS)[0],
    "add_employees_outcome": lambda i: jobs.add_employees(i.emp, i.derived("candidates"), RUN_TS)[1],
    "update_employees": lambda i: jobs.update_employees(i.emp, i.derived("edits"), RUN_TS)[0],
    "update_employees_outcome": lambda i: jobs.update_employees(i.emp, i.derived("edits"), RUN_TS)[1],
    "deactivate_employees": lambda i: jobs.deactivate_employees(i.emp, _paid(i), RUN_TS),
    "delete_employees": lambda i: jobs.delete_employees(_staff(i), i.derived("departures"), i.rec)[0],
    "delete_employees_outcome": lambda i: jobs.delete_employees(_staff(i), i.derived("departures"), i.rec)[1],
    "log_deleted_employees": _log_deletions,
    "log_payroll_run": _log_payroll,
    "log_etl_run": _log_etl,
    "validate_periods": _period_errors,
    "log_edited_employees": _log_edits,
    "log_added_employees": _log_additions,
    "compute_pay": lambda i: jobs.compute_pay(filters.select_payees(i.emp)),
    "run_payroll": lambda i: jobs.run_payroll(i.stored_rec, i.emp, NEW_YEAR, NEW_MONTH, RUN_TS)[0],
    "run_payroll_department": lambda i: jobs.run_payroll(
        i.stored_rec, i.emp, NEW_YEAR, NEW_MONTH, RUN_TS, "department", DEPARTMENT)[0],
    "run_payroll_specific": lambda i: jobs.run_payroll(
        i.stored_rec, i.emp, NEW_YEAR, NEW_MONTH, RUN_TS, "specific", ids=_paid(i))[0],
    "published_run_payroll": lambda i: _published_job(
        i, lambda rec, reserve: jobs.run_payroll(rec, i.emp, NEW_YEAR, NEW_MONTH, RUN_TS, reserve=reserve), [NEW_YEAR]),
    "published_merge_payroll": lambda i: _published_job(
        i, lambda rec, reserve: jobs.merge_payroll(rec, i.emp, i.stored_requests, RUN_TS, reserve=reserve),
        sorted(r[0] for r in i.stored_requests.select("payroll_year").distinct().collect())),
    "published_delete_period": lambda i: _published_job(
        i, lambda rec, _: (filters.delete_period(rec, YEAR, MONTH), filters.period_records(rec, YEAR, MONTH)), [YEAR]),
    "run_payroll_outcome": lambda i: jobs.run_payroll(i.stored_rec, i.emp, NEW_YEAR, NEW_MONTH, RUN_TS)[1],
    "run_payroll_refused": lambda i: jobs.run_payroll(i.stored_rec, i.emp, YEAR, MONTH, RUN_TS)[1],
    "run_payroll_employee_guard": lambda i: jobs.run_payroll(
        i.stored_rec, i.emp, YEAR, MONTH, RUN_TS, guard="employee")[0],
    "merge_payroll": lambda i: jobs.merge_payroll(i.stored_rec, i.emp, i.stored_requests, RUN_TS)[0],
    "merge_payroll_outcome": lambda i: jobs.merge_payroll(i.stored_rec, i.emp, i.stored_requests, RUN_TS)[1],
    # warehouse load
    "dim_department": lambda i: etl.dim_department(i.emp, RUN_TS),
    "dim_employee": lambda i: etl.dim_employee(i.emp, RUN_TS),
    "dim_time": lambda i: etl.dim_time(i.rec),
    "fact_payroll": lambda i: i.star["fact_payroll"],
}


def queries() -> dict[str, Query]:
    return {name: (lambda spark, folder, run=run: run(Inputs(spark, folder)))
            for name, run in _QUERIES.items()}

"""Audit-trail actions of the data-changing jobs.

Each function turns what a job did into action rows for
``sources.sinks.append_activity``, which adds the user's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paystrata.functions import text
from paystrata.operators.ranking import global_row_number

# Action names, and how each begins its details text.
EMPLOYEE_ACTIONS = {
    "ADD_EMPLOYEE": "Added employee: ",
    "EDIT_EMPLOYEE": "Edited employee: ",
    "DELETE_EMPLOYEE": "Deleted employee: ",
}


def _actions(rows: DataFrame, user_id: int, action: str, module: str, details: Column, run_ts: str,
             ip_address: str | None) -> DataFrame:
    return rows.select(
        "log_id", F.lit(user_id).cast("long").alias("user_id"), F.lit(action).alias("action_name"),
        F.lit(module).alias("module_name"), details.alias("details_text"),
        F.lit(ip_address).cast("string").alias("ip_address"),
        F.lit(run_ts).cast("timestamp_ntz").alias("created_at"))


def employee_actions(changed: DataFrame, action: str, user_id: int, run_ts: str, first_log_id: int,
                     ip_address: str | None = None, slots: int | None = None) -> DataFrame:
    """One action per added, edited or deleted employee row; edits name the new version."""
    details = F.concat(F.lit(EMPLOYEE_ACTIONS[action]), "employee_code", F.lit(" - "), text.full_name())
    if action == "EDIT_EMPLOYEE":
        details = F.concat(details, F.lit(" (Version: "), "version_number", F.lit(")"))
    numbered = global_row_number(changed, [F.col("employee_id")], "log_id", start=first_log_id, slots=slots)
    return _actions(numbered, user_id, action, "Employees", details, run_ts, ip_address)


def payroll_action(outcome: DataFrame, year: int, month: int, user_id: int, run_ts: str, log_id: int,
                   ip_address: str | None = None) -> DataFrame:
    """The action of one payroll run; none when the run was refused."""
    period = F.date_format(F.make_date(F.lit(year), F.lit(month), F.lit(1)), "MMMM yyyy")
    details = F.concat(F.lit("Processed payroll for "), period, F.lit(" - "), "record_count", F.lit(" employees"))
    done = outcome.filter(F.col("result_code") == 0).withColumn("log_id", F.lit(log_id).cast("long"))
    return _actions(done, user_id, "PROCESS_PAYROLL", "Payroll", details, run_ts, ip_address)


def etl_action(jobs: DataFrame, job_id: int, user_id: int, run_ts: str, log_id: int,
               ip_address: str | None = None) -> DataFrame:
    """The action of one completed warehouse load."""
    details = F.concat(F.lit("ETL process completed - "), "records_processed", F.lit(" records processed"))
    done = jobs.filter((F.col("job_id") == job_id) & (F.col("job_status") == "completed"))
    return _actions(done.withColumn("log_id", F.lit(log_id).cast("long")), user_id, "RUN_ETL",
                    "Data Warehouse", details, run_ts, ip_address)

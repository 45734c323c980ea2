"""Warehouse load: operational tables to the star schema."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paystrata.functions import calendar, text
from paystrata.operators.filters import processed_only
from paystrata.operators.ranking import global_row_number
from paystrata.schema import WAREHOUSE
from paystrata.sources.sinks import claim_job, log_job, write_snapshot
from paystrata.sources.staging import staged
from paystrata.sources.tables import load_tables

NOTHING_TO_LOAD = "no processed payroll records"


def _shaped(df: DataFrame, table: str) -> DataFrame:
    return df.select([F.col(f.name).cast(f.dataType) for f in WAREHOUSE[table]])


def _stamp(run_ts: str) -> Column:
    return F.lit(run_ts).cast("timestamp_ntz")


def etl_precheck(rec: DataFrame) -> bool:
    """Whether there is anything to load; reads until the first processed record."""
    return not processed_only(rec).limit(1).isEmpty()


def dim_department(emp: DataFrame, run_ts: str, collation: str | None = None,
                   slots: int | None = None) -> DataFrame:
    """Distinct cleaned names of all employees; under a collation one per spelling group."""
    names = emp.select(text.cleaned("department", "Unknown").alias("department_name"))
    if collation:
        names = names.groupBy(text.collated(F.col("department_name"), collation).alias("_spelling")) \
            .agg(F.min("department_name").alias("department_name")).drop("_spelling")
    else:
        names = names.distinct()
    keyed = global_row_number(names, [F.col("department_name")], "department_key", slots=slots)
    return _shaped(keyed.withColumn("created_at", _stamp(run_ts)), "dim_department")


def dim_employee(emp: DataFrame, run_ts: str, slots: int | None = None) -> DataFrame:
    """Current snapshot of the active employees."""
    current = emp.filter(F.col("emp_status") == "active").select(
        "employee_id", "employee_code", text.full_name().alias("full_name"),
        text.cleaned("department", "Unknown").alias("department_name"),
        text.cleaned("emp_position", "Staff").alias("position_title"),
        F.lit(True).alias("is_current_record"), _stamp(run_ts).alias("loaded_at"),
    )
    return _shaped(global_row_number(current, [F.col("employee_id")], "employee_key", slots=slots),
                   "dim_employee")


def dim_time(rec: DataFrame) -> DataFrame:
    """One row per processed period.

    The key comes from a plain window: there are at most twelve rows per year.
    """
    year, month = F.col("year_number"), F.col("month_number")
    periods = processed_only(rec).select(
        F.col("payroll_year").alias("year_number"), F.col("payroll_month").alias("month_number")).distinct()
    keyed = periods.withColumn("time_key", F.row_number().over(Window.orderBy(year, month)))
    return _shaped(
        keyed.withColumn("month_name_text", calendar.month_name(year, month))
        .withColumn("year_month_text", calendar.year_month(year, month))
        .withColumn("quarter_number", calendar.quarter(month))
        .withColumn("half_year", calendar.half_year(month)), "dim_time")


def fact_payroll(rec: DataFrame, dims: dict[str, DataFrame], run_ts: str,
                 collation: str | None = None, slots: int | None = None) -> DataFrame:
    """Processed records with the keys of their dimensions.

    The department key is looked up on the employee dimension first, so that
    records are joined once by employee and once by period.
    """
    by_name = dims["dim_department"].select(
        "department_key", text.collated(F.col("department_name"), collation).alias("_name"))
    people = dims["dim_employee"].select(
        "employee_key", "employee_id", text.collated(F.col("department_name"), collation).alias("_name"))
    people = people.join(by_name, "_name").drop("_name")
    periods = dims["dim_time"].select("time_key", F.col("year_number").alias("payroll_year"),
                                      F.col("month_number").alias("payroll_month"))
    loaded = (
        processed_only(rec)
        .select("employee_id", "payroll_year", "payroll_month", "net_amount", "gross_amount",
                "total_deductions_amount", "allowances_amount", "overtime_amount")
        .join(periods, ["payroll_year", "payroll_month"])
        .join(people, "employee_id")
        .select("employee_key", "time_key", "department_key",
                F.col("net_amount").alias("net_pay"), F.col("gross_amount").alias("gross_pay"),
                F.col("total_deductions_amount").alias("total_deductions"),
                F.col("allowances_amount").alias("allowances"), F.col("overtime_amount").alias("overtime"))
    )
    keyed = global_row_number(loaded, [F.col("time_key"), F.col("employee_key")], "fact_id", slots=slots)
    return _shaped(keyed.withColumn("loaded_at", _stamp(run_ts)), "fact_payroll")


def _dimensions(emp: DataFrame, rec: DataFrame, run_ts: str, collation: str | None,
                slots: int | None) -> dict[str, DataFrame]:
    return {
        "dim_department": dim_department(emp, run_ts, collation, slots),
        "dim_employee": dim_employee(emp, run_ts, slots),
        "dim_time": dim_time(rec),
    }


def build_star(emp: DataFrame, rec: DataFrame, run_ts: str, collation: str | None = None,
               slots: int | None = None) -> dict[str, DataFrame]:
    """The four warehouse tables of one run, unpublished. Keys restart at 1 each time.

    The dimensions are written first: the joins of the fact table then see
    their true sizes, and none of them is computed twice.
    """
    dims = {name: staged(df, name) for name, df in _dimensions(emp, rec, run_ts, collation, slots).items()}
    return {**dims, "fact_payroll": fact_payroll(rec, dims, run_ts, collation, slots)}


def _now() -> str:
    return dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")


def run_etl(emp: DataFrame, rec: DataFrame, folder: str, job_id: int | None, run_ts: str,
            collation: str | None = None, slots: int | None = None, clock: Callable[[], str] = _now) -> str:
    """Load the warehouse and publish it as the new current snapshot.

    The tables go to a directory of their own; only the ``completed`` job row
    makes readers see it, so a failed run leaves the previous snapshot in
    place. Each run has a job id of its own: the next one if ``job_id`` is None;
    one that has been used is refused with a ValueError before a row is written,
    so no run can overrule another's state. Returns ``completed`` or ``nothing
    to load``; a failure is logged in full and raised again. ``clock`` gives the
    time a job ends.
    """
    spark = emp.sparkSession
    if not etl_precheck(rec):
        return NOTHING_TO_LOAD
    job_id = claim_job(spark, folder, job_id)
    log_job(spark, folder, job_id, "running", 0, None, run_ts, None)
    try:
        dims = _dimensions(emp, rec, run_ts, collation, slots)
        path = write_snapshot(dims, folder, job_id)
        written = load_tables(spark, path, tuple(dims))
        write_snapshot({"fact_payroll": fact_payroll(rec, written, run_ts, collation, slots)}, folder, job_id)
        facts = load_tables(spark, path, ("fact_payroll",))["fact_payroll"].count()
    except Exception as error:
        log_job(spark, folder, job_id, "failed", 0, str(error), run_ts, clock())
        raise
    log_job(spark, folder, job_id, "completed", facts, None, run_ts, clock())
    return "completed"

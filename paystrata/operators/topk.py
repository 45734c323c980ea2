"""Top-k listings. Every task keeps its own k rows; only those are merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paystrata.functions import text
from paystrata.operators.joins import records_with_employee, star_join
from paystrata.schema import KEYS


def recent_employees(emp: DataFrame, k: int = 5) -> DataFrame:
    return (
        emp.orderBy(F.desc("employee_id")).limit(k)
        .select("employee_code", "first_name", "last_name", "department", "basic_salary")
    )


def fact_detail(star: dict[str, DataFrame], k: int = 30) -> DataFrame:
    """The latest and highest facts; only these are joined with the wide dimensions."""
    order = [F.desc("year_number"), F.desc("month_number"), F.desc("net_pay"), F.asc("fact_id")]
    facts = star["fact_payroll"]
    latest = (
        facts.join(star["dim_time"].select("time_key", "year_number", "month_number"), "time_key")
        .join(star["dim_department"].select("department_key"), "department_key", "left_semi")
        .join(star["dim_employee"].select("employee_key"), "employee_key", "left_semi")
        .orderBy(*order).limit(k).select(facts.columns)
    )
    return (
        star_join({**star, "fact_payroll": latest})
        .orderBy(*order)
        .select("fact_id", "net_pay", "gross_pay", "total_deductions", "allowances", "overtime",
                "full_name", F.col("employee_department").alias("department_name"), "position_title",
                F.concat("month_name_text", F.lit(" "), "year_number").alias("period"), "quarter_number")
    )


def etl_history(jobs: DataFrame, k: int = 10) -> DataFrame:
    return (
        jobs.select("job_id", "job_name", "job_status", "records_processed", "error_message",
                    "started_at", "completed_at")
        .orderBy(F.desc("started_at"), F.desc("job_id")).limit(k)
    )


def latest_job(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.desc("job_id")).limit(1)


def recent_payrolls(rec: DataFrame, emp: DataFrame, k: int = 50) -> DataFrame:
    """The latest processed records of any status; never processed ones come last."""
    latest = rec.join(emp.select("employee_id"), "employee_id", "left_semi") \
        .orderBy(F.desc("processed_at"), F.desc("payroll_id")).limit(k)
    return records_with_employee(latest, emp).select(
        *rec.columns, text.full_name().alias("employee_name"), "employee_code", "department",
    ).orderBy(F.desc("processed_at"), F.desc("payroll_id"))


def recent_payrolls_brief(rec: DataFrame, emp: DataFrame, k: int = 5) -> DataFrame:
    return recent_payrolls(rec, emp, k).select(
        "payroll_id", F.col("employee_name").alias("name"), "gross_amount", "processed_at")


_PREVIEW = {
    "dim_employee": ["employee_id", "employee_code", "full_name", "department_name", "position_title"],
    "dim_time": ["year_number", "month_number", "month_name_text", "year_month_text"],
    "dim_department": ["department_name"],
}


def dim_preview(star: dict[str, DataFrame], name: str, k: int = 20) -> DataFrame:
    """First rows of a dimension by key; the newest periods of the time dimension."""
    order = ([F.desc("year_number"), F.desc("month_number")] if name == "dim_time"
             else [F.col(KEYS[name])])
    return star[name].orderBy(*order).limit(k).select(*_PREVIEW[name])


def fact_preview(star: dict[str, DataFrame], k: int = 10) -> DataFrame:
    known = star["dim_employee"].select("employee_key", "full_name", "department_name")
    first = star["fact_payroll"].join(known.select("employee_key"), "employee_key", "left_semi") \
        .orderBy("fact_id").limit(k)
    return first.join(known, "employee_key").select(
        "fact_id", "net_pay", "gross_pay", "total_deductions", "full_name", "department_name",
    ).orderBy("fact_id")

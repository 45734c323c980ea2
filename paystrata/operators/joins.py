"""Joins and referential rules.

No join here carries a broadcast hint: table sizes are not bounded, so the
planner decides from measured sizes and splits skewed sides at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paystrata.functions import text
from paystrata.sources.staging import staged

# Columns of the employee side that records also have or that no report needs.
_EMPLOYEE_ONLY = ["employee_id", "employee_code", "first_name", "last_name", "department", "emp_position"]


def records_with_employee(rec: DataFrame, emp: DataFrame) -> DataFrame:
    """Records joined with the descriptive columns of their employee."""
    return rec.join(emp.select(*_EMPLOYEE_ONLY), "employee_id")


def one_spelling(emp: DataFrame, collation: str | None) -> DataFrame:
    """Employees with one spelling per department: the smallest of those that are equal under the collation.

    Without a collation nothing changes. The spellings are written first: one
    row per department, which the planner broadcasts by its size.
    """
    if not collation:
        return emp
    key = text.collated(F.col("department"), collation)
    spellings = staged(emp.filter(F.col("department").isNotNull()).groupBy(key.alias("_key")).agg(
        F.min("department").alias("_spelling")).select("_spelling"), "spellings")
    return (
        emp.withColumn("_key", key)
        .join(spellings.withColumn("_key", text.collated(F.col("_spelling"), collation)), "_key", "left")
        .withColumn("department", F.coalesce("_spelling", "department")).select(emp.columns)
    )


def star_join(star: dict[str, DataFrame]) -> DataFrame:
    """Facts with their three dimensions; a NULL key drops the fact."""
    dim_employee = star["dim_employee"].withColumnRenamed("loaded_at", "employee_loaded_at") \
        .withColumnRenamed("department_name", "employee_department")
    dim_department = star["dim_department"].withColumnRenamed("created_at", "department_created_at")
    return (
        star["fact_payroll"]
        .join(star["dim_time"], "time_key")
        .join(dim_department, "department_key")
        .join(dim_employee, "employee_key")
    )


def deletable_employees(emp: DataFrame, ids: DataFrame, rec: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split requested ids by whether payroll rows restrict the delete.

    Returns the employees that may go, and the rejected ids with their count of
    records. The count is combined before the join, so a hot id is one row.
    """
    # The ids that exist are written first: a small batch is then broadcast, and only its own records are counted.
    wanted = staged(emp.join(ids.select("employee_id").distinct(), "employee_id", "left_semi"), "wanted-employees")
    held = staged(rec.select("employee_id").join(wanted.select("employee_id"), "employee_id", "left_semi").groupBy("employee_id").agg(
        F.count("*").alias("record_count")), "held-records")
    allowed = wanted.join(held, "employee_id", "left_anti")
    rejected = wanted.select("employee_id", "employee_code").join(held, "employee_id")
    return allowed, rejected


def null_deleted_users(log: DataFrame, users: DataFrame) -> DataFrame:
    """Log rows of users that are gone lose the id and keep the name."""
    known = users.select("user_id", F.lit(True).alias("_known"))
    return (
        log.join(known, "user_id", "left")
        .withColumn("user_id", F.when(F.col("_known"), F.col("user_id")))
        .select(*log.columns)
    )


def cascade_facts(fact: DataFrame, star: dict[str, DataFrame]) -> DataFrame:
    """Facts whose dimension rows all exist; a NULL key refers to nothing and stays."""
    kept = fact
    for key, dim in (("time_key", "dim_time"), ("department_key", "dim_department"),
                     ("employee_key", "dim_employee")):
        flag = f"_has_{key}"
        kept = (
            kept.join(star[dim].select(key, F.lit(True).alias(flag)), key, "left")
            .filter(F.col(flag) | F.col(key).isNull()).drop(flag)
        )
    return kept.select(*fact.columns)


def etl_rejects(rec: DataFrame, star: dict[str, DataFrame]) -> DataFrame:
    """Processed records that the warehouse load dropped: no current employee row."""
    processed = rec.filter(F.col("payroll_status") == "processed")
    loaded_periods = star["dim_time"].select(F.col("year_number").alias("payroll_year"),
                                             F.col("month_number").alias("payroll_month"),
                                             F.lit(True).alias("_period"))
    loaded_employees = (
        star["dim_employee"].join(star["dim_department"].select("department_name"), "department_name", "left_semi")
        .select("employee_id", F.lit(True).alias("_employee"))
    )
    return (
        processed.join(loaded_employees, "employee_id", "left")
        .join(loaded_periods, ["payroll_year", "payroll_month"], "left")
        .filter(F.col("_employee").isNull() | F.col("_period").isNull())
        .select(*rec.columns)
    )

"""Sinks: the audit log, exports, and the published warehouse snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paystrata.functions.text import action_label
from paystrata.schema import ACTIVITY_LOGS, ETL_JOBS, WAREHOUSE
from paystrata.sources import versions
from paystrata.sources.tables import append_table, load_tables

# Fixed value: the name of the warehouse job.
JOB_NAME = "Payroll ETL"


# --- audit log -------------------------------------------------------------

def append_activity(log: DataFrame, actions: DataFrame, users: DataFrame) -> DataFrame:
    """The log with new actions, each carrying the user's name as of now.

    The name is frozen: later changes of the user do not reach the log.
    """
    # The name and the address where there is none.
    names = users.select("user_id", "username")
    rows = actions.join(names, "user_id", "left").select(
        "log_id", "user_id",
        F.coalesce("username", F.lit("Unknown")).alias("username"),
        "action_name", "module_name", "details_text",
        F.coalesce("ip_address", F.lit("127.0.0.1")).alias("ip_address"),
        "created_at",
    )
    shaped = rows.select([F.col(f.name).cast(f.dataType) for f in ACTIVITY_LOGS])
    return log.unionByName(shaped)


def write_activity(actions: DataFrame, users: DataFrame, folder: str) -> None:
    """Append new actions to the log table, by month, without rewriting it."""
    none_yet = actions.sparkSession.createDataFrame([], ACTIVITY_LOGS)
    append_table(append_activity(none_yet, actions, users), "activity_logs", folder)


# --- exports ---------------------------------------------------------------

# The headings of the audit export.
AUDIT_COLUMNS = ["Timestamp", "User", "Action", "Module", "Details", "IP Address"]


def audit_export_rows(log: DataFrame) -> DataFrame:
    """The audit listing as displayed, with commas turned into semicolons."""
    shown = [
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"),
        F.col("username"),
        action_label(F.col("action_name")),
        F.coalesce("module_name", F.lit("-")),
        F.coalesce("details_text", F.lit("-")),
        F.coalesce("ip_address", F.lit("")),
    ]
    return log.select([F.translate(value, ",", ";").alias(name)
                       for value, name in zip(shown, AUDIT_COLUMNS)])


def export_audit_csv(log: DataFrame, path: str) -> None:
    """CSV files with a header line and every field quoted."""
    (audit_export_rows(log).write.option("header", True).option("quoteAll", True)
     .option("escape", '"').csv(path))


def export_json(df: DataFrame, path: str) -> None:
    """One JSON object per row; NULL fields are written as null."""
    df.write.option("ignoreNullFields", False).json(path)


# --- warehouse snapshot ----------------------------------------------------

def write_snapshot(star: dict[str, DataFrame], folder: str, job_id: int) -> str:
    """Write warehouse tables of one run to the run's own directory."""
    path = f"{folder}/run_id={job_id}"
    for name, df in star.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    return path


def claim_job(spark: SparkSession, folder: str, job_id: int | None = None) -> int:
    """Take a job id that no run has had: the given one, or the next. Each id goes to one caller.

    A used id is refused before anything is written.
    """
    log = f"{folder}/etl_jobs"
    used = read_jobs(spark, folder).select("job_id") if versions.names(spark, log) else None
    if job_id is not None:
        taken = used is not None and not used.filter(F.col("job_id") == job_id).isEmpty()
        if taken or not versions.put_if_absent(spark, f"{folder}/_jobs/{job_id}", ""):
            raise ValueError(f"job {job_id} has been run")
        return job_id
    newest = used.agg(F.max("job_id")).first()[0] if used is not None else None
    job_id = max([newest or 0, *(int(name) for name in versions.names(spark, f"{folder}/_jobs") if name.isdigit())]) + 1
    while not versions.put_if_absent(spark, f"{folder}/_jobs/{job_id}", ""):
        job_id += 1
    return job_id


def log_job(spark: SparkSession, folder: str, job_id: int, status: str, records: int,
             message: str | None, started: str, completed: str | None) -> None:
    row = spark.range(1).select(
        F.lit(job_id).alias("job_id"), F.lit(JOB_NAME).alias("job_name"), F.lit(status).alias("job_status"),
        F.lit(records).alias("records_processed"), F.lit(message).alias("error_message"),
        F.lit(started).alias("started_at"), F.lit(completed).alias("completed_at"))
    row.select([F.col(f.name).cast(f.dataType) for f in ETL_JOBS]) \
        .coalesce(1).write.mode("append").parquet(f"{folder}/etl_jobs")


def read_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """The job log, one row per job: completed if it ever was, else its latest final state, else running."""
    log = spark.read.schema(ETL_JOBS).parquet(f"{folder}/etl_jobs")
    state = F.struct((F.col("job_status") == "completed").alias("whole"), F.col("completed_at").alias("ended"), *ETL_JOBS.names)
    return log.groupBy("job_id").agg(F.max(state).alias("state")) \
        .select([F.col(f"state.{name}") for name in ETL_JOBS.names])


def read_snapshot(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The warehouse tables of the latest completed run."""
    newest = read_jobs(spark, folder).filter(F.col("job_status") == "completed") \
        .agg(F.max("job_id").alias("job_id")).first()
    if newest.job_id is None:
        raise LookupError("no completed warehouse load")
    return load_tables(spark, f"{folder}/run_id={newest.job_id}", tuple(WAREHOUSE))

"""Payroll lens: the operational model seen through order-and-event tables.

The sample data holds customers, orders and events, not payroll. Each function
derives one table of the model from whole input tables, so that work grows with
them:

* ``employees`` are customers; a small balance means no department yet, a
  negative one an inactive employee, a large one no position.
* ``payroll_records`` are a customer's orders of one month, ten years on. The pair (employee,
  period) is unique. The largest order is the basic salary (a sum could outgrow
  the amount type when one customer holds much of the data). Status F makes the month processed, else O a draft, else
  it is paid. Drafts have no processing time and lock 0.
* ``users`` are event users, except those whose last event is an error: those
  accounts are gone. ``activity_logs`` are the events, ``etl_jobs`` their hours.
* ``candidates``, ``edits``, ``staged_payroll`` and ``actions`` are request
  batches for the data-changing jobs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paystrata.functions.money import pay_columns
from paystrata.schema import EMPLOYEES, MONEY, PAYROLL_RECORDS, USERS

_EPOCH = "2024-01-01 00:00:00"
_YEARS_ON = 10  # orders begin in 1995, payroll years in 2000


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _email_of(name: Column) -> Column:
    return F.concat(F.lower(F.translate(name, "# ", "..")), F.lit("@example.com"))


def employees(spark: SparkSession, folder: str) -> DataFrame:
    balance = F.col("c_acctbal")
    unassigned = (balance >= 0) & (balance < 200)
    derived = _read(spark, folder, "customer").select(
        F.col("c_custkey").alias("employee_id"),
        F.col("c_name").alias("employee_code"),
        F.split_part("c_name", F.lit("#"), F.lit(1)).alias("first_name"),
        F.split_part("c_name", F.lit("#"), F.lit(2)).alias("last_name"),
        _email_of(F.col("c_name")).alias("email"),
        F.when(~unassigned, F.col("c_mktsegment")).alias("department"),
        F.when(balance < 9000, F.concat(F.lit(" Grade "), "c_nationkey")).alias("emp_position"),
        F.greatest(F.abs(balance), F.lit(1.0)).cast(MONEY).alias("basic_salary"),
        F.date_add(F.lit("2015-01-01").cast("date"), F.col("c_nationkey") * 90).alias("hire_date"),
        F.when(balance < 0, "inactive").otherwise("active").alias("emp_status"),
        F.lit(1).alias("version_number"),
        _moment(_EPOCH).alias("created_at"),
        _moment(_EPOCH).alias("updated_at"),
    )
    return derived.select([F.col(f.name).cast(f.dataType) for f in EMPLOYEES])


def recruits(spark: SparkSession, folder: str) -> DataFrame:
    """Employees that were never paid: one per supplier, with negative ids."""
    derived = _read(spark, folder, "supplier").select(
        (-F.col("s_suppkey") - 1).alias("employee_id"),
        F.col("s_name").alias("employee_code"),
        F.split_part("s_name", F.lit("#"), F.lit(1)).alias("first_name"),
        F.split_part("s_name", F.lit("#"), F.lit(2)).alias("last_name"),
        _email_of(F.col("s_name")).alias("email"),
        F.lit("Supply").alias("department"),
        F.lit("Recruit").alias("emp_position"),
        F.greatest(F.abs("s_acctbal"), F.lit(1.0)).cast(MONEY).alias("basic_salary"),
        F.lit("2024-01-01").cast("date").alias("hire_date"),
        F.lit("active").alias("emp_status"),
        F.lit(1).alias("version_number"),
        _moment(_EPOCH).alias("created_at"),
        _moment(_EPOCH).alias("updated_at"),
    )
    return derived.select([F.col(f.name).cast(f.dataType) for f in EMPLOYEES])


def departures(spark: SparkSession, folder: str) -> DataFrame:
    """Ids asked to be deleted: every customer that ordered, and one negative id per part, few of which exist."""
    return _read(spark, folder, "orders").select(F.col("o_custkey").alias("employee_id")).unionByName(
        _read(spark, folder, "part").select((-F.col("p_partkey") - 1).alias("employee_id")))


def payroll_records(spark: SparkSession, folder: str) -> DataFrame:
    status = F.col("o_orderstatus")
    monthly = (
        _read(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("employee_id"),
                 F.month("o_orderdate").alias("payroll_month"),
                 (F.year("o_orderdate") + _YEARS_ON).alias("payroll_year"))
        .agg((F.min("o_orderkey") + 1).alias("payroll_id"),
             F.max(F.col("o_totalprice").cast(MONEY)).alias("basic"),
             # A number, not the letter: text in an aggregate forces a sort.
             F.min(F.when(status == "F", 0).when(status == "O", 1).otherwise(2)).alias("stage"),
             F.max("o_orderdate").alias("last_order"))
    )
    draft = F.col("stage") == 1
    derived = monthly.select(
        "payroll_id", "employee_id", "payroll_month", "payroll_year",
        *[amount.alias(name) for name, amount in pay_columns(F.col("basic")).items()],
        F.when(F.col("stage") == 0, "processed").when(draft, "draft")
        .otherwise("paid").alias("payroll_status"),
        F.when(~draft, F.col("last_order") + F.make_ym_interval(F.lit(_YEARS_ON)))
        .alias("processed_at"),
        F.when(draft, 0).otherwise(1).alias("lock_version"),
    )
    return derived.select([F.col(f.name).cast(f.dataType) for f in PAYROLL_RECORDS])


def users(spark: SparkSession, folder: str) -> DataFrame:
    seen = (
        _read(spark, folder, "events").groupBy("user_id")
        .agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_event"),
             F.min("ts").alias("created_at"), F.max("ts").alias("last_seen"))
        .filter(F.col("last_event") != "error")
    )
    derived = seen.select(
        "user_id",
        F.concat(F.lit("user_"), "user_id").alias("username"),
        F.concat(F.lit("User "), "user_id").alias("full_name"),
        F.concat(F.lit("user."), F.col("user_id"), F.lit("@example.com")).alias("email"),
        F.when(F.col("last_event") == "purchase", "admin").otherwise("staff").alias("user_role"),
        F.lit("active").alias("user_status"),
        F.when(F.col("last_event") != "signup", F.col("last_seen")).alias("last_login"),
        "created_at",
    )
    return derived.select([F.col(f.name).cast(f.dataType) for f in USERS])


def activity_logs(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    return _read(spark, folder, "events").select(
        F.col("event_id").alias("log_id"),
        "user_id",
        F.concat(F.lit("user_"), "user_id").alias("username"),
        F.concat(F.upper(kind), F.lit("_EVENT")).alias("action_name"),
        F.when(kind == "purchase", "Payroll").when(kind == "signup", "Employees").alias("module_name"),
        F.concat(F.col("props"), F.lit(", amount "), F.col("value").cast(MONEY).cast("string"))
        .alias("details_text"),
        F.lit("127.0.0.1").alias("ip_address"),
        F.col("ts").alias("created_at"),
    )


def etl_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """One job per hour of events; hours where errors exceed a quarter failed."""
    hours = (
        _read(spark, folder, "events")
        .groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
        .agg(F.min("event_id").alias("job_id"), F.count("*").alias("events"),
             F.count_if(F.col("event_type") == "error").alias("errors"),
             F.min("ts").alias("started_at"), F.max("ts").alias("completed_at"))
    )
    failed = F.col("errors") * 4 > F.col("events")
    return hours.select(
        "job_id", F.lit("Payroll ETL").alias("job_name"),
        F.when(failed, "failed").otherwise("completed").alias("job_status"),
        F.when(failed, 0).otherwise(F.col("events")).cast("long").alias("records_processed"),
        F.when(failed, "too many errors").alias("error_message"),
        "started_at", "completed_at",
    )


def actions(spark: SparkSession, folder: str) -> DataFrame:
    """One user action per order, by the user whose id is the customer's."""
    return _read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("log_id"),
        F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_orderstatus") == "F", "PROCESS_PAYROLL").otherwise("RUN_ETL").alias("action_name"),
        F.when(F.col("o_orderstatus") == "F", "Payroll").alias("module_name"),
        F.concat(F.lit("order "), "o_orderkey").alias("details_text"),
        F.lit(None).cast("string").alias("ip_address"),
        F.col("o_orderdate").alias("created_at"),
    )


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """New-employee requests: one per part, and one per supplier.

    Parts share codes (name and brand) and e-mails (name and type), so requests
    of one batch collide; suppliers ask for e-mails that customers hold. By
    nation, a supplier's form has a tab for a first name, an address between
    white space, an over-long code or text after the salary.
    """
    kind = F.col("s_nationkey") % 5
    dotted = F.translate(F.col("p_name"), " ", ".")
    parts = _read(spark, folder, "part").select(
        (F.col("p_partkey") * 2).alias("request_order"),
        F.concat(F.col("p_name"), F.lit("/"), F.col("p_brand")).alias("employee_code"),
        F.split_part("p_name", F.lit(" "), F.lit(1)).alias("first_name"),
        F.split_part("p_name", F.lit(" "), F.lit(2)).alias("last_name"),
        F.concat(F.lower(dotted), F.lit("."), F.lower("p_type"), F.lit("@example.com")).alias("email"),
        F.col("p_type").alias("department"),
        F.col("p_brand").alias("emp_position"),
        F.col("p_retailprice").cast(MONEY).cast("string").alias("basic_salary"),
        F.lit("2024-02-01").alias("hire_date"),
    )
    held = _email_of(F.concat(F.lit("Customer#"), F.split_part("s_name", F.lit("#"), F.lit(2))))
    fresh = F.concat(F.lit("supplier."), F.col("s_suppkey"), F.lit("@example.com"))
    suppliers = _read(spark, folder, "supplier").select(
        (F.col("s_suppkey") * 2 + 1).alias("request_order"),
        F.when(kind == 2, F.rpad("s_name", 40, "+")).otherwise(F.col("s_name")).alias("employee_code"),
        F.when(kind == 0, "\t").otherwise(F.split_part("s_name", F.lit("#"), F.lit(1))).alias("first_name"),
        F.split_part("s_name", F.lit("#"), F.lit(2)).alias("last_name"),
        F.when(kind == 1, F.concat(F.lit("\t\n"), fresh, F.lit("\x0b\n"))).otherwise(held).alias("email"),
        F.lit("Supply").alias("department"),
        F.when(F.col("s_acctbal") > 0, "Buyer").otherwise("").alias("emp_position"),
        F.when(F.col("s_acctbal") > 100, F.concat(
            F.col("s_acctbal").cast(MONEY).cast("string"), F.when(kind == 3, "abc").otherwise("")))
        .otherwise("n/a").alias("basic_salary"),
        F.lit("2024-02-01").alias("hire_date"),
    )
    return parts.unionByName(suppliers)


def edits(spark: SparkSession, folder: str) -> DataFrame:
    """One employee edit per order; the priority decides what is wrong with it.

    Every fiftieth order asks for an employee that does not exist.
    """
    priority = F.col("o_orderpriority")
    fresh = F.concat(F.lit("edit."), "o_orderkey", F.lit("@example.com"))
    held = _email_of(F.concat(F.lit("Customer#"), F.lpad((F.col("o_custkey") + 1).cast("string"), 9, "0")))
    return _read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("request_order"),
        F.when(F.col("o_orderkey") % 50 == 0, -F.col("o_custkey") - 1).otherwise(F.col("o_custkey")).alias("employee_id"),
        F.when(priority == "3-MEDIUM", 0).otherwise(1).alias("current_version"),
        F.lit("Edited").alias("first_name"),
        F.concat(F.lit("Order"), "o_orderkey").alias("last_name"),
        F.when(priority == "1-URGENT", held).when(priority == "2-HIGH", "not an address")
        .otherwise(fresh).alias("email"),
        F.lit("MACHINERY").alias("department"),
        F.lit("Editor").alias("emp_position"),
        F.col("o_totalprice").cast(MONEY).cast("string").alias("basic_salary"),
        F.when(F.col("o_orderstatus") == "O", "inactive").otherwise("active").alias("emp_status"),
    )


def staged_payroll(spark: SparkSession, folder: str) -> DataFrame:
    """Payroll rows to merge: one per order line, for the employee of the part id.

    The return flag gives the lock version the sender had read.
    """
    # A number, not the letter: text in an aggregate forces a sort. Other letters
    # keep their place before, between and after the two that count.
    letter = F.col("l_returnflag")
    flag = (F.when(letter < "A", 0).when(letter == "A", 1).when(letter < "N", 2).when(letter == "N", 3)
            .when(letter > "N", 4))
    lines = (
        _read(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber")
        .agg(F.min("l_partkey").alias("employee_id"),
             F.min("l_shipdate").alias("shipped"),
             F.max(F.col("l_extendedprice").cast(MONEY)).alias("basic_salary"),
             F.max(F.col("l_quantity").cast(MONEY)).alias("quantity"),
             F.min(flag).alias("flag"))
    )
    fixed = {"sss_amount": "1350.00", "philhealth_amount": "450.00", "pagibig_amount": "200.00"}
    return lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request_order"),
        "employee_id",
        F.month("shipped").alias("payroll_month"),
        (F.year("shipped") + _YEARS_ON).alias("payroll_year"),
        "basic_salary",
        F.col("quantity").alias("allowances_amount"),
        F.col("quantity").alias("overtime_amount"),
        F.col("quantity").alias("tax_amount"),
        *[F.lit(amount).cast(MONEY).alias(name) for name, amount in fixed.items()],
        F.lit("1.00").cast(MONEY).alias("other_deductions"),
        F.when(F.col("flag") == 3, 0).when(F.col("flag") == 1, 1).otherwise(2).alias("expected_lock"),
    )


def operational(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {
        "users": users(spark, folder),
        "employees": employees(spark, folder),
        "payroll_records": payroll_records(spark, folder),
        "activity_logs": activity_logs(spark, folder),
    }

"""Data-changing jobs over whole request tables.

Each job takes the current state and a table of requests and returns the new
state and one outcome per request. All requests are checked against the state
as it was when the batch began, and then take effect in request order; a later
request that would collide with an earlier one of the batch is refused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paystrata.functions import calendar, text
from paystrata.functions.money import DEFAULT_RATES, PayRates, net_of, pay_columns
from paystrata.operators.filters import select_payees
from paystrata.operators.joins import deletable_employees
from paystrata.operators.ranking import global_row_number
from paystrata.plans.serving import ORDER, first_come
from paystrata.schema import EMPLOYEE_STATUSES, EMPLOYEES, MONEY, PAYROLL_RECORDS
from paystrata.sources.staging import staged
from paystrata.sources.tables import load_tables, publish_records, records_version


def _shaped(df: DataFrame, schema) -> DataFrame:
    return df.select([F.col(f.name).cast(f.dataType) for f in schema])


# --- validation ------------------------------------------------------------

def _messages(checks: list[tuple[Column, str]]) -> Column:
    # Joined from lists of one and none: a filter over the list would be interpreted row by row.
    none = F.array().cast("array<string>")
    return F.concat(*[F.when(broken, F.array(F.lit(message))).otherwise(none) for broken, message in checks])


# The longest text each column holds, and what the field is called in messages.
LENGTHS = {
    "employee_code": (20, "Employee code"), "first_name": (50, "First name"), "last_name": (50, "Last name"),
    "email": (100, "Email"), "department": (50, "Department"), "emp_position": (50, "Position"),
}


def validate_employees(candidates: DataFrame, editing: bool = False) -> DataFrame:
    """Add ``errors``: what is wrong with each candidate, in form order, then what is too long.

    An edit has no code and no hire date of its own.
    """
    # Every field is read as typed once, in a column of its own, which all checks share.
    read = [*(column for column in LENGTHS if not (editing and column == "employee_code")), *([] if editing else ["hire_date"])]
    typed = {column: F.col(f"_typed_{column}") for column in read}

    def blank(column: str) -> Column:
        """Missing, blank or the text 0, which all count as not filled in."""
        return F.coalesce(typed[column], F.lit("")).isin("", "0")

    # The messages of the form.
    checks = [
        (blank("first_name"), "First name required"),
        (blank("last_name"), "Last name required"),
        (blank("email"), "Email required"),
        (blank("department"), "Department required"),
        (blank("emp_position"), "Position required"),
        (text.decimal_or_zero(F.col("basic_salary").cast("string")) <= 0, "Valid salary required"),
    ]
    if not editing:
        checks = [(blank("employee_code"), "Employee code required"), *checks,
                  (blank("hire_date"), "Hire date required"),
                  (~blank("hire_date") & typed["hire_date"].try_cast("date").isNull(), "Valid hire date required")]
    checks.append((~blank("email") & ~text.is_email(typed["email"]), "Invalid email format"))
    if "emp_status" in candidates.columns:
        checks.append((F.col("emp_status").isNotNull() & ~F.col("emp_status").isin(*EMPLOYEE_STATUSES),
                       "Valid status required"))
    checks += [(F.length(typed[column]) > most, f"{field} too long")
               for column, (most, field) in LENGTHS.items() if column in typed]
    rows = candidates.withColumns({f"_typed_{column}": text.typed(F.col(column).cast("string")) for column in read})
    return rows.withColumn("errors", _messages(checks)).drop(*[f"_typed_{column}" for column in read])


def validate_periods(rows: DataFrame) -> DataFrame:
    """Add ``errors`` about the month and year of payroll rows."""
    month, year = F.col("payroll_month"), F.col("payroll_year")
    return rows.withColumn("errors", _messages([
        (~F.coalesce(month.between(1, 12), F.lit(False)), "Month must be 1 to 12"),
        (~F.coalesce(year >= 2000, F.lit(False)), "Year must be 2000 or later"),
    ]))


# --- keys -----------------------------------------------------------------

#: Takes how many ids are needed and the first one that the stored rows leave free, and returns the first to use.
Reserve = Callable[[int, int], int]


def next_id(df: DataFrame, column: str) -> int:
    return (df.agg(F.max(column)).first()[0] or 0) + 1


def _first_id(df: DataFrame, column: str, rows: DataFrame, reserve: Reserve | None) -> int:
    """The first id of new rows: the next one, or of a range that is reserved for them (``sources.versions.reserve_ids``)."""
    free = next_id(df, column)
    return reserve(rows.count(), free) if reserve else free


# --- employees -------------------------------------------------------------

# Result codes of the add and merge jobs.
OK, DUPLICATE, CONFLICT, REFUSED = 0, 1, 2, 3


def add_employees(emp: DataFrame, candidates: DataFrame, run_ts: str,
                  collation: str | None = None, slots: int | None = None,
                  reserve: Reserve | None = None) -> tuple[DataFrame, DataFrame]:
    """Insert candidates whose code and e-mail are free.

    Outcome codes: 0 added, 1 duplicate code or e-mail, 3 invalid. The code and
    e-mail checks are two anti joins; one join on "either" would compare every
    pair.
    """
    # The forms are checked once, in as many tasks as there are cores, however few files they come from.
    checked = validate_employees(candidates.repartition(ORDER))
    checked = staged(checked.select(
        ORDER, text.typed(F.col("employee_code")).alias("employee_code"), text.typed(F.col("first_name")).alias("first_name"),
        text.typed(F.col("last_name")).alias("last_name"), text.typed(F.col("email")).alias("email"),
        text.typed(F.col("department")).alias("department"), text.typed(F.col("emp_position")).alias("emp_position"),
        text.decimal_or_zero(F.col("basic_salary").cast("string")).alias("basic_salary"),
        text.typed(F.col("hire_date").cast("string")).try_cast("date").alias("hire_date"),
        (F.size("errors") > 0).alias("invalid"),
        text.collated(text.typed(F.col("employee_code")), collation).alias("_code"),
        text.collated(text.typed(F.col("email")), collation).alias("_email"),
    ), "checked-candidates")
    valid = checked.filter(~F.col("invalid"))
    held_codes = emp.select(text.collated(F.col("employee_code"), collation).alias("_code"))
    held_emails = emp.filter(F.col("email").isNotNull()).select(text.collated(F.col("email"), collation).alias("_email"))
    free = valid.join(held_codes, "_code", "left_anti").join(held_emails, "_email", "left_anti")
    accepted = staged(first_come(free, ["_code", "_email"]), "accepted-requests")

    inserted = global_row_number(
        valid.join(accepted, ORDER, "left_semi"), [F.col(ORDER)], "employee_id",
        start=_first_id(emp, "employee_id", accepted, reserve), slots=slots)
    stamp = F.lit(run_ts).cast("timestamp_ntz")
    new_rows = _shaped(
        inserted.withColumn("emp_status", F.lit("active")).withColumn("version_number", F.lit(1))
        .withColumn("created_at", stamp).withColumn("updated_at", stamp), EMPLOYEES)

    # The messages of the job.
    added = accepted.withColumn("_added", F.lit(True))
    code = (F.when(F.col("invalid"), REFUSED).when(F.col("_added"), OK).otherwise(DUPLICATE))
    outcome = checked.select(ORDER, "employee_code", "invalid").join(added, ORDER, "left").select(
        ORDER, "employee_code", code.alias("result_code"),
        F.when(code == OK, "Employee added successfully").when(code == DUPLICATE, "Duplicate employee code or email")
        .otherwise("Invalid employee data").alias("result_msg"))
    return emp.unionByName(new_rows), outcome


def update_employees(emp: DataFrame, edits: DataFrame, run_ts: str,
                     collation: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Apply edits that carry the stored version; the version grows by one.

    Outcomes, the first that fits: ``not found``, ``conflict`` (stale version),
    ``invalid``, ``duplicate email`` (held by another employee), ``conflict at
    write`` (an earlier edit of the batch won the employee), ``updated``. Code
    and hire date never change.
    """
    checked = validate_employees(edits, editing=True)
    checked = checked.select(
        ORDER, "employee_id", "current_version",
        text.typed(F.col("first_name")).alias("first_name"), text.typed(F.col("last_name")).alias("last_name"),
        text.typed(F.col("email")).alias("email"), text.typed(F.col("department")).alias("department"),
        text.typed(F.col("emp_position")).alias("emp_position"),
        text.decimal_or_zero(F.col("basic_salary").cast("string")).alias("basic_salary"),
        "emp_status", (F.size("errors") > 0).alias("invalid"),
        text.collated(text.typed(F.col("email")), collation).alias("_email"),
    )
    # Only what the batch asks about is looked up: its keys are written first, so
    # that a small batch is broadcast and the employees are not shuffled.
    checked = staged(checked, "checked-batch")
    stored = emp.select("employee_id", F.col("version_number").alias("_version")).join(
        checked.select("employee_id").distinct(), "employee_id", "left_semi")
    holders = (
        emp.filter(F.col("email").isNotNull())
        .select("employee_id", text.collated(F.col("email"), collation).alias("_email"))
        .join(checked.select("_email").distinct(), "_email", "left_semi")
        .groupBy("_email")
        .agg(F.min("employee_id").alias("_first_holder"), F.max("employee_id").alias("_last_holder"))
    )
    looked_up = (
        checked.join(stored, "employee_id", "left").join(holders, "_email", "left")
        .withColumn("verdict", F.when(F.col("_version").isNull(), "not found")
                    .when(~F.col("_version").eqNullSafe(F.col("current_version")), "conflict")
                    .when(F.col("invalid"), "invalid")
                    .when((F.col("_first_holder") != F.col("employee_id"))
                          | (F.col("_last_holder") != F.col("employee_id")), "duplicate email"))
    )
    looked_up = staged(looked_up.drop("_version", "_first_holder", "_last_holder", "invalid"), "checked-edits")
    passing = looked_up.filter(F.col("verdict").isNull())
    accepted = staged(first_come(passing, ["employee_id", "_email"]), "accepted-edits")
    winners = staged(passing.join(accepted, ORDER, "left_semi"), "winning-edits")

    # Why a passing edit lost: the employee was already written, else the e-mail was taken.
    # The outcomes.
    written = winners.select("employee_id", F.col(ORDER).alias("_written_by"))
    outcome = looked_up.join(written, "employee_id", "left").select(
        ORDER, "employee_id",
        F.when(F.col("verdict").isNotNull(), F.col("verdict"))
        .when(F.col("_written_by") == F.col(ORDER), "updated")
        .when(F.col("_written_by") < F.col(ORDER), "conflict at write")
        .otherwise("duplicate email").alias("outcome"))

    edited = ["first_name", "last_name", "email", "department", "emp_position", "basic_salary", "emp_status"]
    changes = winners.select("employee_id", F.lit(True).alias("_edited"),
                             *[F.col(c).alias(f"_new_{c}") for c in edited])
    joined = emp.join(changes, "employee_id", "left")
    hit = F.coalesce(F.col("_edited"), F.lit(False))
    new_values = {c: F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)) for c in edited}
    new_values["version_number"] = F.col("version_number") + hit.cast("int")
    new_values["updated_at"] = F.when(hit, F.lit(run_ts).cast("timestamp_ntz")).otherwise(F.col("updated_at"))
    return _shaped(joined.withColumns(new_values), EMPLOYEES), outcome


def deactivate_employees(emp: DataFrame, ids: DataFrame, run_ts: str) -> DataFrame:
    """Set employees inactive, whatever their version; the version grows by one."""
    flags = ids.select("employee_id").distinct().withColumn("_hit", F.lit(True))
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return _shaped(
        emp.join(flags, "employee_id", "left")
        .withColumn("emp_status", F.when(hit, "inactive").otherwise(F.col("emp_status")))
        .withColumn("version_number", F.col("version_number") + hit.cast("int"))
        .withColumn("updated_at", F.when(hit, F.lit(run_ts).cast("timestamp_ntz"))
                    .otherwise(F.col("updated_at"))), EMPLOYEES)


def delete_employees(emp: DataFrame, ids: DataFrame, rec: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete employees that have no payroll record; the others stay.

    The outcome has one row per requested id: ``deleted``, ``has records`` with
    their count, or ``not found``.
    """
    allowed, rejected = deletable_employees(emp, ids, rec)
    gone = staged(allowed.select("employee_id"), "deleted-employees")
    verdicts = gone.select("employee_id", F.lit(0).cast("long").alias("record_count")).unionByName(
        rejected.select("employee_id", "record_count"))
    outcome = ids.select("employee_id").distinct().join(verdicts, "employee_id", "left").select(
        "employee_id",
        F.when(F.col("record_count").isNull(), "not found").when(F.col("record_count") > 0, "has records")
        .otherwise("deleted").alias("outcome"),
        F.coalesce("record_count", F.lit(0)).alias("record_count"))
    return emp.join(gone, "employee_id", "left_anti").select(emp.columns), outcome


# --- payroll ---------------------------------------------------------------

def compute_pay(payees: DataFrame, rates: PayRates = DEFAULT_RATES) -> DataFrame:
    """Every pay component of the payees, each rounded before it is summed."""
    return payees.select("employee_id", *[amount.alias(name) for name, amount in
                                          pay_columns(F.col("basic_salary"), rates).items()])


def run_payroll(rec: DataFrame, emp: DataFrame, year: int, month: int, run_ts: str, mode: str = "all",
                department: str | None = None, ids: Iterable[int] | DataFrame | None = None,
                guard: str = "period", rates: PayRates = DEFAULT_RATES,
                slots: int | None = None, reserve: Reserve | None = None) -> tuple[DataFrame, DataFrame]:
    """Pay the selected active employees for one period, all of them or none.

    ``guard="period"`` refuses when the period has any record of any status;
    ``guard="employee"`` leaves out only employees who already have one.
    """
    if guard not in ("period", "employee"):
        raise ValueError(f"unknown guard {guard!r}")
    if not (1 <= int(month) <= 12 and int(year) >= 2000):
        raise ValueError("month must be 1 to 12 and year 2000 or later")
    # The messages of the run, here and below.
    payees = select_payees(emp, mode, department, ids)
    same_period = rec.filter((F.col("payroll_year") == int(year)) & (F.col("payroll_month") == int(month)))
    if guard == "period" and not same_period.limit(1).isEmpty():
        return rec, _payroll_outcome(rec, DUPLICATE, 0, "Payroll for this period already exists!")
    if guard == "employee":
        payees = payees.join(same_period.select("employee_id"), "employee_id", "left_anti")
    pay = compute_pay(payees, rates)
    numbered = global_row_number(pay, [F.col("employee_id")], "_nth", start=0, slots=slots)
    count = numbered.count()
    if count == 0:
        return rec, _payroll_outcome(rec, REFUSED, 0, "No active employees found.")
    first = _first_id(rec, "payroll_id", numbered, reserve)
    new_rows = _shaped(
        numbered.withColumns({
            "payroll_id": F.col("_nth") + first,
            "payroll_year": F.lit(int(year)), "payroll_month": F.lit(int(month)),
            "payroll_status": F.lit("processed"), "lock_version": F.lit(1),
            "processed_at": F.lit(run_ts).cast("timestamp_ntz"),
        }), PAYROLL_RECORDS)
    name = calendar.period_name(F.lit(int(year)), F.lit(int(month)))
    outcome = _payroll_outcome(rec, OK, count, F.concat(
        F.lit(f"Payroll successfully processed for {count} employees in period: "), name))
    return rec.unionByName(new_rows), outcome


def _payroll_outcome(rec: DataFrame, code: int, count: int, message: str | Column) -> DataFrame:
    return rec.sparkSession.range(1).select(
        F.lit(code).alias("result_code"), F.lit(count).cast("long").alias("record_count"),
        (F.lit(message) if isinstance(message, str) else message).alias("result_msg"))


_PARTS = ["basic_salary", "allowances_amount", "overtime_amount", "tax_amount", "sss_amount",
          "philhealth_amount", "pagibig_amount", "other_deductions"]
_SUMS = ["gross_amount", "total_deductions_amount", "net_amount"]

#: Up to as many requests, the stored tables are cut to the keys of a batch before they are joined with it.
SMALL_BATCH = 500_000


def merge_payroll(rec: DataFrame, emp: DataFrame, requests: DataFrame, run_ts: str,
                  slots: int | None = None, reserve: Reserve | None = None) -> tuple[DataFrame, DataFrame]:
    """Insert or update one record per request, guarded by its lock version.

    Result codes, the first that fits: 3 employee absent or not active, or a
    period or amount the table does not accept; 2 stored lock differs from the
    expected one; 1 a record exists but none was expected; 2 an earlier request
    of the batch wrote the same record; 0 done. The requests are read more than
    once, so they should be stored.
    """
    period_key = ["employee_id", "payroll_year", "payroll_month"]
    active = emp.filter(F.col("emp_status") == "active").select("employee_id", F.lit(True).alias("_active"))
    stored = rec.select(*period_key, F.col("payroll_id").alias("_payroll_id"), F.col("lock_version").alias("_lock"))
    if requests.count() <= SMALL_BATCH:
        # Both tables are first cut to the keys of the batch, which are written so
        # that they are broadcast; neither table is shuffled for it. The keys of a
        # large batch would be sorted and shuffled once more, to cut next to nothing.
        asked = staged(requests.select(*period_key).distinct(), "asked-payroll")
        active = active.join(asked.select("employee_id").distinct(), "employee_id", "left_semi")
        stored = stored.join(asked, period_key, "left_semi")
    amounts = {p: F.col(p).cast(MONEY) for p in _PARTS}
    sums = net_of({p: F.col(p) for p in _PARTS})
    bad = (F.size("errors") > 0) | sums["net_amount"].isNull()
    exists = F.col("_payroll_id").isNotNull()
    # What is refused needs no amounts, and the sums follow from the parts: neither is carried along.
    met = (
        validate_periods(requests.select(ORDER, *period_key, "expected_lock", *[a.alias(p) for p, a in amounts.items()]))
        .join(active, "employee_id", "left").withColumn("_refused", F.col("_active").isNull() | bad)
        .select(ORDER, *period_key, "expected_lock", "_refused", *[F.when(~F.col("_refused"), F.col(p)).alias(p) for p in _PARTS])
    )
    judged = met.join(stored, period_key, "left").select(
        ORDER, *period_key, *_PARTS, "_payroll_id",
        F.when(F.col("_refused"), REFUSED)
        .when(exists & ~F.col("_lock").eqNullSafe(F.col("expected_lock")), CONFLICT)
        .when(exists & (F.col("expected_lock") == 0), DUPLICATE).alias("verdict"))
    judged = staged(judged, "judged-payroll")
    # One winner per record: the first passing request. Combined before the shuffle.
    row = F.struct(ORDER, "_payroll_id", *_PARTS)
    winners = staged(
        judged.filter(F.col("verdict").isNull()).groupBy(*period_key).agg(F.min(row).alias("w"))
        .select(*period_key, "w.*").withColumns(sums), "winning-payroll")

    outcome = judged.join(winners.select(ORDER, F.lit(True).alias("_won")), ORDER, "left").select(
        ORDER, "employee_id", "payroll_year", "payroll_month",
        F.when(F.col("verdict").isNotNull(), F.col("verdict")).when(F.col("_won"), OK)
        .otherwise(CONFLICT).alias("result_code"))

    stamp = F.lit(run_ts).cast("timestamp_ntz")
    new = winners.filter(F.col("_payroll_id").isNull())
    inserted = global_row_number(new, [F.col(ORDER)], "payroll_id", start=_first_id(rec, "payroll_id", new, reserve), slots=slots)
    new_rows = _shaped(inserted.withColumns({
        "payroll_status": F.lit("processed"), "processed_at": stamp, "lock_version": F.lit(1)}), PAYROLL_RECORDS)

    changes = winners.filter(F.col("_payroll_id").isNotNull()).select(
        F.col("_payroll_id").alias("payroll_id"), F.lit(True).alias("_hit"),
        *[F.col(c).alias(f"_new_{c}") for c in _PARTS + _SUMS])
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    updated = rec.join(changes, "payroll_id", "left").withColumns({
        **{c: F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)) for c in _PARTS + _SUMS},
        "payroll_status": F.when(hit, "processed").otherwise(F.col("payroll_status")),
        "processed_at": F.when(hit, stamp).otherwise(F.col("processed_at")),
        "lock_version": F.col("lock_version") + hit.cast("int"),
    })
    return _shaped(updated, PAYROLL_RECORDS).unionByName(new_rows), outcome


def publish_job(spark: SparkSession, folder: str, years: Iterable[int], job: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
                ) -> tuple[int, DataFrame]:
    """Run a job on the stored records and publish the years that it may change.

    The job takes the records and returns their new state and an outcome. The
    answer is 0 and the outcome, or 2 when another writer has replaced one of
    the years since the records were read: nothing is published then, and the
    job may be run again on the new records.
    """
    version = records_version(spark, folder)
    state, outcome = job(load_tables(spark, folder, ("payroll_records",))["payroll_records"])
    return publish_records(state, folder, list(years), version), outcome

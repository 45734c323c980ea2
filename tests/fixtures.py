"""Hand-sized tables: the seed of ten employees over three months, and row builders."""

from __future__ import annotations

import csv
import datetime as dt
import os
from decimal import Decimal

from paystrata.schema import ACTIVITY_LOGS, EMPLOYEES, PAYROLL_RECORDS, USERS

_FOLDER = os.path.join(os.path.dirname(__file__), "golden")
_TYPES = {"DecimalType": Decimal, "IntegerType": int, "LongType": int}


def golden(name: str) -> list[dict]:
    with open(os.path.join(_FOLDER, f"{name}.csv"), newline="") as f:
        return [{k: (v if v != "" else None) for k, v in row.items()} for row in csv.DictReader(f)]


def _row(schema, values: dict) -> tuple:
    unknown = set(values) - set(schema.names)
    assert not unknown, unknown
    out = []
    for field in schema:
        value = values.get(field.name)
        convert = _TYPES.get(type(field.dataType).__name__)
        out.append(convert(value) if convert and value is not None else value)
    return tuple(out)


def employee(id: int, **values) -> tuple:
    base = dict(
        employee_id=id, employee_code=f"EMP{id:03d}", first_name=f"First{id}", last_name=f"Last{id}",
        email=f"e{id}@example.com", department="Finance", emp_position="Clerk", basic_salary="1000.00",
        hire_date=dt.date(2020, 1, 1), emp_status="active", version_number=1,
        created_at=dt.datetime(2020, 1, 1), updated_at=dt.datetime(2020, 1, 1))
    return _row(EMPLOYEES, {**base, **values})


def record(id: int, employee_id: int, year: int, month: int, net, **values) -> tuple:
    base = dict(
        payroll_id=id, employee_id=employee_id, payroll_year=year, payroll_month=month, basic_salary=net,
        allowances_amount=0, overtime_amount=0, tax_amount=0, sss_amount=0, philhealth_amount=0,
        pagibig_amount=0, other_deductions=0, gross_amount=net, total_deductions_amount=0, net_amount=net,
        payroll_status="processed", processed_at=dt.datetime(year, month, 28), lock_version=1)
    return _row(PAYROLL_RECORDS, {**base, **values})


def log_row(id: int, at: dt.datetime, **values) -> tuple:
    base = dict(log_id=id, user_id=1, username="admin", action_name="LOGIN", module_name="Auth",
                details_text="x", ip_address="10.0.0.1", created_at=at)
    return _row(ACTIVITY_LOGS, {**base, **values})


def employees(spark, *rows):
    return spark.createDataFrame(list(rows), EMPLOYEES)


def records(spark, *rows):
    return spark.createDataFrame(list(rows), PAYROLL_RECORDS)


def logs(spark, *rows):
    return spark.createDataFrame(list(rows), ACTIVITY_LOGS)


def users(spark, *rows):
    return spark.createDataFrame([_row(USERS, r) for r in rows], USERS)


def seed(spark):
    """The seed employees and their thirty processed records."""
    people, paid = [], []
    for e in golden("seed_employees"):
        first, last = e["full_name"].split(" ")
        people.append(employee(int(e["employee_id"]), employee_code=e["employee_code"], first_name=first,
                               last_name=last, department=e["department"], emp_position=e["emp_position"],
                               basic_salary=e["basic_salary"]))
    for month, day in ((3, 31), (4, 30), (5, 31)):
        for e in golden("seed_employees"):
            basic, overtime = Decimal(e["basic_salary"]), Decimal(e[f"overtime_{month}"])
            gross, deductions = basic * Decimal("1.1") + overtime, basic / 10 + 2000
            paid.append(record(
                len(paid) + 1, int(e["employee_id"]), 2026, month, gross - deductions, basic_salary=basic,
                allowances_amount=basic / 10, overtime_amount=overtime, tax_amount=basic / 10, sss_amount=1350,
                philhealth_amount=450, pagibig_amount=200, gross_amount=gross, total_deductions_amount=deductions,
                processed_at=dt.datetime(2026, month, day, 10)))
    return employees(spark, *people), records(spark, *paid)

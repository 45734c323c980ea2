"""Table schemas of the operational model, the star schema and the job log."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)      # stored amounts
MONEY_SUM = T.DecimalType(22, 2)  # sums of stored amounts
RATIO = T.DecimalType(18, 2)      # averages and percentages, 2 places

_long, _int, _str = T.LongType(), T.IntegerType(), T.StringType()
_ntz, _date, _bool = T.TimestampNTZType(), T.DateType(), T.BooleanType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in columns.items()])


USERS = _table(
    user_id=_long, username=_str, full_name=_str, email=_str, user_role=_str,
    user_status=_str, last_login=_ntz, created_at=_ntz,
)

EMPLOYEES = _table(
    employee_id=_long, employee_code=_str, first_name=_str, last_name=_str,
    email=_str, department=_str, emp_position=_str, basic_salary=MONEY,
    hire_date=_date, emp_status=_str, version_number=_int,
    created_at=_ntz, updated_at=_ntz,
)

PAYROLL_RECORDS = _table(
    payroll_id=_long, employee_id=_long, payroll_month=_int, payroll_year=_int,
    basic_salary=MONEY, allowances_amount=MONEY, overtime_amount=MONEY,
    tax_amount=MONEY, sss_amount=MONEY, philhealth_amount=MONEY,
    pagibig_amount=MONEY, other_deductions=MONEY, gross_amount=MONEY,
    total_deductions_amount=MONEY, net_amount=MONEY, payroll_status=_str,
    processed_at=_ntz, lock_version=_int,
)

ACTIVITY_LOGS = _table(
    log_id=_long, user_id=_long, username=_str, action_name=_str,
    module_name=_str, details_text=_str, ip_address=_str, created_at=_ntz,
)

DIM_DEPARTMENT = _table(department_key=_long, department_name=_str, created_at=_ntz)

DIM_EMPLOYEE = _table(
    employee_key=_long, employee_id=_long, employee_code=_str, full_name=_str,
    department_name=_str, position_title=_str, is_current_record=_bool, loaded_at=_ntz,
)

DIM_TIME = _table(
    time_key=_long, year_number=_int, month_number=_int, month_name_text=_str,
    year_month_text=_str, quarter_number=_int, half_year=_int,
)

FACT_PAYROLL = _table(
    fact_id=_long, employee_key=_long, time_key=_long, department_key=_long,
    net_pay=MONEY, gross_pay=MONEY, total_deductions=MONEY, allowances=MONEY,
    overtime=MONEY, loaded_at=_ntz,
)

ETL_JOBS = _table(
    job_id=_long, job_name=_str, job_status=_str, records_processed=_long,
    error_message=_str, started_at=_ntz, completed_at=_ntz,
)

OPERATIONAL = {
    "users": USERS,
    "employees": EMPLOYEES,
    "payroll_records": PAYROLL_RECORDS,
    "activity_logs": ACTIVITY_LOGS,
}

WAREHOUSE = {
    "dim_department": DIM_DEPARTMENT,
    "dim_employee": DIM_EMPLOYEE,
    "dim_time": DIM_TIME,
    "fact_payroll": FACT_PAYROLL,
}

TABLES = {**OPERATIONAL, **WAREHOUSE, "etl_jobs": ETL_JOBS}

# The primary key of each table; sorts end on it so that results are repeatable.
KEYS = {
    "users": "user_id",
    "employees": "employee_id",
    "payroll_records": "payroll_id",
    "activity_logs": "log_id",
    "dim_department": "department_key",
    "dim_employee": "employee_key",
    "dim_time": "time_key",
    "fact_payroll": "fact_id",
    "etl_jobs": "job_id",
}

# The allowed states of each enumerated column.
EMPLOYEE_STATUSES = ("active", "inactive", "terminated")

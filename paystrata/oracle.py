"""Reference SQL of the registered queries, for DuckDB over the same tables.

Every statement is put together from named common table expressions (the lens
tables, the warehouse tables) and one final SELECT. Averages and percentages
are computed from whole cents, because decimal division is inexact there.
"""

from __future__ import annotations

from paystrata.catalog import (
    DAY_FROM, DAY_TO, DEPARTMENT, DONE_TS, MONTH, NEW_MONTH, NEW_YEAR, RUN_TS, YEAR,
)
from paystrata.schema import OPERATIONAL

_STAMP = f"TIMESTAMP '{RUN_TS}'"


def _cents(amount: str) -> str:
    return f"CAST(({amount}) * 100 AS HUGEINT)"


def _half_up(numerator: str, denominator: str, scale: str = "0.01", dtype: str = "DECIMAL(18,2)") -> str:
    """Whole-number division rounded half up, read as hundredths."""
    n, d = f"({numerator})", f"({denominator})"
    whole = f"CAST(sign({n}) * sign({d}) * ((2 * abs({n}) + abs({d})) // (2 * abs({d}))) AS BIGINT)"
    return f"CAST(CASE WHEN {d} <> 0 THEN CAST({whole} AS DECIMAL(18,0)) * {scale} END AS {dtype})"


def _mean(amount: str) -> str:
    return _half_up(f"CAST(sum({amount}) * 100 AS HUGEINT)", f"CAST(count({amount}) AS HUGEINT)")


def _percent(part: str, whole: str) -> str:
    """100 * part / whole for amounts, as hundredths of a percent."""
    return _half_up(f"10000 * {_cents(part)}", _cents(whole))


def _shown(amount: str) -> str:
    """An amount with thousands separators."""
    cents = f"abs({_cents(amount)})"
    whole = "format('{:,}', " + f"CAST({cents} // 100 AS BIGINT))"
    return f"(CASE WHEN {amount} < 0 THEN '-' ELSE '' END || {whole} || '.' || lpad(CAST({cents} % 100 AS VARCHAR), 2, '0'))"


def _sum(amount: str) -> str:
    return f"CAST(sum({amount}) AS DECIMAL(22,2))"


def _sum0(amount: str) -> str:
    return f"CAST(coalesce(sum({amount}), 0) AS DECIMAL(22,2))"


_PERIOD_NAME = "strftime(make_date(payroll_year, payroll_month, 1), '%B %Y')"
_FULL_NAME = "first_name || ' ' || last_name"

_PAY = """
    basic AS basic_salary,
    CAST(round(basic * 0.10, 2) AS DECIMAL(12,2)) AS allowances_amount,
    CAST(round(basic * 0.05, 2) AS DECIMAL(12,2)) AS overtime_amount,
    CAST(round(basic * 0.10, 2) AS DECIMAL(12,2)) AS tax_amount,
    CAST(1350 AS DECIMAL(12,2)) AS sss_amount,
    CAST(450 AS DECIMAL(12,2)) AS philhealth_amount,
    CAST(200 AS DECIMAL(12,2)) AS pagibig_amount,
    CAST(0 AS DECIMAL(12,2)) AS other_deductions,
    CAST(basic + round(basic * 0.10, 2) + round(basic * 0.05, 2) AS DECIMAL(12,2)) AS gross_amount,
    CAST(round(basic * 0.10, 2) + 2000 AS DECIMAL(12,2)) AS total_deductions_amount,
    CAST(basic + round(basic * 0.05, 2) - 2000 AS DECIMAL(12,2)) AS net_amount"""

_REC_COLUMNS = """payroll_id, employee_id, payroll_month, payroll_year, basic_salary, allowances_amount,
    overtime_amount, tax_amount, sss_amount, philhealth_amount, pagibig_amount, other_deductions,
    gross_amount, total_deductions_amount, net_amount, payroll_status, processed_at, lock_version"""

# name -> (the expressions it reads, its SELECT)
_CTES: dict[str, tuple[list[str], str]] = {
    # --- the payroll lens ---
    "employees": ([], """
        SELECT c_custkey AS employee_id, c_name AS employee_code,
            split_part(c_name, '#', 1) AS first_name, split_part(c_name, '#', 2) AS last_name,
            lower(translate(c_name, '# ', '..')) || '@example.com' AS email,
            CASE WHEN c_acctbal < 0 OR c_acctbal >= 200 THEN c_mktsegment END AS department,
            CASE WHEN c_acctbal < 9000 THEN ' Grade ' || c_nationkey END AS emp_position,
            CAST(greatest(abs(c_acctbal), 1) AS DECIMAL(12,2)) AS basic_salary,
            CAST(DATE '2015-01-01' + c_nationkey * 90 AS DATE) AS hire_date,
            CASE WHEN c_acctbal < 0 THEN 'inactive' ELSE 'active' END AS emp_status,
            CAST(1 AS INTEGER) AS version_number,
            TIMESTAMP '2024-01-01 00:00:00' AS created_at, TIMESTAMP '2024-01-01 00:00:00' AS updated_at
        FROM customer"""),
    "recruits": ([], """
        SELECT -s_suppkey - 1 AS employee_id, s_name AS employee_code,
            split_part(s_name, '#', 1) AS first_name, split_part(s_name, '#', 2) AS last_name,
            lower(translate(s_name, '# ', '..')) || '@example.com' AS email, 'Supply' AS department,
            'Recruit' AS emp_position, CAST(greatest(abs(s_acctbal), 1) AS DECIMAL(12,2)) AS basic_salary,
            DATE '2024-01-01' AS hire_date, 'active' AS emp_status, CAST(1 AS INTEGER) AS version_number,
            TIMESTAMP '2024-01-01 00:00:00' AS created_at, TIMESTAMP '2024-01-01 00:00:00' AS updated_at
        FROM supplier"""),
    "staff": (["employees", "recruits"], "SELECT * FROM employees UNION ALL SELECT * FROM recruits"),
    "record_counts": (["payroll_records"], """
        SELECT employee_id, count(*) AS record_count FROM payroll_records GROUP BY 1"""),
    "monthly_orders": ([], """
        SELECT o_custkey AS employee_id, CAST(month(o_orderdate) AS INTEGER) AS payroll_month,
            CAST(year(o_orderdate) + 10 AS INTEGER) AS payroll_year, min(o_orderkey) + 1 AS payroll_id,
            max(CAST(o_totalprice AS DECIMAL(12,2))) AS basic,
            min(o_orderstatus) AS first_status, max(o_orderdate) AS last_order
        FROM orders GROUP BY 1, 2, 3"""),
    "payroll_records": (["monthly_orders"], f"""
        SELECT payroll_id, employee_id, payroll_month, payroll_year, {_PAY},
            CASE first_status WHEN 'F' THEN 'processed' WHEN 'O' THEN 'draft' ELSE 'paid' END AS payroll_status,
            CASE WHEN first_status <> 'O' THEN last_order + INTERVAL 10 YEAR END AS processed_at,
            CAST(CASE WHEN first_status = 'O' THEN 0 ELSE 1 END AS INTEGER) AS lock_version
        FROM monthly_orders"""),
    "processed": (["payroll_records"], "SELECT * FROM payroll_records WHERE payroll_status = 'processed'"),
    "departures": ([], """
        SELECT DISTINCT o_custkey AS employee_id FROM orders UNION SELECT -p_partkey - 1 FROM part"""),
    "paid_ids": (["payroll_records"], "SELECT DISTINCT employee_id FROM payroll_records WHERE payroll_status = 'paid'"),
    "users": ([], """
        SELECT user_id, 'user_' || user_id AS username, 'User ' || user_id AS full_name,
            'user.' || user_id || '@example.com' AS email,
            CASE last_event WHEN 'purchase' THEN 'admin' ELSE 'staff' END AS user_role,
            'active' AS user_status, CASE WHEN last_event <> 'signup' THEN last_seen END AS last_login, created_at
        FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_event,
                  min(ts) AS created_at, max(ts) AS last_seen FROM events GROUP BY user_id)
        WHERE last_event <> 'error'"""),
    "activity_logs": ([], """
        SELECT event_id AS log_id, user_id, 'user_' || user_id AS username,
            upper(event_type) || '_EVENT' AS action_name,
            CASE event_type WHEN 'purchase' THEN 'Payroll' WHEN 'signup' THEN 'Employees' END AS module_name,
            props || ', amount ' || CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) AS details_text,
            '127.0.0.1' AS ip_address, ts AS created_at
        FROM events"""),
    "log_with_actions": (["activity_logs", "users"], """
        SELECT * FROM activity_logs UNION ALL
        SELECT o_orderkey, o_custkey, coalesce(username, 'Unknown'),
            CASE WHEN o_orderstatus = 'F' THEN 'PROCESS_PAYROLL' ELSE 'RUN_ETL' END,
            CASE WHEN o_orderstatus = 'F' THEN 'Payroll' END, 'order ' || o_orderkey, '127.0.0.1', o_orderdate
        FROM orders LEFT JOIN users ON o_custkey = user_id"""),
    "etl_jobs": ([], """
        SELECT job_id, 'Payroll ETL' AS job_name,
            CASE WHEN errors * 4 > n THEN 'failed' ELSE 'completed' END AS job_status,
            CAST(CASE WHEN errors * 4 > n THEN 0 ELSE n END AS BIGINT) AS records_processed,
            CASE WHEN errors * 4 > n THEN 'too many errors' END AS error_message, started_at, completed_at
        FROM (SELECT date_trunc('hour', ts) AS hour, min(event_id) AS job_id, count(*) AS n,
                  count(*) FILTER (event_type = 'error') AS errors,
                  min(ts) AS started_at, max(ts) AS completed_at FROM events GROUP BY 1)"""),
    "joined": (["payroll_records", "employees"], """
        SELECT r.*, employee_code, first_name, last_name, department, emp_position
        FROM payroll_records r JOIN employees USING (employee_id)"""),
    "paid_history": (["joined"], """
        SELECT payroll_id, payroll_month, payroll_year, basic_salary, allowances_amount AS allowances,
            overtime_amount AS overtime, tax_amount AS tax, sss_amount AS sss, philhealth_amount AS philhealth,
            pagibig_amount AS pagibig, gross_amount AS gross_pay, total_deductions_amount AS total_deductions,
            net_amount AS net_pay, processed_at, employee_id, employee_code, first_name, last_name,
            department, emp_position AS position
        FROM joined WHERE payroll_status = 'processed'"""),
    # --- the warehouse ---
    "dim_department": (["employees"], f"""
        SELECT row_number() OVER (ORDER BY department_name) AS department_key, department_name, {_STAMP} AS created_at
        FROM (SELECT DISTINCT coalesce(trim(department), 'Unknown') AS department_name FROM employees)"""),
    "dim_employee": (["employees"], f"""
        SELECT row_number() OVER (ORDER BY employee_id) AS employee_key, employee_id, employee_code,
            {_FULL_NAME} AS full_name, coalesce(trim(department), 'Unknown') AS department_name,
            coalesce(trim(emp_position), 'Staff') AS position_title, true AS is_current_record, {_STAMP} AS loaded_at
        FROM employees WHERE emp_status = 'active'"""),
    "dim_time": (["processed"], """
        SELECT row_number() OVER (ORDER BY payroll_year, payroll_month) AS time_key,
            payroll_year AS year_number, payroll_month AS month_number,
            monthname(make_date(payroll_year, payroll_month, 1)) AS month_name_text,
            payroll_year || '-' || lpad(CAST(payroll_month AS VARCHAR), 2, '0') AS year_month_text,
            CAST((payroll_month + 2) // 3 AS INTEGER) AS quarter_number,
            CAST(CASE WHEN payroll_month <= 6 THEN 1 ELSE 2 END AS INTEGER) AS half_year
        FROM (SELECT DISTINCT payroll_year, payroll_month FROM processed)"""),
    "fact_payroll": (["processed", "dim_employee", "dim_time", "dim_department"], f"""
        SELECT row_number() OVER (ORDER BY time_key, employee_key) AS fact_id, employee_key, time_key, department_key,
            net_amount AS net_pay, gross_amount AS gross_pay, total_deductions_amount AS total_deductions,
            allowances_amount AS allowances, overtime_amount AS overtime, {_STAMP} AS loaded_at
        FROM processed JOIN dim_employee USING (employee_id)
        JOIN dim_time ON payroll_year = year_number AND payroll_month = month_number
        JOIN dim_department USING (department_name)"""),
    "star": (["fact_payroll", "dim_employee", "dim_time", "dim_department"], """
        SELECT f.*, t.* EXCLUDE (time_key), d.department_name, d.created_at AS department_created_at,
            e.employee_id, e.employee_code, e.full_name, e.department_name AS employee_department,
            e.position_title, e.is_current_record, e.loaded_at AS employee_loaded_at
        FROM fact_payroll f JOIN dim_time t USING (time_key) JOIN dim_department d USING (department_key)
        JOIN dim_employee e USING (employee_key)"""),
    "mart": (["star"], f"""
        SELECT department_name, year_number, month_number, month_name_text, year_month_text, quarter_number,
            count(fact_id) AS payroll_count, {_sum('net_pay')} AS total_net_pay, {_sum('gross_pay')} AS total_gross_pay,
            {_sum('total_deductions')} AS total_deductions, {_mean('net_pay')} AS avg_net_pay,
            max(net_pay) AS highest_net_pay, min(net_pay) AS lowest_net_pay
        FROM star GROUP BY ALL"""),
    # --- request batches ---
    "candidates": ([], """
        SELECT p_partkey * 2 AS request_order, p_name || '/' || p_brand AS employee_code,
            split_part(p_name, ' ', 1) AS first_name, split_part(p_name, ' ', 2) AS last_name,
            lower(translate(p_name, ' ', '.')) || '.' || lower(p_type) || '@example.com' AS email,
            p_type AS department, p_brand AS emp_position,
            CAST(p_retailprice AS DECIMAL(12,2)) AS basic_salary, DATE '2024-02-01' AS hire_date,
            CASE WHEN length(p_name || '/' || p_brand) > 20 THEN 'Employee code too long' ELSE '' END AS errors
        FROM part UNION ALL
        SELECT s_suppkey * 2 + 1, CASE WHEN s_nationkey % 5 = 2 THEN rpad(s_name, 40, '+') ELSE s_name END,
            split_part(s_name, '#', 1), split_part(s_name, '#', 2),
            CASE WHEN s_nationkey % 5 = 1 THEN 'supplier.' || s_suppkey
                ELSE 'customer.' || split_part(s_name, '#', 2) END || '@example.com', 'Supply', 'Buyer',
            CAST(s_acctbal AS DECIMAL(12,2)), DATE '2024-02-01',
            concat_ws(', ', CASE WHEN s_nationkey % 5 = 0 THEN 'First name required' END,
                CASE WHEN NOT s_acctbal > 0 THEN 'Position required' END,
                CASE WHEN NOT s_acctbal > 100 THEN 'Valid salary required' END,
                CASE WHEN s_nationkey % 5 = 2 THEN 'Employee code too long' END)
        FROM supplier"""),
    "open_requests": (["candidates", "employees"], """
        SELECT row_number() OVER (ORDER BY request_order) AS turn, c.*
        FROM candidates c WHERE errors = ''
            AND employee_code NOT IN (SELECT employee_code FROM employees)
            AND email NOT IN (SELECT email FROM employees)"""),
    # One step per request: take it unless its code or e-mail was taken before.
    "served": (["open_requests"], """
        SELECT CAST(0 AS BIGINT) AS turn, CAST([] AS VARCHAR[]) AS codes, CAST([] AS VARCHAR[]) AS emails,
            CAST([] AS BIGINT[]) AS accepted
        UNION ALL
        SELECT o.turn,
            CASE WHEN free THEN list_append(codes, employee_code) ELSE codes END,
            CASE WHEN free THEN list_append(emails, email) ELSE emails END,
            CASE WHEN free THEN list_append(accepted, request_order) ELSE accepted END
        FROM (SELECT s.codes, s.emails, s.accepted, r.*,
                  NOT list_contains(s.codes, r.employee_code) AND NOT list_contains(s.emails, r.email) AS free
              FROM served s JOIN open_requests r ON r.turn = s.turn + 1) o"""),
    "accepted": (["served"], """
        SELECT unnest(accepted) AS request_order FROM (SELECT accepted FROM served ORDER BY turn DESC LIMIT 1)"""),
    "edits": (["employees"], """
        SELECT o_orderkey AS request_order, CASE WHEN o_orderkey % 50 = 0 THEN -o_custkey - 1 ELSE o_custkey END AS employee_id,
            o_orderpriority AS priority, o_totalprice,
            o_orderstatus, CASE WHEN o_orderpriority = '1-URGENT'
                THEN 'customer.' || lpad(CAST(o_custkey + 1 AS VARCHAR), 9, '0') || '@example.com'
                ELSE 'edit.' || o_orderkey || '@example.com' END AS email,
            CASE WHEN o_orderkey % 50 = 0 OR o_custkey NOT IN (SELECT employee_id FROM employees) THEN 'not found'
                WHEN o_orderpriority = '3-MEDIUM' THEN 'conflict' WHEN o_orderpriority = '2-HIGH' THEN 'invalid'
                WHEN o_orderpriority = '1-URGENT' AND o_custkey + 1 IN (SELECT employee_id FROM employees)
                THEN 'duplicate email' END AS verdict
        FROM orders"""),
    "winning_edits": (["edits"], """
        SELECT * FROM edits WHERE verdict IS NULL
        QUALIFY row_number() OVER (PARTITION BY employee_id ORDER BY request_order) = 1"""),
    "staged_payroll": ([], """
        SELECT l_orderkey * 10 + l_linenumber AS request_order, employee_id,
            CAST(month(shipped) AS INTEGER) AS payroll_month, CAST(year(shipped) + 10 AS INTEGER) AS payroll_year,
            basic, q, CASE flag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS expected_lock
        FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS employee_id, min(l_shipdate) AS shipped,
                  max(CAST(l_extendedprice AS DECIMAL(12,2))) AS basic,
                  max(CAST(l_quantity AS DECIMAL(12,2))) AS q, min(l_returnflag) AS flag
              FROM lineitem GROUP BY 1, 2)"""),
    "judged": (["staged_payroll", "employees", "payroll_records"], """
        SELECT s.*, r.payroll_id,
            CASE WHEN e.employee_id IS NULL THEN 3 WHEN r.lock_version <> s.expected_lock THEN 2
                WHEN r.payroll_id IS NOT NULL AND s.expected_lock = 0 THEN 1 END AS verdict
        FROM staged_payroll s
        LEFT JOIN (SELECT employee_id FROM employees WHERE emp_status = 'active') e USING (employee_id)
        LEFT JOIN payroll_records r USING (employee_id, payroll_year, payroll_month)"""),
    "winning_payroll": (["judged"], """
        SELECT *, CAST(basic + q + q AS DECIMAL(12,2)) AS gross, CAST(q + 2001 AS DECIMAL(12,2)) AS deductions,
            CAST(basic + q - 2001 AS DECIMAL(12,2)) AS net
        FROM judged WHERE verdict IS NULL
        QUALIFY row_number() OVER (PARTITION BY employee_id, payroll_year, payroll_month ORDER BY request_order) = 1"""),
    "new_pay": (["employees"], f"""
        SELECT employee_id, {_PAY}
        FROM (SELECT employee_id, basic_salary AS basic FROM employees WHERE emp_status = 'active')"""),
    # --- analytics ---
    "history": (["joined"], "SELECT * FROM joined WHERE payroll_status = 'processed'"),
    "spending": (["history"], f"""
        SELECT department, payroll_year, payroll_month, count(*) AS emp_count, {_sum('net_amount')} AS total_payroll,
            {_mean('net_amount')} AS avg_pay, max(net_amount) AS highest_pay, min(net_amount) AS lowest_pay
        FROM history GROUP BY 1, 2, 3"""),
}


def _with(body: str, *names: str) -> str:
    """Prefix a SELECT with the expressions it needs, dependencies first."""
    ordered: list[str] = []

    def need(name: str) -> None:
        if name in ordered:
            return
        for other in _CTES[name][0]:
            need(other)
        ordered.append(name)

    for name in names:
        need(name)
    parts = ",\n".join(f"{name} AS ({_CTES[name][1]})" for name in ordered)
    recursive = "RECURSIVE " if "served" in ordered else ""
    return f"WITH {recursive}{parts}\n{body}"


def _content(table: str, column: str) -> str:
    """How many rows a column has, how many are filled, and a sum of 32-bit hashes of their text."""
    return f"""
        SELECT '{table}' AS table_name, '{column}' AS column_name, count(*) AS row_count, count({column}) AS filled,
            CAST(coalesce(sum(CAST('0x' || substr(md5(CAST({column} AS VARCHAR)), 1, 8) AS BIGINT)), 0) AS BIGINT) AS hash_sum FROM {table}"""


def _whole(table: str, where: str = "true") -> str:
    return _with(f"SELECT * FROM {table} WHERE {where}", table)


def _csv(where: str = "true") -> str:
    return _with(f"""
        SELECT strftime(created_at, '%Y-%m-%d %H:%M:%S') AS "Timestamp", username AS "User",
            replace(action_name, '_', ' ') AS "Action", coalesce(module_name, '-') AS "Module",
            replace(coalesce(details_text, '-'), ',', ';') AS "Details", ip_address AS "IP Address"
        FROM activity_logs WHERE {where}""", "activity_logs")


def _audit(where: str = "true") -> str:
    return _with(f"""SELECT * FROM activity_logs WHERE {where}
        ORDER BY created_at DESC, log_id DESC LIMIT 200""", "activity_logs")


def _new_payroll(guard: str, year: int, month: int) -> str:
    return _with(f"""
        SELECT {_REC_COLUMNS} FROM payroll_records UNION ALL
        SELECT {_REC_COLUMNS} FROM (
            SELECT (SELECT max(payroll_id) FROM payroll_records) + row_number() OVER (ORDER BY employee_id) AS payroll_id,
                *, CAST({month} AS INTEGER) AS payroll_month, CAST({year} AS INTEGER) AS payroll_year,
                'processed' AS payroll_status, {_STAMP} AS processed_at, CAST(1 AS INTEGER) AS lock_version
            FROM new_pay WHERE {guard})""", "payroll_records", "new_pay", "employees", "paid_ids")


def _applied(parts: dict[str, str]) -> str:
    """Payroll record columns in order, with some replaced."""
    names = [c.strip() for c in _REC_COLUMNS.replace("\n", " ").split(",")]
    return ", ".join(f"{parts.get(n, 'r.' + n)} AS {n}" for n in names)


_MERGED = {
    "basic_salary": "w.basic", "allowances_amount": "w.q", "overtime_amount": "w.q", "tax_amount": "w.q",
    "sss_amount": "CAST(1350 AS DECIMAL(12,2))", "philhealth_amount": "CAST(450 AS DECIMAL(12,2))",
    "pagibig_amount": "CAST(200 AS DECIMAL(12,2))", "other_deductions": "CAST(1 AS DECIMAL(12,2))",
    "gross_amount": "w.gross", "total_deductions_amount": "w.deductions", "net_amount": "w.net",
    "payroll_status": "'processed'", "processed_at": _STAMP,
}
_UPDATED = {n: f"CASE WHEN w.request_order IS NULL THEN r.{n} ELSE {v} END" for n, v in _MERGED.items()}
_UPDATED["lock_version"] = "CAST(r.lock_version + CASE WHEN w.request_order IS NULL THEN 0 ELSE 1 END AS INTEGER)"
_INSERTED = {
    **_MERGED,
    "payroll_id": "(SELECT max(payroll_id) FROM payroll_records) + row_number() OVER (ORDER BY w.request_order)",
    "employee_id": "w.employee_id", "payroll_month": "w.payroll_month", "payroll_year": "w.payroll_year",
    "lock_version": "CAST(1 AS INTEGER)",
}

_BY_EMPLOYEE = "PARTITION BY employee_id ORDER BY payroll_year, payroll_month"
_BY_DEPARTMENT = "PARTITION BY department ORDER BY payroll_year, payroll_month"
_TIE = "employee_id, payroll_year, payroll_month"


def oracle_sql() -> dict[str, str]:
    like = " OR ".join(f"lower({c}) LIKE '%r#0%7_1%'" for c in ("first_name", "last_name", "employee_code", "email"))
    named = " OR ".join(f"lower({c}) LIKE '%customer%'" for c in ("first_name", "last_name", "employee_code", "email"))
    quick = " OR ".join(f"lower({c}) LIKE '%mach%'" for c in ("first_name", "last_name", "department"))
    sql = {
        # sources and sinks
        "load_tables": _with(" UNION ALL ".join(_content(name, column) for name, schema in OPERATIONAL.items() for column in schema.names),
                             *OPERATIONAL),
        "append_activity": _whole("log_with_actions"),
        "write_activity": _whole("log_with_actions"),
        "export_audit_csv": _csv(),
        "export_audit_csv_action": _csv("action_name = 'PURCHASE_EVENT'"),
        "run_etl": _whole("fact_payroll"),
        "run_etl_job": _with(f"""
            SELECT CAST(1 AS BIGINT) AS job_id, 'Payroll ETL' AS job_name, 'completed' AS job_status,
                count(*) AS records_processed, CAST(NULL AS VARCHAR) AS error_message,
                {_STAMP} AS started_at, TIMESTAMP '{DONE_TS}' AS completed_at
            FROM fact_payroll""", "fact_payroll"),
        # filters and projections
        "processed_only": _whole("processed"),
        "payroll_history": _whole("paid_history"),
        "payroll_history_by_year": _whole("paid_history", f"payroll_year = {YEAR}"),
        "payroll_history_by_month": _whole("paid_history", f"payroll_month = {MONTH}"),
        "payroll_history_by_department": _whole("paid_history", f"department = '{DEPARTMENT}'"),
        "employee_search": _whole("employees"),
        "employee_search_text": _whole("employees", like),
        "employee_search_department": _whole("employees", f"({named}) AND department = '{DEPARTMENT}'"),
        "employee_quick_search": _whole("employees", quick),
        "audit_search": _audit(),
        "audit_search_action": _audit("action_name = 'PURCHASE_EVENT'"),
        "audit_search_user": _audit("lower(username) LIKE '%user_1%'"),
        "audit_search_date_range": _audit(
            f"CAST(created_at AS DATE) BETWEEN DATE '{DAY_FROM}' AND DATE '{DAY_TO}'"),
        "audit_search_stored_days": _whole("log_with_actions",
            f"CAST(created_at AS DATE) BETWEEN DATE '{DAY_FROM}' AND DATE '{DAY_TO}'"),
        "select_payees_all": _whole("employees", "emp_status = 'active'"),
        "select_payees_department": _whole("employees", f"emp_status = 'active' AND department = '{DEPARTMENT}'"),
        "select_payees_specific": _with("""SELECT * FROM employees
            WHERE emp_status = 'active' AND employee_id IN (SELECT employee_id FROM paid_ids)""",
            "employees", "paid_ids"),
        "active_employees": _with("""SELECT employee_id, employee_code, first_name, last_name, department, basic_salary
            FROM employees WHERE emp_status = 'active'""", "employees"),
        "employee_roster": _with("""SELECT employee_id, employee_code, first_name, last_name, email, department,
            emp_position, basic_salary, hire_date, emp_status FROM employees""", "employees"),
        "user_roster": _with("""SELECT user_id, username, full_name, upper(full_name[1]) AS avatar_initial, email,
            user_role, user_status, coalesce(strftime(last_login, '%b %d, %Y'), 'Never') AS last_login_label, created_at
            FROM users""", "users"),
        "payroll_history_detail": _with(f"""SELECT payroll_id, employee_id, employee_code, {_FULL_NAME} AS full_name,
            department, emp_position, payroll_month, payroll_year, {_PERIOD_NAME} AS period_name, basic_salary,
            allowances_amount, overtime_amount, gross_amount, tax_amount, sss_amount, philhealth_amount, pagibig_amount,
            other_deductions, total_deductions_amount, net_amount, payroll_status, processed_at, lock_version
            FROM joined""", "joined"),
        "period_records": _whole("processed", f"payroll_year = {YEAR} AND payroll_month = {MONTH}"),
        "delete_period": _whole("payroll_records", f"""NOT (payroll_year = {YEAR} AND payroll_month = {MONTH}
            AND payroll_status = 'processed')"""),
        # joins and referential rules
        "records_with_employee": _whole("joined"),
        "star_join": _whole("star"),
        "deletable_employees": _with("""SELECT * FROM staff
            WHERE employee_id NOT IN (SELECT employee_id FROM record_counts)""", "staff", "record_counts"),
        "undeletable_employees": _with("""SELECT employee_id, employee_code, record_count
            FROM staff JOIN record_counts USING (employee_id)""", "staff", "record_counts"),
        "null_deleted_users": _with("""SELECT log_id, u.user_id, l.username, action_name, module_name, details_text,
            ip_address, l.created_at FROM activity_logs l LEFT JOIN users u ON l.user_id = u.user_id""",
            "activity_logs", "users"),
        "cascade_facts": _with(f"""SELECT f.* FROM fact_payroll f JOIN dim_time USING (time_key)
            JOIN dim_department USING (department_key)
            WHERE department_name <> 'Unknown' AND year_number <> {YEAR}""",
            "fact_payroll", "dim_time", "dim_department"),
        "etl_rejects": _with("""SELECT * FROM processed
            WHERE employee_id NOT IN (SELECT employee_id FROM employees WHERE emp_status = 'active')""",
            "processed", "employees"),
        # aggregates
        "monthly_summary": _with(f"""SELECT payroll_year, payroll_month, {_PERIOD_NAME} AS period_name,
            count(DISTINCT employee_id) AS employees_paid, count(*) AS total_transactions,
            {_sum0('gross_amount')} AS total_gross, {_sum0('total_deductions_amount')} AS total_deductions,
            {_sum0('net_amount')} AS total_net, {_mean('net_amount')} AS average_net_pay
            FROM processed GROUP BY 1, 2""", "processed"),
        "department_summary": _with(f"""SELECT department AS department_name, payroll_year, payroll_month,
            {_PERIOD_NAME} AS period_label, count(DISTINCT employee_id) AS employee_count,
            (SELECT count(*) FROM employees e WHERE e.department = h.department AND e.emp_status = 'active')
                AS total_dept_employees,
            {_sum('net_amount')} AS total_net_pay, {_mean('net_amount')} AS average_net_pay,
            max(net_amount) AS highest_net_pay, min(net_amount) AS lowest_net_pay
            FROM history h GROUP BY department, payroll_year, payroll_month""", "history", "employees"),
        "data_mart_dept_summary": _whole("mart"),
        "data_mart_report": _with("""SELECT department_name, month_name_text || ' ' || year_number AS period_name,
            year_number, month_number, quarter_number, payroll_count AS employee_count, total_net_pay AS total_net,
            total_gross_pay, total_deductions, avg_net_pay, highest_net_pay, lowest_net_pay FROM mart""", "mart"),
        "processed_periods": _with(f"""SELECT payroll_year, payroll_month, {_PERIOD_NAME} AS period_name,
            count(*) AS emp_count, {_sum('net_amount')} AS total_paid, max(processed_at) AS processed_date,
            {_mean('net_amount')} AS avg_per_employee FROM processed GROUP BY 1, 2""", "processed"),
        "payroll_trend": _with(f"""SELECT payroll_year, payroll_month,
            strftime(make_date(payroll_year, payroll_month, 1), '%b %Y') AS month_label,
            {_sum('net_amount')} AS total_pay FROM processed GROUP BY 1, 2""", "processed"),
        "history_summary": _with(f"""SELECT count(*) AS total_records, {_sum0('net_amount')} AS total_paid,
            coalesce({_mean('net_amount')}, 0) AS avg_pay, max(net_amount) AS highest_pay, min(net_amount) AS lowest_pay,
            count(DISTINCT employee_id) AS unique_employees FROM processed""", "processed"),
        "history_summary_labels": _with(f"""SELECT total_records, {_shown('total_paid')} AS total_paid, {_shown('avg_pay')} AS avg_pay,
            {_shown('highest_pay')} AS highest_pay, {_shown('lowest_pay')} AS lowest_pay, unique_employees
            FROM (SELECT count(*) AS total_records, {_sum0('net_amount')} AS total_paid,
                coalesce({_mean('net_amount')}, 0) AS avg_pay, max(net_amount) AS highest_pay, min(net_amount) AS lowest_pay,
                count(DISTINCT employee_id) AS unique_employees FROM processed)""", "processed"),
        "department_distribution": _with(f"""SELECT row_number() OVER (ORDER BY emp_count DESC, department) AS position,
            department, emp_count, {_half_up('CAST(1000 * emp_count AS HUGEINT)',
            '(SELECT CAST(count(*) AS HUGEINT) FROM employees)', scale='0.1')} AS percentage
            FROM (SELECT coalesce(department, 'Unknown') AS department, count(*) AS emp_count
                  FROM employees GROUP BY 1)""", "employees"),
        "dashboard_kpis": _with(f"""
            SELECT people.*, pay.*, {_half_up(_cents('total_paid'), 'CAST(total_employees AS HUGEINT)')}
                AS net_paid_per_employee, latest.*
            FROM (SELECT count(*) AS total_employees, count(*) FILTER (emp_status = 'active') AS active_employees,
                      count(DISTINCT department) AS total_departments FROM employees) people,
                (SELECT count(*) AS total_records, {_sum0('net_amount')} AS total_paid FROM processed) pay,
                (SELECT processed_at AS last_processed_at, payroll_year AS last_payroll_year,
                     payroll_month AS last_payroll_month FROM processed
                 ORDER BY processed_at DESC, payroll_year DESC, payroll_month DESC LIMIT 1) latest""",
            "employees", "processed"),
        "employee_stats": _with(f"""SELECT count(*) AS total_employees,
            count(*) FILTER (emp_status = 'active') AS active_employees, {_sum0('basic_salary')} AS total_basic_salary,
            {_mean('basic_salary')} AS average_basic_salary, count(DISTINCT department) AS departments
            FROM employees""", "employees"),
        "payroll_estimate": _estimate("true"),
        "payroll_estimate_department": _estimate(f"department = '{DEPARTMENT}'"),
        "payroll_estimate_specific": _estimate("employee_id IN (SELECT employee_id FROM paid_ids)"),
        "payroll_estimate_by_department": _with(f"""SELECT department, count(*) AS employee_count,
            {_sum('basic_salary')} AS basic_salary_sum FROM employees WHERE emp_status = 'active' GROUP BY 1""",
            "employees"),
        "warehouse_stats": _with(f"""
            SELECT *, dim_employee_count + dim_time_count + dim_department_count AS dim_rows
            FROM (SELECT (SELECT count(*) FROM fact_payroll) AS fact_count,
                (SELECT count(*) FROM dim_employee) AS dim_employee_count,
                (SELECT count(*) FROM dim_time) AS dim_time_count,
                (SELECT count(*) FROM dim_department) AS dim_department_count,
                count(*) AS processed_records, {_sum0('net_amount')} AS total_net FROM processed)""",
            "fact_payroll", "dim_employee", "dim_time", "dim_department", "processed"),
        "audit_stats": _with(f"""SELECT count(*) AS total_logs,
            count(*) FILTER (CAST(created_at AS DATE) = DATE '{DAY_FROM}') AS day_logs,
            count(DISTINCT username) AS unique_users FROM activity_logs""", "activity_logs"),
        "api_totals": _with(f"""SELECT (SELECT count(*) FROM employees WHERE emp_status = 'active') AS total_employees,
            count(*) AS total_payrolls, {_sum0('gross_amount')} AS total_gross_paid FROM payroll_records""",
            "employees", "payroll_records"),
        "departments": _with("SELECT DISTINCT department FROM employees WHERE department IS NOT NULL", "employees"),
        "departments_active": _with("""SELECT DISTINCT department FROM employees
            WHERE department IS NOT NULL AND emp_status = 'active'""", "employees"),
        "audit_actions": _with("SELECT DISTINCT action_name FROM activity_logs", "activity_logs"),
        # windows
        "employee_payroll_ranking": _with(f"""
            SELECT employee_id, employee_code, {_FULL_NAME} AS full_name, department, payroll_year, payroll_month,
                {_PERIOD_NAME} AS period_name, net_amount, rank_in_department, dense_rank_in_dept,
                {_half_up('dept_cents', 'dept_rows')} AS dept_avg_pay,
                {_half_up(_cents('net_amount') + ' * dept_rows - dept_cents', 'dept_rows')} AS diff_from_dept_avg,
                previous_month_pay,
                {_percent('net_amount - previous_month_pay', 'previous_month_pay')} AS mom_change_pct,
                next_month_pay, highest_pay_ever, pay_quartile, overall_rank
            FROM (SELECT *,
                rank() OVER (PARTITION BY department, payroll_year, payroll_month ORDER BY net_amount DESC)
                    AS rank_in_department,
                dense_rank() OVER (PARTITION BY department ORDER BY net_amount DESC) AS dense_rank_in_dept,
                CAST(sum(net_amount) OVER (PARTITION BY department) * 100 AS HUGEINT) AS dept_cents,
                CAST(count(*) OVER (PARTITION BY department) AS HUGEINT) AS dept_rows,
                lag(net_amount) OVER ({_BY_EMPLOYEE}) AS previous_month_pay,
                lead(net_amount) OVER ({_BY_EMPLOYEE}) AS next_month_pay,
                max(net_amount) OVER (PARTITION BY employee_id) AS highest_pay_ever,
                ntile(4) OVER (PARTITION BY department ORDER BY net_amount DESC, {_TIE}) AS pay_quartile,
                row_number() OVER (ORDER BY net_amount DESC, {_TIE}) AS overall_rank
                FROM history)""", "history"),
        "department_trends": _with(f"""
            SELECT department, payroll_year, payroll_month, {_PERIOD_NAME} AS period, emp_count, total_payroll, avg_pay,
                highest_pay, lowest_pay, CAST(total_payroll - previous AS DECIMAL(22,2)) AS payroll_change,
                {_percent('total_payroll - previous', 'previous')} AS pct_change,
                {_half_up('three_cents', 'three_rows')} AS three_month_moving_avg,
                CAST(running AS DECIMAL(22,2)) AS cumulative_payroll, department_rank
            FROM (SELECT *, lag(total_payroll) OVER ({_BY_DEPARTMENT}) AS previous,
                CAST(sum(total_payroll) OVER ({_BY_DEPARTMENT} ROWS 2 PRECEDING) * 100 AS HUGEINT) AS three_cents,
                CAST(count(*) OVER ({_BY_DEPARTMENT} ROWS 2 PRECEDING) AS HUGEINT) AS three_rows,
                sum(total_payroll) OVER ({_BY_DEPARTMENT} ROWS UNBOUNDED PRECEDING) AS running,
                rank() OVER (ORDER BY total_payroll DESC) AS department_rank
                FROM spending)""", "spending"),
        "employee_payroll_analytics": _with(f"""
            SELECT employee_id, employee_code, {_FULL_NAME} AS full_name, department, emp_position, payroll_year,
                payroll_month, net_amount, gross_amount, total_deductions_amount,
                CAST(running AS DECIMAL(22,2)) AS cumulative_earnings,
                {_half_up('three_cents', 'three_rows')} AS rolling_3_month_avg,
                {_percent('net_amount', 'cell_total')} AS pct_of_dept_total, overall_rank
            FROM (SELECT *, sum(net_amount) OVER ({_BY_EMPLOYEE} ROWS UNBOUNDED PRECEDING) AS running,
                CAST(sum(net_amount) OVER ({_BY_EMPLOYEE} ROWS 2 PRECEDING) * 100 AS HUGEINT) AS three_cents,
                CAST(count(*) OVER ({_BY_EMPLOYEE} ROWS 2 PRECEDING) AS HUGEINT) AS three_rows,
                sum(net_amount) OVER (PARTITION BY department, payroll_year, payroll_month) AS cell_total,
                row_number() OVER (ORDER BY net_amount DESC, {_TIE}) AS overall_rank
                FROM history)""", "history"),
        "global_row_number": _with(f"""SELECT employee_id, payroll_year, payroll_month, net_amount,
            row_number() OVER (ORDER BY net_amount DESC, {_TIE}) AS overall_rank FROM processed""", "processed"),
        # top-k listings
        "recent_employees": _with("""SELECT employee_code, first_name, last_name, department, basic_salary
            FROM employees ORDER BY employee_id DESC LIMIT 5""", "employees"),
        "fact_detail": _with("""SELECT fact_id, net_pay, gross_pay, total_deductions, allowances, overtime, full_name,
            employee_department AS department_name, position_title, month_name_text || ' ' || year_number AS period,
            quarter_number FROM star
            ORDER BY year_number DESC, month_number DESC, net_pay DESC, fact_id LIMIT 30""", "star"),
        "etl_history": _with("SELECT * FROM etl_jobs ORDER BY started_at DESC, job_id DESC LIMIT 10", "etl_jobs"),
        "latest_job": _with("SELECT * FROM etl_jobs ORDER BY job_id DESC LIMIT 1", "etl_jobs"),
        "recent_payrolls": _with(f"""SELECT {_REC_COLUMNS}, {_FULL_NAME} AS employee_name, employee_code, department
            FROM joined ORDER BY processed_at DESC NULLS LAST, payroll_id DESC LIMIT 50""", "joined"),
        "recent_payrolls_brief": _with(f"""SELECT payroll_id, {_FULL_NAME} AS name, gross_amount, processed_at
            FROM joined ORDER BY processed_at DESC NULLS LAST, payroll_id DESC LIMIT 5""", "joined"),
        "dim_employee_preview": _with("""SELECT employee_id, employee_code, full_name, department_name, position_title
            FROM dim_employee ORDER BY employee_key LIMIT 20""", "dim_employee"),
        "dim_time_preview": _with("""SELECT year_number, month_number, month_name_text, year_month_text
            FROM dim_time ORDER BY year_number DESC, month_number DESC LIMIT 20""", "dim_time"),
        "dim_department_preview": _with("""SELECT department_name FROM dim_department
            ORDER BY department_key LIMIT 20""", "dim_department"),
        "fact_preview": _with("""SELECT fact_id, net_pay, gross_pay, total_deductions, full_name, department_name
            FROM fact_payroll JOIN dim_employee USING (employee_key) ORDER BY fact_id LIMIT 10""",
            "fact_payroll", "dim_employee"),
        # data-changing jobs
        "validate_employees": _with("SELECT request_order, employee_code, errors FROM candidates", "candidates"),
        "add_employees": _with(f"""SELECT * FROM employees UNION ALL
            SELECT (SELECT max(employee_id) FROM employees) + row_number() OVER (ORDER BY request_order),
                employee_code, first_name, last_name, email, department, emp_position, basic_salary, hire_date,
                'active', CAST(1 AS INTEGER), {_STAMP}, {_STAMP}
            FROM candidates JOIN accepted USING (request_order)""", "employees", "candidates", "accepted"),
        "add_employees_outcome": _with("""SELECT request_order, employee_code,
                CAST(CASE WHEN errors <> '' THEN 3 WHEN a.request_order IS NOT NULL THEN 0 ELSE 1 END AS INTEGER)
                    AS result_code,
                CASE WHEN errors <> '' THEN 'Invalid employee data'
                    WHEN a.request_order IS NOT NULL THEN 'Employee added successfully'
                    ELSE 'Duplicate employee code or email' END AS result_msg
            FROM candidates LEFT JOIN accepted a USING (request_order)""", "candidates", "accepted"),
        "update_employees": _with(f"""SELECT e.employee_id, employee_code,
                CASE WHEN w.employee_id IS NULL THEN first_name ELSE 'Edited' END AS first_name,
                CASE WHEN w.employee_id IS NULL THEN last_name ELSE 'Order' || request_order END AS last_name,
                CASE WHEN w.employee_id IS NULL THEN e.email ELSE w.email END AS email,
                CASE WHEN w.employee_id IS NULL THEN department ELSE 'MACHINERY' END AS department,
                CASE WHEN w.employee_id IS NULL THEN emp_position ELSE 'Editor' END AS emp_position,
                CASE WHEN w.employee_id IS NULL THEN basic_salary
                    ELSE CAST(o_totalprice AS DECIMAL(12,2)) END AS basic_salary, hire_date,
                CASE WHEN w.employee_id IS NULL THEN emp_status WHEN o_orderstatus = 'O' THEN 'inactive'
                    ELSE 'active' END AS emp_status,
                CAST(CASE WHEN w.employee_id IS NULL THEN 1 ELSE 2 END AS INTEGER) AS version_number, created_at,
                CASE WHEN w.employee_id IS NULL THEN updated_at ELSE {_STAMP} END AS updated_at
            FROM employees e LEFT JOIN winning_edits w ON w.employee_id = e.employee_id""",
            "employees", "winning_edits"),
        "update_employees_outcome": _with("""SELECT e.request_order, e.employee_id,
                coalesce(e.verdict, CASE WHEN w.request_order = e.request_order THEN 'updated'
                    ELSE 'conflict at write' END) AS outcome
            FROM edits e LEFT JOIN winning_edits w ON w.employee_id = e.employee_id""", "edits", "winning_edits"),
        "deactivate_employees": _with(f"""SELECT e.* REPLACE (
                CASE WHEN p.employee_id IS NULL THEN emp_status ELSE 'inactive' END AS emp_status,
                CAST(CASE WHEN p.employee_id IS NULL THEN 1 ELSE 2 END AS INTEGER) AS version_number,
                CASE WHEN p.employee_id IS NULL THEN updated_at ELSE {_STAMP} END AS updated_at)
            FROM employees e LEFT JOIN paid_ids p ON p.employee_id = e.employee_id""", "employees", "paid_ids"),
        "delete_employees": _with("""SELECT * FROM staff
            WHERE employee_id IN (SELECT employee_id FROM record_counts)
                OR employee_id NOT IN (SELECT employee_id FROM departures)""", "staff", "record_counts", "departures"),
        "delete_employees_outcome": _with("""SELECT d.employee_id,
                CASE WHEN e.employee_id IS NULL THEN 'not found' WHEN record_count > 0 THEN 'has records'
                    ELSE 'deleted' END AS outcome,
                CASE WHEN e.employee_id IS NULL THEN 0 ELSE coalesce(record_count, 0) END AS record_count
            FROM departures d LEFT JOIN staff e ON e.employee_id = d.employee_id
            LEFT JOIN record_counts r ON r.employee_id = d.employee_id""",
            "staff", "record_counts", "departures"),
        "log_deleted_employees": _with(f"""SELECT * FROM activity_logs UNION ALL
            SELECT (SELECT max(log_id) FROM activity_logs) + row_number() OVER (ORDER BY employee_id) AS log_id,
                CAST(1 AS BIGINT) AS user_id,
                coalesce((SELECT username FROM users WHERE user_id = 1), 'Unknown') AS username,
                'DELETE_EMPLOYEE' AS action_name, 'Employees' AS module_name,
                'Deleted employee: ' || employee_code || ' - ' || {_FULL_NAME} AS details_text,
                '127.0.0.1' AS ip_address, {_STAMP} AS created_at
            FROM staff WHERE employee_id IN (SELECT employee_id FROM departures)
                AND employee_id NOT IN (SELECT employee_id FROM record_counts)""",
            "staff", "record_counts", "departures", "users", "activity_logs"),
        "log_payroll_run": _one_action("PROCESS_PAYROLL", "Payroll", f"""'Processed payroll for '
            || strftime(make_date({NEW_YEAR}, {NEW_MONTH}, 1), '%B %Y') || ' - ' || (SELECT count(*) FROM new_pay) || ' employees'""",
            "new_pay"),
        "log_etl_run": _one_action("RUN_ETL", "Data Warehouse", """'ETL process completed - '
            || (SELECT count(*) FROM fact_payroll) || ' records processed'""", "fact_payroll"),
        "validate_periods": _with("""SELECT request_order, payroll_month, payroll_year, CASE WHEN payroll_month > 11
                THEN 'Month must be 1 to 12' ELSE '' END || CASE WHEN payroll_month > 11 AND payroll_year < 2008 THEN ', ' ELSE '' END
                || CASE WHEN payroll_year < 2008 THEN 'Year must be 2000 or later' ELSE '' END AS errors
            FROM staged_payroll""", "staged_payroll"),
        "log_edited_employees": _with(f"""SELECT * FROM activity_logs UNION ALL
            SELECT (SELECT max(log_id) FROM activity_logs) + row_number() OVER (ORDER BY employee_id) AS log_id,
                CAST(1 AS BIGINT) AS user_id,
                coalesce((SELECT username FROM users WHERE user_id = 1), 'Unknown') AS username,
                'EDIT_EMPLOYEE' AS action_name, 'Employees' AS module_name,
                'Edited employee: ' || employee_code || ' - Edited Order' || request_order || ' (Version: 2)'
                    AS details_text, '127.0.0.1' AS ip_address, {_STAMP} AS created_at
            FROM winning_edits JOIN employees USING (employee_id)""", "winning_edits", "employees", "users", "activity_logs"),
        "log_added_employees": _with(f"""SELECT * FROM activity_logs UNION ALL
            SELECT (SELECT max(log_id) FROM activity_logs) + row_number() OVER (ORDER BY request_order) AS log_id,
                CAST(1 AS BIGINT) AS user_id,
                coalesce((SELECT username FROM users WHERE user_id = 1), 'Unknown') AS username,
                'ADD_EMPLOYEE' AS action_name, 'Employees' AS module_name,
                'Added employee: ' || employee_code || ' - ' || {_FULL_NAME} AS details_text,
                '127.0.0.1' AS ip_address, {_STAMP} AS created_at
            FROM candidates JOIN accepted USING (request_order)""", "candidates", "accepted", "users", "activity_logs"),
        "compute_pay": _whole("new_pay"),
        "run_payroll": _new_payroll("true", NEW_YEAR, NEW_MONTH),
        "run_payroll_department": _new_payroll(
            f"employee_id IN (SELECT employee_id FROM employees WHERE department = '{DEPARTMENT}')", NEW_YEAR, NEW_MONTH),
        "run_payroll_specific": _new_payroll("employee_id IN (SELECT employee_id FROM paid_ids)", NEW_YEAR, NEW_MONTH),
        "run_payroll_outcome": _with(f"""SELECT CAST(0 AS INTEGER) AS result_code, count(*) AS record_count,
            'Payroll successfully processed for ' || count(*) || ' employees in period: '
                || strftime(make_date({NEW_YEAR}, {NEW_MONTH}, 1), '%B %Y') AS result_msg FROM new_pay""", "new_pay"),
        "run_payroll_refused": _with("""SELECT DISTINCT CAST(1 AS INTEGER) AS result_code,
            CAST(0 AS BIGINT) AS record_count, 'Payroll for this period already exists!' AS result_msg
            FROM payroll_records""" + f" WHERE payroll_year = {YEAR} AND payroll_month = {MONTH}", "payroll_records"),
        "run_payroll_employee_guard": _new_payroll(f"""employee_id NOT IN (SELECT employee_id FROM payroll_records
            WHERE payroll_year = {YEAR} AND payroll_month = {MONTH})""", YEAR, MONTH),
        "merge_payroll": _with(f"""
            SELECT {_applied(_UPDATED)} FROM payroll_records r
            LEFT JOIN winning_payroll w ON w.payroll_id = r.payroll_id
            UNION ALL
            SELECT {_applied(_INSERTED)} FROM winning_payroll w WHERE w.payroll_id IS NULL""",
            "payroll_records", "winning_payroll"),
        "merge_payroll_outcome": _with("""SELECT j.request_order, j.employee_id, j.payroll_year, j.payroll_month,
                CAST(coalesce(j.verdict, CASE WHEN w.request_order IS NULL THEN 2 ELSE 0 END) AS INTEGER) AS result_code
            FROM judged j LEFT JOIN winning_payroll w ON w.request_order = j.request_order""",
            "judged", "winning_payroll"),
    }
    # queries that return one of the expressions as it is
    sql["export_json"] = sql["employee_roster"]
    # the smallest spelling is the one in capitals, which the lens gives without collation
    for name in ("department_summary", "department_distribution", "payroll_estimate_department",
                 "payroll_estimate_by_department", "employee_payroll_ranking", "department_trends", "employee_payroll_analytics"):
        sql[f"{name}_collated"] = sql[name]
    for job in ("run_payroll", "merge_payroll", "delete_period"):
        sql[f"published_{job}"] = sql[job]
    for table in ("dim_department", "dim_employee", "dim_time", "fact_payroll"):
        sql[table] = _whole(table)
    return sql


def _estimate(where: str) -> str:
    return _with(f"""SELECT count(*) AS employee_count,
        CAST(round(coalesce(sum(basic_salary), 0) * 1.15, 2) AS DECIMAL(22,2)) AS estimated_gross
        FROM employees WHERE emp_status = 'active' AND {where}""", "employees", "paid_ids")


def _one_action(action: str, module: str, details: str, *names: str) -> str:
    return _with(f"""SELECT * FROM activity_logs UNION ALL
        SELECT (SELECT max(log_id) FROM activity_logs) + 1, CAST(1 AS BIGINT),
            coalesce((SELECT username FROM users WHERE user_id = 1), 'Unknown'), '{action}', '{module}', {details},
            '127.0.0.1', {_STAMP}""", "activity_logs", "users", *names)

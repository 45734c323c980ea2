"""What the physical plans must and must not contain."""

import itertools
from decimal import Decimal

import pytest

from paystrata import catalog
from paystrata.operators import aggregates as agg
from paystrata.operators import filters, joins, topk, windows
from paystrata.plans import etl, jobs
from paystrata.sources import lens, staging, tables
from tests.fixtures import log_row, logs, seed, users


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    import datetime as dt
    emp, rec = seed(spark)
    folder = str(tmp_path_factory.mktemp("db") / "t")
    known = users(spark, dict(user_id=1, username="admin", full_name="Ann"))
    log = logs(spark, log_row(1, dt.datetime(2026, 1, 1)))
    tables.save_tables({"users": known, "employees": emp, "payroll_records": rec, "activity_logs": log}, folder)
    return tables.load_tables(spark, folder, ("users", "employees", "payroll_records", "activity_logs"))


@pytest.fixture(scope="module", autouse=True)
def whole_plan_text(spark):
    settings = {"spark.sql.maxMetadataStringLength": "100000", "spark.sql.debug.maxToStringFields": "200"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_record_filters_reach_the_scan(stored):
    rec, emp = stored["payroll_records"], stored["employees"]
    text = plan(filters.payroll_history(rec, emp, year=2026, month=5))
    assert "EqualTo(payroll_status,processed)" in text and "EqualTo(payroll_month,5)" in text
    assert "PartitionFilters: [isnotnull(payroll_year" in text


def test_summary_reads_only_its_columns(stored):
    text = plan(agg.monthly_summary(stored["payroll_records"]))
    schema = text[text.index("FileScan"):]
    assert "basic_salary" not in schema and "net_amount" in schema
    assert "SortAggregate" not in text and text.count("partial_") >= 1


def test_audit_dates_reach_the_scan(stored):
    text = plan(filters.audit_search(stored["activity_logs"], date_from="2026-01-01", date_to="2026-01-31"))
    assert "GreaterThanOrEqual(created_at" in text and "LessThan(created_at" in text
    assert "TakeOrderedAndProject" not in text  # all rows, unless a page is asked for
    assert "TakeOrderedAndProject" in plan(filters.audit_search(stored["activity_logs"], limit=200))


@pytest.mark.parametrize("view", [windows.employee_payroll_ranking, windows.employee_payroll_analytics,
                                  windows.department_trends])
def test_rankings_never_gather_one_partition(spark, stored, view, monkeypatch):
    seen = []
    from paystrata.operators import ranking
    write = ranking.staged

    def spy(df, label):
        seen.append((label, plan(df)))
        return write(df, label)

    monkeypatch.setattr(ranking, "staged", spy)
    final = view(stored["payroll_records"], stored["employees"])
    rows = [text for label, text in seen if label == "ranked-rows"]
    assert rows and all("SinglePartition" not in text for text in rows)
    # only narrow rows are ranged and dealt out by slot
    assert not any(name in text for text in rows for name in ("employee_code", "first_name", "full_name", "emp_position"))
    # the only single-task window runs over one row per slot
    assert {label for label, text in seen if "SinglePartition" in text} <= {"slot-shifts"}
    for after in plan(final).split("Exchange SinglePartition")[1:]:
        assert "HashAggregate(keys=[_slot#" in after.split("FileScan")[0]


def test_no_cross_or_nested_loop_joins(stored):
    rec, emp = stored["payroll_records"], stored["employees"]
    star = etl.build_star(emp, rec, "2026-06-01 00:00:00")
    for df in (agg.dashboard_kpis(emp, rec), agg.api_totals(emp, rec), agg.warehouse_stats(star, rec),
               agg.department_distribution(emp), agg.department_summary(rec, emp), joins.star_join(star),
               joins.cascade_facts(star["fact_payroll"], star), joins.etl_rejects(rec, star),
               windows.employee_payroll_ranking(rec, emp)):
        text = plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_small_dimensions_are_broadcast_by_their_size(spark, stored):
    star = etl.build_star(stored["employees"], stored["payroll_records"], "2026-06-01 00:00:00")
    assert "BroadcastHashJoin" in plan(joins.star_join(star))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(joins.star_join(star))
        assert "BroadcastHashJoin [employee" not in text and "SortMergeJoin" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_top_k_is_per_task(stored):
    for df in (topk.recent_employees(stored["employees"]),
               topk.recent_payrolls(stored["payroll_records"], stored["employees"])):
        assert "TakeOrderedAndProject" in plan(df)


def test_no_python_in_the_plans(stored):
    rec, emp = stored["payroll_records"], stored["employees"]
    for df in (agg.payroll_trend(rec), filters.payroll_history_detail(rec, emp), windows.department_trends(rec, emp)):
        assert "Python" not in plan(df)


@pytest.mark.parametrize("hot", ["7", "NULL"])
def test_a_hot_key_is_split(spark, hot):
    """A third of the log belongs to one user, or to none: its join side is split at run time."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB", "spark.sql.shuffle.partitions": "32",
    }
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        log = spark.range(0, 300000, 1, 8).selectExpr(
            "id AS log_id", f"CASE WHEN id % 3 = 0 THEN {hot} ELSE id % 5000 END AS user_id", "uuid() AS username",
            "'A' AS action_name", "'M' AS module_name", "'d' AS details_text", "'i' AS ip_address",
            "TIMESTAMP_NTZ '2026-01-01' AS created_at")
        known = spark.range(5000).withColumnRenamed("id", "user_id")
        df = joins.null_deleted_users(log, known)
        execution = df._jdf.queryExecution()
        assert execution.toRdd().count() == 300000
        assert "SortMergeJoin(skew=true)" in execution.executedPlan().toString()
    finally:
        for key in settings:
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_small_delete_does_not_shuffle_the_records(spark, stored, monkeypatch):
    plans = {}

    def noted(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return staging.staged(df, label)
    monkeypatch.setattr(joins, "staged", noted)
    ids = spark.createDataFrame([(1,)], "employee_id long")
    joins.deletable_employees(stored["employees"], ids, stored["payroll_records"])
    plan = plans["held-records"]
    above = plan[:plan.index("BroadcastHashJoin")]
    # The records reach the join as they are scanned; what is exchanged above it are their counts.
    assert "LeftSemi" in plan and "SortMergeJoin" not in plan and above.count("Exchange hashpartitioning") == 1 and "partial_count" in above


def test_detail_listing_cuts_facts_before_the_wide_dimensions(stored):
    star = etl.build_star(stored["employees"], stored["payroll_records"], "2026-06-01 00:00:00")
    lines = plan(topk.fact_detail(star, 3)).splitlines()
    depth = [len(line) - len(line.lstrip(" :+-*(0123456789)")) for line in lines]
    top = next(i for i, line in enumerate(lines) if "TakeOrderedAndProject" in line)
    below = list(itertools.takewhile(lambda i: depth[i] > depth[top], range(top + 1, len(lines))))
    assert any("full_name" in line for line in lines) and not any("full_name" in lines[i] for i in below)
    assert any("FileScan" in lines[i] for i in below)
    every = topk.fact_detail(star, 10**6).collect()
    gone = every[0]["department_name"]
    fewer = {**star, "dim_department": star["dim_department"].filter(f"department_name <> '{gone}'")}
    kept = {r["fact_id"] for r in joins.star_join(fewer).collect()}
    assert topk.fact_detail(fewer, 3).collect() == [r for r in every if r["fact_id"] in kept][:3]


def _lines(spark, folder, flags):
    """Order lines of one day, one for each flag; those of a key come in a row of flags."""
    rows = [(key, 1, 7, 2.0, 10.0, flag) for key, some in flags.items() for flag in some]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, "
                          "l_returnflag string").selectExpr("*", "timestamp_ntz'1996-03-04' AS l_shipdate").write.parquet(f"{folder}/lineitem.parquet")


def test_staged_payroll_is_not_sorted_to_be_grouped(spark, tmp_path):
    flags = {1: "N", 2: "A", 3: "R", 4: "RN", 5: "NA", 6: "RA", 7: "BN", 8: ["0", "A"], 9: [None], 10: [None, "N"], 11: ["", "N"], 12: "Zz"}
    _lines(spark, str(tmp_path), flags)
    found = lens.staged_payroll(spark, str(tmp_path))
    assert "SortAggregate" not in plan(found) and "HashAggregate" in plan(found)
    least = {key: min((f for f in some if f is not None), default=None) for key, some in flags.items()}
    assert {r.request_order: r.expected_lock for r in found.collect()} == {
        key * 10 + 1: {"N": 0, "A": 1}.get(flag, 2) for key, flag in least.items()}


def test_published_merge_builds_its_requests_once(spark, tmp_path, monkeypatch):
    folder, calls = str(tmp_path), []
    _lines(spark, folder, {1: "N", 2: "N"})
    spark.sql("SELECT 7L AS c_custkey, 'Customer#7' AS c_name, 1 AS c_nationkey, 500.0D AS c_acctbal, 'MACHINERY' AS c_mktsegment").write.parquet(
        f"{folder}/customer.parquet")
    spark.sql("SELECT 1L AS o_orderkey, 7L AS o_custkey, 'F' AS o_orderstatus, 10.0D AS o_totalprice, timestamp_ntz'1996-02-01' AS o_orderdate, "
              "'5-LOW' AS o_orderpriority").write.parquet(f"{folder}/orders.parquet")
    build = lens.staged_payroll
    monkeypatch.setattr(lens, "staged_payroll", lambda *args: calls.append(1) or build(*args))
    rows = catalog.queries()["published_merge_payroll"](spark, folder).collect()
    assert sorted((r.payroll_year, r.payroll_month, str(r.basic_salary)) for r in rows) == [(2006, 2, "10.00"), (2006, 3, "10.00")]
    assert len(calls) == 1


def test_refused_merge_requests_lose_their_amounts(spark, stored, monkeypatch):
    """They are dropped before the requests meet the records, where rows are shuffled."""
    plans = {}

    def noted(df, label):
        plans[label] = staging.staged(df, label)
        return plans[label]
    monkeypatch.setattr(jobs, "staged", noted)
    parts = ", ".join(f"{p} decimal(12,2)" for p in jobs._PARTS)
    rows = [(i, i, 2026, 9, 0, *[Decimal("1.00")] * len(jobs._PARTS)) for i in (1, 99)]
    requests = spark.createDataFrame(rows, f"request_order long, employee_id long, payroll_year int, payroll_month int, expected_lock int, {parts}")
    _, outcome = jobs.merge_payroll(stored["payroll_records"], stored["employees"], requests, "2026-06-01 00:00:00")
    assert {r.request_order: r.result_code for r in outcome.collect()} == {1: 0, 99: 3}
    assert {r.request_order: r.basic_salary for r in plans["judged-payroll"].collect()} == {1: Decimal("1.00"), 99: None}

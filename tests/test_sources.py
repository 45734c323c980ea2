"""Table files, exports, staging and the published warehouse snapshot."""

import datetime as dt
import json
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from paystrata.plans import etl, jobs
from paystrata.schema import ACTIVITY_LOGS, OPERATIONAL
from paystrata.sources import sinks, staging, tables, versions
from tests.fixtures import employee, employees, log_row, logs, record, records, seed, users

STAMP, LATER = "2026-06-01 00:00:00", "2026-07-01 00:00:00"


def test_tables_round_trip(spark, tmp_path):
    emp, rec = seed(spark)
    log = logs(spark, log_row(1, dt.datetime(2026, 1, 1)), log_row(2, dt.datetime(2026, 1, 2), user_id=None))
    known = users(spark, dict(user_id=1, username="admin", full_name="Ann"))
    saved = {"users": known, "employees": emp, "payroll_records": rec, "activity_logs": log}
    folder = str(tmp_path / "db")
    tables.save_tables(saved, folder)
    loaded = tables.load_tables(spark, folder, tuple(OPERATIONAL))
    for name, df in saved.items():
        assert loaded[name].schema.names == df.schema.names
        assert sorted(map(str, loaded[name].collect())) == sorted(map(str, df.collect()))
    sinks.write_activity(spark.createDataFrame(
        [(3, 1, "RUN_ETL", None, None, None, dt.datetime(2026, 1, 3))],
        "log_id long, user_id long, action_name string, module_name string, details_text string, "
        "ip_address string, created_at timestamp_ntz"), known, folder)
    again = tables.load_tables(spark, folder, ("activity_logs",))["activity_logs"]
    assert again.count() == 3 and again.filter("log_id = 3").first().username == "admin"


def test_csv_export(spark, tmp_path):
    log = logs(spark, log_row(1, dt.datetime(2026, 1, 1, 9, 8, 7), action_name="ADD_EMPLOYEE", module_name=None,
                              details_text='a, b "c"')).coalesce(1)
    path = str(tmp_path / "csv")
    sinks.export_audit_csv(log, path)
    part, = [f for f in os.listdir(path) if f.endswith(".csv")]
    with open(os.path.join(path, part)) as f:
        assert f.read().splitlines() == [
            '"Timestamp","User","Action","Module","Details","IP Address"',
            '"2026-01-01 09:08:07","admin","ADD EMPLOYEE","-","a; b ""c""","10.0.0.1"']


def test_json_export_keeps_nulls(spark, tmp_path):
    path = str(tmp_path / "json")
    sinks.export_json(employees(spark, employee(1, department=None)).select("employee_id", "department").coalesce(1), path)
    part, = [f for f in os.listdir(path) if f.endswith(".json")]
    with open(os.path.join(path, part)) as f:
        assert json.loads(f.read()) == {"employee_id": 1, "department": None}


def test_snapshot_is_replaced_only_by_a_complete_run(spark, tmp_path, monkeypatch):
    emp, rec = seed(spark)
    folder = str(tmp_path / "dw")
    assert etl.run_etl(emp, records(spark), folder, 1, STAMP) == etl.NOTHING_TO_LOAD
    assert not os.path.exists(folder)
    assert etl.run_etl(emp, rec, folder, 1, STAMP) == "completed"
    assert sinks.read_snapshot(spark, folder)["fact_payroll"].count() == 30

    broken = rec.withColumn("net_amount", F.expr("raise_error('disk full')").cast("decimal(12,2)"))
    with pytest.raises(Exception):
        etl.run_etl(emp, broken, folder, 2, LATER)
    assert sinks.read_snapshot(spark, folder)["fact_payroll"].count() == 30
    log = {r.job_id: r for r in sinks.read_jobs(spark, folder).collect()}
    assert (log[1].job_status, log[1].records_processed) == ("completed", 30)
    assert log[2].job_status == "failed" and log[2].error_message

    fewer = employees(spark, employee(1))
    assert etl.run_etl(fewer, rec, folder, 3, LATER) == "completed"
    star = sinks.read_snapshot(spark, folder)
    assert star["fact_payroll"].count() == 3 and star["dim_employee"].first().employee_key == 1


def test_no_snapshot_yet(spark, tmp_path):
    folder = str(tmp_path / "dw")
    sinks.log_job(spark, folder, 1, "running", 0, None, STAMP, None)
    assert sinks.read_jobs(spark, folder).first().job_status == "running"
    with pytest.raises(LookupError):
        sinks.read_snapshot(spark, folder)


class _Session:
    """Stands for a session: only what the staging folder is read from."""

    def __init__(self, master, setting=None):
        self.conf, self.master, self.sparkContext = {"spark.checkpoint.dir": setting} if setting else {}, master, self

    def getConf(self):
        return self.conf

    def getCheckpointDir(self):
        return None


def test_staging_folder(spark):
    assert staging.staging_root(_Session("yarn", "hdfs://x/shared/")) == "hdfs://x/shared/paystrata"
    with pytest.raises(RuntimeError):
        staging.staging_root(_Session("yarn"))
    rec = records(spark, record(1, 1, 2026, 1, "1.00"))
    assert staging.staged(rec, "probe").first() == rec.first()


def test_staged_tables_can_be_released(spark, monkeypatch):
    monkeypatch.setattr(staging, "_scopes", [[]])
    kept = staging.staged(records(spark, record(1, 1, 2026, 1, "1.00")), "probe")
    folder = _local(staging._scopes[0][0])
    assert kept.count() == 1 and os.path.isdir(folder)
    assert staging.release_staged(spark) == 1
    assert not os.path.exists(folder) and staging.release_staged(spark) == 0


def _local(path):
    return path.removeprefix("file://")


def test_a_scope_deletes_its_own_tables_only(spark, monkeypatch):
    monkeypatch.setattr(staging, "_scopes", [[]])
    rows = records(spark, record(1, 1, 2026, 1, "1.00"))
    outer = staging.staged(rows, "outer")
    with pytest.raises(ZeroDivisionError):
        with staging.staging_scope(spark):
            staging.staged(rows, "inner")
            with staging.staging_scope(spark):
                deepest = _local(staging.staging_path(spark, "path"))
                rows.write.parquet(deepest)
            assert not os.path.exists(deepest)
            inner = _local(staging._scopes[-1][0])
            assert os.path.isdir(inner)
            1 / 0
    assert not os.path.exists(inner) and outer.count() == 1
    staging.release_staged(spark)


def _files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.startswith("part-")}


def _saved_records(spark, folder):
    rec = records(spark, *[record(y * 10 + m, 1, y, m, "10.00") for y in (2024, 2025, 2026) for m in (1, 2)])
    tables.save_tables({"payroll_records": rec}, folder)
    return _records(spark, folder)


def _records(spark, folder):
    return tables.load_tables(spark, folder, ("payroll_records",))["payroll_records"]


def _states(rec):
    return sorted((r.payroll_year, r.payroll_status) for r in rec.collect())


def _paid(rec, year):
    return rec.withColumn("payroll_status", F.when(F.col("payroll_year") == year, "paid").otherwise(F.col("payroll_status")))


SAVED = [(year, "processed") for year in (2024, 2025, 2026) for _ in (1, 2)]


def test_publishing_keeps_the_files_of_other_years(spark, tmp_path):
    folder = str(tmp_path)
    stored = _saved_records(spark, folder)
    before = _files(folder)
    assert tables.records_version(spark, folder) == 0
    assert tables.publish_records(_paid(stored, 2025).filter("payroll_year <> 2026"), folder, [2025, 2026]) == tables.PUBLISHED
    assert tables.records_version(spark, folder) == 1
    after = _records(spark, folder)
    assert _states(after) == [(2024, "processed")] * 2 + [(2025, "paid")] * 2
    # Readers that have begun keep their files.
    assert before <= _files(folder) and _states(stored) == SAVED
    new = _files(folder) - before
    assert new and all("=2025" in f for f in new)
    plan = after.filter("payroll_year = 2025")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(payroll_year" in plan
    assert tables.publish_records(_paid(after, 2024), folder, [2024, 2025]) == tables.PUBLISHED
    assert _states(_records(spark, folder)) == [(2024, "paid")] * 2 + [(2025, "paid")] * 2
    assert tables.remove_replaced(spark, folder) == 1 and not new & _files(folder)
    assert _states(_records(spark, folder)) == [(2024, "paid")] * 2 + [(2025, "paid")] * 2
    assert tables.publish_records(after.limit(0), folder, [2024, 2025]) == tables.PUBLISHED
    assert _records(spark, folder).count() == 0 and _records(spark, folder).columns == stored.columns


def test_a_failure_before_the_switch_leaves_the_table_whole(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    stored = _saved_records(spark, folder)

    def broken(*_):
        raise OSError("the store is gone")
    with monkeypatch.context() as patch:
        patch.setattr(tables.versions, "put_if_absent", broken)
        with pytest.raises(OSError):
            tables.publish_records(_paid(stored, 2025), folder, [2025, 2026])
    assert _states(_records(spark, folder)) == SAVED and tables.records_version(spark, folder) == 0
    with pytest.raises(Exception, match="disk full"):
        bad = stored.withColumn("net_amount", F.expr("raise_error('disk full')").cast("decimal(12,2)"))
        tables.publish_records(bad, folder, [2025])
    assert _states(_records(spark, folder)) == SAVED


def test_the_second_of_two_overlapping_publishes_is_refused(spark, tmp_path):
    folder = str(tmp_path)
    stored = _saved_records(spark, folder)
    version = tables.records_version(spark, folder)
    assert tables.publish_records(_paid(stored, 2025), folder, [2025], version) == tables.PUBLISHED
    assert tables.publish_records(_paid(stored, 2025).filter("payroll_month = 1"), folder, [2025, 2026], version) == tables.REPLACED_SINCE
    # Another year of the same version is nobody's loss.
    assert tables.publish_records(_paid(stored, 2024), folder, [2024], version) == tables.PUBLISHED
    assert _states(_records(spark, folder)) == [(2024, "paid")] * 2 + [(2025, "paid")] * 2 + [(2026, "processed")] * 2


def test_a_writer_that_comes_between_check_and_switch(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    stored = _saved_records(spark, folder)
    switch, other = tables.versions.switch, []

    def late(*args):
        if not other:
            other.append(True)
            assert tables.publish_records(_paid(stored, 2024), folder, [2024]) == tables.PUBLISHED
        return switch(*args)
    monkeypatch.setattr(tables.versions, "switch", late)
    assert tables.publish_records(_paid(stored, 2025), folder, [2025], 0) == tables.PUBLISHED
    assert _states(_records(spark, folder)) == [(2024, "paid")] * 2 + [(2025, "paid")] * 2 + [(2026, "processed")] * 2
    other.clear()
    assert tables.publish_records(_paid(stored, 2024).filter("payroll_month = 2"), folder, [2024], 2) == tables.REPLACED_SINCE


def test_jobs_publish_with_their_version(spark, tmp_path):
    folder = str(tmp_path)
    _saved_records(spark, folder)
    emp = employees(spark, employee(1), employee(2))

    def run(rec, month):
        return jobs.run_payroll(rec, emp, 2026, month, STAMP, reserve=lambda n, free: versions.reserve_ids(spark, folder, "payroll_id", n, free))

    def slow(rec):
        # A second run for another month of the same year ends while this one is at work.
        assert jobs.publish_job(spark, folder, [2026], lambda now: run(now, 3))[0] == tables.PUBLISHED
        return run(rec, 4)
    code, outcome = jobs.publish_job(spark, folder, [2026], slow)
    assert code == tables.REPLACED_SINCE and outcome.first().result_code == 0
    assert {(r.payroll_month, r.payroll_id) for r in _records(spark, folder).filter("payroll_year = 2026 and payroll_month > 2").collect()} == {
        (3, 20263), (3, 20264)}
    assert jobs.publish_job(spark, folder, [2026], lambda rec: run(rec, 4))[0] == tables.PUBLISHED
    got = _records(spark, folder).filter("payroll_year = 2026")
    assert got.count() == 6 and got.select("payroll_id").distinct().count() == 6


def test_jobs_that_start_from_the_same_state_get_different_ids(spark, tmp_path):
    folder = str(tmp_path)
    reserve = lambda n, free: versions.reserve_ids(spark, folder, "payroll_id", n, free)
    emp, rec = employees(spark, employee(1), employee(2), employee(3)), records(spark, record(7, 1, 2025, 1, "1.00"))
    one, _ = jobs.run_payroll(rec, emp, 2026, 1, STAMP, reserve=reserve)
    two, _ = jobs.run_payroll(rec, emp, 2026, 2, STAMP, reserve=reserve)
    ids = [sorted(r.payroll_id for r in state.filter("payroll_year = 2026").collect()) for state in (one, two)]
    assert ids == [[8, 9, 10], [11, 12, 13]]
    with ThreadPoolExecutor(8) as pool:
        firsts = sorted(pool.map(lambda n: (versions.reserve_ids(spark, folder, "log_id", n, 100), n), range(1, 17)))
    assert firsts[0][0] == 100 and all(a + n == b for (a, n), (b, _) in zip(firsts, firsts[1:]))
    assert versions.reserve_ids(spark, folder, "log_id", 1, 5000) == 5000


def test_a_version_is_written_once(spark, tmp_path):
    place = str(tmp_path / "record")
    assert versions.latest(spark, place) == (0, None)
    assert versions.put_next(spark, place, 0, "one") and not versions.put_next(spark, place, 0, "other")
    assert versions.latest(spark, place) == (1, "one") and versions.put_next(spark, place, 1, "é")
    assert versions.latest(spark, place) == (2, "é") and not [f for f in os.listdir(place) if f.startswith(".") and not f.endswith(".crc")]


def test_a_used_job_id_is_refused_and_the_snapshot_stays(spark, tmp_path):
    folder = str(tmp_path / "dw")
    emp, rec = employees(spark, employee(1)), records(spark, record(1, 1, 2026, 1, "1.00"))
    assert etl.run_etl(emp, rec, folder, 1, STAMP) == "completed"
    before = _files(folder)
    with pytest.raises(ValueError, match="job 1"):
        etl.run_etl(emp, rec, folder, 1, LATER)
    assert _files(folder) == before and sinks.read_snapshot(spark, folder)["fact_payroll"].count() == 1
    assert etl.run_etl(emp, rec, folder, None, LATER) == "completed"
    assert sorted(r.job_id for r in sinks.read_jobs(spark, folder).collect()) == [1, 2]
    # A log without claims, as earlier runs left it, and a state that comes after the end.
    sinks.log_job(spark, folder, 7, "completed", 1, None, STAMP, LATER)
    sinks.log_job(spark, folder, 7, "failed", 0, "late", STAMP, "2027-01-01 00:00:00")
    assert {r.job_id: r.job_status for r in sinks.read_jobs(spark, folder).collect()}[7] == "completed"
    with pytest.raises(ValueError):
        sinks.claim_job(spark, folder, 7)
    assert sinks.claim_job(spark, folder) == 8 and sinks.claim_job(spark, folder) == 9
    sinks.log_job(spark, folder, 9, "failed", 0, "first", STAMP, "2026-01-02 00:00:00")
    sinks.log_job(spark, folder, 9, "failed", 0, "a second", STAMP, "2026-01-03 00:00:00")
    assert {r.job_id: r.error_message for r in sinks.read_jobs(spark, folder).collect()}[9] == "a second"


def test_content_tells_tables_apart(spark):
    rec = records(spark, record(1, 1, 2026, 1, "1.00"), record(2, 1, 2026, 2, "2.00"))
    facts = lambda df: {tuple(r) for r in tables.content(df, "t").collect()}
    assert facts(rec) == facts(rec.orderBy(F.desc("payroll_id")).repartition(3))
    other = facts(rec.withColumn("payroll_month", F.lit(1)))
    assert {r[1] for r in facts(rec) ^ other} == {"payroll_month"}
    assert {r[2:] for r in facts(rec.limit(0))} == {(0, 0, 0)}


def test_a_range_of_days_reads_only_its_months(spark, tmp_path):
    folder = str(tmp_path)
    rows = [(i, 1, "u", "A", None, None, None, dt.datetime(2024, m, 10)) for i, m in enumerate((1, 2, 3, 3))]
    log = spark.createDataFrame(rows, ACTIVITY_LOGS)
    tables.save_tables({"activity_logs": log.limit(2)}, folder)
    tables.append_table(log, "activity_logs", folder)
    found = tables.load_log(spark, folder, "2024-02-05", "2024-03-05")
    assert found.schema.names == ACTIVITY_LOGS.names and found.count() == 4
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_month" in plan
    assert tables.load_tables(spark, folder, ("activity_logs",))["activity_logs"].count() == 6


def test_a_failed_load_logs_the_whole_message_and_the_end(spark, tmp_path):
    emp, rec = employees(spark, employee(1)), records(spark, record(1, 1, 2026, 1, "1.00"))
    long = "x" * 3000
    broken = rec.withColumn("net_amount", F.expr(f"raise_error('{long}')").cast("decimal(12,2)"))
    with pytest.raises(Exception):
        etl.run_etl(emp, broken, str(tmp_path), 1, STAMP, clock=lambda: LATER)
    job = sinks.read_jobs(spark, str(tmp_path)).first()
    assert long in job.error_message and str(job.started_at) == STAMP and str(job.completed_at) == LATER

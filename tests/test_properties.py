"""Identities that hold for any data."""

from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from paystrata.operators import aggregates as agg
from paystrata.operators import joins, windows
from paystrata.plans import etl
from tests.fixtures import employee, employees, record, records

STAMP = "2026-06-01 00:00:00"
MONEY = st.integers(-5000, 500000).map(lambda c: Decimal(c) / 100)


@st.composite
def payrolls(draw):
    people = [employee(i, department=draw(st.sampled_from([None, "a", "b"])),
                       emp_status=draw(st.sampled_from(["active", "inactive"]))) for i in range(1, 7)]
    paid = []
    for i in range(1, 7):
        for month in draw(st.sets(st.integers(1, 6), max_size=5)):
            net = draw(st.one_of(MONEY, st.just(Decimal("100.00")), st.just(Decimal("0.00"))))
            status = draw(st.sampled_from(["processed", "processed", "draft", "paid"]))
            paid.append(record(i * 10 + month, i, 2026, month, net, payroll_status=status))
    return people, paid


@settings(max_examples=4, deadline=None, derandomize=True,
          suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(payrolls())
def test_identities(spark, data):
    emp, rec = employees(spark, *data[0]), records(spark, *data[1])
    processed = [r for r in rec.collect() if r.payroll_status == "processed"]
    total = sum((r.net_amount for r in processed), Decimal("0.00"))

    ranking = windows.employee_payroll_ranking(rec, emp, slots=4).collect()
    assert sorted(r.overall_rank for r in ranking) == list(range(1, len(processed) + 1))
    by_rank = sorted(ranking, key=lambda r: r.overall_rank)
    assert [r.net_amount for r in by_rank] == sorted((r.net_amount for r in processed), reverse=True)

    analytics = windows.employee_payroll_analytics(rec, emp, slots=4).collect()
    last = {}
    for r in sorted(analytics, key=lambda r: r.payroll_month):
        last[r.employee_id] = r.cumulative_earnings
    assert sum(last.values(), Decimal("0.00")) == total
    shares = {}
    for r in analytics:
        shares.setdefault((r.department, r.payroll_month), []).append(r.pct_of_dept_total)
    for parts in shares.values():
        if None not in parts:
            assert abs(sum(parts) - 100) <= Decimal("0.005") * len(parts)

    assert sum((r.total_net for r in agg.monthly_summary(rec).collect()), Decimal("0.00")) == total
    star = etl.build_star(emp, rec, STAMP, slots=3)
    mart = sum((r.total_net_pay for r in agg.data_mart_dept_summary(star).collect()), Decimal("0.00"))
    lost = sum((r.net_amount for r in joins.etl_rejects(rec, star).collect()), Decimal("0.00"))
    assert mart + lost == total

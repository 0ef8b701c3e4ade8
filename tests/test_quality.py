from datetime import date, datetime, timedelta

import pytest
from conftest import AS_OF, money

from rentgrain.operators import constraints, quality
from rentgrain.sources import star

HEALTHY = dict(units=[{"unit_status": "occupied"}])
BROKEN = {
    "X1": dict(units=[{"unit_status": "occupied"}, {"unit_status": "occupied"}]),
    "X2": dict(units=[{}]),
    "X3": dict(leases=[{}, {"tenant_id": 9, "lease_status": "expired"}]),
    "X4": dict(leases=[{}, {"unit_id": 9, "lease_status": "expired"}]),
    "X5": dict(payments=[{}, {"lease_id": 9}]),
    "X6": dict(payments=[{"amount_paid": money(2000), "payment_status": "paid"}]),
    "X7": dict(payments=[{}, {}]),
    "X8": dict(leases=[{}, {"end_date": date(2024, 1, 1), "lease_status": "expired"}]),
    "X9": dict(maintenance_requests=[{}, {"unit_id": 9}]),
    "X10": dict(work_orders=[{}, {"request_id": 9}]),
    "X11": dict(leases=[{}, {}]),
    "X12": dict(maintenance_requests=[{"closed_at": datetime(2024, 2, 1)}]),
}


def test_healthy_portfolio_has_no_violations(make):
    t = make(**HEALTHY)
    assert quality.violations(t, AS_OF).collect() == []
    assert constraints.schema_violations(t).collect() == []
    assert {x.status for x in quality.test_scorecard(t, AS_OF).collect()} == {"PASS"}
    quality.quality_gate(t, AS_OF)


@pytest.mark.parametrize("rule", BROKEN)
def test_each_rule_finds_its_violation(make, rule):
    found = quality.violations(make(**(HEALTHY | BROKEN[rule])), AS_OF).collect()
    assert [x.rule_id for x in found] == [rule]


def test_scorecard_counts(make):
    rows = {x.rule_id: (x.violations, x.status) for x in quality.scorecard(make(**BROKEN["X1"]), AS_OF).collect()}
    assert rows.pop("X1") == (1, "FAIL")
    assert set(rows.values()) == {(0, "PASS")} and len(rows) == 11


def test_schema_rules(make):
    t = make(
        properties=[{}, {"property_code": "P"}],
        units=[{"unit_status": "haunted", "bedrooms": 9, "square_feet": None}],
        leases=[{}, {}, {"security_deposit": money(-1), "lease_status": "draft"}],
        payments=[{"payment_status": "pending", "paid_date": AS_OF}, {"payment_method": "barter"}],
        maintenance_requests=[{"request_status": "closed"}, {"tenant_id": 5}],
        work_orders=[{"vendor_id": 8, "completed_at": datetime(2023, 1, 1)}],
    )
    assert sorted(x.rule_id for x in constraints.schema_violations(t).collect()) == [
        "leases.one_active_per_unit",
        "leases.security_deposit_not_negative",
        "maintenance_requests.closed_has_time",
        "maintenance_requests.tenant_id_reference",
        "payments.payment_method_domain",
        "payments.pending_is_untouched",
        "properties.property_code_unique",
        "units.bedrooms_range",
        "units.square_feet_required",
        "units.unit_status_domain",
        "work_orders.completed_after_assigned",
        "work_orders.vendor_id_reference",
    ]


def test_every_schema_rule_occurs_in_the_broken_portfolio(spark):
    found = constraints.schema_violations(star.broken_tables(spark, "/root/testdata/sf0.01"))
    counts = {x.rule_id: x["count"] for x in found.groupBy("rule_id").count().collect()}
    assert set(counts) == set(constraints.rule_names()) and len(counts) == 118


def test_schema_rules_shuffle_once_and_read_each_table_once(spark):
    tables = star.broken_tables(spark, "/root/testdata/sf0.001")
    plan = constraints.schema_violations(tables)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [domain") == 3 and "Window" not in plan


def test_a_key_of_a_third_of_the_rows_is_one_entry_per_task(make):
    t = make(leases=[{"unit_id": 7, "lease_status": "expired"} for _ in range(40)], payments=[{"lease_id": 99}] * 30)
    found = constraints.schema_violations(t).collect()
    assert sum(x.rule_id == "leases.unit_id_reference" and x.detail == "7" for x in found) == 40
    assert sum(x.rule_id == "payments.lease_id_reference" for x in found) == 30
    assert not [x for x in found if x.rule_id.endswith("unique")]


def test_gate_raises_on_orphan_payment(make):
    with pytest.raises(quality.QualityGateError, match="orphan_payments = 1"):
        quality.quality_gate(make(**(HEALTHY | BROKEN["X5"])), AS_OF)


def test_status_mismatch_fails_the_cache_test(make):
    rows = {x.test_name[:3]: x for x in quality.test_scorecard(make(), AS_OF + timedelta(1)).collect()}
    assert (rows["T08"].actual_result, rows["T08"].status) == ("1 mismatches", "FAIL")


def test_row_checks_are_not_shuffled_and_keys_keep_their_types(spark):
    tables = star.broken_tables(spark, "/root/testdata/sf0.001")
    plan = constraints.schema_violations(tables)._jdf.queryExecution().optimizedPlan().toString()
    grouped = [line for line in plan.splitlines() if "Aggregate [domain" in line]
    assert len([line for line in grouped if "k0#" in line]) == 3 and "getbit" not in plan
    assert plan.count("Join LeftAnti") == len(constraints.REFERENCES)

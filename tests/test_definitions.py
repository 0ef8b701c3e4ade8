from datetime import date, datetime, timedelta

import pytest
from conftest import AS_OF, money

from rentgrain.operators import definitions as d
from rentgrain.operators import reports as r


def by(df, key="property_id"):
    return {row[key]: row for row in df.collect()}


def test_unit_with_two_current_leases_counts_once(make):
    t = make(units=[{}, {}], leases=[{}, {"tenant_id": 1}])
    row = by(d.property_occupancy(t, AS_OF))[1]
    assert (row.total_units, row.occupied_units, row.vacant_units, row.occupancy_percentage) == (2, 1, 1, 50.0)


def test_property_without_units_and_inactive_property(make):
    t = make(properties=[{}, {}, {"is_active": False}], units=[{}, {"property_id": 3}])
    rows = by(d.property_occupancy(t, AS_OF))
    assert set(rows) == {1, 2}
    assert (rows[2].total_units, rows[2].occupied_units, rows[2].occupancy_percentage) == (0, 0, None)


@pytest.mark.parametrize("start,end,current", [(0, 10, True), (-10, 0, True), (1, 10, False), (-10, -1, False)])
def test_lease_is_in_force_on_both_end_days(make, start, end, current):
    lease = {"start_date": AS_OF + timedelta(start), "end_date": AS_OF + timedelta(end)}
    assert d.active_leases(make(leases=[lease]), AS_OF).count() == int(current)


def test_lease_of_unknown_tenant_is_not_in_force(make):
    t = make(leases=[{"tenant_id": 9}])
    assert d.active_leases(t, AS_OF).count() == 0
    assert by(d.property_occupancy(t, AS_OF))[1].occupied_units == 0


def test_collections_without_current_lease_only_show_in_month_report(make):
    t = make(
        leases=[{"lease_status": "expired", "end_date": date(2024, 5, 2)}],
        payments=[{"amount_paid": money(700), "payment_status": "partial"}],
    )
    current = by(d.rent_collection(t, AS_OF))[1]
    month = by(r.rent_collection_report(t, AS_OF))[1]
    assert (current.report_month, current.collected_rent, current.collection_percentage) == (None, 0, 0.0)
    assert (month.expected_rent, month.collected_rent, month.collection_percentage) == (1000, 700, 70.0)


def test_collection_month_is_half_open_and_may_exceed_hundred(make):
    days = [date(2024, 4, 30), date(2024, 5, 1), date(2024, 5, 31), date(2024, 6, 1)]
    t = make(payments=[{"due_date": day, "amount_paid": money(800), "payment_status": "partial"} for day in days])
    row = by(d.rent_collection(t, AS_OF))[1]
    assert (row.collected_rent, row.pending_rent, row.collection_percentage) == (1600, 0, 160.0)


def test_maintenance_summary_counts_and_mean_hours(make):
    opened = datetime(2024, 5, 1)
    t = make(
        properties=[{}, {}],
        maintenance_requests=[
            {"request_status": "closed", "created_at": opened, "closed_at": opened + timedelta(hours=5)},
            {"request_status": "closed", "created_at": opened, "closed_at": opened + timedelta(hours=6, minutes=30)},
            {"request_status": "cancelled", "priority": "high"},
            {"request_status": "on_hold", "priority": "emergency"},
        ],
    )
    rows = by(d.maintenance_summary(t))
    assert tuple(rows[1])[3:] == (4, 1, 2, 2, 5.8)
    assert tuple(rows[2])[3:] == (0, 0, 0, 0, None)


def test_outstanding_ignores_paid_and_waived(make):
    t = make(
        leases=[{}, {}],
        payments=[{}, {"payment_status": "waived"}, {"payment_status": "partial", "amount_paid": money(550)}],
    )
    rows = by(d.lease_outstanding(t), "lease_id")
    assert rows[1].outstanding == 1450 and rows[2].outstanding == 0


def test_property_functions_select_one_property(make):
    t = make(properties=[{}, {}], units=[{}, {"property_id": 2}])
    assert d.occupancy_by_property(t, AS_OF, 1).collect() == [(1, 100.0)]
    assert d.occupancy_by_property(t, AS_OF, 7).collect() == []
    row = d.property_summary(t, AS_OF, 2).first()
    assert (row.property_id, row.occupancy_percentage, row.open_maintenance_requests) == (2, 0.0, 0)


def test_snapshot_is_written_once_and_keyed(make, tmp_path):
    t = make(properties=[{}, {}])
    stored = d.write_performance_snapshot(t, AS_OF, str(tmp_path))
    assert stored.count() == 2
    with pytest.raises(Exception, match="already exists"):
        d.write_performance_snapshot(t, AS_OF, str(tmp_path))


def test_snapshot_rejects_repeated_property(make, tmp_path):
    t = make(properties=[{}, {"property_id": 1}])
    with pytest.raises(d.DuplicateKeyError):
        d.write_performance_snapshot(t, AS_OF, str(tmp_path))

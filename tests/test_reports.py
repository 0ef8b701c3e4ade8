from datetime import date, timedelta

import pytest
from conftest import AS_OF, money

from rentgrain.operators import dashboard, listings, rewrites
from rentgrain.operators import reports as r
from rentgrain.sources import canonical


def test_expiry_windows(make):
    left = [-1, 0, 30, 31, 60, 61, 90, 91]
    t = make(leases=[{"start_date": date(2023, 1, 1), "end_date": AS_OF + timedelta(n)} for n in left])
    found = {row.days_remaining: row.expiry_window for row in r.lease_expiry_report(t, AS_OF, 90).collect()}
    assert found == {
        0: "within 30 days", 30: "within 30 days", 31: "within 60 days", 60: "within 60 days",
        61: "within 90 days", 90: "within 90 days",
    }
    assert r.lease_expiry_report(t, AS_OF, 30).count() == 2


def test_expiry_uses_status_only_while_answers_need_a_current_lease(make):
    t = make(leases=[{"start_date": AS_OF + timedelta(5), "end_date": AS_OF + timedelta(20)}])
    assert r.lease_expiry_report(t, AS_OF).count() == 1
    assert dashboard.expiring_leases(t, AS_OF).count() == 0
    assert dashboard.upcoming_expirations(t, AS_OF).count() == 0


def test_expiry_days_are_checked(make):
    with pytest.raises(ValueError):
        r.lease_expiry_report(make(), AS_OF, 45)
    with pytest.raises(ValueError):
        dashboard.low_occupancy(make(), AS_OF, 0)


def test_delinquent_keeps_debt_or_two_late(make):
    paid = {"amount_paid": money(1000), "payment_status": "late"}
    t = make(
        tenants=[{}, {}, {}, {}],
        units=[{}, {}, {}, {}],
        leases=[{"tenant_id": n, "unit_id": n} for n in (1, 2, 3, 4)],
        payments=[
            paid | {"lease_id": 1}, paid | {"lease_id": 1},  # two late, nothing owed
            paid | {"lease_id": 2},  # one late
            {"lease_id": 3, "payment_status": "waived"},  # waived still counts
            {"lease_id": 4, "due_date": AS_OF + timedelta(1)},  # not due yet
        ],
    )
    rows = {x.tenant_id: (x.late_payment_count, x.unpaid_charge_count, x.outstanding_balance)
            for x in r.delinquent_tenant_report(t, AS_OF).collect()}
    assert rows == {1: (2, 0, 0), 3: (0, 1, 1000)}


def test_history_filters_tenant_and_keeps_ties_at_the_limit(make):
    t = make(
        tenants=[{}, {"first_name": "Bea"}],
        leases=[{}, {"tenant_id": 2}],
        payments=[{"lease_id": 1 + n % 2, "due_date": date(2024, 5, 1 + n // 4)} for n in range(12)],
    )
    assert {x.tenant_id for x in r.tenant_payment_history(t, tenant_id=2).collect()} == {2}
    everything = r.tenant_payment_history(t).collect()
    assert r.tenant_payment_history(t, limit=3).collect() == everything[:3]
    assert everything[0].due_date == date(2024, 5, 3)


def test_top_rows_skip_orphans(make):
    t = make(payments=[{"due_date": date(2024, 7, 1), "lease_id": 99}, {}, {"due_date": date(2024, 4, 1)}])
    page = listings.payments_list(t, page_size=1).collect()
    assert [row.payment_id for row in page] == [2]
    assert [row.payment_id for row in listings.payments_list(t, page=2, page_size=1).collect()] == [3]
    assert listings.payments_list(t, page=3, page_size=1).collect() == []


def test_pages_are_as_large_as_asked_for(make):
    t = make(tenants=[{"last_name": f"N{n:03d}"} for n in range(60)])
    assert [x.last_name for x in listings.tenants_list(t).collect()][:2] == ["N000", "N001"]
    assert listings.tenants_list(t, page=2).count() == 10
    assert listings.tenants_list(t, page=9).count() == 0
    assert listings.tenants_list(t, page_size=9999).count() == 60
    for wrong in ({"page": 0}, {"page_size": 0}):
        with pytest.raises(ValueError, match="start at 1"):
            listings.tenants_list(t, **wrong)


def test_no_limit_gives_every_row(make):
    t = make(payments=[{"due_date": date(2024, 1 + n % 5, 1)} for n in range(700)])
    assert r.tenant_payment_history(t, limit=None).count() == 700
    assert r.tenant_payment_history(t).count() == 500


def test_dashboard_bundle(make, tmp_path):
    t = make(properties=[{}, {"is_active": False}], units=[{}, {"property_id": 2}], payments=[{}, {"due_date": date(2024, 6, 1)}])
    bundle = dashboard.dashboard_bundle(t, AS_OF, str(tmp_path))
    assert set(bundle) == {"summary", "occupancy", "rent_collection", "recent_maintenance", "upcoming_expirations"}
    assert tuple(bundle["summary"].first()) == (1, 2, 100.0, 0.0, 1, 1)
    assert bundle["recent_maintenance"].count() == 1


def test_bundle_reads_the_leases_once(spark, make, tmp_path):
    folder = str(tmp_path / "tables")
    canonical.save_tables(make(), folder)
    t = canonical.load_tables(spark, folder)
    shared = rewrites.PlanFacts.of(dashboard.leases_of_month(t, AS_OF))
    assert shared.scans == 2  # the leases, and the month of the charges
    for name, part in dashboard.dashboard_bundle(t, AS_OF, str(tmp_path / "kept")).items():
        assert not [f for f in part.inputFiles() if "/tables/leases" in f], name


def test_pending_payments_sum_over_units_of_a_property(make):
    t = make(units=[{}, {}], leases=[{}, {"unit_id": 2}], payments=[{}, {"lease_id": 2}])
    assert [tuple(x) for x in dashboard.pending_payments(t, AS_OF).collect()] == [("Ana Walker", "Oak", 2000)]

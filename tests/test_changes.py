import json
import random
from datetime import date, datetime, timedelta

import pytest
from conftest import AS_OF, NOW, frame, money

from rentgrain.operators import changes, listings
from rentgrain.plans import catalog
from rentgrain.schema import AUDIT_LOGS

PROPOSAL = (
    "proposal_id long, unit_id long, tenant_id long, start_date date, end_date date, "
    "monthly_rent decimal(12,2), deposit decimal(12,2)"
)


def one_by_one(units, tenants, active, proposals):
    """Proposals applied in order, each seeing the leases admitted before it."""
    held, outcome = {u: list(active.get(u, [])) for u in set(active) | units}, {}
    for key, unit, tenant, start, end, rent, deposit in proposals:
        deposit = rent if deposit is None else deposit
        if None in (unit, tenant, start, end, rent):
            reason = "missing_field"
        elif end <= start:
            reason = "invalid_dates"
        elif tenant not in tenants:
            reason = "unknown_tenant"
        elif unit not in units:
            reason = "unknown_unit"
        elif any(s <= end and e >= start for s, e in held[unit]):
            reason = "overlaps_active_lease"
        elif rent <= 0:
            reason = "invalid_rent"
        elif deposit < 0:
            reason = "invalid_deposit"
        elif held[unit]:
            reason = "unit_already_leased"
        else:
            reason = None
            held[unit].append((start, end))
        outcome[key] = reason
    return outcome


def test_admission_equals_one_by_one(spark, make):
    rng = random.Random(11)
    day = lambda: date(2024, 1, 1) + timedelta(rng.randrange(700))
    active = {}
    for unit in range(1, 60):
        for _ in range(rng.choice([0, 0, 1, 2])):
            start = day()
            active.setdefault(unit, []).append((start, start + timedelta(rng.randrange(1, 200))))
    proposals = []
    for key in range(1, 1201):
        start = day()
        # A third of all proposals want the same unit.
        unit = 100 if rng.random() < 0.33 else rng.randrange(1, 110)
        proposals.append((
            key, None if rng.random() < 0.02 else unit, rng.randrange(1, 12), start,
            start + timedelta(rng.randrange(-5, 250)), money(rng.choice([0, 900, 1000, 1000])),
            rng.choice([None, money(-5), money(500), money(500)]),
        ))
    units = set(range(1, 106))
    t = make(
        units=[{"unit_id": u} for u in units],
        tenants=[{"tenant_id": n} for n in range(1, 11)],
        leases=[{"unit_id": u, "start_date": s, "end_date": e} for u, spans in active.items() for s, e in spans],
        payments=[{"payment_id": 40}],
    )
    done = changes.admit_leases(t, spark.createDataFrame(proposals, PROPOSAL).repartition(8), NOW)
    expected = one_by_one(units, set(range(1, 11)), active, proposals)
    admitted = [k for k, reason in expected.items() if reason is None]
    assert {x.proposal_id: x.reason for x in done.rejects.collect()} == {k: r for k, r in expected.items() if r}
    assert len(set(expected.values())) == 9
    first = sum(map(len, active.values())) + 1
    leases = sorted(done.leases.collect(), key=lambda x: x.lease_id)
    by_key = {p[0]: p for p in proposals}
    assert [(x.lease_id, x.unit_id, x.start_date) for x in leases] == [
        (first + i, by_key[k][1], by_key[k][3]) for i, k in enumerate(admitted)
    ]
    charges = {x.lease_id: x for x in done.charges.collect()}
    assert charges[first].payment_id == 41 and charges[first].amount_due == leases[0].monthly_rent
    assert charges[first].payment_reference == f"PAY-LEASE-{first}-{leases[0].start_date:%Y%m}"
    taken = {x.unit_id for x in leases}
    assert {x.unit_id for x in done.tables.units.collect() if x.unit_status == "occupied"} == taken
    assert done.tables.leases.count() == first - 1 + len(admitted)


def test_deposit_defaults_to_rent(spark, make):
    t = make(leases=[{"lease_status": "expired"}])
    rows = [(1, 1, 1, date(2024, 1, 1), date(2024, 2, 1), money(800), None)]
    assert changes.admit_leases(t, spark.createDataFrame(rows, PROPOSAL), NOW).leases.first().security_deposit == 800


def test_audit_rows_hold_both_images(spark, make):
    old = make(leases=[{}, {}, {}]).leases
    new = make(leases=[{}, {"lease_status": "expired"}, {"lease_id": 4}]).leases
    rows = {x.record_id: x for x in changes.audit_changes(old, new, NOW).collect()}
    assert {k: x.action for k, x in rows.items()} == {2: "UPDATE", 3: "DELETE", 4: "INSERT"}
    assert json.loads(rows[2].old_data)["lease_status"] == "active"
    assert json.loads(rows[2].new_data)["lease_status"] == "expired"
    assert rows[4].old_data is None and rows[3].new_data is None
    nulls = changes.audit_changes(
        frame(spark, "properties", [{}]), frame(spark, "properties", []), NOW, "properties", "property_id"
    )
    assert json.loads(nulls.first().old_data)["acquisition_date"] is None
    log = changes.append_audit(spark.createDataFrame([], AUDIT_LOGS), changes.audit_changes(old, new, NOW))
    assert [(x.audit_id, x.record_id) for x in listings.audit_list(log).collect()] == [(3, 4), (2, 3), (1, 2)]
    again = changes.append_audit(log, changes.audit_changes(old, new, NOW))
    assert again.count() == 6 and listings.audit_list(again, page_size=1).first().audit_id == 6


def test_status_events_equal_one_by_one(spark, make):
    rng = random.Random(3)
    base = datetime(2024, 3, 1)
    requests = [{"request_status": rng.choice(["open", "closed"]), "closed_at": None} for _ in range(40)]
    events = [
        (n, 1 if rng.random() < 0.33 else rng.randrange(1, 45),
         rng.choice(["vendor", " Tenant", "operations", "support_engineer", "guest", None]),
         rng.choice(["open", "Closed ", "cancelled", "in_progress", "assigned", "lost", None]),
         base + timedelta(minutes=rng.randrange(300)))
        for n in range(600)
    ]
    state = {n + 1: (r["request_status"], None, datetime(2024, 1, 1)) for n, r in enumerate(requests)}
    refused = {}
    for key, request, role, status, at in sorted(events, key=lambda e: (e[4], e[0])):
        role, status = (role or "").strip().lower(), (status or "").strip().lower()
        if role not in ("operations", "vendor", "tenant", "support_engineer"):
            refused[key] = "role_not_allowed"
        elif status not in ("open", "assigned", "in_progress", "on_hold", "closed", "cancelled"):
            refused[key] = "unknown_status"
        elif role == "vendor" and status not in ("in_progress", "closed", "assigned"):
            refused[key] = "not_for_vendor"
        elif role == "tenant" and status != "cancelled":
            refused[key] = "not_for_tenant"
        elif request not in state:
            refused[key] = "unknown_request"
        else:
            state[request] = (status, at if status == "closed" else state[request][1], at)
    schema = "event_id long, request_id long, role string, new_status string, event_ts timestamp"
    done = changes.apply_status_changes(
        make(maintenance_requests=requests).maintenance_requests, spark.createDataFrame(events, schema)
    )
    assert {x.event_id: x.reason for x in done.rejects.collect()} == refused
    found = {x.request_id: (x.request_status, x.closed_at, x.updated_at) for x in done.table.collect()}
    assert found == state
    assert len(set(refused.values())) == 5


def test_payments_are_paid_once_on_the_day_of_the_event(spark, make):
    t = make(payments=[{}, {"payment_status": "paid", "amount_paid": money(1000)}, {"payment_status": "waived"}, {}])
    at = datetime(2024, 5, 3, 10)
    events = [(1, 1, at + timedelta(1)), (2, 1, at), (3, 2, at), (4, 3, at), (5, 99, at)]
    done = changes.apply_payments(
        t.payments, spark.createDataFrame(events, "event_id long, payment_id long, event_ts timestamp")
    )
    rows = {x.payment_id: (x.payment_status, x.amount_paid, x.paid_date) for x in done.table.collect()}
    assert rows[1] == ("paid", 1000, date(2024, 5, 3)) and rows[3] == ("paid", 1000, date(2024, 5, 3))
    assert rows[2][2] is None and rows[4] == ("pending", 0, None)
    assert {x.event_id for x in done.rejects.collect()} == {1, 3, 5}


def test_new_requests(spark, make):
    at = datetime(2024, 5, 3)
    events = [
        (1, 1, " Broken  ", None, "URGENT", None, at + timedelta(1)),
        (2, 1, "Leak", " Sink ", " High", 1, at),
        (3, 1, None, "x", "low", 1, at),
        (4, 8, "t", "x", "low", 1, at),
        (5, 1, "t", "x", "low", 8, at),
        (6, 1, "t" * 161, "x", "low", 1, at),
    ]
    schema = (
        "event_id long, unit_id long, title string, description string, priority string, tenant_id long, "
        "event_ts timestamp"
    )
    done = changes.ingest_requests(make(), spark.createDataFrame(events, schema))
    rows = {x.request_id: x for x in done.table.collect()}
    assert set(rows) == {1, 2, 3}
    assert (rows[2].title, rows[2].description, rows[2].priority) == ("Leak", "Sink", "high")
    assert (rows[3].title, rows[3].description, rows[3].priority, rows[3].tenant_id) == ("Broken", "Broken", "medium", 1)
    assert {x.event_id: x.reason for x in done.rejects.collect()} == {
        3: "missing_field", 4: "unknown_unit", 5: "unknown_tenant", 6: "title_too_long"
    }


@pytest.mark.parametrize("repair", [False, True])
def test_unit_status(make, repair):
    t = make(units=[{}, {"unit_status": "occupied"}, {"unit_status": "offline"}])
    job = changes.repair_unit_status if repair else changes.refresh_unit_status
    rows = {x.unit_id: (x.unit_status, x.updated_at == NOW) for x in job(t, NOW).collect()}
    assert AS_OF == NOW.date()
    if repair:
        assert rows == {1: ("vacant", False), 2: ("vacant", True), 3: ("offline", False)}
    else:
        assert rows == {1: ("occupied", True), 2: ("vacant", True), 3: ("vacant", True)}


CHANGES = (
    "change_id long, action string, tenant_id long, first_name string, last_name string, email string, phone string, "
    "emergency_contact string"
)


def test_merged_changes_equal_one_by_one(spark, make):
    rng = random.Random(3)
    person = lambda: (rng.choice("abc"), rng.choice("xy"), "mail", "1", rng.choice([None, "c"]))
    start = {k: person() for k in range(1, 80)}
    names = ("first_name", "last_name", "email", "phone", "emergency_contact")
    table = make(tenants=[{"tenant_id": k, **dict(zip(names, v))} for k, v in start.items()]).tenants
    batch = []
    for number in range(300):
        key = None if number % 50 == 7 else 5 if rng.random() < 0.3 else rng.randrange(1, 120)  # one key has a third of all changes
        batch.append((number, rng.choice(["put", "put", "delete"]), key, *person()))
    done = changes.merge_changes(table, spark.createDataFrame(batch, CHANGES), "tenant_id", NOW)
    last = {b[2]: b for b in batch if b[2] is not None}
    after = {k: v for k, v in start.items() if last.get(k, ("", "put"))[1] == "put"}
    after |= {k: b[3:] for k, b in last.items() if b[1] == "put"}
    found = {r.tenant_id: r for r in done.table.collect()}
    assert {k: tuple(r[n] for n in names) for k, r in found.items()} == after
    for key, r in found.items():
        assert (r.updated_at == NOW) == (start.get(key) != after[key]), key
        assert (r.created_at == NOW) == (key not in start)
    refused = sorted((b[0], "missing_key" if b[2] is None else "unknown_key") for b in batch
                     if b[2] is None or (b is last[b[2]] and b[1] == "delete" and b[2] not in start))
    assert sorted((r.change_id, r.reason) for r in done.rejects.collect()) == refused


def test_only_ranges_with_a_change_are_compared(spark):
    old = spark.range(10_000).selectExpr("id AS lease_id", "IF(id % 7 = 0, NULL, id) AS a", "IF(id % 7 = 0, id, NULL) AS b")
    # Values that move between columns, a repeated row and a lost one are changes too.
    new = old.selectExpr("lease_id", "IF(lease_id = 14, b, a) AS a", "IF(lease_id = 14, NULL, b) AS b").filter("lease_id <> 5000")
    new = new.unionByName(new.filter("lease_id = 9000"))
    assert sorted(r["range"] for r in changes.changed_ranges(old, new, "lease_id").collect()) == [0, 5000 // 256, 9000 // 256]
    assert changes.changed_ranges(old, old.repartition(3), "lease_id").isEmpty()
    found = changes.audit_changes(old, old.filter("lease_id <> 5000"), NOW).collect()
    assert [(r.action, r.record_id, r.new_data) for r in found] == [("DELETE", 5000, None)]


def test_roles_are_refused(spark, make):
    t = make(payments=[{}, {}], maintenance_requests=[{}])
    events = spark.createDataFrame(
        [(1, 1, "vendor", NOW), (2, 1, " Tenant ", NOW), (3, 2, None, NOW), (4, 9, "operations", NOW)],
        "event_id long, payment_id long, role string, event_ts timestamp",
    )
    done = changes.apply_payments(t.payments, events)
    assert {r.payment_id: r.payment_status for r in done.table.collect()} == {1: "paid", 2: "pending"}
    assert {r.event_id: r.reason for r in done.rejects.collect()} == {
        1: "role_not_allowed", 3: "role_not_allowed", 4: "already_paid_or_unknown"
    }
    tickets = spark.createDataFrame(
        [(1, "vendor", 1, "a", None, None, None, NOW), (2, "tenant", 1, "b", None, None, None, NOW)],
        "event_id long, role string, unit_id long, title string, description string, priority string, tenant_id long, event_ts timestamp",
    )
    done = changes.ingest_requests(t, tickets)
    assert {r.event_id: r.reason for r in done.rejects.collect()} == {1: "role_not_allowed"}
    assert done.table.count() == 2


def test_every_reason_occurs_in_the_registered_jobs(spark):
    reasons = {
        "admit_leases_rejects": {"role_not_allowed", "missing_field", "invalid_dates", "unknown_tenant", "unknown_unit",
                                 "overlaps_active_lease", "invalid_rent", "invalid_deposit", "unit_already_leased"},
        "apply_status_changes_rejects": {"role_not_allowed", "unknown_status", "not_for_vendor", "not_for_tenant", "unknown_request"},
        "apply_payments_rejects": {"role_not_allowed", "already_paid_or_unknown"},
        "ingest_requests_rejects": {"role_not_allowed", "missing_field", "title_too_long", "unknown_unit", "unknown_tenant"},
        "merge_leases_rejects": {"unknown_key", "missing_key"},
    }
    for name, expected in reasons.items():
        found = catalog.queries()[name](spark, "/root/testdata/sf0.01").select("reason").distinct().collect()
        assert {r.reason for r in found} == expected, name

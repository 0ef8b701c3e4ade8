"""Sums that absorb batches against a recomputation of the snapshot."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from conftest import AS_OF, NOW, frame, money

from rentgrain.operators import absorbing as a
from rentgrain.operators import changes
from rentgrain.operators import definitions as d


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def some_rows(seed: int) -> dict[str, list[dict]]:
    """A small portfolio with overlapping leases, unknown units and tenants and repeated charges."""
    r = random.Random(seed)
    day = lambda low, high: AS_OF + timedelta(days=r.randint(low, high))
    return {
        "properties": [{"property_id": k, "is_active": k != 4} for k in range(1, 6)],
        "units": [{"unit_id": k, "property_id": k % 5 + 1} for k in range(1, 13)],
        "tenants": [{"tenant_id": k} for k in range(1, 9) if r.random() < 0.9],
        "leases": [
            {"lease_id": k, "unit_id": r.randint(1, 14), "tenant_id": r.randint(1, 9), "start_date": day(-300, 20), "end_date": day(-20, 300),
             "monthly_rent": money(r.randint(0, 3) * 500), "lease_status": r.choice(["active", "active", "expired"])}
            for k in range(1, 30) if r.random() < 0.8
        ],
        "payments": [
            {"payment_id": k, "lease_id": r.randint(1, 32), "due_date": day(-30, 30), "amount_paid": money(r.randint(0, 900))}
            for k in range(1, 80) if r.random() < 0.8
        ],
        "maintenance_requests": [
            {"request_id": k, "unit_id": r.randint(1, 14), "priority": r.choice(["low", "high", "emergency"]),
             "request_status": (s := r.choice(["open", "closed", "cancelled"])),
             "closed_at": datetime(2024, 1, 1 + r.randint(0, 9), 5) if s == "closed" and r.random() < 0.8 else None}
            for k in range(1, 40) if r.random() < 0.8
        ],
    }


@pytest.mark.parametrize("seed", [1, 2])
def test_absorbed_sums_equal_a_recomputation(make, seed):
    before, after = make(**some_rows(seed)), make(**some_rows(seed + 100))
    sums = a.unit_sums(before, AS_OF)
    assert rows(a.performance_of(before, sums)) == rows(d.property_performance(before, AS_OF))
    absorbed = a.absorb(sums, before, after, a.changed_images(before, after, *a.SUMMED), AS_OF)
    assert rows(a.performance_of(after, absorbed)) == rows(d.property_performance(after, AS_OF))
    assert a.performance_of(after, absorbed).schema.simpleString() == d.property_performance(after, AS_OF).schema.simpleString()


@pytest.mark.parametrize("name", a.SUMMED)
def test_each_table_alone(make, name):
    first, second = some_rows(5), some_rows(6)
    before, after = make(**first), make(**(first | {name: second[name]}))
    absorbed = a.absorb(a.unit_sums(before, AS_OF), before, after, a.changed_images(before, after, name), AS_OF)
    assert rows(a.performance_of(after, absorbed)) == rows(d.property_performance(after, AS_OF))


def test_batches_are_absorbed_once_and_in_turn(spark, make, tmp_path):
    t, folder = make(**some_rows(8)), str(tmp_path)
    with pytest.raises(Exception, match="applied"):
        a.absorb_batch(t, t, {}, AS_OF, folder, "b1")
    a.start_sums(t, AS_OF, folder)
    events = spark.createDataFrame(
        [(k, k, "tenant", datetime(2024, 5, 10, 8)) for k in range(1, 60)], "event_id long, payment_id long, role string, event_ts timestamp"
    )
    paid = t.with_(payments=changes.apply_payments(t.payments, events).table)
    a.absorb_batch(t, paid, a.changed_images(t, paid, "payments"), AS_OF, folder, "b1")
    with pytest.raises(a.AlreadyAppliedError):
        a.absorb_batch(t, paid, a.changed_images(t, paid, "payments"), AS_OF, folder, "b1")
    opened = paid.with_(maintenance_requests=paid.maintenance_requests.unionByName(
        frame(spark, "maintenance_requests", [{"request_id": 900, "unit_id": 3, "priority": "high"}])
    ))
    new = opened.maintenance_requests.filter("request_id = 900")
    last = a.absorb_batch(paid, opened, {"maintenance_requests": a.inserted(new)}, AS_OF, folder, "b2")
    assert rows(a.performance_of(opened, last)) == rows(d.property_performance(opened, AS_OF))
    with pytest.raises(LookupError):
        a.absorb_batch(t, t, {}, date(2020, 1, 1), folder, "b1")


def test_repeated_units_are_not_listed(make, spark, tmp_path):
    t = make(**some_rows(9))
    sums = a.unit_sums(t, AS_OF)
    with pytest.raises(d.DuplicateKeyError):
        a._store(sums.unionByName(sums), t, str(tmp_path), AS_OF, "start", 0)
    a.start_sums(t, AS_OF, str(tmp_path))
    assert rows(a.performance_of(t, spark.read.parquet(f"{tmp_path}/sums/as_of={AS_OF}/number=0"))) == rows(d.property_performance(t, AS_OF))


def test_admission_adds_its_leases_and_charges(spark, make):
    t = make(**(some_rows(11) | {"leases": []}))
    proposals = spark.createDataFrame(
        [(k, k, k, date(2024, 5, 1), date(2025, 4, 30), money(700), money(700)) for k in range(1, 6)],
        "proposal_id long, unit_id long, tenant_id long, start_date date, end_date date, monthly_rent decimal(12,2), deposit decimal(12,2)",
    )
    done = changes.admit_leases(t, proposals, NOW)
    images = {"leases": a.inserted(done.leases), "payments": a.inserted(done.charges)}
    absorbed = a.absorb(a.unit_sums(t, AS_OF), t, done.tables, images, AS_OF)
    assert rows(a.performance_of(done.tables, absorbed)) == rows(d.property_performance(done.tables, AS_OF))


def test_images_hold_what_the_sums_of_the_day_count(make):
    before, after = make(**some_rows(12)), make(**some_rows(13))
    images = a.changed_images(before, after, *a.SUMMED, as_of=AS_OF)
    assert {name: tuple(i.old.columns) for name, i in images.items()} == a.READ
    assert {r.due_date.month for i in (images["payments"].old, images["payments"].new) for r in i.collect()} == {AS_OF.month}
    absorbed = a.absorb(a.unit_sums(before, AS_OF), before, after, images, AS_OF)
    assert rows(a.performance_of(after, absorbed)) == rows(d.property_performance(after, AS_OF))

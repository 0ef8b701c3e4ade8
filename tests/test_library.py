import random
from collections import Counter
from datetime import date, timedelta
from itertools import groupby

from conftest import AS_OF, money

from rentgrain.functions.prefix import row_positions, running_sum
from rentgrain.operators import cases, library, rewrites
from rentgrain.operators.duplicates import duplicate_payments


def test_unit_list_repeats_a_unit_with_two_leases(make):
    t = make(units=[{}, {}], leases=[{}, {}])
    rows = [tuple(x) for x in library.unit_current_tenant(t, AS_OF).collect()]
    assert rows == [("Oak", "1A", "Ana Walker"), ("Oak", "1A", "Ana Walker"), ("Oak", "2A", "Vacant")]


def test_running_sum_matches_brute_force_on_a_hot_day(spark):
    rng = random.Random(4)
    # A third of all rows on one day, ids far apart, and ties on the whole sort key.
    rows = [(1 if rng.random() < 0.5 else 2, 7 if rng.random() < 0.34 else rng.randrange(31), rng.randrange(10**12),
             rng.randrange(100)) for _ in range(3000)]
    rows += rows[:50]
    df = spark.createDataFrame(rows, "g int, d int, id long, v long").repartition(8)
    expected = {}
    for g, members in groupby(sorted(rows), key=lambda x: x[0]):
        total = 0
        for key, tied in groupby(members, key=lambda x: x[:3]):
            total += sum(x[3] for x in tied)
            expected[key] = total
    found = running_sum(df, "v", ["g"], ["d", "id"], "s").collect()
    assert len(found) == len(rows)
    assert all(expected[(x.g, x.d, x.id)] == x.s for x in found)


def test_row_positions_are_dense_and_ordered(spark):
    df = spark.range(0, 5000, 7).selectExpr("id * id % 100003 AS k").distinct()
    found = row_positions(df, ["k"], "n").orderBy("k").collect()
    assert [x.n for x in found] == list(range(1, len(found) + 1))


def test_dense_rank_shares_ties(make):
    rents = [1000, 1000, 500, 250]
    t = make(
        properties=[{"property_name": f"P{n}"} for n in range(4)],
        units=[{"property_id": n + 1} for n in range(4)],
        leases=[{"unit_id": n + 1} for n in range(4)],
        payments=[{"lease_id": n + 1, "amount_paid": money(paid), "payment_status": "paid"} for n, paid in enumerate(rents)],
    )
    ranks = {x.property_name: x.collection_rank for x in library.collection_rank(t, AS_OF).collect()}
    assert ranks == {"P0": 1, "P1": 1, "P2": 2, "P3": 3}


def test_latest_payment_over_several_leases(make):
    day = date(2024, 5, 1)
    t = make(
        tenants=[{}, {}],
        leases=[{}, {}, {"tenant_id": 2}],
        payments=[{"due_date": day}, {"due_date": day, "lease_id": 2}, {"due_date": day - timedelta(1), "lease_id": 2},
                  {"lease_id": 3, "due_date": day - timedelta(400)}],
    )
    assert {x.tenant_id: x.payment_id for x in library.latest_payment_per_tenant(t).collect()} == {1: 2, 2: 4}


def test_overdue_category_and_method(make):
    t = make(payments=[{}, {"due_date": AS_OF}, {"payment_status": "partial", "payment_method": "ach"}])
    rows = {x.payment_reference: (x.collection_category, x.payment_method)
            for x in library.payment_collection_category(t, AS_OF).collect()}
    assert rows == {"R1": ("overdue", "not provided"), "R2": ("pending", "not provided"), "R3": ("partially paid", "ach")}


def test_rent_gap_may_be_negative(make):
    t = make(payments=[{"amount_paid": money(1500), "amount_due": money(1500), "payment_status": "paid"}])
    assert library.rent_gap_by_property(t, AS_OF).first().pending_rent == -500


def test_duplicates_have_one_row_for_each_reference(make):
    t = make(payments=[{"payment_reference": f"X{n:04d}"} for n in range(500)] + [{"lease_id": 2}, {"lease_id": 3}, {"lease_id": 3}])
    rows = duplicate_payments(t).collect()
    assert {(x.lease_id, x.duplicate_count) for x in rows} == {(1, 500), (3, 2)}
    assert sorted(x.payment_reference for x in rows if x.lease_id == 1) == [f"X{n:04d}" for n in range(500)]
    assert sum(x.lease_id == 3 for x in rows) == 2


def test_fanout_figures_equal_the_joined_rows(make):
    t = make(
        units=[{}, {}, {}],
        leases=[{}, {"monthly_rent": money(500)}, {"unit_id": 2}, {"unit_id": 3, "lease_status": "expired"}],
        payments=[{"lease_id": n, "amount_paid": money(10 * n), "payment_status": "partial"} for n in (1, 1, 1, 2, 3)],
        maintenance_requests=[{}, {}, {"unit_id": 3}],
    )
    joined = (
        t.units.join(t.leases.drop("created_at", "updated_at"), "unit_id")
        .join(t.payments.select("lease_id", "amount_paid"), "lease_id", "left")
        .join(t.maintenance_requests.select("unit_id", "request_id"), "unit_id", "left")
        .selectExpr("sum(monthly_rent) AS rent", "sum(amount_paid) AS paid")
        .first()
    )
    row = cases.multi_fact_fanout(t, AS_OF).first()
    assert (row.faulty_expected_rent, row.faulty_collected) == (joined.rent, joined.paid)
    fanout = cases.rent_fanout(t, AS_OF).first()
    assert fanout.inflated_expected_rent == 3 * 1000 + 500 + 1000 and fanout.expected_once == 2500
    assert cases.occupancy_inflation(t, AS_OF).first().occupied_count == 3
    assert [tuple(x) for x in cases.overlapping_units(t, AS_OF).collect()] == [(1, 2)]


def test_orphans_are_listed_and_counted(make):
    t = make(payments=[{}, {"lease_id": 7}, {"lease_id": 7}])
    assert {x.payment_id for x in cases.orphan_payments(t).collect()} == {2, 3}
    assert cases.orphan_payment_count(t).first()[0] == 2
    assert cases.orphan_payment_count(make()).first()[0] == 0


def test_rewrites_are_compared_row_by_row(make):
    t = make(
        tenants=[{}, {"last_name": "Walkerson"}, {"first_name": "Walker", "last_name": "Lee"}],
        leases=[{}, {"lease_status": "expired", "end_date": date(2024, 6, 1)}, {}],
    )
    tenants = rewrites.compare(rewrites.tenant_before(t, "Walker"), rewrites.tenant_after(t, "Walker"))
    assert not tenants.is_equivalent() and tenants.only_before.count() == 2 and tenants.only_after.count() == 0
    paid = {(x.side, x.lease_id): x.paid_total
            for x in rewrites.difference(rewrites.payment_before(t), rewrites.payment_after(t)).collect()}
    assert paid == {("before", 3): None, ("after", 3): 0}
    expiry = rewrites.compare(rewrites.expiry_before(t, AS_OF), rewrites.expiry_after(t, AS_OF))
    assert [x.lease_id for x in expiry.only_before.collect()] == [2]
    same = rewrites.compare(t.leases, t.leases)
    assert same.is_equivalent() and "Scan" in same.before_plan


def test_difference_counts_each_row_once_for_both_directions(spark):
    before = spark.createDataFrame([(1, "a")] * 5000 + [(1, None)] * 3 + [(2, "b")], "k int, v string")
    after = spark.createDataFrame([("a", 1), (None, 1), (None, 1), ("b", 2), ("b", 2), (None, None)], "v string, k int")
    found = rewrites.difference(before, after)
    rows = Counter((x.k, x.v, x.side) for x in found.collect())
    assert rows == {(1, "a", "before"): 4999, (1, None, "before"): 1, (2, "b", "after"): 1, (None, None, "after"): 1}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Union") == 1

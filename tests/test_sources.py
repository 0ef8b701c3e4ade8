import json

import pytest
from conftest import AS_OF

from rentgrain.operators import library, reports, rewrites
from rentgrain.plans.views import register
from rentgrain.sources import canonical


@pytest.fixture
def some(make):
    return make(
        properties=[{}, {"property_code": "Q"}], units=[{}, {"property_id": 2}], leases=[{}, {"unit_id": 2}],
        payments=[{}, {"payment_reference": "S", "lease_id": 2}], maintenance_requests=[{}], vendors=[{}], work_orders=[{}],
    )


def test_tables_round_trip_and_filters_reach_the_scan(spark, some, tmp_path):
    folder = str(tmp_path / "v1")
    canonical.save_tables(some, folder)
    stored = canonical.load_tables(spark, folder)
    assert {n: f.count() for n, f in stored.items()} == {n: f.count() for n, f in some.items()}
    with pytest.raises(Exception, match="already exists"):
        canonical.save_tables(some, folder)

    scans = rewrites.plan_text
    after = scans(rewrites.expiry_after(stored, AS_OF))
    assert "PushedFilters: [IsNotNull(lease_status), IsNotNull(end_date), EqualTo(lease_status,active)" in after
    assert "GreaterThanOrEqual(end_date,2024-05-15)" in after
    assert "GreaterThanOrEqual(end_date" not in scans(rewrites.expiry_before(stored, AS_OF))
    collected = scans(reports.rent_collection_report(stored, AS_OF))
    assert "GreaterThanOrEqual(due_date,2024-05-01), LessThan(due_date,2024-06-01)" in collected
    assert "ReadSchema: struct<lease_id:bigint,due_date:date,amount_paid:decimal(12,2)>" in collected


def test_records_keep_missing_fields(spark, make, tmp_path):
    path = str(tmp_path / "out")
    canonical.write_records(library.active_cities(make()).selectExpr("city", "cast(null AS string) AS note"), path)
    lines = [json.loads(x.value) for x in spark.read.text(path).collect()]
    assert lines == [{"city": "Austin", "note": None}]


def test_views_and_functions_in_sql(spark, make):
    names = register(spark, make(units=[{}, {}]), AS_OF)
    assert spark.sql("SELECT occupancy_percentage FROM property_occupancy_view").first()[0] == 50.0
    assert spark.sql("SELECT calculate_property_occupancy(1), calculate_property_occupancy(9)").first() == (50.0, None)
    assert spark.sql("SELECT calculate_lease_outstanding(1), calculate_lease_outstanding(9)").first() == (1000, 0)
    assert spark.sql("SELECT * FROM property_summary(1)").first() == ("Oak", 50.0, 0.0, 1)
    for name in names:
        spark.catalog.dropTempView(name)

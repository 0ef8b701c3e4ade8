"""Behaviour when one key holds a third of all rows."""

from contextlib import contextmanager

import pytest
from conftest import frame
from pyspark.sql import functions as F

from rentgrain.operators import changes, library, reports
from rentgrain.operators import definitions as d
from rentgrain.operators.duplicates import duplicate_payments

CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.shuffle.partitions": "16",
}


@contextmanager
def small_thresholds(spark):
    before = {key: spark.conf.get(key, None) for key in CONF}
    for key, value in CONF.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture(scope="module")
def hot(spark, make):
    """60,000 work orders and charges, a third of them on request and lease 1."""
    work = spark.range(1, 60_001, numPartitions=8).selectExpr(
        "id AS work_order_id", "IF(id % 3 = 0, 1, id % 3000 + 1) AS request_id", "CAST(NULL AS BIGINT) AS vendor_id",
        "TIMESTAMP '2024-01-01' AS assigned_at", "CAST(NULL AS DATE) AS scheduled_date",
        "CAST(NULL AS TIMESTAMP) AS completed_at", "CAST(1 AS DECIMAL(12,2)) AS labor_cost",
        "CAST(1 AS DECIMAL(12,2)) AS material_cost", "'assigned' AS work_order_status",
        "md5(string(id)) AS notes", "TIMESTAMP '2024-01-01' AS created_at", "TIMESTAMP '2024-01-01' AS updated_at",
    )
    charges = spark.range(1, 60_001, numPartitions=8).selectExpr(
        "id AS payment_id", "IF(id % 3 = 0, 1, id % 3000 + 1) AS lease_id", "md5(string(id)) AS payment_reference",
        "DATE '2024-05-01' AS due_date", "CAST(NULL AS DATE) AS paid_date", "CAST(10 AS DECIMAL(12,2)) AS amount_due",
        "CAST(4 AS DECIMAL(12,2)) AS amount_paid", "'partial' AS payment_status",
        "CAST(NULL AS STRING) AS payment_method", "TIMESTAMP '2024-01-01' AS created_at",
        "TIMESTAMP '2024-01-01' AS updated_at",
    )
    requests = frame(spark, "maintenance_requests", [{}] * 3100)
    leases = frame(spark, "leases", [{}] * 3100)
    return make().with_(work_orders=work, payments=charges, maintenance_requests=requests, leases=leases)


def final_plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_hot_request_is_split_and_all_rows_stay(spark, hot):
    with small_thresholds(spark):
        df = library.request_workorder_cost(hot)
        rows = df.collect()
        assert "SortMergeJoin(skew=true)" in final_plan(df)
    # every order, and the requests without one
    assert len(rows) == 60_000 + sum(row.work_order_status is None for row in rows)
    assert sum(row.request_id == 1 for row in rows) >= 20_000


def test_hot_lease_is_folded_before_the_join(spark, hot):
    with small_thresholds(spark):
        df = d.payments_per_unit(hot, ("paid", hot.payments.amount_paid))
        assert [row.paid for row in df.collect()] == [240_000]
        # Summed by lease in the scan stage already, and by unit before the second shuffle.
        assert final_plan(df).count("partial_sum") == 2


def test_hot_lease_is_split_in_the_ledger(spark, hot):
    with small_thresholds(spark):
        df = reports.tenant_payment_history(hot, limit=70_000)
        assert df.count() == 60_000
        df.collect()
        assert "SortMergeJoin(skew=true)" in final_plan(df)


def test_copies_of_one_charge_are_shared_out(spark, hot):
    charges = hot.payments.withColumns({"lease_id": F.expr("IF(lease_id = 1, 1, payment_id)")})
    with small_thresholds(spark):
        df = duplicate_payments(hot.with_(payments=charges))
        rows = df.collect()
    assert {row.lease_id for row in rows} == {1}
    assert len({row.payment_reference for row in rows}) == len(rows) == rows[0].duplicate_count > 20_000


def test_unit_wanted_by_a_third_of_proposals(spark, hot):
    proposals = spark.range(1, 30_001, numPartitions=8).selectExpr(
        "id AS proposal_id", "IF(id % 3 = 0, 1, id % 500) AS unit_id", "1L AS tenant_id",
        "date_add(DATE '2025-01-01', int(id % 900)) AS start_date",
        "date_add(DATE '2025-02-01', int(id % 900)) AS end_date",
        "CAST(900 AS DECIMAL(12,2)) AS monthly_rent", "CAST(NULL AS DECIMAL(12,2)) AS deposit",
    )
    with small_thresholds(spark):
        rows = changes.decide_proposals(hot, proposals).groupBy("unit_id", "reason").count().collect()
    found = {(row.unit_id, row.reason): row["count"] for row in rows}
    wanted = sum(1 for n in range(1, 30_001) if n % 3 == 0 or n % 500 == 1)
    assert found[(1, "unit_already_leased")] == wanted
    assert sum(found.values()) == 30_000

"""The query library: basic filters, joins, aggregates, subqueries, CTEs and windows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import (
    as_total,
    balance,
    day,
    full_name,
    in_month,
    is_current,
    job_cost,
    mean_hours,
    micros_between,
    or_zero,
    unpaid,
)
from ..functions.joins import left_join_many
from ..functions.paging import at_least_kth, limited
from ..functions.prefix import dense_ranks, running_sum
from ..schema import Tables
from . import definitions as d
from . import reports as r


def vacant_units_by_rent(t: Tables) -> DataFrame:
    """Units whose stored status is vacant, dearest first."""
    return (
        t.units.filter("unit_status = 'vacant'")
        .join(t.properties.select("property_id", "property_name"), "property_id")
        .select("unit_id", "property_name", "unit_number", "bedrooms", "market_rent")
        .orderBy(F.desc("market_rent"), "property_name", "unit_number", "unit_id")
    )


def active_cities(t: Tables) -> DataFrame:
    """Cities with an active property."""
    return (
        t.properties.filter("is_active")
        .select("city", "state_code")
        .distinct()
        .orderBy("state_code", "city")
    )


def payment_collection_category(t: Tables, as_of: date, limit: int | None = 100) -> DataFrame:
    """The latest charges with a business-friendly category."""
    status = F.col("payment_status")
    return (
        t.payments.filter(at_least_kth(t.payments, "due_date", limit))
        .orderBy(F.desc("due_date"), "payment_id")
        .transform(limited, limit)
        .select(
            "payment_reference",
            "due_date",
            "amount_due",
            "amount_paid",
            F.when((status == "pending") & (F.col("due_date") < day(as_of)), "overdue")
            .when(status == "partial", "partially paid")
            .otherwise(status)
            .alias("collection_category"),
            F.coalesce("payment_method", F.lit("not provided")).alias("payment_method"),
        )
    )


def active_lease_roster(t: Tables) -> DataFrame:
    """Leases with status active and everyone involved."""
    leases = t.leases.filter("lease_status = 'active'").select(
        "lease_id", "tenant_id", "unit_id", "start_date", "end_date", "monthly_rent"
    )
    tenants = t.tenants.select("tenant_id", full_name().alias("tenant_name"))
    return (
        r.lease_context(t, leases, tenants)
        .select(
            "lease_id", "tenant_name", "property_name", "unit_number", "start_date", "end_date", "monthly_rent"
        )
        .orderBy("property_name", "unit_number", "lease_id")
    )


def unit_current_tenant(t: Tables, as_of: date) -> DataFrame:
    """Every unit with its current tenant or "Vacant".

    A unit with overlapping leases appears once per lease.
    """
    current = (
        t.leases.filter(is_current(as_of))
        .select("lease_id", "unit_id", "tenant_id")
        .join(t.tenants.select("tenant_id", full_name().alias("tenant_name")), "tenant_id")
    )
    units = t.units.select("unit_id", "property_id", "unit_number").join(
        t.properties.select("property_id", "property_name"), "property_id"
    )
    return (
        left_join_many(units, current, "unit_id")
        .orderBy("property_name", "unit_number", F.asc_nulls_first("lease_id"))
        .select("property_name", "unit_number", F.coalesce("tenant_name", F.lit("Vacant")).alias("current_tenant"))
    )


def request_workorder_cost(t: Tables) -> DataFrame:
    """Requests with their work orders, vendors and cost."""
    orders = t.work_orders.select(
        "work_order_id", "request_id", "vendor_id", "work_order_status", job_cost().alias("total_cost")
    ).join(t.vendors.select("vendor_id", "vendor_name"), "vendor_id", "left")
    requests = (
        t.maintenance_requests.select("request_id", "unit_id", "title", "created_at")
        .join(t.units.select("unit_id", "property_id", "unit_number"), "unit_id")
        .join(t.properties.select("property_id", "property_name"), "property_id")
    )
    return (
        left_join_many(requests, orders, "request_id")
        .orderBy(F.desc("created_at"), "request_id", F.asc_nulls_last("work_order_id"))
        .select(
            "request_id",
            "property_name",
            "unit_number",
            "title",
            "work_order_status",
            "vendor_name",
            "total_cost",
        )
    )


def property_payment_kpis(t: Tables) -> DataFrame:
    """Charge totals per property that is still owed money."""
    sums = [
        ("payment_count", F.lit(1)),
        ("total_due", F.col("amount_due")),
        ("total_paid", F.col("amount_paid")),
        ("outstanding", balance()),
        ("late_payment_count", F.when(F.col("payment_status") == "late", 1).otherwise(0)),
    ]
    names = [name for name, _ in sums]
    return (
        d.per_property(t, d.payments_per_unit(t, *sums), *names)
        .join(t.properties.select("property_id", "property_name"), "property_id")
        .filter("outstanding > 0")
        .orderBy(F.desc("outstanding"), "property_id")
        .select(
            "property_name",
            "payment_count",
            *[as_total(F.col(c)).alias(c) for c in ("total_due", "total_paid", "outstanding")],
            "late_payment_count",
        )
    )


def vendor_specialty_cost(t: Tables, at_least: int = 5) -> DataFrame:
    """Average job cost of the specialties with enough completed work."""
    per_vendor = (
        t.work_orders.filter("work_order_status = 'completed'")
        .groupBy("vendor_id")
        .agg(F.count("*").alias("jobs"), F.sum(job_cost()).alias("cost"))
    )
    return (
        per_vendor.join(t.vendors.select("vendor_id", "specialty"), "vendor_id")
        .groupBy("specialty")
        .agg(F.sum("jobs").alias("completed_jobs"), F.sum("cost").alias("cost"))
        .filter(F.col("completed_jobs") >= at_least)
        .select(
            "specialty",
            "completed_jobs",
            F.round(F.col("cost").cast("double") / F.col("completed_jobs"), 2).alias("average_job_cost"),
        )
        .orderBy(F.desc("average_job_cost"), "specialty")
    )


def above_average_rent(t: Tables) -> DataFrame:
    """Active leases above the mean rent of active leases."""
    active = t.leases.filter("lease_status = 'active'").select("lease_id", "monthly_rent")
    mean = F.sum("monthly_rent").cast("double") / F.count("*")
    return active.filter(F.col("monthly_rent").cast("double") > active.agg(mean).scalar()).orderBy(
        F.desc("monthly_rent"), "lease_id"
    )


def tenants_with_overdue_debt(t: Tables, as_of: date) -> DataFrame:
    """Tenants with an unpaid charge that fell due before the day."""
    in_debt = t.payments.filter(unpaid() & (F.col("due_date") < day(as_of))).select("lease_id").distinct()
    debtors = t.leases.select("lease_id", "tenant_id").join(in_debt, "lease_id", "left_semi")
    return (
        t.tenants.select("tenant_id", "first_name", "last_name", "email")
        .join(debtors.select("tenant_id").distinct(), "tenant_id", "left_semi")
        .orderBy("last_name", "first_name", "tenant_id")
    )


def units_without_current_lease(t: Tables, as_of: date) -> DataFrame:
    """Units nobody has a lease on today."""
    return (
        t.units.select("unit_id", "property_id", "unit_number")
        .join(d.leased_units(t, as_of), "unit_id", "left_anti")
        .join(t.properties.select("property_id", "property_name"), "property_id")
        .select("unit_id", "unit_number", "property_name")
        .orderBy("property_name", "unit_number", "unit_id")
    )


def rent_gap_by_property(t: Tables, as_of: date) -> DataFrame:
    """Expected against collected rent; the gap may be negative."""
    collected = or_zero(F.col("collected_rent"))
    return (
        t.properties.select("property_id", "property_name")
        .join(d.expected_rent(t, as_of), "property_id")
        .join(d.collected_rent(t, as_of), "property_id", "left")
        .select(
            "property_id",
            "property_name",
            as_total(F.col("expected_rent")).alias("expected_rent"),
            collected.alias("collected_rent"),
            as_total(F.col("expected_rent") - collected).alias("pending_rent"),
        )
        .orderBy(F.desc("pending_rent"), "property_id")
        .drop("property_id")
    )


def resolution_time_by_property(t: Tables) -> DataFrame:
    """Closed requests and mean hours to close, for every property."""
    per_unit = (
        t.maintenance_requests.filter("request_status = 'closed'")
        .withColumn("micros", micros_between("created_at", "closed_at"))
        .groupBy("unit_id")
        .agg(
            F.count("*").alias("closed_requests"),
            F.sum("micros").alias("micros"),
            F.count("micros").alias("timed"),
        )
    )
    return (
        t.properties.select("property_id", "property_name")
        .join(d.per_property(t, per_unit, "closed_requests", "micros", "timed"), "property_id", "left")
        .select(
            "property_id",
            "property_name",
            F.coalesce("closed_requests", F.lit(0)).alias("closed_requests"),
            mean_hours(F.col("micros"), F.col("timed")).alias("average_resolution_hours"),
        )
        .orderBy(F.desc_nulls_last("average_resolution_hours"), "property_id")
        .drop("property_id")
    )


def latest_payment_per_tenant(t: Tables) -> DataFrame:
    """Each tenant's most recent charge.

    The latest charge per lease is found first, then the latest lease per tenant. Spark
    keeps only the best row per group before each shuffle, so a tenant or lease with very
    many charges sends one row per input partition.
    """
    newest = [F.desc("due_date"), F.desc("payment_id")]
    per_lease = (
        t.payments.select("payment_id", "lease_id", "due_date", "paid_date", "amount_paid", "payment_status")
        .withColumn("rank_in_lease", F.row_number().over(W.partitionBy("lease_id").orderBy(*newest)))
        .filter("rank_in_lease = 1")
        .drop("rank_in_lease")
    )
    return (
        t.leases.select("lease_id", "tenant_id")
        .join(per_lease, "lease_id")
        .withColumn("recency_rank", F.row_number().over(W.partitionBy("tenant_id").orderBy(*newest)))
        .filter("recency_rank = 1")
        .join(t.tenants.select("tenant_id", full_name().alias("tenant_name")), "tenant_id")
        .select(
            "tenant_id",
            "tenant_name",
            "payment_id",
            "due_date",
            "paid_date",
            "amount_paid",
            "payment_status",
            "recency_rank",
        )
        .orderBy("tenant_name", "tenant_id")
    )


def monthly_running_collection(t: Tables, month: date) -> DataFrame:
    """Running total of money received over the month's charges."""
    rows = t.payments.filter(in_month("due_date", month)).select(
        F.trunc("due_date", "month").alias("month"), "due_date", "payment_id", "payment_reference", "amount_paid"
    )
    return (
        running_sum(rows, "amount_paid", ["month"], ["due_date", "payment_id"], "monthly_running_total")
        .orderBy("due_date", "payment_id")
        .select(
            "due_date",
            "payment_reference",
            "amount_paid",
            as_total(F.col("monthly_running_total")).alias("monthly_running_total"),
        )
    )


def collection_rank(t: Tables, as_of: date) -> DataFrame:
    """Dense rank of the properties by collection rate, ties sharing a rank."""
    rates = d.rent_collection(t, as_of).select("property_name", "collection_percentage")
    return dense_ranks(rates, "collection_percentage", "collection_rank", descending=True)


def status_cache_mismatch(t: Tables, as_of: date) -> DataFrame:
    """Units whose stored status disagrees with their leases."""
    return (
        d.units_with_lease_flag(t, as_of)
        .filter((F.col("unit_status") == "occupied") != F.col("has_lease"))
        .join(t.properties.select("property_id", "property_name"), "property_id")
        .select("property_name", "unit_id", "unit_number", "unit_status", F.col("has_lease").alias("has_active_lease"))
    )


def workorder_status_conflicts(t: Tables) -> DataFrame:
    """Work orders that are completed while their request is not closed, or the reverse."""
    closed, completed = F.col("request_status") == "closed", F.col("work_order_status") == "completed"
    return (
        t.maintenance_requests.select("request_id", "request_status", "closed_at")
        .join(t.work_orders.select("work_order_id", "request_id", "work_order_status", "completed_at"), "request_id")
        .filter(closed != completed)
    )


def completed_cost_by_property(t: Tables) -> DataFrame:
    """Completed work orders folded to property: jobs and exact cost."""
    per_request = (
        t.work_orders.filter("work_order_status = 'completed'")
        .groupBy("request_id")
        .agg(F.count("*").alias("jobs"), F.sum(job_cost()).alias("cost"))
    )
    per_unit = (
        t.maintenance_requests.select("request_id", "unit_id")
        .join(per_request, "request_id")
        .groupBy("unit_id")
        .agg(F.sum("jobs").alias("jobs"), F.sum("cost").alias("cost"))
    )
    return (
        d.per_property(t, per_unit, "jobs", "cost")
        .join(t.properties.select("property_id", "property_name"), "property_id")
        .select("property_id", "property_name", "jobs", as_total(F.col("cost")).alias("total_cost"))
    )


def maintenance_spend_by_property(t: Tables) -> DataFrame:
    """Completed work per property with total and average cost."""
    return (
        completed_cost_by_property(t)
        .orderBy(F.desc("total_cost"), "property_id")
        .select(
            "property_name",
            F.col("jobs").alias("completed_orders"),
            "total_cost",
            F.round(F.col("total_cost").cast("double") / F.col("jobs"), 2).alias("average_cost"),
        )
    )


def table_row_counts(t: Tables) -> DataFrame:
    """Number of rows per table."""
    counts = [
        frame.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("entity"), "row_count")
        for name, frame in t.items()
        if name != "audit_logs"
    ]
    combined = counts[0]
    for other in counts[1:]:
        combined = combined.unionByName(other)
    return combined.orderBy("entity")

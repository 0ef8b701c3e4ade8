"""The named reports."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    balance,
    count_where,
    day,
    days_until,
    full_name,
    month_start,
    next_month,
    unpaid,
)
from ..functions.paging import at_least_kth, limited
from ..schema import MONEY_TOTAL, Tables
from . import definitions as d

EXPIRY_WINDOWS = (30, 60, 90)


def occupancy_report(t: Tables, as_of: date) -> DataFrame:
    """Occupancy per active property, emptiest first."""
    return d.property_occupancy(t, as_of).orderBy(
        F.asc_nulls_last("occupancy_percentage"), "property_name", "property_id"
    )


def rent_collection_month(t: Tables, month: date) -> DataFrame:
    """Expected and collected rent for any month, unordered.

    Expected rent covers active and expired leases that overlap the month.
    """
    first, after = month_start(month), next_month(month)
    overlaps = (F.col("start_date") < day(after)) & (F.col("end_date") >= day(first))
    per_unit = (
        t.leases.filter(F.col("lease_status").isin("active", "expired") & overlaps)
        .groupBy("unit_id")
        .agg(F.sum("monthly_rent").alias("expected_rent"))
    )
    return (
        t.properties.filter("is_active")
        .select("property_id", "property_code", "property_name")
        .join(d.per_property(t, per_unit, "expected_rent"), "property_id", "left")
        .join(d.collected_rent(t, month), "property_id", "left")
        .select("property_id", "property_code", "property_name", *d.collection_columns())
    )


def rent_collection_report(t: Tables, month: date) -> DataFrame:
    """:func:`rent_collection_month`, weakest collection first."""
    return rent_collection_month(t, month).orderBy("collection_percentage", "property_name", "property_id")


def lease_expiry_report(t: Tables, as_of: date, days: int = 30) -> DataFrame:
    """Leases with status active that end within 30, 60 or 90 days."""
    if days not in EXPIRY_WINDOWS:
        raise ValueError(f"expiry is reported for {EXPIRY_WINDOWS} days ahead, not {days}")
    left = days_until("end_date", as_of)
    ending = F.col("end_date").between(day(as_of), day(as_of + timedelta(days=days)))
    return (
        t.leases.filter((F.col("lease_status") == "active") & ending)
        .select("lease_id", "unit_id", "tenant_id", "end_date")
        .join(t.tenants.select("tenant_id", full_name().alias("tenant_name")), "tenant_id")
        .join(t.units.select("unit_id", "property_id", "unit_number"), "unit_id")
        .join(t.properties.select("property_id", "property_name"), "property_id")
        .select(
            "lease_id",
            "tenant_id",
            "tenant_name",
            "property_name",
            "unit_number",
            "end_date",
            left.alias("days_remaining"),
            F.when(left <= 30, "within 30 days")
            .when(left <= 60, "within 60 days")
            .otherwise("within 90 days")
            .alias("expiry_window"),
        )
        .orderBy("end_date", "property_name", "unit_number", "lease_id")
    )


def tenant_payment_history(t: Tables, tenant_id: int | None = None, limit: int | None = 500) -> DataFrame:
    """Ledger of one tenant, or of all, newest charges first."""
    leases = t.leases.select("lease_id", "tenant_id", "unit_id")
    tenants = t.tenants.select("tenant_id", full_name().alias("tenant_name"))
    if tenant_id is not None:
        leases = leases.filter(F.col("tenant_id") == tenant_id)
        tenants = tenants.filter(F.col("tenant_id") == tenant_id)
    context = lease_context(t, leases, tenants)
    latest = at_least_kth(t.payments.join(context, "lease_id", "left_semi"), "due_date", limit)
    return (
        t.payments.filter(latest)
        .select(
            "payment_id",
            "lease_id",
            "due_date",
            "paid_date",
            "amount_due",
            "amount_paid",
            "payment_status",
            "payment_method",
        )
        .join(context, "lease_id")
        .orderBy(F.desc("due_date"), "tenant_name", "payment_id")
        .transform(limited, limit)
        .select(
            "tenant_id",
            "tenant_name",
            "property_name",
            "unit_number",
            "due_date",
            "paid_date",
            "amount_due",
            "amount_paid",
            "payment_status",
            "payment_method",
        )
    )


def lease_context(t: Tables, leases: DataFrame, tenants: DataFrame) -> DataFrame:
    """Leases with names looked up, before they meet the much larger charges.

    The four small-to-medium tables are joined once per lease rather than once per charge,
    and charges are then shuffled a single time, on lease_id.
    """
    return (
        leases.join(tenants, "tenant_id")
        .join(t.units.select("unit_id", "property_id", "unit_number"), "unit_id")
        .join(t.properties.select("property_id", "property_name"), "property_id")
    )


def delinquent_tenant_report(t: Tables, as_of: date) -> DataFrame:
    """Tenants that owe money or were late at least twice, per property and unit.

    Waived charges count as unpaid here, unlike in ``lease_outstanding``.
    """
    sums = ("late_payment_count", "unpaid_charge_count", "outstanding_balance")
    per_lease = (
        t.payments.filter(F.col("due_date") <= day(as_of))
        .groupBy("lease_id")
        .agg(
            count_where(F.col("payment_status") == "late").alias("late_payment_count"),
            count_where(unpaid()).alias("unpaid_charge_count"),
            F.sum(balance()).alias("outstanding_balance"),
        )
    )
    per_tenant_unit = (
        t.leases.select("lease_id", "tenant_id", "unit_id")
        .join(per_lease, "lease_id")
        .groupBy("tenant_id", "unit_id")
        .agg(*[F.sum(name).alias(name) for name in sums])
    )
    tenants = t.tenants.select("tenant_id", "email", full_name().alias("tenant_name"))
    return (
        lease_context(t, per_tenant_unit, tenants)
        .groupBy("tenant_id", "tenant_name", "email", "property_name", "unit_number")
        .agg(*[F.sum(name).alias(name) for name in sums])
        .filter((F.col("outstanding_balance") > 0) | (F.col("late_payment_count") >= 2))
        .withColumn("outstanding_balance", F.col("outstanding_balance").cast(MONEY_TOTAL))
        .orderBy(F.desc("outstanding_balance"), F.desc("late_payment_count"), "tenant_id", "unit_number")
    )


def maintenance_report(t: Tables) -> DataFrame:
    """Maintenance summary, most open requests first."""
    return d.maintenance_summary(t).orderBy(F.desc("open_requests"), "property_name", "property_id")


def property_performance_report(t: Tables, as_of: date) -> DataFrame:
    """Occupancy, collection and maintenance per property, weakest first."""
    return d.property_performance(t, as_of).orderBy(
        F.asc_nulls_last("occupancy_percentage"), F.asc_nulls_first("collection_percentage"), "property_id"
    )

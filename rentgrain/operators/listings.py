"""Paged entity listings."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import full_name
from ..functions.paging import DEFAULT_PAGE_SIZE, at_least_kth, page_of, rows_through
from ..schema import Tables
from . import dashboard
from . import definitions as d
from . import reports as r


def properties_list(t: Tables, as_of: date, page: int = 1, page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """All properties; inactive ones have no occupancy."""
    occupancy = d.property_occupancy(t, as_of).select("property_id", "total_units", "occupancy_percentage")
    rows = t.properties.join(occupancy, "property_id", "left").select(
        "property_id",
        "property_code",
        "property_name",
        "address_line1",
        "city",
        "state_code",
        "postal_code",
        "manager_name",
        "is_active",
        "total_units",
        "occupancy_percentage",
    )
    return page_of(rows, ["property_name", "property_id"], page, page_size)


def units_list(t: Tables, page: int = 1, page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """Units with their property."""
    named = t.units.join(t.properties.select("property_id", "property_name"), "property_id")
    order = ["property_name", "unit_number", "unit_id"]
    rows = named.select(
        "unit_id",
        "property_name",
        "unit_number",
        "bedrooms",
        "bathrooms",
        "square_feet",
        "market_rent",
        "unit_status",
    )
    return page_of(rows, order, page, page_size, keys=named)


def tenant_lease_counts(t: Tables) -> DataFrame:
    """Every tenant once, with the number of leases."""
    counts = t.leases.groupBy("tenant_id").agg(F.count("*").alias("lease_count"))
    return t.tenants.join(counts, "tenant_id", "left").select(
        "tenant_id",
        "first_name",
        "last_name",
        "email",
        "phone",
        F.coalesce("lease_count", F.lit(0)).alias("lease_count"),
    )


def tenants_list(t: Tables, page: int = 1, page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """Tenants with their number of leases."""
    # Every tenant is one row of the list, so their names alone tell which rows a page holds.
    return page_of(
        tenant_lease_counts(t), ["last_name", "first_name", "tenant_id"], page, page_size, keys=t.tenants
    )


def leases_list(t: Tables, page: int = 1, page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """Leases with names, latest end first."""
    leases = t.leases.select(
        "lease_id", "tenant_id", "unit_id", "start_date", "end_date", "monthly_rent", "lease_status"
    )
    tenants = t.tenants.select("tenant_id", full_name().alias("tenant_name"))
    kept = r.lease_context(t, t.leases.select("lease_id", "unit_id", "tenant_id", "end_date"), tenants)
    latest = at_least_kth(kept, "end_date", rows_through(page, page_size))
    return page_of(
        r.lease_context(t, leases, tenants),
        ["-end_date", "lease_id"],
        page,
        page_size,
        keys=kept,
        top=r.lease_context(t, leases.filter(latest), tenants),
    ).select(
        "lease_id",
        "tenant_name",
        "property_name",
        "unit_number",
        "start_date",
        "end_date",
        "monthly_rent",
        "lease_status",
    )


def payments_list(t: Tables, page: int = 1, page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """Charges with names, latest due first."""
    tenants = t.tenants.select("tenant_id", full_name().alias("tenant_name"))
    context = r.lease_context(t, t.leases.select("lease_id", "tenant_id", "unit_id"), tenants)
    kept = t.payments.join(context, "lease_id", "left_semi")
    latest = at_least_kth(kept, "due_date", rows_through(page, page_size))
    named = context.select("lease_id", "tenant_name", "property_name")
    return page_of(
        t.payments.join(named, "lease_id"),
        ["-due_date", "-payment_id"],
        page,
        page_size,
        keys=kept,
        top=t.payments.filter(latest).join(named, "lease_id"),
    ).select(
        "payment_id",
        "payment_reference",
        "tenant_name",
        "property_name",
        "due_date",
        "paid_date",
        "amount_due",
        "amount_paid",
        "payment_status",
        "payment_method",
    )


def maintenance_list(t: Tables, page: int = 1, page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """Requests with unit and property, newest first."""
    return page_of(
        dashboard.placed_requests(t),
        ["-created_at", "request_id"],
        page,
        page_size,
        keys=t.maintenance_requests.join(dashboard.placed_units(t), "unit_id", "left_semi"),
        top=dashboard.newest_requests(t, rows_through(page, page_size)),
    ).select(
        "request_id",
        "property_name",
        "unit_number",
        "title",
        "priority",
        "request_status",
        "created_at",
        "closed_at",
    )


def audit_list(audit_logs: DataFrame, page: int = 1, page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """Audit rows, newest id first."""
    return page_of(audit_logs, ["-audit_id"], page, page_size).select(
        "audit_id", "table_name", "action", "record_id", "old_data", "new_data", "changed_at"
    )

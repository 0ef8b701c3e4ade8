"""Dashboard figures and the five question-backed answers."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    balance,
    count_where,
    day,
    days_until,
    full_name,
    in_month,
    is_open_request,
    month_start,
    next_month,
    percentage,
    unpaid,
)
from ..functions.joins import flag
from ..functions.paging import at_least_kth, limited
from ..schema import MONEY_TOTAL, Tables
from . import definitions as d
from . import reports as r


def dashboard_summary(t: Tables, as_of: date) -> DataFrame:
    """The six headline figures, one row.

    Occupancy is the plain mean over properties; collection is weighted by rent.
    """
    spark = t.properties.sparkSession
    units = t.units.agg(F.count("*"))
    occupancy = d.property_occupancy(t, as_of).agg(F.round(F.avg("occupancy_percentage"), 1))
    collection = d.rent_collection(t, as_of).agg(
        percentage(F.sum("collected_rent"), F.sum("expected_rent"), 1)
    )
    pending = t.payments.filter(unpaid() & (F.col("due_date") <= day(as_of))).agg(F.count("*"))
    requests = t.maintenance_requests.agg(count_where(is_open_request()))
    properties = t.properties.agg(count_where(F.col("is_active")))
    # Scalar subqueries: each is one row and they run side by side, without any join.
    return spark.range(1).select(
        properties.scalar().alias("total_properties"),
        units.scalar().alias("total_units"),
        occupancy.scalar().alias("occupancy_rate"),
        collection.scalar().alias("collection_rate"),
        pending.scalar().alias("pending_payments"),
        requests.scalar().alias("open_maintenance"),
    )


def recent_maintenance(t: Tables, limit: int | None = 8) -> DataFrame:
    """The newest requests with their property and unit."""
    return (
        newest_requests(t, limit)
        .transform(limited, limit)
        .select(
            "request_id", "property_name", "unit_number", "title", "priority", "request_status", "created_at"
        )
    )


def placed_units(t: Tables) -> DataFrame:
    """Units with the name of their property."""
    return t.units.select("unit_id", "property_id", "unit_number").join(
        t.properties.select("property_id", "property_name"), "property_id"
    )


def placed_requests(t: Tables, condition: Column | None = None) -> DataFrame:
    """Requests with unit and property names."""
    requests = t.maintenance_requests if condition is None else t.maintenance_requests.filter(condition)
    return requests.drop("description", "tenant_id", "updated_at").join(placed_units(t), "unit_id")


def newest_requests(t: Tables, at_least: int | None) -> DataFrame:
    """Requests with unit and property names, newest first, at least the given number if there are."""
    kept = t.maintenance_requests.join(placed_units(t), "unit_id", "left_semi")
    latest = at_least_kth(kept, "created_at", at_least)
    return placed_requests(t, latest).orderBy(F.desc("created_at"), "request_id")


def active_lease_names(t: Tables, as_of: date) -> DataFrame:
    """Leases in force with tenant and property names and the days left."""
    return (
        d.active_leases(t, as_of)
        .join(t.properties.select("property_id", "property_name"), "property_id")
        .select(
            "lease_id",
            full_name().alias("tenant_name"),
            "property_name",
            "unit_number",
            "end_date",
            days_until("end_date", as_of).alias("days_remaining"),
        )
    )


def upcoming_expirations(t: Tables, as_of: date, days: int = 60, limit: int | None = 8) -> DataFrame:
    """The leases in force that end soonest."""
    ending = F.col("end_date").between(day(as_of), day(as_of + timedelta(days=days)))
    return active_lease_names(t, as_of).filter(ending).orderBy("end_date", "lease_id").transform(limited, limit)


def lowest_collection(t: Tables, month: date, limit: int | None = 7) -> DataFrame:
    """The properties with the weakest collection in the month."""
    return (
        r.rent_collection_month(t, month)
        .orderBy("collection_percentage", "property_name", "property_id")
        .transform(limited, limit)
    )


def lowest_occupancy(t: Tables, as_of: date, limit: int | None = 12) -> DataFrame:
    """The emptiest properties."""
    return r.occupancy_report(t, as_of).transform(limited, limit)


def leases_of_month(t: Tables, as_of: date) -> DataFrame:
    """The leases that any part of the dashboard can need: in force on the day, of the month, or charged in it."""
    first, after = month_start(as_of), next_month(as_of)
    charged = t.payments.filter(in_month("due_date", as_of)).select("lease_id").distinct()
    touching = (F.col("start_date") < day(after)) & (F.col("end_date") >= day(first))
    return flag(t.leases, charged, "lease_id", "_charged").filter(touching | F.col("_charged")).drop("_charged")


def dashboard_bundle(t: Tables, as_of: date, folder: str) -> dict[str, DataFrame]:
    """Everything the dashboard shows, all from one snapshot of the tables.

    One job reads the leases and keeps those that matter in ``folder``; every part reads these.
    """
    path = f"{folder}/leases_of_month"
    leases_of_month(t, as_of).write.mode("errorifexists").parquet(path)
    t = t.with_(leases=t.properties.sparkSession.read.schema(t.leases.schema).parquet(path))
    return {
        "summary": dashboard_summary(t, as_of),
        "occupancy": r.occupancy_report(t, as_of),
        "rent_collection": r.rent_collection_report(t, as_of),
        "recent_maintenance": recent_maintenance(t),
        "upcoming_expirations": upcoming_expirations(t, as_of),
    }


def low_occupancy(t: Tables, as_of: date, threshold: int = 80) -> DataFrame:
    """Properties below an occupancy threshold."""
    if not 1 <= threshold <= 100:
        raise ValueError(f"a threshold is a percentage from 1 to 100, not {threshold}")
    return (
        d.property_occupancy(t, as_of)
        .filter(F.col("occupancy_percentage") < threshold)
        .select(
            "property_id", "property_name", "city", "occupied_units", "total_units", "occupancy_percentage"
        )
        .orderBy("occupancy_percentage", "property_name", "property_id")
        .drop("property_id")
    )


def expiring_leases(t: Tables, as_of: date, days: int = 30) -> DataFrame:
    """Leases in force that end within the given days."""
    # Stated on end_date itself, so the range reaches the scan.
    ending = F.col("end_date").between(day(as_of), day(as_of + timedelta(days=days)))
    return (
        active_lease_names(t, as_of)
        .filter(ending)
        .orderBy("days_remaining", "lease_id")
        .drop("lease_id")
    )


def pending_payments(t: Tables, as_of: date, limit: int | None = 100) -> DataFrame:
    """The largest unpaid balances per tenant and property."""
    owed = F.sum(balance()).alias("owed")
    per_lease = (
        t.payments.filter(unpaid() & (F.col("due_date") <= day(as_of))).groupBy("lease_id").agg(owed)
    )
    per_tenant_property = (
        t.leases.select("lease_id", "tenant_id", "unit_id")
        .join(per_lease, "lease_id")
        .join(t.units.select("unit_id", "property_id"), "unit_id")
        .groupBy("tenant_id", "property_id")
        .agg(F.sum("owed").alias("owed"))
    )
    return (
        per_tenant_property.join(t.tenants.select("tenant_id", full_name().alias("tenant_name")), "tenant_id")
        .join(t.properties.select("property_id", "property_name"), "property_id")
        .groupBy("tenant_id", "tenant_name", "property_name")
        .agg(F.sum("owed").cast(MONEY_TOTAL).alias("outstanding_balance"))
        .orderBy(F.desc("outstanding_balance"), "tenant_id", "property_name")
        .transform(limited, limit)
        .select("tenant_name", "property_name", "outstanding_balance")
    )


def top_collection(t: Tables, as_of: date, limit: int | None = 5) -> DataFrame:
    """The properties with the best collection this month."""
    return (
        d.rent_collection(t, as_of)
        .orderBy(F.desc_nulls_last("collection_percentage"), "property_id")
        .transform(limited, limit)
        .select("property_name", "expected_rent", "collected_rent", "collection_percentage")
    )

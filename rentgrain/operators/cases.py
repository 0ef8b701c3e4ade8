"""Support cases: the faulty figure next to the right one.

Where a faulty query multiplies rows by joining facts of different grain, the inflated
figure is computed from the multiplicities (sum of value times number of matches), which
gives the same number without producing the multiplied rows.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_total, day, is_current, total
from ..schema import FANOUT_TOTAL, Tables
from . import definitions as d
from . import library as lib
from .duplicates import repeated_keys
from .listings import tenant_lease_counts


def inflation(faulty: str, correct: str) -> Column:
    """How many times too large the faulty figure is."""
    ratio = F.col(faulty).cast("double") / F.nullif(F.col(correct).cast("double"), F.lit(0.0))
    return F.round(ratio, 4).alias("inflation_factor")


def occupancy_inflation(t: Tables, as_of: date) -> DataFrame:
    """Active leases counted as occupied units, against units counted once."""
    leases = t.leases.filter("lease_status = 'active'").groupBy("unit_id").agg(F.count("*").alias("leases"))
    per_prop = (
        t.units.join(leases, "unit_id", "left")
        .groupBy("property_id")
        .agg(F.coalesce(F.sum("leases"), F.lit(0)).alias("occupied_count"), F.count("*").alias("total_units"))
    )
    right = d.property_occupancy(t, as_of).select("property_id", "occupied_units", "occupancy_percentage")
    return (
        t.properties.select("property_id", "property_name")
        .join(per_prop, "property_id")
        .join(right, "property_id", "left")
        .select(
            "property_id",
            "property_name",
            "occupied_count",
            "total_units",
            "occupied_units",
            "occupancy_percentage",
            inflation("occupied_count", "occupied_units"),
        )
    )


def overlapping_units(t: Tables, as_of: date) -> DataFrame:
    """Units with more than one lease in force."""
    return repeated_keys(t.leases.filter(is_current(as_of)), ["unit_id"], "lease_count")


def occupancy_above_hundred(t: Tables, as_of: date) -> DataFrame:
    """Validation: properties above 100 percent."""
    return d.property_occupancy(t, as_of).filter("occupancy_percentage > 100")


def rent_fanout(t: Tables, as_of: date) -> DataFrame:
    """Rent summed once per payment, against rent summed once per lease."""
    payments = t.payments.groupBy("lease_id").agg(F.count("*").alias("payments"))
    inflated = (
        t.leases.filter("lease_status = 'active'")
        .select("lease_id", "unit_id", "monthly_rent")
        .join(payments, "lease_id")
        .groupBy("unit_id")
        .agg(F.sum(F.col("monthly_rent") * F.col("payments")).alias("inflated"))
    )
    once = d.expected_rent(t, as_of)
    return (
        d.per_property(t, inflated, "inflated")
        .join(once, "property_id", "left")
        .select(
            "property_id",
            F.col("inflated").cast(FANOUT_TOTAL).alias("inflated_expected_rent"),
            as_total(F.col("expected_rent")).alias("expected_once"),
            inflation("inflated", "expected_rent"),
        )
    )


def rent_matches_report(t: Tables, as_of: date) -> DataFrame:
    """Validation: active properties whose reported expected rent differs from the rent counted once."""
    once = d.expected_rent(t, as_of).withColumnRenamed("expected_rent", "expected_once")
    return (
        d.rent_collection(t, as_of)
        .join(once, "property_id", "left")
        .filter(F.col("expected_rent") != F.coalesce("expected_once", F.lit(0)))
        .select("property_id", "expected_rent", as_total(F.col("expected_once")).alias("expected_once"))
    )


def tenant_payment_rows(t: Tables) -> DataFrame:
    """Rows a tenant takes in a list joined to payments, against its one row with a lease count."""
    payments = t.payments.groupBy("lease_id").agg(F.count("*").alias("payments"))
    joined = (
        t.leases.select("lease_id", "tenant_id")
        .join(payments, "lease_id")
        .groupBy("tenant_id")
        .agg(F.sum("payments").alias("joined_rows"))
        .filter("joined_rows > 1")
    )
    return tenant_lease_counts(t).join(joined, "tenant_id").select("tenant_id", "email", "joined_rows", "lease_count")


def repeated_tenants(t: Tables) -> DataFrame:
    """Validation: tenants listed more than once in the corrected list."""
    return repeated_keys(tenant_lease_counts(t), ["tenant_id"], "row_count")


def occupied_without_lease(t: Tables, as_of: date) -> DataFrame:
    """Units stored as occupied that nobody has a lease on."""
    return (
        t.units.filter("unit_status = 'occupied'")
        .select("unit_id", "property_id", "unit_number", "unit_status")
        .join(d.leased_units(t, as_of), "unit_id", "left_anti")
        .join(t.properties.select("property_id", "property_name"), "property_id")
        .select("property_name", "unit_id", "unit_number", "unit_status")
    )


def orphan_payments(t: Tables) -> DataFrame:
    """Charges whose lease does not exist."""
    return t.payments.select("payment_id", "payment_reference", "lease_id").join(
        t.leases.select("lease_id"), "lease_id", "left_anti"
    )


def orphan_payment_count(t: Tables) -> DataFrame:
    """Validation: the number of :func:`orphan_payments`."""
    per_lease = t.payments.groupBy("lease_id").agg(F.count("*").alias("rows"))
    orphans = per_lease.join(t.leases.select("lease_id"), "lease_id", "left_anti")
    return orphans.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("orphan_payments"))


def expired_but_active(t: Tables, as_of: date) -> DataFrame:
    """Leases whose status is active although they have ended."""
    return t.leases.filter((F.col("lease_status") == "active") & (F.col("end_date") < day(as_of))).select(
        "lease_id", "lease_status", "start_date", "end_date"
    )


def outside_active_view(t: Tables, as_of: date) -> DataFrame:
    """Validation: leases reported as in force although the day lies outside them."""
    outside = (F.col("end_date") < day(as_of)) | (F.col("start_date") > day(as_of))
    return d.active_leases(t, as_of).filter(outside).select("lease_id")


def status_conflicts(t: Tables) -> DataFrame:
    """Requests and work orders that disagree on completion."""
    return lib.workorder_status_conflicts(t).select(
        "request_id", "request_status", "closed_at", "work_order_id", "work_order_status", "completed_at"
    )


def maintenance_cost_share(t: Tables) -> DataFrame:
    """Cost per property against the portfolio mean."""
    cost = lib.completed_cost_by_property(t)
    mean = cost.agg(F.round(F.sum("total_cost").cast("double") / F.count("*"), 2))
    return (
        cost.withColumn("portfolio_average", mean.scalar())
        .orderBy(F.desc("total_cost"), "property_id")
        .select("property_id", "property_name", "total_cost", "portfolio_average")
    )


def maintenance_cost_per_job(t: Tables) -> DataFrame:
    """Cost per completed job, dearest property first."""
    return (
        lib.completed_cost_by_property(t)
        .withColumn("cost_per_job", F.col("total_cost").cast("double") / F.col("jobs"))
        .orderBy(F.desc("cost_per_job"), "property_id")
        .select("property_name", "jobs", "total_cost", "cost_per_job")
    )


def multi_fact_fanout(t: Tables, as_of: date) -> DataFrame:
    """Three facts joined before summing, against each summed on its own."""
    payments = t.payments.groupBy("lease_id").agg(F.count("*").alias("payments"), F.sum("amount_paid").alias("paid"))
    requests = t.maintenance_requests.groupBy("unit_id").agg(F.count("*").alias("requests"))
    per_unit = (
        t.leases.select("lease_id", "unit_id", "monthly_rent")
        .join(payments, "lease_id", "left")
        .groupBy("unit_id")
        .agg(
            F.sum(F.col("monthly_rent") * F.coalesce("payments", F.lit(1))).alias("rent"),
            F.sum("paid").alias("paid"),
        )
        .join(requests, "unit_id", "left")
        .withColumn("repeats", F.coalesce("requests", F.lit(1)).cast("decimal(12,0)"))
        .select(
            "unit_id",
            (F.col("rent").cast("decimal(24,2)") * F.col("repeats")).alias("rent"),
            (F.col("paid").cast("decimal(24,2)") * F.col("repeats")).alias("paid"),
        )
    )
    right = d.rent_collection(t, as_of).select("property_id", "expected_rent", "collected_rent")
    return (
        t.properties.select("property_id")
        .join(d.per_property(t, per_unit, "rent", "paid"), "property_id")
        .join(right, "property_id", "left")
        .select(
            "property_id",
            F.col("rent").cast(FANOUT_TOTAL).alias("faulty_expected_rent"),
            F.col("paid").cast(FANOUT_TOTAL).alias("faulty_collected"),
            "expected_rent",
            "collected_rent",
            inflation("rent", "expected_rent"),
        )
    )


def correct_totals(t: Tables, as_of: date) -> DataFrame:
    """The corrected combined report."""
    occupancy = d.property_occupancy(t, as_of).select("property_id", "property_name", "occupancy_percentage")
    rent = d.rent_collection(t, as_of).select("property_id", "expected_rent", "collected_rent")
    maintenance = d.maintenance_summary(t).select("property_id", "total_requests", "open_requests")
    return occupancy.join(rent, "property_id", "left").join(maintenance, "property_id", "left").drop("property_id")


def rent_totals(t: Tables, as_of: date) -> DataFrame:
    """Validation: portfolio rent totals, unaffected by maintenance rows."""
    return d.rent_collection(t, as_of).agg(
        total(F.col("expected_rent")).alias("expected"), total(F.col("collected_rent")).alias("collected")
    )

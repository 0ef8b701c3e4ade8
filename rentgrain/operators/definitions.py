"""Shared business definitions and the scalar and table functions built on them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    as_total,
    balance,
    count_where,
    day,
    in_month,
    is_current,
    is_open_request,
    mean_hours,
    micros_between,
    month_start,
    or_zero,
    percentage,
    total,
)
from ..functions.joins import flag
from ..schema import Tables


def active_leases(t: Tables, as_of: date) -> DataFrame:
    """Leases in force on the day, with their unit and tenant."""
    units = t.units.select("unit_id", "property_id", "unit_number")
    tenants = t.tenants.select("tenant_id", "first_name", "last_name", "email")
    return (
        t.leases.filter(is_current(as_of))
        .join(units, "unit_id")
        .join(tenants, "tenant_id")
        .select(
            *t.leases.columns, "property_id", "unit_number", "first_name", "last_name", "email"
        )
    )


def current_leases(t: Tables, as_of: date) -> DataFrame:
    """Leases in force on the day whose tenant exists; units are not looked up yet."""
    return t.leases.filter(is_current(as_of)).join(t.tenants.select("tenant_id"), "tenant_id", "left_semi")


def leased_units(t: Tables, as_of: date) -> DataFrame:
    """Each unit_id with at least one lease in force, once."""
    return current_leases(t, as_of).select("unit_id").distinct()


def units_with_lease_flag(t: Tables, as_of: date) -> DataFrame:
    """All units with ``has_lease``; overlapping leases do not repeat a unit."""
    return flag(t.units, current_leases(t, as_of), "unit_id", "has_lease")


def payments_per_unit(t: Tables, *sums: tuple[str, Column], keep: Column | None = None) -> DataFrame:
    """Charges folded to (unit_id, sums): first per lease, then per unit.

    ``sums`` are (name, expression) pairs. The first aggregate and the join share the
    hash partitioning on lease_id, so this costs one shuffle of the charges.
    """
    rows = t.payments if keep is None else t.payments.filter(keep)
    per_lease = rows.groupBy("lease_id").agg(*[F.sum(value).alias(name) for name, value in sums])
    return (
        t.leases.select("lease_id", "unit_id")
        .join(per_lease, "lease_id")
        .groupBy("unit_id")
        .agg(*[F.sum(name).alias(name) for name, _ in sums])
    )


def per_property(t: Tables, per_unit: DataFrame, *names: str) -> DataFrame:
    """Per-unit sums folded to their property."""
    return (
        t.units.select("unit_id", "property_id")
        .join(per_unit, "unit_id")
        .groupBy("property_id")
        .agg(*[F.sum(name).alias(name) for name in names])
    )


def property_occupancy(t: Tables, as_of: date) -> DataFrame:
    """Units, occupied units and occupancy per active property."""
    per_prop = (
        units_with_lease_flag(t, as_of)
        .groupBy("property_id")
        .agg(F.count("*").alias("total_units"), count_where(F.col("has_lease")).alias("occupied_units"))
    )
    units, occupied = F.coalesce("total_units", F.lit(0)), F.coalesce("occupied_units", F.lit(0))
    return (
        t.properties.filter("is_active")
        .join(per_prop, "property_id", "left")
        .select(
            "property_id",
            "property_code",
            "property_name",
            "city",
            units.alias("total_units"),
            occupied.alias("occupied_units"),
            (units - occupied).alias("vacant_units"),
            percentage(occupied, units).alias("occupancy_percentage"),
        )
    )


def expected_rent(t: Tables, as_of: date) -> DataFrame:
    """Monthly rent of the leases in force, per property."""
    per_unit = current_leases(t, as_of).groupBy("unit_id").agg(F.sum("monthly_rent").alias("expected_rent"))
    return per_property(t, per_unit, "expected_rent")


def collected_rent(t: Tables, month: date) -> DataFrame:
    """Money received for charges due in the month, per property."""
    paid = ("collected_rent", F.col("amount_paid"))
    return per_property(t, payments_per_unit(t, paid, keep=in_month("due_date", month)), "collected_rent")


def collection_columns() -> list[Column]:
    """Expected, collected, pending and rate from two nullable sums."""
    expected, collected = or_zero(F.col("expected_rent")), or_zero(F.col("collected_rent"))
    return [
        expected.alias("expected_rent"),
        collected.alias("collected_rent"),
        as_total(F.greatest(expected - collected, F.lit(0))).alias("pending_rent"),
        F.coalesce(percentage(collected, F.col("expected_rent")), F.lit(0.0)).alias("collection_percentage"),
    ]


def rent_collection(t: Tables, as_of: date) -> DataFrame:
    """Expected and collected rent of the current month per active property.

    Collections are matched on property *and* report month, and the month comes from the
    expected side: a property without a lease in force therefore shows no collections.
    """
    expected = expected_rent(t, as_of).withColumn("report_month", day(month_start(as_of)))
    collected = collected_rent(t, as_of).withColumn("report_month", day(month_start(as_of)))
    return (
        t.properties.filter("is_active")
        .select("property_id", "property_code", "property_name")
        .join(expected, "property_id", "left")
        .join(collected, ["property_id", "report_month"], "left")
        .select("property_id", "property_code", "property_name", "report_month", *collection_columns())
    )


def maintenance_summary(t: Tables) -> DataFrame:
    """Request counts and mean resolution time per active property."""
    closed = F.col("request_status") == "closed"
    micros = F.when(closed, micros_between("created_at", "closed_at"))
    counts = ["total_requests", "open_requests", "closed_requests", "high_priority_requests"]
    sums = ["_micros", "_timed"]
    per_unit = t.maintenance_requests.groupBy("unit_id").agg(
        F.count("*").alias("total_requests"),
        count_where(is_open_request()).alias("open_requests"),
        count_where(closed).alias("closed_requests"),
        count_where(F.col("priority").isin("high", "emergency")).alias("high_priority_requests"),
        F.sum(micros).alias("_micros"),
        F.count(micros).alias("_timed"),
    )
    return (
        t.properties.filter("is_active")
        .select("property_id", "property_code", "property_name")
        .join(per_property(t, per_unit, *counts, *sums), "property_id", "left")
        .select(
            "property_id",
            "property_code",
            "property_name",
            *[F.coalesce(name, F.lit(0)).alias(name) for name in counts],
            mean_hours(F.col("_micros"), F.col("_timed")).alias("average_resolution_hours"),
        )
    )


def property_performance(t: Tables, as_of: date) -> DataFrame:
    """Occupancy, collection and maintenance side by side, one row per active property."""
    occupancy = property_occupancy(t, as_of).select(
        "property_id", "property_code", "property_name", "city", "occupancy_percentage"
    )
    rent = rent_collection(t, as_of).select(
        "property_id", "expected_rent", "collected_rent", "pending_rent", "collection_percentage"
    )
    maintenance = maintenance_summary(t).select(
        "property_id", "total_requests", "open_requests", "high_priority_requests", "average_resolution_hours"
    )
    return occupancy.join(rent, "property_id", "left").join(maintenance, "property_id", "left")


class DuplicateKeyError(ValueError):
    """A snapshot holds a key more than once."""


def write_performance_snapshot(t: Tables, as_of: date, folder: str) -> DataFrame:
    """Store :func:`property_performance` for the day and read it back.

    Each day is its own partition folder and is written once. The report is computed a single time,
    into a folder aside; its key is checked there, and only then it appears under its day.
    """
    spark, name = t.properties.sparkSession, f"as_of={as_of.isoformat()}"
    aside, path = f"{folder}/_unchecked/{name}", f"{folder}/{name}"
    property_performance(t, as_of).write.mode("errorifexists").parquet(aside)
    unchecked = spark.read.parquet(aside)
    if not unchecked.groupBy("property_id").count().filter("count > 1").isEmpty():
        raise DuplicateKeyError(f"property_id is not unique in {aside}")
    unchecked.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def only_property(t: Tables, property_id: int | None) -> Tables:
    """The tables restricted to one property, or unchanged for None."""
    if property_id is None:
        return t
    wanted = F.col("property_id") == property_id
    units = t.units.filter(wanted)
    # What lies elsewhere goes before it is folded.
    of_units = lambda df: df.join(units.select("unit_id"), "unit_id", "left_semi")
    leases = of_units(t.leases)
    return t.with_(
        properties=t.properties.filter(wanted),
        units=units,
        leases=leases,
        payments=t.payments.join(leases.select("lease_id"), "lease_id", "left_semi"),
        maintenance_requests=of_units(t.maintenance_requests),
    )


def occupancy_by_property(t: Tables, as_of: date, property_id: int | None = None) -> DataFrame:
    """Occupancy of one property or of all; no row if inactive or unknown."""
    return property_occupancy(only_property(t, property_id), as_of).select("property_id", "occupancy_percentage")


def lease_outstanding(t: Tables) -> DataFrame:
    """What each lease still owes on charges that are neither paid nor waived."""
    owed = (
        t.payments.filter(~F.col("payment_status").isin("paid", "waived"))
        .groupBy("lease_id")
        .agg(total(balance()).alias("outstanding"))
    )
    return (
        t.leases.select("lease_id")
        .join(owed, "lease_id", "left")
        .select("lease_id", or_zero(F.col("outstanding")).alias("outstanding"))
    )


def property_summary(t: Tables, as_of: date, property_id: int | None = None) -> DataFrame:
    """Name, occupancy, collection rate and open requests of one property, or of all."""
    return property_performance(only_property(t, property_id), as_of).select(
        "property_id",
        "property_name",
        "occupancy_percentage",
        "collection_percentage",
        F.col("open_requests").alias("open_maintenance_requests"),
    )

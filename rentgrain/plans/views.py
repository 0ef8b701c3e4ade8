"""The tables, shared definitions and functions under their SQL names.

After :func:`register`, ``spark.sql`` can use the tables, the four views and three
functions, so ad-hoc SQL sees the same definitions as the reports.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import SparkSession

from ..operators import definitions as d
from ..schema import Tables


def register(spark: SparkSession, t: Tables, as_of: date) -> list[str]:
    """Create temporary views and functions for the day; returns the view names."""
    views = dict(t.items()) | {
        "active_leases_view": d.active_leases(t, as_of),
        "property_occupancy_view": d.property_occupancy(t, as_of),
        "rent_collection_view": d.rent_collection(t, as_of),
        "maintenance_summary_view": d.maintenance_summary(t),
        "lease_outstanding_view": d.lease_outstanding(t),
        "property_summary_view": d.property_summary(t, as_of),
    }
    for name, frame in views.items():
        frame.createOrReplaceTempView(name)
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION calculate_property_occupancy(wanted BIGINT) RETURNS DOUBLE RETURN "
        "SELECT max(occupancy_percentage) FROM property_occupancy_view WHERE property_id = wanted"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION calculate_lease_outstanding(wanted BIGINT) RETURNS DECIMAL(28,2) RETURN "
        "SELECT coalesce(max(outstanding), 0) FROM lease_outstanding_view WHERE lease_id = wanted"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION property_summary(wanted BIGINT) RETURNS TABLE (property_name STRING, "
        "occupancy_percentage DOUBLE, collection_percentage DOUBLE, open_maintenance_requests BIGINT) RETURN "
        "SELECT property_name, occupancy_percentage, collection_percentage, open_maintenance_requests "
        "FROM property_summary_view WHERE property_id = wanted"
    )
    return list(views)

"""The registered queries, each over whole star tables in a folder."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import absorbing, cases, changes, constraints, dashboard, definitions, grid, library, listings, publishing, quality, reports, rewrites, search
from ..operators.duplicates import duplicate_payments, loose_duplicate_payments
from ..schema import AUDIT_LOGS, SCHEMAS, Tables
from ..sources import star
from ..sources.canonical import fresh_folder
from ..sources.star import AS_OF
from .checks import PROPERTY, SEARCHES

Query = Callable[[SparkSession, str], DataFrame]
NOW = datetime(AS_OF.year, AS_OF.month, AS_OF.day)
NAME_TERM, NAME_PART = "machinery", "achine"
TENANT = 7
# Tables whose rows carry the time of their last change.
STAMPED = tuple(name for name, schema in SCHEMAS.items() if "updated_at" in schema.names)

CLEAN: dict[str, Callable[[Tables], DataFrame]] = {
    "active_leases": lambda t: definitions.active_leases(t, AS_OF),
    "property_occupancy": lambda t: definitions.property_occupancy(t, AS_OF),
    "rent_collection": lambda t: definitions.rent_collection(t, AS_OF),
    "maintenance_summary": definitions.maintenance_summary,
    "property_performance_snapshot": lambda t: definitions.property_performance(t, AS_OF),
    "occupancy_by_property": lambda t: definitions.occupancy_by_property(t, AS_OF),
    "occupancy_by_property_one": lambda t: definitions.occupancy_by_property(t, AS_OF, PROPERTY),
    "property_summary_one": lambda t: definitions.property_summary(t, AS_OF, PROPERTY),
    "lease_outstanding": definitions.lease_outstanding,
    "property_summary": lambda t: definitions.property_summary(t, AS_OF),
    "occupancy_report": lambda t: reports.occupancy_report(t, AS_OF),
    "rent_collection_report": lambda t: reports.rent_collection_report(t, AS_OF),
    "lease_expiry_report": lambda t: reports.lease_expiry_report(t, AS_OF, days=90),
    "lease_expiry_30_days": lambda t: reports.lease_expiry_report(t, AS_OF, days=30),
    "lease_expiry_60_days": lambda t: reports.lease_expiry_report(t, AS_OF, days=60),
    "tenant_payment_history": reports.tenant_payment_history,
    "tenant_payment_history_all": lambda t: reports.tenant_payment_history(t, limit=None),
    "tenant_payment_history_one": lambda t: reports.tenant_payment_history(t, tenant_id=TENANT, limit=None),
    "delinquent_tenant_report": lambda t: reports.delinquent_tenant_report(t, AS_OF),
    "maintenance_report": reports.maintenance_report,
    "property_performance_report": lambda t: reports.property_performance_report(t, AS_OF),
    "dashboard_summary": lambda t: dashboard.dashboard_summary(t, AS_OF),
    "recent_maintenance": dashboard.recent_maintenance,
    "upcoming_expirations": lambda t: dashboard.upcoming_expirations(t, AS_OF),
    "lowest_collection": lambda t: dashboard.lowest_collection(t, AS_OF),
    "lowest_occupancy": lambda t: dashboard.lowest_occupancy(t, AS_OF),
    "properties_list": lambda t: listings.properties_list(t, AS_OF),
    "units_list": lambda t: listings.units_list(t, page=2),
    "tenants_list": listings.tenants_list,
    "leases_list": listings.leases_list,
    "payments_list": listings.payments_list,
    "maintenance_list": listings.maintenance_list,
    "payments_list_page_1000": lambda t: listings.payments_list(t, page=1_000),
    "payments_list_page_100000": lambda t: listings.payments_list(t, page=100_000, page_size=5),
    "units_list_page_15000": lambda t: listings.units_list(t, page=15_000, page_size=1),
    "maintenance_list_last_page": lambda t: listings.maintenance_list(t, page=2, page_size=9_000),
    "low_occupancy": lambda t: dashboard.low_occupancy(t, AS_OF, threshold=50),
    "expiring_leases": lambda t: dashboard.expiring_leases(t, AS_OF),
    "pending_payments": lambda t: dashboard.pending_payments(t, AS_OF),
    "pending_payments_all": lambda t: dashboard.pending_payments(t, AS_OF, limit=None),
    "top_collection": lambda t: dashboard.top_collection(t, AS_OF),
    "vacant_units_by_rent": library.vacant_units_by_rent,
    "active_cities": library.active_cities,
    "payment_collection_category": lambda t: library.payment_collection_category(t, AS_OF),
    "payment_collection_category_all": lambda t: library.payment_collection_category(t, AS_OF, limit=None),
    "active_lease_roster": library.active_lease_roster,
    "unit_current_tenant": lambda t: library.unit_current_tenant(t, AS_OF),
    "request_workorder_cost": library.request_workorder_cost,
    "property_payment_kpis": library.property_payment_kpis,
    "vendor_specialty_cost": library.vendor_specialty_cost,
    "above_average_rent": library.above_average_rent,
    "tenants_with_overdue_debt": lambda t: library.tenants_with_overdue_debt(t, AS_OF),
    "units_without_current_lease": lambda t: library.units_without_current_lease(t, AS_OF),
    "rent_gap_by_property": lambda t: library.rent_gap_by_property(t, AS_OF),
    "resolution_time_by_property": library.resolution_time_by_property,
    "latest_payment_per_tenant": library.latest_payment_per_tenant,
    "monthly_running_collection": lambda t: library.monthly_running_collection(t, AS_OF),
    "collection_rank": lambda t: library.collection_rank(t, AS_OF),
    "status_cache_mismatch": lambda t: library.status_cache_mismatch(t, AS_OF),
    "workorder_status_conflicts": lambda t: library.workorder_status_conflicts(t),
    "maintenance_spend_by_property": library.maintenance_spend_by_property,
    "table_row_counts": library.table_row_counts,
    "case_occupancy_inflation": lambda t: cases.occupancy_inflation(t, AS_OF),
    "case_overlapping_units": lambda t: cases.overlapping_units(t, AS_OF),
    "case_occupancy_above_hundred": lambda t: cases.occupancy_above_hundred(t, AS_OF),
    "case_rent_fanout": lambda t: cases.rent_fanout(t, AS_OF),
    "case_rent_matches_report": lambda t: cases.rent_matches_report(t, AS_OF),
    "case_tenant_payment_rows": cases.tenant_payment_rows,
    "case_repeated_tenants": cases.repeated_tenants,
    "case_occupied_without_lease": lambda t: cases.occupied_without_lease(t, AS_OF),
    "case_expired_but_active": lambda t: cases.expired_but_active(t, AS_OF),
    "case_outside_active_view": lambda t: cases.outside_active_view(t, AS_OF),
    "case_status_conflicts": cases.status_conflicts,
    "case_maintenance_cost_share": cases.maintenance_cost_share,
    "case_maintenance_cost_per_job": cases.maintenance_cost_per_job,
    "case_multi_fact_fanout": lambda t: cases.multi_fact_fanout(t, AS_OF),
    "case_correct_totals": lambda t: cases.correct_totals(t, AS_OF),
    "case_rent_totals": lambda t: cases.rent_totals(t, AS_OF),
    "opt_expiry_before": lambda t: rewrites.expiry_before(t, AS_OF),
    "opt_expiry_after": lambda t: rewrites.expiry_after(t, AS_OF),
    "opt_tenant_before": lambda t: rewrites.tenant_before(t, NAME_TERM),
    "opt_tenant_after": lambda t: rewrites.tenant_after(t, NAME_TERM),
    "opt_payment_before": rewrites.payment_before,
    "opt_payment_after": rewrites.payment_after,
    "rewrite_expiry_difference": lambda t: rewrites.difference(
        rewrites.expiry_before(t, AS_OF), rewrites.expiry_after(t, AS_OF)
    ),
    "rewrite_tenant_difference": lambda t: rewrites.difference(
        rewrites.tenant_before(t, NAME_TERM), rewrites.tenant_after(t, NAME_TERM)
    ),
    "rewrite_payment_difference": lambda t: rewrites.difference(
        rewrites.payment_before(t), rewrites.payment_after(t)
    ),
    "rewrite_tenant_difference_part": lambda t: rewrites.difference(
        rewrites.tenant_before(t, NAME_PART), rewrites.tenant_after(t, NAME_PART)
    ),
    "rewrite_expiry_equivalence": lambda t: rewrites.equivalence(
        rewrites.expiry_before(t, AS_OF), rewrites.expiry_after(t, AS_OF)
    ),
    "rewrite_tenant_equivalence": lambda t: rewrites.equivalence(
        rewrites.tenant_before(t, NAME_TERM), rewrites.tenant_after(t, NAME_TERM)
    ),
    "rewrite_tenant_equivalence_part": lambda t: rewrites.equivalence(
        rewrites.tenant_before(t, NAME_PART), rewrites.tenant_after(t, NAME_PART)
    ),
    "rewrite_payment_equivalence": lambda t: rewrites.equivalence(
        rewrites.payment_before(t), rewrites.payment_after(t)
    ),
    "grid_query": lambda t: grid.grid_query(
        t.units,
        term="RING",
        sort="market_rent",
        descending=True,
        page=2,
        tie="unit_id",
    ),
    "refresh_unit_status": lambda t: changes.refresh_unit_status(t, NOW),
    "repair_unit_status": lambda t: changes.repair_unit_status(t, NOW),
}


def _rule(name: str) -> Callable[[Tables], DataFrame]:
    return lambda t: quality.RULES[name](t, AS_OF)


DAMAGED: dict[str, Callable[[Tables], DataFrame]] = {
    **{f"rule_{name.lower()}": _rule(name) for name in quality.RULES},
    "violations": lambda t: quality.violations(t, AS_OF),
    "scorecard": lambda t: quality.scorecard(t, AS_OF),
    "test_scorecard": lambda t: quality.test_scorecard(t, AS_OF),
    "gate_findings": lambda t: quality.gate_findings(t, AS_OF),
    "duplicate_payments": duplicate_payments,
    "payment_business_key_duplicates": duplicate_payments,
    "case_duplicate_payments": duplicate_payments,
    "case_loose_duplicate_payments": loose_duplicate_payments,
    "case_orphan_payments": cases.orphan_payments,
    "case_orphan_payment_count": cases.orphan_payment_count,
}


BROKEN: dict[str, Callable[[Tables], DataFrame]] = {"schema_violations": constraints.schema_violations}


def _admission(spark: SparkSession, folder: str) -> changes.Admission:
    tables = star.star_tables(spark, folder)
    tables = tables.with_(leases=star.rolled_over(tables.leases))
    return changes.admit_leases(tables, star.lease_proposals(spark, folder), NOW)


def _merged(name: str) -> Callable[[SparkSession, str], changes.Applied]:
    def run(spark: SparkSession, folder: str) -> changes.Applied:
        table = getattr(star.star_tables(spark, folder), name)
        return changes.merge_changes(table, star.table_changes(spark, folder, name), SCHEMAS[name][0].name, NOW)

    return run


def _audit(spark: SparkSession, folder: str) -> DataFrame:
    return changes.audit_changes(star.star_tables(spark, folder).leases, _merged("leases")(spark, folder).table, NOW)


def _audit_list(spark: SparkSession, folder: str) -> DataFrame:
    empty = spark.createDataFrame([], AUDIT_LOGS)
    return listings.audit_list(changes.append_audit(empty, _audit(spark, folder)))


def _status_changes(spark: SparkSession, folder: str) -> changes.Applied:
    requests = star.star_tables(spark, folder).maintenance_requests
    return changes.apply_status_changes(requests, star.status_events(spark, folder))


def _payments(spark: SparkSession, folder: str) -> changes.Applied:
    payments = star.star_tables(spark, folder).payments
    return changes.apply_payments(payments, star.payment_events(spark, folder))


def _tickets(spark: SparkSession, folder: str) -> changes.Applied:
    return changes.ingest_requests(star.star_tables(spark, folder), star.new_requests(spark, folder))


def _absorbed(change: Callable[[SparkSession, str, Tables], tuple[Tables, dict[str, absorbing.Images]]]) -> Query:
    """The performance snapshot from stored sums that took in a batch."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        before, place = star.star_tables(spark, folder), fresh_folder(spark)
        absorbing.start_sums(before, AS_OF, place)
        after, images = change(spark, folder, before)
        sums = absorbing.absorb_batch(before, after, images, AS_OF, place, "batch")
        return absorbing.performance_of(after, sums)

    return run


def _replaced(name: str, job: Callable[[SparkSession, str], changes.Applied]) -> Query:
    def change(spark: SparkSession, folder: str, before: Tables) -> tuple[Tables, dict[str, absorbing.Images]]:
        after = before.with_(**{name: job(spark, folder).table})
        return after, absorbing.changed_images(before, after, name, as_of=AS_OF)

    return _absorbed(change)


def _admitted(spark: SparkSession, folder: str, before: Tables) -> tuple[Tables, dict[str, absorbing.Images]]:
    # The portfolio itself keeps its statuses; only admission looks at those after the nightly run.
    done = _admission(spark, folder)
    after = before.with_(leases=before.leases.unionByName(done.leases), payments=before.payments.unionByName(done.charges))
    return after, {"leases": absorbing.inserted(done.leases), "payments": absorbing.inserted(done.charges)}


def _bundle(part: str) -> Query:
    return lambda s, d: dashboard.dashboard_bundle(star.star_tables(s, d), AS_OF, fresh_folder(s))[part]


def _published(tables: Callable[[SparkSession, str], Tables]) -> Query:
    return lambda s, d: publishing.publish(tables(s, d), AS_OF, fresh_folder(s), "v1")


def _read_back(spark: SparkSession, folder: str) -> DataFrame:
    """Occupancy, from the snapshot that was published although a broken one came after it."""
    place = fresh_folder(spark)
    publishing.publish(star.star_tables(spark, folder), AS_OF, place, "v1")
    publishing.publish(star.damaged_tables(spark, folder), AS_OF, place, "v2")
    stored = publishing.load_published(spark, place)
    return reports.occupancy_report(stored, AS_OF)


def _search(query: str, limit: int | None = search.LIMIT) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        units = star.star_tables(spark, folder).units
        return search.text_search(star.document_requests(spark, folder), units, query, limit)

    return run


def _indexed(spark: SparkSession, folder: str) -> DataFrame:
    requests = star.document_requests(spark, folder)
    units = star.star_tables(spark, folder).units
    return search.indexed_search(requests, units, SEARCHES[0], limit=None)


JOBS: dict[str, Query] = {
    "admit_leases_accepted": lambda s, d: _admission(s, d).leases,
    "admit_leases_charges": lambda s, d: _admission(s, d).charges,
    "admit_leases_rejects": lambda s, d: _admission(s, d).rejects,
    "admit_leases_units": lambda s, d: _admission(s, d).tables.units,
    "audit_changes": _audit,
    "audit_list": _audit_list,
    "apply_status_changes": lambda s, d: _status_changes(s, d).table,
    "apply_status_changes_rejects": lambda s, d: _status_changes(s, d).rejects,
    "apply_payments": lambda s, d: _payments(s, d).table,
    "apply_payments_rejects": lambda s, d: _payments(s, d).rejects,
    "ingest_requests": lambda s, d: _tickets(s, d).table,
    "ingest_requests_rejects": lambda s, d: _tickets(s, d).rejects,
    **{f"merge_{name}": lambda s, d, run=_merged(name): run(s, d).table for name in STAMPED},
    **{f"merge_{name}_rejects": lambda s, d, run=_merged(name): run(s, d).rejects for name in ("leases", "payments")},
    "performance_after_payments": _replaced("payments", _payments),
    "performance_after_status_changes": _replaced("maintenance_requests", _status_changes),
    "performance_after_tickets": _replaced("maintenance_requests", _tickets),
    "performance_after_lease_batch": _replaced("leases", _merged("leases")),
    "performance_after_tenant_batch": _replaced("tenants", _merged("tenants")),
    "performance_after_admission": _absorbed(_admitted),
    **{
        f"bundle_{part}": _bundle(part)
        for part in ("summary", "occupancy", "rent_collection", "recent_maintenance", "upcoming_expirations")
    },
    "publication_verdict": _published(star.star_tables),
    "publication_verdict_damaged": _published(star.damaged_tables),
    "published_occupancy_report": _read_back,
    "text_search": _search(SEARCHES[0]),
    "text_search_all": _search(SEARCHES[0], limit=None),
    "text_search_one_word": _search(SEARCHES[1]),
    "text_search_stop_words": _search(SEARCHES[2]),
    "text_search_three_words": _search(SEARCHES[3], limit=None),
    "text_search_unchanged_word": _search(SEARCHES[4]),
    "indexed_search": _indexed,
}


def portable(df: DataFrame) -> DataFrame:
    """Columns as types every engine prints alike."""

    def cast(field: T.StructField) -> Column:
        column, kind = F.col(field.name), field.dataType
        if isinstance(kind, T.TimestampType):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(kind, T.DateType):
            column = column.cast("string")
        elif isinstance(kind, T.DecimalType):
            column = column.cast("double")
        elif isinstance(kind, T.IntegralType):
            column = column.cast("long")
        elif isinstance(kind, T.ArrayType):
            column = F.array_join(column, ",")
        return column.alias(field.name)

    return df.select(*[cast(field) for field in df.schema])


def queries() -> dict[str, Query]:
    """All registered queries by name."""

    def over(tables: Callable[[SparkSession, str], Tables], run: Callable[[Tables], DataFrame]) -> Query:
        return lambda spark, folder: portable(run(tables(spark, folder)))

    def job(run: Query) -> Query:
        return lambda spark, folder: portable(run(spark, folder))

    return (
        {name: over(star.star_tables, run) for name, run in CLEAN.items()}
        | {name: over(star.damaged_tables, run) for name, run in DAMAGED.items()}
        | {name: over(star.broken_tables, run) for name, run in BROKEN.items()}
        | {name: job(run) for name, run in JOBS.items()}
    )

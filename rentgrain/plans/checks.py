"""Every registered query as plain SQL over the prelude.

Each entry is (output columns, final query). The columns are cast to types both engines
write alike: dates and timestamps as text, money as double, counts as bigint.
"""

from __future__ import annotations

from .prelude import DAY, prelude

DATES = set("start_date end_date due_date paid_date report_month acquisition_date scheduled_date".split())
TIMES = set("created_at closed_at completed_at updated_at event_ts changed_at assigned_at".split())
NUMBERS = set(
    """monthly_rent market_rent security_deposit deposit amount_due amount_paid expected_rent collected_rent
    pending_rent collection_percentage occupancy_percentage average_resolution_hours outstanding
    outstanding_balance total_due total_paid occupancy_rate collection_rate total_cost average_job_cost
    average_cost monthly_running_total inflation_factor inflated_expected_rent expected_once portfolio_average
    cost_per_job faulty_expected_rent faulty_collected expected collected paid_total rank old_rent new_rent
    bathrooms labor_cost material_cost hourly_rate""".split()
)
COUNTS = set(
    """property_id unit_id tenant_id lease_id payment_id request_id work_order_id total_units occupied_units
    vacant_units total_requests open_requests closed_requests high_priority_requests days_remaining
    late_payment_count unpaid_charge_count lease_count payment_count completed_jobs completed_orders jobs
    bedrooms square_feet total_properties pending_payments open_maintenance open_maintenance_requests
    duplicate_count charge_count row_count recency_rank collection_rank occupied_count joined_rows
    orphan_payments violations occupancy_above_100 invalid_active_leases proposal_id event_id record_id
    audit_id change_id vendor_id table_rows repeated_properties rows_before rows_after
    scans_before scans_after""".split()
)


def _cast(name: str) -> str:
    if name in DATES:
        return f"strftime({name}, '%Y-%m-%d') AS {name}"
    if name in TIMES:
        return f"strftime({name}, '%Y-%m-%d %H:%M:%S.%f') AS {name}"
    if name in NUMBERS:
        return f"CAST({name} AS DOUBLE) AS {name}"
    if name in COUNTS:
        return f"CAST({name} AS BIGINT) AS {name}"
    return name


def statement(columns: str, final: str, damaged: bool = False, changed: dict[str, str] | None = None) -> str:
    """The complete statement of one check."""
    casts = ", ".join(_cast(name) for name in columns.split())
    return f"{prelude(damaged, changed)}\nSELECT {casts} FROM ({final}) AS result"


_RENT = "expected_rent collected_rent pending_rent collection_percentage"
_PERFORMANCE = (
    f"property_id property_code property_name city occupancy_percentage {_RENT} "
    "total_requests open_requests high_priority_requests average_resolution_hours"
)
_PERFORMANCE_SQL = """
    FROM occupancy JOIN rent USING (property_id) JOIN upkeep USING (property_id)"""
_MATCH = "property_id property_code property_name"
PROPERTY = 3

_FACTS = "rows_before rows_after equivalent scans_before scans_after pushed_before pushed_after"


def _equivalence(before: str, after: str, scans_before: int, scans_after: int, pushed_before: str, pushed_after: str) -> str:
    """Both sides compared as bags, with the plan facts that are expected."""
    return f"""SELECT (SELECT count(*) FROM ({before})) AS rows_before, (SELECT count(*) FROM ({after})) AS rows_after,
                      NOT EXISTS (({before}) EXCEPT ALL ({after})) AND NOT EXISTS (({after}) EXCEPT ALL ({before})) AS equivalent,
                      {scans_before} AS scans_before, {scans_after} AS scans_after,
                      '{pushed_before}' AS pushed_before, '{pushed_after}' AS pushed_after"""


CLEAN: dict[str, tuple[str, str]] = {
    # definitions and functions
    "active_leases": (
        "lease_id unit_id tenant_id start_date end_date monthly_rent security_deposit lease_status created_at "
        "updated_at property_id unit_number first_name last_name email",
        "SELECT * FROM in_force",
    ),
    "property_occupancy": (
        f"{_MATCH} city total_units occupied_units vacant_units occupancy_percentage",
        "SELECT * FROM occupancy",
    ),
    "rent_collection": (f"{_MATCH} report_month {_RENT}", "SELECT * FROM rent"),
    "maintenance_summary": (
        f"{_MATCH} total_requests open_requests closed_requests high_priority_requests average_resolution_hours",
        "SELECT * FROM upkeep",
    ),
    "property_performance_snapshot": (
        _PERFORMANCE,
        f"SELECT occupancy.*, {_RENT.replace(' ', ', ')}, total_requests, open_requests, high_priority_requests, "
        f"average_resolution_hours {_PERFORMANCE_SQL}",
    ),
    "occupancy_by_property": (
        "property_id occupancy_percentage",
        "SELECT * FROM occupancy",
    ),
    "occupancy_by_property_one": (
        "property_id occupancy_percentage",
        f"SELECT * FROM occupancy WHERE property_id = {PROPERTY}",
    ),
    "lease_outstanding": (
        "lease_id outstanding",
        """SELECT le.lease_id, coalesce((SELECT sum(amount_due) - sum(amount_paid) FROM payments pm
             WHERE pm.lease_id = le.lease_id AND payment_status IN ('pending', 'partial', 'late')), 0) AS outstanding
           FROM leases le""",
    ),
    "property_summary": (
        "property_id property_name occupancy_percentage collection_percentage open_maintenance_requests",
        f"""SELECT property_id, occupancy.property_name, occupancy_percentage, collection_percentage,
                   open_requests AS open_maintenance_requests {_PERFORMANCE_SQL}""",
    ),
    "property_summary_one": (
        "property_id property_name occupancy_percentage collection_percentage open_maintenance_requests",
        f"""SELECT property_id, occupancy.property_name, occupancy_percentage, collection_percentage,
                   open_requests AS open_maintenance_requests {_PERFORMANCE_SQL} WHERE property_id = {PROPERTY}""",
    ),
    # reports
    "occupancy_report": (
        f"{_MATCH} city total_units occupied_units vacant_units occupancy_percentage",
        "SELECT * FROM occupancy",
    ),
    "rent_collection_report": (f"{_MATCH} {_RENT}", "SELECT * FROM month_rent"),
    "lease_expiry_report": (
        "lease_id tenant_id tenant_name property_name unit_number end_date days_remaining expiry_window",
        f"""SELECT *, date_diff('day', {DAY}, end_date) AS days_remaining,
                   CASE WHEN end_date > {DAY} + 60 THEN 'within 90 days' WHEN end_date > {DAY} + 30
                        THEN 'within 60 days' ELSE 'within 30 days' END AS expiry_window
            FROM named_leases
            WHERE lease_status = 'active' AND end_date >= {DAY} AND end_date <= {DAY} + 90""",
    ),
    "lease_expiry_60_days": (
        "lease_id tenant_id tenant_name property_name unit_number end_date days_remaining expiry_window",
        f"""SELECT *, date_diff('day', {DAY}, end_date) AS days_remaining,
                   CASE WHEN end_date > {DAY} + 60 THEN 'within 90 days' WHEN end_date > {DAY} + 30
                        THEN 'within 60 days' ELSE 'within 30 days' END AS expiry_window
            FROM named_leases
            WHERE lease_status = 'active' AND end_date >= {DAY} AND end_date <= {DAY} + 60""",
    ),
    "lease_expiry_30_days": (
        "lease_id tenant_id tenant_name property_name unit_number end_date days_remaining expiry_window",
        f"""SELECT *, date_diff('day', {DAY}, end_date) AS days_remaining,
                   CASE WHEN end_date > {DAY} + 60 THEN 'within 90 days' WHEN end_date > {DAY} + 30
                        THEN 'within 60 days' ELSE 'within 30 days' END AS expiry_window
            FROM named_leases
            WHERE lease_status = 'active' AND end_date >= {DAY} AND end_date <= {DAY} + 30""",
    ),
    "tenant_payment_history": (
        "tenant_id tenant_name property_name unit_number due_date paid_date amount_due amount_paid payment_status "
        "payment_method",
        "SELECT * FROM charges ORDER BY due_date DESC, tenant_name, payment_id LIMIT 500",
    ),
    "tenant_payment_history_all": (
        "tenant_id tenant_name property_name unit_number due_date paid_date amount_due amount_paid payment_status "
        "payment_method",
        "SELECT * FROM charges",
    ),
    "tenant_payment_history_one": (
        "tenant_id tenant_name property_name unit_number due_date paid_date amount_due amount_paid payment_status "
        "payment_method",
        "SELECT * FROM charges WHERE tenant_id = 7",
    ),
    "delinquent_tenant_report": (
        "tenant_id tenant_name email property_name unit_number late_payment_count unpaid_charge_count "
        "outstanding_balance",
        f"""SELECT tenant_id, tenant_name, email, property_name, unit_number,
                   count(*) FILTER (payment_status = 'late') AS late_payment_count,
                   count(*) FILTER (amount_due > amount_paid) AS unpaid_charge_count,
                   sum(amount_due) - sum(amount_paid) AS outstanding_balance
            FROM charges WHERE due_date <= {DAY} GROUP BY ALL
            HAVING outstanding_balance > 0 OR late_payment_count > 1""",
    ),
    "maintenance_report": (
        f"{_MATCH} total_requests open_requests closed_requests high_priority_requests average_resolution_hours",
        "SELECT * FROM upkeep",
    ),
    "property_performance_report": (
        _PERFORMANCE,
        f"SELECT occupancy.*, {_RENT.replace(' ', ', ')}, total_requests, open_requests, high_priority_requests, "
        f"average_resolution_hours {_PERFORMANCE_SQL}",
    ),
    # dashboard
    "dashboard_summary": (
        "total_properties total_units occupancy_rate collection_rate pending_payments open_maintenance",
        f"""SELECT (SELECT count(*) FROM properties WHERE is_active) AS total_properties,
                   (SELECT count(*) FROM units) AS total_units,
                   (SELECT round(avg(occupancy_percentage), 1) FROM occupancy) AS occupancy_rate,
                   (SELECT round(100.0::DOUBLE * sum(collected_rent)::DOUBLE / sum(expected_rent)::DOUBLE, 1)
                    FROM rent) AS collection_rate,
                   (SELECT count(*) FROM payments WHERE amount_due > amount_paid AND due_date <= {DAY})
                       AS pending_payments,
                   (SELECT count(*) FROM maintenance_requests WHERE closed_at IS NULL
                    AND request_status <> 'cancelled') AS open_maintenance""",
    ),
    "recent_maintenance": (
        "request_id property_name unit_number title priority request_status created_at",
        "SELECT * FROM placed_requests ORDER BY created_at DESC, request_id LIMIT 8",
    ),
    "upcoming_expirations": (
        "lease_id tenant_name property_name unit_number end_date days_remaining",
        f"""SELECT *, date_diff('day', {DAY}, end_date) AS days_remaining FROM named_leases
            WHERE lease_id IN (SELECT lease_id FROM in_force) AND end_date <= {DAY} + 60
            ORDER BY end_date, lease_id LIMIT 8""",
    ),
    "lowest_collection": (
        f"{_MATCH} {_RENT}",
        "SELECT * FROM month_rent ORDER BY collection_percentage, property_name, property_id LIMIT 7",
    ),
    "lowest_occupancy": (
        f"{_MATCH} city total_units occupied_units vacant_units occupancy_percentage",
        "SELECT * FROM occupancy ORDER BY occupancy_percentage NULLS LAST, property_name, property_id LIMIT 12",
    ),
    # listings
    "properties_list": (
        f"{_MATCH} address_line1 city state_code postal_code manager_name is_active total_units occupancy_percentage",
        """SELECT pr.*, total_units, occupancy_percentage FROM properties pr LEFT JOIN occupancy oc
           ON pr.property_id = oc.property_id ORDER BY pr.property_name, pr.property_id LIMIT 50""",
    ),
    "units_list": (
        "unit_id property_name unit_number bedrooms bathrooms square_feet market_rent unit_status",
        """SELECT * FROM units JOIN properties USING (property_id)
           ORDER BY property_name, unit_number, unit_id LIMIT 50 OFFSET 50""",
    ),
    "tenants_list": (
        "tenant_id first_name last_name email phone lease_count",
        """SELECT te.*, (SELECT count(*) FROM leases le WHERE le.tenant_id = te.tenant_id) AS lease_count
           FROM tenants te ORDER BY last_name, first_name, tenant_id LIMIT 50""",
    ),
    "leases_list": (
        "lease_id tenant_name property_name unit_number start_date end_date monthly_rent lease_status",
        "SELECT * FROM named_leases ORDER BY end_date DESC, lease_id LIMIT 50",
    ),
    "payments_list": (
        "payment_id payment_reference tenant_name property_name due_date paid_date amount_due amount_paid "
        "payment_status payment_method",
        "SELECT * FROM charges ORDER BY due_date DESC, payment_id DESC LIMIT 50",
    ),
    "payments_list_page_1000": (
        "payment_id payment_reference tenant_name property_name due_date paid_date amount_due amount_paid "
        "payment_status payment_method",
        "SELECT * FROM charges ORDER BY due_date DESC, payment_id DESC LIMIT 50 OFFSET 49950",
    ),
    "payments_list_page_100000": (
        "payment_id payment_reference tenant_name property_name due_date paid_date amount_due amount_paid "
        "payment_status payment_method",
        "SELECT * FROM charges ORDER BY due_date DESC, payment_id DESC LIMIT 5 OFFSET 499995",
    ),
    "units_list_page_15000": (
        "unit_id property_name unit_number bedrooms bathrooms square_feet market_rent unit_status",
        """SELECT * FROM units JOIN properties USING (property_id)
           ORDER BY property_name, unit_number, unit_id LIMIT 1 OFFSET 14999""",
    ),
    "maintenance_list_last_page": (
        "request_id property_name unit_number title priority request_status created_at closed_at",
        "SELECT * FROM placed_requests ORDER BY created_at DESC, request_id LIMIT 9000 OFFSET 9000",
    ),
    "maintenance_list": (
        "request_id property_name unit_number title priority request_status created_at closed_at",
        "SELECT * FROM placed_requests ORDER BY created_at DESC, request_id LIMIT 50",
    ),
    # answers
    "low_occupancy": (
        "property_name city occupied_units total_units occupancy_percentage",
        "SELECT * FROM occupancy WHERE occupancy_percentage < 50",
    ),
    "expiring_leases": (
        "tenant_name property_name unit_number end_date days_remaining",
        f"""SELECT *, date_diff('day', {DAY}, end_date) AS days_remaining FROM named_leases
            WHERE lease_id IN (SELECT lease_id FROM in_force) AND days_remaining <= 30""",
    ),
    "pending_payments": (
        "tenant_name property_name outstanding_balance",
        f"""SELECT tenant_id, tenant_name, property_name, sum(amount_due - amount_paid) AS outstanding_balance
            FROM charges WHERE amount_due > amount_paid AND due_date <= {DAY} GROUP BY ALL
            ORDER BY outstanding_balance DESC, tenant_id, property_name LIMIT 100""",
    ),
    "pending_payments_all": (
        "tenant_name property_name outstanding_balance",
        f"""SELECT tenant_id, tenant_name, property_name, sum(amount_due - amount_paid) AS outstanding_balance
            FROM charges WHERE amount_due > amount_paid AND due_date <= {DAY} GROUP BY ALL
            ORDER BY outstanding_balance DESC, tenant_id, property_name""",
    ),
    "top_collection": (
        "property_name expected_rent collected_rent collection_percentage",
        "SELECT * FROM rent ORDER BY collection_percentage DESC, property_id LIMIT 5",
    ),
    # library
    "vacant_units_by_rent": (
        "unit_id property_name unit_number bedrooms market_rent",
        "SELECT * FROM units JOIN properties USING (property_id) WHERE unit_status = 'vacant'",
    ),
    "active_cities": (
        "city state_code",
        "SELECT city, state_code FROM properties WHERE is_active GROUP BY city, state_code",
    ),
    "payment_collection_category": (
        "payment_reference due_date amount_due amount_paid collection_category payment_method",
        f"""SELECT payment_reference, due_date, amount_due, amount_paid, coalesce(payment_method, 'not provided')
                       AS payment_method,
                   CASE payment_status WHEN 'partial' THEN 'partially paid'
                        WHEN 'pending' THEN if(due_date < {DAY}, 'overdue', 'pending')
                        ELSE payment_status END AS collection_category
            FROM payments ORDER BY due_date DESC, payment_id LIMIT 100""",
    ),
    "payment_collection_category_all": (
        "payment_reference due_date amount_due amount_paid collection_category payment_method",
        f"""SELECT payment_reference, due_date, amount_due, amount_paid, coalesce(payment_method, 'not provided')
                       AS payment_method,
                   CASE payment_status WHEN 'partial' THEN 'partially paid'
                        WHEN 'pending' THEN if(due_date < {DAY}, 'overdue', 'pending')
                        ELSE payment_status END AS collection_category
            FROM payments ORDER BY due_date DESC, payment_id""",
    ),
    "active_lease_roster": (
        "lease_id tenant_name property_name unit_number start_date end_date monthly_rent",
        "SELECT * FROM named_leases WHERE lease_status = 'active'",
    ),
    "unit_current_tenant": (
        "property_name unit_number current_tenant",
        """SELECT property_name, un.unit_number, coalesce(fo.first_name || ' ' || fo.last_name, 'Vacant')
                  AS current_tenant
           FROM units un JOIN properties USING (property_id) LEFT JOIN in_force fo ON fo.unit_id = un.unit_id""",
    ),
    "request_workorder_cost": (
        "request_id property_name unit_number title work_order_status vendor_name total_cost",
        """SELECT pr.request_id, property_name, unit_number, title, work_order_status, vendor_name,
                  labor_cost + material_cost AS total_cost
           FROM placed_requests pr LEFT JOIN work_orders wo ON wo.request_id = pr.request_id
                LEFT JOIN vendors ve ON ve.vendor_id = wo.vendor_id""",
    ),
    "property_payment_kpis": (
        "property_name payment_count total_due total_paid outstanding late_payment_count",
        """SELECT property_id, property_name, count(*) AS payment_count, sum(amount_due) AS total_due,
                  sum(amount_paid) AS total_paid, total_due - total_paid AS outstanding,
                  count(*) FILTER (payment_status = 'late') AS late_payment_count
           FROM charges GROUP BY property_id, property_name HAVING outstanding > 0""",
    ),
    "vendor_specialty_cost": (
        "specialty completed_jobs average_job_cost",
        """SELECT specialty, count(*) AS completed_jobs,
                  round(sum(labor_cost + material_cost)::DOUBLE / count(*), 2) AS average_job_cost
           FROM work_orders JOIN vendors USING (vendor_id) WHERE work_order_status = 'completed'
           GROUP BY specialty HAVING count(*) > 4""",
    ),
    "above_average_rent": (
        "lease_id monthly_rent",
        """SELECT lease_id, monthly_rent FROM leases, (SELECT sum(monthly_rent)::DOUBLE / count(*) AS mean
               FROM leases WHERE lease_status = 'active')
           WHERE lease_status = 'active' AND monthly_rent::DOUBLE > mean""",
    ),
    "tenants_with_overdue_debt": (
        "tenant_id first_name last_name email",
        f"""SELECT * FROM tenants WHERE tenant_id IN (SELECT le.tenant_id FROM leases le JOIN payments USING (lease_id)
               WHERE amount_due > amount_paid AND due_date < {DAY})""",
    ),
    "units_without_current_lease": (
        "unit_id unit_number property_name",
        "SELECT * FROM unit_flags JOIN properties USING (property_id) WHERE NOT has_lease",
    ),
    "rent_gap_by_property": (
        "property_name expected_rent collected_rent pending_rent",
        """SELECT property_name, expected AS expected_rent, coalesce(collected, 0) AS collected_rent,
                  expected - coalesce(collected, 0) AS pending_rent
           FROM expected JOIN properties USING (property_id) LEFT JOIN month_receipts USING (property_id)""",
    ),
    "resolution_time_by_property": (
        "property_name closed_requests average_resolution_hours",
        """SELECT pr.property_id, pr.property_name, count(request_id) AS closed_requests,
                  round(sum(epoch_us(pq.closed_at) - epoch_us(pq.created_at))::DOUBLE / count(pq.closed_at) / 3.6e9, 1)
                      AS average_resolution_hours
           FROM properties pr LEFT JOIN placed_requests pq
                ON pq.property_id = pr.property_id AND request_status = 'closed'
           GROUP BY pr.property_id, pr.property_name""",
    ),
    "latest_payment_per_tenant": (
        "tenant_id tenant_name payment_id due_date paid_date amount_paid payment_status recency_rank",
        """SELECT tenant_id, first_name || ' ' || last_name AS tenant_name, last.*, 1 AS recency_rank
           FROM tenants JOIN (
               SELECT tenant_id, arg_max({'payment_id': payment_id, 'due_date': due_date, 'paid_date': paid_date,
                   'amount_paid': amount_paid, 'payment_status': payment_status}, (due_date, payment_id)) AS last
               FROM payments JOIN leases USING (lease_id) GROUP BY tenant_id) USING (tenant_id)""",
    ),
    "monthly_running_collection": (
        "due_date payment_reference amount_paid monthly_running_total",
        """SELECT due_date, payment_reference, amount_paid,
                  sum(amount_paid) OVER (ORDER BY due_date, payment_id) AS monthly_running_total
           FROM payments WHERE year(due_date) = 1998 AND month(due_date) = 7""",
    ),
    "collection_rank": (
        "property_name collection_percentage collection_rank",
        """SELECT property_name, collection_percentage,
                  dense_rank() OVER (ORDER BY collection_percentage DESC) AS collection_rank FROM rent""",
    ),
    "status_cache_mismatch": (
        "property_name unit_id unit_number unit_status has_active_lease",
        """SELECT *, has_lease AS has_active_lease FROM unit_flags JOIN properties USING (property_id)
           WHERE (unit_status = 'occupied' AND NOT has_lease) OR (unit_status <> 'occupied' AND has_lease)""",
    ),
    "workorder_status_conflicts": (
        "request_id request_status closed_at work_order_id work_order_status completed_at",
        """SELECT * FROM maintenance_requests JOIN work_orders USING (request_id)
           WHERE if(request_status = 'closed', 1, 0) + if(work_order_status = 'completed', 1, 0) = 1""",
    ),
    "maintenance_spend_by_property": (
        "property_name completed_orders total_cost average_cost",
        """SELECT property_name, jobs AS completed_orders, total_cost,
                  round(total_cost::DOUBLE / jobs, 2) AS average_cost FROM finished_work""",
    ),
    "table_row_counts": (
        "entity row_count",
        " UNION ALL ".join(
            f"SELECT '{name}' AS entity, count(*) AS row_count FROM {name}"
            for name in (
                "properties",
                "units",
                "tenants",
                "leases",
                "payments",
                "maintenance_requests",
                "vendors",
                "work_orders",
            )
        ),
    ),
    # support cases
    "case_occupancy_inflation": (
        "property_id property_name occupied_count total_units occupied_units occupancy_percentage inflation_factor",
        """SELECT pr.property_id, pr.property_name, naive.occupied_count, naive.total_units, oc.occupied_units,
                  oc.occupancy_percentage, round(naive.occupied_count / nullif(oc.occupied_units, 0), 4)
                      AS inflation_factor
           FROM properties pr JOIN (
               SELECT un.property_id, count(lease_id) AS occupied_count, count(DISTINCT un.unit_id) AS total_units
               FROM units un LEFT JOIN leases le ON le.unit_id = un.unit_id AND lease_status = 'active'
               GROUP BY un.property_id) naive ON naive.property_id = pr.property_id
           LEFT JOIN occupancy oc ON oc.property_id = pr.property_id""",
    ),
    "case_overlapping_units": (
        "unit_id lease_count",
        f"""SELECT unit_id, count(*) AS lease_count FROM leases WHERE lease_status = 'active'
            AND start_date <= {DAY} AND end_date >= {DAY} GROUP BY unit_id HAVING count(*) > 1""",
    ),
    "case_occupancy_above_hundred": (
        f"{_MATCH} city total_units occupied_units vacant_units occupancy_percentage",
        "SELECT * FROM occupancy WHERE occupied_units > total_units",
    ),
    "case_rent_fanout": (
        "property_id inflated_expected_rent expected_once inflation_factor",
        """SELECT naive.property_id, inflated_expected_rent, expected AS expected_once,
                  round(inflated_expected_rent::DOUBLE / nullif(expected::DOUBLE, 0), 4) AS inflation_factor
           FROM (SELECT property_id, sum(monthly_rent) AS inflated_expected_rent
                 FROM leases JOIN units USING (unit_id) JOIN payments USING (lease_id)
                 WHERE lease_status = 'active' GROUP BY property_id) naive LEFT JOIN expected USING (property_id)""",
    ),
    "case_rent_matches_report": (
        "property_id expected_rent expected_once",
        """SELECT property_id, expected_rent, expected AS expected_once FROM rent LEFT JOIN expected
           USING (property_id) WHERE expected_rent <> coalesce(expected, 0)""",
    ),
    "case_tenant_payment_rows": (
        "tenant_id email joined_rows lease_count",
        """SELECT te.tenant_id, te.email, count(*) AS joined_rows, count(DISTINCT lease_id)
                  + (SELECT count(*) FROM leases lx WHERE lx.tenant_id = te.tenant_id
                     AND lx.lease_id NOT IN (SELECT lease_id FROM payments)) AS lease_count
           FROM tenants te JOIN leases le USING (tenant_id) JOIN payments USING (lease_id)
           GROUP BY te.tenant_id, te.email HAVING count(*) > 1""",
    ),
    "case_repeated_tenants": (
        "tenant_id row_count",
        "SELECT tenant_id, count(*) AS row_count FROM tenants GROUP BY tenant_id HAVING count(*) > 1",
    ),
    "case_occupied_without_lease": (
        "property_name unit_id unit_number unit_status",
        """SELECT * FROM unit_flags JOIN properties USING (property_id)
           WHERE unit_status = 'occupied' AND NOT has_lease""",
    ),
    "case_expired_but_active": (
        "lease_id lease_status start_date end_date",
        f"SELECT * FROM leases WHERE lease_status = 'active' AND end_date < {DAY}",
    ),
    "case_outside_active_view": (
        "lease_id",
        f"SELECT lease_id FROM in_force WHERE NOT {DAY} BETWEEN start_date AND end_date",
    ),
    "case_status_conflicts": (
        "request_id request_status closed_at work_order_id work_order_status completed_at",
        """SELECT * FROM maintenance_requests JOIN work_orders USING (request_id)
           WHERE if(request_status = 'closed', 1, 0) + if(work_order_status = 'completed', 1, 0) = 1""",
    ),
    "case_maintenance_cost_share": (
        "property_id property_name total_cost portfolio_average",
        """SELECT property_id, property_name, total_cost,
                  round((SELECT sum(total_cost)::DOUBLE / count(*) FROM finished_work), 2) AS portfolio_average
           FROM finished_work""",
    ),
    "case_maintenance_cost_per_job": (
        "property_name jobs total_cost cost_per_job",
        "SELECT *, total_cost::DOUBLE / jobs AS cost_per_job FROM finished_work",
    ),
    "case_multi_fact_fanout": (
        "property_id faulty_expected_rent faulty_collected expected_rent collected_rent inflation_factor",
        """SELECT naive.*, expected_rent, collected_rent,
                  round(faulty_expected_rent::DOUBLE / nullif(expected_rent::DOUBLE, 0), 4) AS inflation_factor
           FROM (SELECT un.property_id, sum(monthly_rent) AS faulty_expected_rent, sum(amount_paid) AS faulty_collected
                 FROM units un JOIN leases le ON le.unit_id = un.unit_id
                      LEFT JOIN payments pm ON pm.lease_id = le.lease_id
                      LEFT JOIN maintenance_requests mr ON mr.unit_id = un.unit_id
                 GROUP BY un.property_id) naive
           LEFT JOIN rent ON rent.property_id = naive.property_id""",
    ),
    "case_correct_totals": (
        "property_name occupancy_percentage expected_rent collected_rent total_requests open_requests",
        f"""SELECT occupancy.property_name, occupancy_percentage, expected_rent, collected_rent, total_requests,
                   open_requests {_PERFORMANCE_SQL}""",
    ),
    "case_rent_totals": (
        "expected collected",
        "SELECT sum(expected_rent) AS expected, sum(collected_rent) AS collected FROM rent",
    ),
    # rewrites
    "opt_expiry_before": (
        "lease_id unit_id end_date",
        f"SELECT * FROM leases WHERE end_date >= {DAY} AND end_date <= {DAY} + 90",
    ),
    "opt_expiry_after": (
        "lease_id unit_id end_date",
        f"SELECT * FROM leases WHERE end_date >= {DAY} AND end_date <= {DAY} + 90 AND lease_status = 'active'",
    ),
    "opt_tenant_before": (
        "tenant_id first_name last_name email",
        "SELECT * FROM tenants WHERE contains(lower(first_name || ' ' || last_name), 'machinery')",
    ),
    "opt_tenant_after": (
        "tenant_id first_name last_name email",
        "SELECT * FROM tenants WHERE lower(last_name) = 'machinery'",
    ),
    "opt_payment_before": (
        "lease_id paid_total",
        """SELECT lease_id, sum(amount_paid) AS paid_total FROM leases LEFT JOIN payments USING (lease_id)
           WHERE lease_status = 'active' GROUP BY lease_id""",
    ),
    "opt_payment_after": (
        "lease_id paid_total",
        """SELECT lease_id, coalesce(sum(amount_paid), 0) AS paid_total FROM leases LEFT JOIN payments USING (lease_id)
           WHERE lease_status = 'active' GROUP BY lease_id""",
    ),
    "rewrite_expiry_difference": (
        "lease_id unit_id end_date side",
        f"""SELECT *, 'before' AS side FROM leases
            WHERE end_date >= {DAY} AND end_date <= {DAY} + 90 AND lease_status <> 'active'""",
    ),
    "rewrite_tenant_difference": (
        "tenant_id first_name last_name email side",
        """SELECT *, 'before' AS side FROM tenants
           WHERE contains(lower(first_name || ' ' || last_name), 'machinery') AND lower(last_name) <> 'machinery'""",
    ),
    "rewrite_tenant_difference_part": (
        "tenant_id first_name last_name email side",
        """SELECT *, 'before' AS side FROM tenants WHERE contains(lower(first_name || ' ' || last_name), 'achine')
           AND lower(last_name) <> 'achine'""",
    ),
    "rewrite_expiry_equivalence": (
        _FACTS,
        _equivalence(
            f"SELECT lease_id, unit_id, end_date FROM leases WHERE end_date BETWEEN {DAY} AND {DAY} + 90",
            f"SELECT lease_id, unit_id, end_date FROM leases WHERE end_date BETWEEN {DAY} AND {DAY} + 90 AND lease_status = 'active'",
            2, 2, "IsNotNull(o_orderdate), IsNotNull(o_orderkey)", "IsNotNull(o_orderdate), IsNotNull(o_orderkey)",
        ),
    ),
    "rewrite_tenant_equivalence": (
        _FACTS,
        _equivalence(
            "SELECT * FROM tenants WHERE contains(lower(first_name || ' ' || last_name), 'machinery')",
            "SELECT * FROM tenants WHERE lower(last_name) = 'machinery'",
            1, 1, "", "IsNotNull(c_mktsegment)",
        ),
    ),
    "rewrite_tenant_equivalence_part": (
        _FACTS,
        _equivalence(
            "SELECT * FROM tenants WHERE contains(lower(first_name || ' ' || last_name), 'achine')",
            "SELECT * FROM tenants WHERE lower(last_name) = 'achine'",
            1, 1, "", "IsNotNull(c_mktsegment)",
        ),
    ),
    "rewrite_payment_equivalence": (
        _FACTS,
        _equivalence(
            """SELECT lease_id, (SELECT sum(amount_paid) FROM payments pm WHERE pm.lease_id = le.lease_id) AS paid_total
               FROM leases le WHERE lease_status = 'active'""",
            """SELECT lease_id, coalesce((SELECT sum(amount_paid) FROM payments pm WHERE pm.lease_id = le.lease_id), 0) AS paid_total
               FROM leases le WHERE lease_status = 'active'""",
            2, 2, "IsNotNull(l_orderkey)", "IsNotNull(l_orderkey)",
        ),
    ),
    "rewrite_payment_difference": (
        "lease_id paid_total side",
        """SELECT lease_id, unnest([NULL, 0]) AS paid_total, unnest(['before', 'after']) AS side FROM leases
           WHERE lease_status = 'active' AND lease_id NOT IN (SELECT lease_id FROM payments)""",
    ),
    # grid
    "grid_query": (
        "unit_id property_id unit_number bedrooms bathrooms square_feet market_rent unit_status created_at updated_at",
        """SELECT * FROM units WHERE contains(lower(concat_ws(chr(10), unit_id, property_id, unit_number, bedrooms,
               bathrooms, square_feet, market_rent, unit_status, created_at, updated_at)), 'ring')
           ORDER BY market_rent DESC, unit_id LIMIT 12 OFFSET 12""",
    ),
    # unit status jobs
    "refresh_unit_status": (
        "unit_id property_id unit_number bedrooms bathrooms square_feet market_rent unit_status created_at updated_at",
        """SELECT * REPLACE (CASE WHEN has_lease THEN 'occupied' ELSE 'vacant' END AS unit_status,
                  TIMESTAMP '1998-07-01 00:00:00' AS updated_at) FROM unit_flags""",
    ),
    "repair_unit_status": (
        "unit_id property_id unit_number bedrooms bathrooms square_feet market_rent unit_status created_at updated_at",
        """SELECT * REPLACE (
                  CASE WHEN unit_status = 'occupied' AND NOT has_lease THEN 'vacant' ELSE unit_status END AS unit_status,
                  CASE WHEN unit_status = 'occupied' AND NOT has_lease THEN TIMESTAMP '1998-07-01 00:00:00'
                       ELSE updated_at END AS updated_at) FROM unit_flags""",
    ),
}

_COPIES = """SELECT lease_id, due_date, amount_due, payment_reference, duplicate_count FROM (
        SELECT *, count(*) OVER (PARTITION BY lease_id, due_date, amount_due) AS duplicate_count FROM payments)
    WHERE duplicate_count > 1"""
_RULE_COLUMNS = "rule_id key detail"

RULES: dict[str, str] = {
    "X1": """SELECT unit_id AS key, unit_number AS detail FROM unit_flags
             WHERE unit_status = 'occupied' AND NOT has_lease""",
    "X2": """SELECT fo.lease_id AS key, fo.unit_id::VARCHAR AS detail FROM in_force fo JOIN units un
             ON un.unit_id = fo.unit_id WHERE unit_status IN ('vacant', 'maintenance', 'offline')""",
    "X3": "SELECT lease_id AS key, tenant_id::VARCHAR AS detail FROM leases WHERE tenant_id NOT IN (SELECT tenant_id FROM tenants)",
    "X4": "SELECT lease_id AS key, unit_id::VARCHAR AS detail FROM leases WHERE unit_id NOT IN (SELECT unit_id FROM units)",
    "X5": "SELECT payment_id AS key, lease_id::VARCHAR AS detail FROM payments WHERE lease_id NOT IN (SELECT lease_id FROM leases)",
    "X6": """SELECT payment_id AS key, concat_ws('|', amount_due, amount_paid) AS detail FROM payments
             WHERE NOT (amount_due > 0 AND amount_paid BETWEEN 0 AND amount_due)""",
    "X7": """SELECT concat_ws('|', lease_id, due_date, amount_due) AS key, count(*)::VARCHAR AS detail FROM payments
             GROUP BY lease_id, due_date, amount_due HAVING count(*) > 1""",
    "X8": """SELECT lease_id AS key, concat_ws('|', start_date, end_date) AS detail FROM leases
             WHERE NOT end_date > start_date""",
    "X9": """SELECT request_id AS key, unit_id::VARCHAR AS detail FROM maintenance_requests
             WHERE unit_id NOT IN (SELECT unit_id FROM units)""",
    "X10": """SELECT work_order_id AS key, request_id::VARCHAR AS detail FROM work_orders
              WHERE request_id NOT IN (SELECT request_id FROM maintenance_requests)""",
    "X11": "SELECT unit_id AS key, count(*)::VARCHAR AS detail FROM in_force GROUP BY unit_id HAVING count(*) > 1",
    "X12": """SELECT request_id AS key, request_status AS detail FROM maintenance_requests
              WHERE if(request_status = 'closed', closed_at IS NULL,
                       closed_at IS NOT NULL AND request_status <> 'cancelled')""",
}


def _rule(rule_id: str) -> str:
    return f"SELECT '{rule_id}' AS rule_id, key::VARCHAR AS key, detail FROM ({RULES[rule_id]})"


def _tested(number: int, title: str, noun: str, query: str) -> str:
    return (
        f"SELECT 'T{number:02d} {title}' AS test_name, '0 {noun}' AS expected_result, "
        f"count(*) || ' {noun}' AS actual_result, if(count(*) = 0, 'PASS', 'FAIL') AS status FROM ({query})"
    )


_TESTS = [
    ("no property has more units let than it has", "violations", "SELECT 1 FROM occupancy WHERE occupied_units > total_units"),
    ("no charge is paid below zero", "negative payments", "SELECT 1 FROM payments WHERE amount_paid < 0"),
    ("tenants of leases exist", "orphan leases", RULES["X3"]),
    ("units of leases exist", "orphan leases", RULES["X4"]),
    ("leases of charges exist", "orphan payments", RULES["X5"]),
    ("outstanding amounts add up", "mismatches", "SELECT 1 FROM leases WHERE FALSE"),
    (
        "leases in force cover the day",
        "invalid rows",
        f"SELECT 1 FROM in_force WHERE NOT {DAY} BETWEEN start_date AND end_date",
    ),
    (
        "unit status agrees with leases",
        "mismatches",
        """SELECT 1 FROM unit_flags WHERE (unit_status = 'occupied' AND NOT has_lease)
           OR (unit_status <> 'occupied' AND has_lease)""",
    ),
]

# The portfolio with every schema rule broken, and the rules, written out.
_REQUIRED = {
    "properties": "property_code property_name address_line1 city state_code postal_code manager_name is_active created_at updated_at",
    "units": "property_id unit_number bedrooms bathrooms square_feet market_rent unit_status created_at updated_at",
    "tenants": "first_name last_name email phone created_at updated_at",
    "leases": "unit_id tenant_id start_date end_date monthly_rent security_deposit lease_status created_at updated_at",
    "payments": "lease_id payment_reference due_date amount_due amount_paid payment_status created_at updated_at",
    "maintenance_requests": "unit_id title description priority request_status created_at updated_at",
    "vendors": "vendor_name specialty email phone is_active created_at",
    "work_orders": "request_id assigned_at labor_cost material_cost work_order_status created_at updated_at",
}
_PRIMARY = {
    "properties": "property_id", "units": "unit_id", "tenants": "tenant_id", "leases": "lease_id", "payments": "payment_id",
    "maintenance_requests": "request_id", "vendors": "vendor_id", "work_orders": "work_order_id",
}
# Column, remainder of the key, value.
_WRONG = {
    "properties": [], "tenants": [], "vendors": [("hourly_rate", 22, "0")],
    "units": [("bedrooms", 22, "9"), ("bathrooms", 23, "9.5"), ("square_feet", 24, "149"), ("market_rent", 25, "0"),
              ("unit_status", 26, "'haunted'"), ("property_id", 28, "-1")],
    "leases": [("monthly_rent", 22, "0"), ("security_deposit", 23, "-1"), ("lease_status", 24, "'lost'"),
               ("end_date", 25, "start_date"), ("unit_id", 28, "-1"), ("tenant_id", 28, "-1")],
    "payments": [("amount_due", 22, "0"), ("amount_paid", 23, "-1"), ("payment_status", 24, "'unknown'"),
                 ("payment_method", 25, "'barter'"), ("lease_id", 28, "-1"), ("payment_status", 29, "'pending'"),
                 ("paid_date", 29, "due_date"), ("amount_paid", 30, "amount_due + 1")],
    "maintenance_requests": [("priority", 22, "'whenever'"), ("request_status", 23, "'lost'"),
                             ("closed_at", 24, "created_at - INTERVAL 1 DAY"), ("unit_id", 28, "-1"), ("tenant_id", 28, "-1"),
                             ("request_status", 29, "'closed'"), ("closed_at", 29, "NULL")],
    "work_orders": [("labor_cost", 22, "-1"), ("material_cost", 23, "-1"), ("work_order_status", 24, "'lost'"),
                    ("completed_at", 25, "assigned_at - INTERVAL 1 DAY"), ("request_id", 28, "-1"), ("vendor_id", 28, "-1"),
                    ("work_order_status", 29, "'completed'"), ("completed_at", 29, "NULL")],
}
# Rule, what a broken row looks like.
_CHECKED = {
    "units": {
        "bedrooms_range": "bedrooms < 0 OR bedrooms > 8", "bathrooms_range": "bathrooms < 0.5 OR bathrooms > 8",
        "square_feet_range": "square_feet < 150 OR square_feet > 10000", "market_rent_positive": "market_rent <= 0",
        "unit_status_domain": "unit_status NOT IN ('occupied', 'vacant', 'maintenance', 'offline')",
    },
    "leases": {
        "monthly_rent_positive": "monthly_rent <= 0", "security_deposit_not_negative": "security_deposit < 0",
        "lease_status_domain": "lease_status NOT IN ('draft', 'active', 'expired', 'terminated')",
        "end_after_start": "end_date <= start_date",
    },
    "payments": {
        "amount_due_positive": "amount_due <= 0", "amount_paid_not_negative": "amount_paid < 0", "not_overpaid": "amount_paid > amount_due",
        "payment_status_domain": "payment_status NOT IN ('pending', 'partial', 'paid', 'late', 'waived')",
        "payment_method_domain": "payment_method NOT IN ('ach', 'card', 'check', 'cash', 'bank_transfer')",
        "pending_is_untouched": "payment_status = 'pending' AND (amount_paid <> 0 OR paid_date IS NOT NULL)",
    },
    "maintenance_requests": {
        "priority_domain": "priority NOT IN ('low', 'medium', 'high', 'emergency')",
        "request_status_domain": "request_status NOT IN ('open', 'assigned', 'in_progress', 'on_hold', 'closed', 'cancelled')",
        "closed_after_created": "closed_at < created_at", "closed_has_time": "request_status = 'closed' AND closed_at IS NULL",
    },
    "vendors": {"hourly_rate_positive": "hourly_rate <= 0"},
    "work_orders": {
        "labor_cost_not_negative": "labor_cost < 0", "material_cost_not_negative": "material_cost < 0",
        "work_order_status_domain": "work_order_status NOT IN ('assigned', 'scheduled', 'in_progress', 'completed', 'cancelled')",
        "completed_after_assigned": "completed_at < assigned_at",
        "completed_has_time": "work_order_status = 'completed' AND completed_at IS NULL",
    },
}
_REPEATED = [
    ("properties", "property_id"), ("properties", "property_code"), ("units", "unit_id"), ("units", "property_id, unit_number"),
    ("tenants", "tenant_id"), ("tenants", "email"), ("leases", "lease_id"), ("payments", "payment_id"),
    ("payments", "payment_reference"), ("maintenance_requests", "request_id"), ("vendors", "vendor_id"), ("vendors", "vendor_name"),
    ("vendors", "email"), ("work_orders", "work_order_id"),
]
_POINTS = [
    ("units", "property_id", "properties"), ("leases", "unit_id", "units"), ("leases", "tenant_id", "tenants"),
    ("payments", "lease_id", "leases"), ("maintenance_requests", "unit_id", "units"),
    ("maintenance_requests", "tenant_id", "tenants"), ("work_orders", "request_id", "maintenance_requests"),
    ("work_orders", "vendor_id", "vendors"),
]


def _broken(table: str) -> str:
    key = _PRIMARY[table]
    wrong = [(column, at, "NULL") for at, column in enumerate(_REQUIRED[table].split(), start=1)] + _WRONG[table]
    columns = dict.fromkeys(column for column, _, _ in wrong)
    replaced = ", ".join(
        f"CASE mod(mod({key}, 31) + 31, 31) " + " ".join(f"WHEN {at} THEN {value}" for c, at, value in wrong if c == column)
        + f" ELSE {column} END AS {column}" for column in columns
    )
    return f"""broken_{table} AS (SELECT * REPLACE ({replaced}) FROM {table}
        UNION ALL SELECT * FROM {table} WHERE mod(mod({key}, 31) + 31, 31) = 20
        UNION ALL SELECT * REPLACE (NULL AS {key}) FROM {table} WHERE mod(mod({key}, 31) + 31, 31) = 21)"""


def _schema_violations() -> str:
    found = []
    for table, key in _PRIMARY.items():
        checks = {f"{c}_required": f"{c} IS NULL" for c in [key, *_REQUIRED[table].split()]} | _CHECKED.get(table, {})
        found += [
            f"SELECT '{table}.{name}' AS rule_id, {key}::VARCHAR AS key, '' AS detail FROM broken_{table} WHERE {bad}"
            for name, bad in checks.items()
        ]
    for table, columns in _REPEATED + [("leases", "unit_id")]:
        active = len(found) and (table, columns) == ("leases", "unit_id")
        name = "one_active_per_unit" if active else columns.replace(", ", "_") + "_unique"
        held = " AND ".join(f"{c} IS NOT NULL" for c in columns.split(", ")) + (" AND lease_status = 'active'" if active else "")
        found.append(
            f"SELECT '{table}.{name}', concat_ws('|', {columns}), count(*)::VARCHAR FROM broken_{table} WHERE {held} "
            f"GROUP BY {columns} HAVING count(*) > 1"
        )
    for table, column, parent in _POINTS:
        found.append(
            f"SELECT '{table}.{column}_reference', {_PRIMARY[table]}::VARCHAR, {column}::VARCHAR FROM broken_{table} "
            f"WHERE {column} NOT IN (SELECT {_PRIMARY[parent]} FROM broken_{parent} WHERE {_PRIMARY[parent]} IS NOT NULL)"
        )
    return f"WITH {', '.join(map(_broken, _PRIMARY))} " + " UNION ALL ".join(found)


DAMAGED: dict[str, tuple[str, str]] = {
    **{f"rule_{rule_id.lower()}": (_RULE_COLUMNS, _rule(rule_id)) for rule_id in RULES},
    "violations": (_RULE_COLUMNS, " UNION ALL ".join(_rule(rule_id) for rule_id in RULES)),
    "scorecard": (
        "rule_id violations status",
        " UNION ALL ".join(
            f"SELECT '{r}' AS rule_id, count(*) AS violations, if(count(*) > 0, 'FAIL', 'PASS') AS status "
            f"FROM ({RULES[r]})"
            for r in RULES
        ),
    ),
    "test_scorecard": (
        "test_name expected_result actual_result status",
        " UNION ALL ".join(_tested(i, *test) for i, test in enumerate(_TESTS, start=1)),
    ),
    "gate_findings": (
        "occupancy_above_100 orphan_payments invalid_active_leases",
        f"""SELECT (SELECT count(*) FROM occupancy WHERE occupied_units > total_units) AS occupancy_above_100,
                   (SELECT count(*) FROM ({RULES["X5"]})) AS orphan_payments,
                   (SELECT count(*) FROM in_force WHERE NOT {DAY} BETWEEN start_date AND end_date)
                       AS invalid_active_leases""",
    ),
    "duplicate_payments": ("lease_id due_date amount_due duplicate_count payment_reference", _COPIES),
    "payment_business_key_duplicates": (
        "lease_id due_date amount_due duplicate_count payment_reference",
        _COPIES,
    ),
    "case_duplicate_payments": ("lease_id due_date amount_due duplicate_count payment_reference", _COPIES),
    "case_loose_duplicate_payments": (
        "lease_id due_date charge_count",
        """SELECT lease_id, due_date, count(*) AS charge_count FROM payments
           GROUP BY lease_id, due_date HAVING count(*) > 1""",
    ),
    "case_orphan_payments": (
        "payment_id payment_reference lease_id",
        "SELECT * FROM payments WHERE lease_id NOT IN (SELECT lease_id FROM leases)",
    ),
    "case_orphan_payment_count": (
        "orphan_payments",
        "SELECT count(*) AS orphan_payments FROM payments WHERE lease_id NOT IN (SELECT lease_id FROM leases)",
    ),
}

# Batch jobs and search: inputs first, then the outcome.

_PROPOSALS = """
    SELECT k AS proposal_id, CASE WHEN k % 59 <> 0 THEN 'property_manager' ELSE 'tenant' END AS role,
           CASE WHEN k % 53 <> 0 THEN k * 31 % ((SELECT count(*) FROM part) + 20) END AS unit_id,
           (k * 11 + 3) % ((SELECT count(*) FROM customer) + 5) AS tenant_id, start_date,
           start_date + (k % 400 - 4)::INT AS end_date, rent AS monthly_rent,
           coalesce(CASE WHEN k % 47 = 0 THEN -1 WHEN k % 3 = 0 THEN price END, rent) AS deposit
    FROM (SELECT o_orderkey AS k, o_orderdate::DATE + 200 AS start_date, o_totalprice::DECIMAL(12,2) AS price,
                 CASE WHEN o_orderkey % 43 = 0 THEN 0 ELSE o_totalprice END::DECIMAL(12,2) AS rent FROM orders)"""
_DECIDED = f"""
    WITH rolled AS (SELECT * FROM leases WHERE lease_status = 'active' AND end_date >= {DAY}), base AS (
        SELECT p.*, tenant_id IN (SELECT tenant_id FROM tenants) AS tenant_known,
               unit_id IN (SELECT unit_id FROM units) AS unit_known,
               unit_id IN (SELECT unit_id FROM rolled) AS taken,
               EXISTS (SELECT 1 FROM rolled le WHERE le.unit_id = p.unit_id
                       AND le.start_date <= p.end_date AND le.end_date >= p.start_date) AS hits_lease
        FROM ({_PROPOSALS}) p
    ), first_fit AS (
        SELECT arg_min(base, proposal_id) AS f FROM base
        WHERE end_date > start_date AND tenant_known AND unit_known AND NOT taken AND monthly_rent > 0 AND deposit >= 0
          AND role = 'property_manager'
        GROUP BY unit_id
    )
    SELECT base.*, CASE
        WHEN role <> 'property_manager' THEN 'role_not_allowed'
        WHEN base.unit_id IS NULL THEN 'missing_field'
        WHEN base.end_date <= base.start_date THEN 'invalid_dates'
        WHEN NOT tenant_known THEN 'unknown_tenant'
        WHEN NOT unit_known THEN 'unknown_unit'
        WHEN hits_lease OR (f.proposal_id < base.proposal_id AND f.start_date <= base.end_date
                            AND f.end_date >= base.start_date) THEN 'overlaps_active_lease'
        WHEN monthly_rent <= 0 THEN 'invalid_rent'
        WHEN deposit < 0 THEN 'invalid_deposit'
        WHEN taken OR f.proposal_id < base.proposal_id THEN 'unit_already_leased' END AS reason
    FROM base LEFT JOIN first_fit ON f.unit_id = base.unit_id"""
_ACCEPTED = f"""
    SELECT *, n + (SELECT max(lease_id) FROM leases) AS lease_id
    FROM (SELECT *, row_number() OVER (ORDER BY proposal_id) AS n FROM ({_DECIDED}) WHERE reason IS NULL)"""

# What a batch changes, and the tables after it.
_COLUMNS = {
    "properties": "property_code property_name address_line1 city state_code postal_code manager_name acquisition_date is_active",
    "units": "property_id unit_number bedrooms bathrooms square_feet market_rent unit_status",
    "tenants": "first_name last_name email phone emergency_contact",
    "leases": "unit_id tenant_id start_date end_date monthly_rent security_deposit lease_status",
    "payments": "lease_id payment_reference due_date paid_date amount_due amount_paid payment_status payment_method",
    "maintenance_requests": "unit_id tenant_id title description priority request_status closed_at",
    "work_orders": "request_id vendor_id assigned_at scheduled_date completed_at labor_cost material_cost work_order_status notes",
}
_ALTERED = {
    "properties": ("manager_name", "'New ' || manager_name"), "units": ("market_rent", "market_rent + 10"),
    "tenants": ("phone", "phone || '0'"), "leases": ("monthly_rent", "monthly_rent + 25"), "payments": ("payment_method", "'cash'"),
    "maintenance_requests": ("priority", "'high'"), "work_orders": ("notes", "notes || ' (changed)'"),
}
_BATCH_TIME = "TIMESTAMP '1998-07-01 00:00:00'"


def _after_batch(table: str) -> str:
    key, (column, value) = _PRIMARY[table], _ALTERED[table]
    new_value = f"if({key} % 17 = 2, {value}, {column})"
    return f"""SELECT * REPLACE ({new_value} AS {column},
                   if({key} % 17 = 2 AND {new_value} IS DISTINCT FROM {column}, {_BATCH_TIME}, updated_at) AS updated_at)
               FROM {table} WHERE {key} % 17 <> 1
               UNION ALL SELECT * REPLACE (-{key} - 1 AS {key}, {_BATCH_TIME} AS created_at, {_BATCH_TIME} AS updated_at)
               FROM {table} WHERE {key} % 17 = 5"""


def _refused(table: str) -> str:
    key = _PRIMARY[table]
    return f"""SELECT {key} * 2 AS change_id, 'delete' AS action, * REPLACE (-{key} - 1 AS {key}), 'unknown_key' AS reason
               FROM {table} WHERE {key} % 17 = 6
               UNION ALL SELECT {key} * 2, 'put', * REPLACE (NULL AS {key}), 'missing_key' FROM {table} WHERE {key} % 17 = 7"""


def _image(row: str) -> str:
    """A lease as the JSON text that the audit keeps."""
    text = lambda c: f"""'"{c}":"' || {row}.{c} || '"'"""
    number = lambda c: f"""'"{c}":' || {row}.{c}"""
    stamp = lambda c: f"""'"{c}":"' || strftime({row}.{c}, '%Y-%m-%dT%H:%M:%S.%gZ') || '"'"""
    fields = [number(c) for c in ("lease_id", "unit_id", "tenant_id")] + [text("start_date"), text("end_date")]
    fields += [number("monthly_rent"), number("security_deposit"), text("lease_status"), stamp("created_at"), stamp("updated_at")]
    return "'{' || " + " || ',' || ".join(fields) + " || '}'"


_AUDIT = f"""
    SELECT 'leases' AS table_name, coalesce(o.lease_id, n.lease_id) AS record_id,
           CASE WHEN o.lease_id IS NULL THEN 'INSERT' WHEN n.lease_id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS action,
           {_image("o")} AS old_data, {_image("n")} AS new_data, {_BATCH_TIME} AS changed_at
    FROM leases o FULL JOIN ({_after_batch("leases")}) n ON o.lease_id = n.lease_id
    WHERE o.lease_id IS NULL OR n.lease_id IS NULL OR o.monthly_rent <> n.monthly_rent"""

_EVENTS = """
    SELECT *, CASE
        WHEN role = 'guest' THEN 'role_not_allowed'
        WHEN new_status = 'reopened' THEN 'unknown_status'
        WHEN role = 'vendor' AND new_status IN ('open', 'on_hold', 'cancelled') THEN 'not_for_vendor'
        WHEN role = 'tenant' AND new_status <> 'cancelled' THEN 'not_for_tenant'
        WHEN request_id NOT IN (SELECT request_id FROM maintenance_requests) THEN 'unknown_request' END AS reason
    FROM (SELECT event_id, CASE event_id % 29 WHEN 0 THEN -event_id - 1 ELSE event_id * 3 // 4 END AS request_id,
                 CASE event_id % 23 WHEN 0 THEN 'guest' ELSE ['vendor', 'tenant', 'property_manager'][event_id % 3 + 1] END AS role,
                 ['open', 'assigned', 'in_progress', 'on_hold', 'closed', 'cancelled',
                  'reopened'][event_id % 7 + 1] AS new_status, ts + INTERVAL 40 DAY AS event_ts FROM events)"""

_PAY_EVENTS = """
    SELECT *, ['tenant', 'property_manager', 'vendor', 'support_engineer', 'tenant'][payment_id % 5 + 1] AS role FROM (
        SELECT payment_id AS event_id, payment_id, created_at + INTERVAL 10 DAY AS event_ts FROM payments
        UNION ALL
        SELECT -payment_id - 1, payment_id, created_at + INTERVAL 11 DAY FROM payments
        WHERE split_part(payment_reference, '-', 3)::INT >= 6)"""

_TICKETS = r"""
    SELECT *, CASE WHEN role = 'vendor' THEN 'role_not_allowed'
                   WHEN unit_id IS NULL OR title IS NULL THEN 'missing_field'
                   WHEN length(title) > 160 THEN 'title_too_long'
                   WHEN unit_id NOT IN (SELECT unit_id FROM units) THEN 'unknown_unit'
                   WHEN tenant_id NOT IN (SELECT tenant_id FROM tenants) THEN 'unknown_tenant' END AS reason
    FROM (SELECT k AS event_id, CASE k % 19 WHEN 0 THEN 'vendor' ELSE 'tenant' END AS role,
                 CASE WHEN k % 37 <> 0 THEN if(k % 47 = 0, -1, k % ((SELECT count(*) FROM part) + 20)) END AS unit_id,
                 CASE WHEN k % 43 = 0 THEN -1 WHEN k % 5 = 0 THEN 1 ELSE conv_id % 50 END AS tenant_id,
                 CASE WHEN k % 41 <> 0 THEN said END AS title,
                 coalesce(CASE WHEN turn > 0 THEN said END, CASE WHEN k % 41 <> 0 THEN said END) AS description,
                 ['high', 'medium', 'low', 'medium'][k % 4 + 1] AS priority,
                 make_timestamp(1709251200000000 + k * 1000000) AS event_ts
          FROM (SELECT *, conv_id * 1000 + turn AS k, regexp_replace(text, '^\s+|\s+$', '', 'g') AS said FROM conversations))"""

SEARCHES = ("haering ering", "handed", "of the and", "things handed onating", "ndble")
# Forms of the words searched for, written out by hand: the statements know no rule for finding them.
_FORMS = {
    "haering": "^haer(e|s|es|ed|ing|edly|ingly|ly|ness|ful)?$",
    "ering": "^er(e|es|ed|ing|edly|ingly|ely)$",
    "handed": "^hand(e|s|es|ed|ing|edly|ingly|ly|ness|ful)?$",
    "things": "^thing(e|s|es|ed|ing|edly|ingly|ly|ness|ful)?$",
    "onating": "^onat(e|s|es|ed|ing|edly|ingly|ly|erly|ally|antly|ently|ively|ously|ion|ions|ional|or|ors|er|ers|ely|ic|al|ant|ent|ive|able|ible|ness|ful|ism|ous|ize)?$",
    "ndble": "^ndble$",
}


def _search(query: str, limit: str = "LIMIT 50") -> str:
    terms = [w for w in query.split() if w in _FORMS]
    which = "".join(f" WHEN regexp_matches(w, '{_FORMS[w]}') THEN {k}" for k, w in enumerate(terms, start=1))
    if len(terms) == 1:
        rank = "SELECT request_id, sum(1.0::DOUBLE / (k * k)) * 0.1::DOUBLE / 1.64493406685 AS rank FROM counted GROUP BY request_id"
    else:
        rank = """SELECT a.request_id, 1 - exp(coalesce(sum(ln(1 - 0.1::DOUBLE / (1.005 + 0.05 * exp((b.p - a.p) / 1.5::DOUBLE - 2))))
                      FILTER (b.p - a.p BETWEEN 1 AND 100 AND a.t <> b.t), 0)) AS rank
                  FROM counted a JOIN counted b ON a.request_id = b.request_id GROUP BY a.request_id"""
    return f"""
        WITH split AS (
            SELECT doc_id AS request_id, doc_id * 3 % (SELECT count(*) FROM part) AS unit_id,
                   source || ' ' || lang AS title, 'medium' AS priority,
                   CASE doc_id % 10 WHEN 0 THEN 'open' WHEN 1 THEN 'assigned' WHEN 2 THEN 'in_progress'
                        WHEN 3 THEN 'on_hold' WHEN 4 THEN 'cancelled' ELSE 'closed' END AS request_status,
                   make_timestamp((1704067200 + doc_id * 60) * 1000000) AS created_at,
                   regexp_extract_all(lower(source || ' ' || lang || ' ' || text), '[\\p{{L}}\\p{{N}}]+') AS words
            FROM documents
        ), located AS (
            SELECT request_id, unnest(list_transform(words, lambda w, i: {{'p': i, 't': CASE{which or " WHEN false THEN 1"} ELSE 0 END}})) AS h
            FROM split
        ), hit AS (
            SELECT request_id, h.p AS p, h.t AS t FROM located WHERE h.t > 0
        ), counted AS (
            SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY p) AS k FROM hit
            WHERE request_id IN (SELECT request_id FROM hit GROUP BY request_id HAVING count(DISTINCT t) = {len(terms)})
        ), ranked AS ({rank})
        SELECT split.*, property_id, round(ranked.rank, 6) AS rank
        FROM ranked JOIN split USING (request_id) JOIN units USING (unit_id)
        ORDER BY rank DESC, created_at DESC, request_id {limit}"""


_FOUND = "request_id property_id unit_id title priority request_status created_at rank"

_VERDICT = (
    "version as_of table_rows occupancy_above_100 orphan_payments invalid_active_leases repeated_properties status"
)


def _verdict() -> str:
    rows = " + ".join(f"(SELECT count(*) FROM {table})" for table in _PRIMARY)
    return f"""SELECT *, if(occupancy_above_100 + orphan_payments + invalid_active_leases + repeated_properties = 0, 'PASS', 'FAIL') AS status
        FROM (SELECT 'v1' AS version, '1998-07-01' AS as_of, {rows} AS table_rows,
                     (SELECT count(*) FROM occupancy WHERE occupied_units > total_units) AS occupancy_above_100,
                     (SELECT count(*) FROM payments pm WHERE NOT EXISTS (SELECT 1 FROM leases le WHERE le.lease_id = pm.lease_id))
                         AS orphan_payments,
                     (SELECT count(*) FROM in_force WHERE NOT {DAY} BETWEEN start_date AND end_date) AS invalid_active_leases,
                     (SELECT count(*) FROM (SELECT property_id FROM properties WHERE is_active GROUP BY property_id HAVING count(*) > 1))
                         AS repeated_properties)"""


JOBS: dict[str, tuple[str, str]] = {
    "schema_violations": ("rule_id key detail", _schema_violations()),
    "admit_leases_accepted": (
        "lease_id unit_id tenant_id start_date end_date monthly_rent security_deposit lease_status created_at updated_at",
        f"""SELECT *, deposit AS security_deposit, 'active' AS lease_status, {_BATCH_TIME} AS created_at,
                   {_BATCH_TIME} AS updated_at FROM ({_ACCEPTED})""",
    ),
    "admit_leases_charges": (
        "payment_id lease_id payment_reference due_date paid_date amount_due amount_paid payment_status payment_method "
        "created_at updated_at",
        f"""SELECT n + (SELECT max(payment_id) FROM payments) AS payment_id, lease_id,
                   'PAY-LEASE-' || lease_id || '-' || strftime(start_date, '%Y%m') AS payment_reference,
                   start_date AS due_date, NULL::DATE AS paid_date, monthly_rent AS amount_due, 0::DECIMAL(12,2) AS amount_paid,
                   'pending' AS payment_status, 'ach' AS payment_method, {_BATCH_TIME} AS created_at,
                   {_BATCH_TIME} AS updated_at FROM ({_ACCEPTED})""",
    ),
    "admit_leases_rejects": (
        "proposal_id unit_id tenant_id start_date end_date monthly_rent deposit reason",
        f"SELECT * FROM ({_DECIDED}) WHERE reason IS NOT NULL",
    ),
    "admit_leases_units": (
        "unit_id property_id unit_number bedrooms bathrooms square_feet market_rent unit_status created_at updated_at",
        f"""SELECT * REPLACE (if(hit, 'occupied', unit_status) AS unit_status, if(hit, {_BATCH_TIME}, updated_at) AS updated_at)
            FROM (SELECT *, unit_id IN (SELECT unit_id FROM ({_ACCEPTED})) AS hit FROM units)""",
    ),
    "audit_changes": ("table_name action record_id old_data new_data changed_at", _AUDIT),
    "audit_list": (
        "audit_id table_name action record_id old_data new_data changed_at",
        f"""SELECT *, row_number() OVER (ORDER BY record_id) AS audit_id FROM ({_AUDIT})
            ORDER BY audit_id DESC LIMIT 50""",
    ),
    "apply_status_changes": (
        "request_id unit_id tenant_id title description priority request_status created_at closed_at updated_at",
        f"""SELECT maintenance_requests.* REPLACE (coalesce(status, request_status) AS request_status,
                   coalesce(closing, closed_at) AS closed_at, coalesce(moved, updated_at) AS updated_at)
            FROM maintenance_requests LEFT JOIN (
                SELECT request_id, arg_max(new_status, (event_ts, event_id)) AS status, max(event_ts) AS moved,
                       max(event_ts) FILTER (new_status = 'closed') AS closing
                FROM ({_EVENTS}) WHERE reason IS NULL GROUP BY request_id) USING (request_id)""",
    ),
    "apply_status_changes_rejects": (
        "event_id request_id role new_status event_ts reason",
        f"SELECT * FROM ({_EVENTS}) WHERE reason IS NOT NULL",
    ),
    "apply_payments": (
        "payment_id lease_id payment_reference due_date paid_date amount_due amount_paid payment_status payment_method "
        "created_at updated_at",
        f"""SELECT * REPLACE (if(hit, amount_due, amount_paid) AS amount_paid, if(hit, 'paid', payment_status) AS payment_status,
                   if(hit, event_ts::DATE, paid_date) AS paid_date, if(hit, event_ts, updated_at) AS updated_at)
            FROM (SELECT *, event_ts IS NOT NULL AND payment_status <> 'paid' AS hit FROM payments LEFT JOIN (
                SELECT payment_id, min(event_ts) AS event_ts FROM ({_PAY_EVENTS}) WHERE role <> 'vendor' GROUP BY payment_id)
                USING (payment_id))""",
    ),
    "apply_payments_rejects": (
        "event_id payment_id role event_ts reason",
        f"""SELECT *, 'already_paid_or_unknown' AS reason
            FROM (SELECT *, row_number() OVER (PARTITION BY payment_id ORDER BY event_ts, event_id) AS n
                  FROM ({_PAY_EVENTS}) WHERE role <> 'vendor') WHERE n > 1
                OR payment_id IN (SELECT payment_id FROM payments WHERE payment_status = 'paid')
            UNION ALL BY NAME SELECT *, 'role_not_allowed' AS reason FROM ({_PAY_EVENTS}) WHERE role = 'vendor'""",
    ),
    "ingest_requests": (
        "request_id unit_id tenant_id title description priority request_status created_at closed_at updated_at",
        f"""SELECT row_number() OVER (ORDER BY event_ts, event_id) + (SELECT max(request_id) FROM maintenance_requests)
                       AS request_id, unit_id, tenant_id, title, description, priority,
                   'open' AS request_status, event_ts AS created_at, NULL::TIMESTAMP AS closed_at, event_ts AS updated_at
            FROM ({_TICKETS}) WHERE reason IS NULL
            UNION ALL SELECT request_id, unit_id, tenant_id, title, description, priority, request_status, created_at,
                   closed_at, updated_at FROM maintenance_requests""",
    ),
    "ingest_requests_rejects": (
        "event_id role unit_id title description priority tenant_id event_ts reason",
        f"SELECT * FROM ({_TICKETS}) WHERE reason IS NOT NULL",
    ),
    "publication_verdict": (_VERDICT, _verdict()),
    "published_occupancy_report": (
        f"{_MATCH} city total_units occupied_units vacant_units occupancy_percentage",
        "SELECT * FROM occupancy",
    ),
    **{
        f"merge_{table}": (f"{_PRIMARY[table]} {columns} created_at updated_at", _after_batch(table))
        for table, columns in _COLUMNS.items()
    },
    **{
        f"merge_{table}_rejects": (f"change_id action {_PRIMARY[table]} {_COLUMNS[table]} reason", _refused(table))
        for table in ("leases", "payments")
    },
    "text_search": (_FOUND, _search(SEARCHES[0])),
    "text_search_all": (_FOUND, _search(SEARCHES[0], limit="")),
    "text_search_one_word": (_FOUND, _search(SEARCHES[1])),
    "text_search_stop_words": (_FOUND, _search(SEARCHES[2])),
    "text_search_three_words": (_FOUND, _search(SEARCHES[3], limit="")),
    "text_search_unchanged_word": (_FOUND, _search(SEARCHES[4])),
    "indexed_search": (_FOUND, _search(SEARCHES[0], limit="")),
}


def _changed_tables() -> dict[str, dict[str, str]]:
    """For each kind of job the tables after it."""

    def after(table: str, job: str) -> str:
        columns, sql = JOBS[job]
        return f"SELECT {columns.replace(' ', ', ')} FROM ({sql})"

    admitted = {
        table: f"SELECT {columns.replace(' ', ', ')} FROM {table} UNION ALL {after(table, job)}"
        for table, job in (("leases", "admit_leases_accepted"), ("payments", "admit_leases_charges"))
        for columns in [JOBS[job][0]]
    }
    return {
        "performance_after_payments": {"payments": after("payments", "apply_payments")},
        "performance_after_status_changes": {"maintenance_requests": after("maintenance_requests", "apply_status_changes")},
        "performance_after_tickets": {"maintenance_requests": after("maintenance_requests", "ingest_requests")},
        "performance_after_lease_batch": {"leases": after("leases", "merge_leases")},
        "performance_after_tenant_batch": {"tenants": after("tenants", "merge_tenants")},
        "performance_after_admission": admitted,
    }


def oracle_sql() -> dict[str, str]:
    """The statement of every registered query."""
    parts = {
        "bundle_summary": "dashboard_summary",
        "bundle_occupancy": "occupancy_report",
        "bundle_rent_collection": "rent_collection_report",
        "bundle_recent_maintenance": "recent_maintenance",
        "bundle_upcoming_expirations": "upcoming_expirations",
    }
    every = CLEAN | JOBS | {part: CLEAN[whole] for part, whole in parts.items()}
    clean = {key: statement(columns, sql) for key, (columns, sql) in every.items()}
    damaged = {key: statement(columns, sql, damaged=True) for key, (columns, sql) in DAMAGED.items()}
    damaged["publication_verdict_damaged"] = statement(_VERDICT, _verdict(), damaged=True)
    performance = CLEAN["property_performance_snapshot"]
    absorbed = {key: statement(*performance, changed=changed) for key, changed in _changed_tables().items()}
    return clean | damaged | absorbed

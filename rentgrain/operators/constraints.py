"""The constraints of the schema as rules over the data.

Every kind of rule is checked by what it needs and no more:

* row checks and missing values are one array in the scan; nothing is shuffled for them;
* the rows of a PRIMARY KEY or UNIQUE key are counted under the key's own columns, partially before the
  shuffle, so a key that a third of the rows have is one row per task;
* the rows of a reference, two columns, are joined with the parents' keys, and those without a partner
  stay; a reference that many rows share may be split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import (
    LEASE_STATUSES,
    PAYMENT_METHODS,
    PAYMENT_STATUSES,
    PRIORITIES,
    REQUEST_STATUSES,
    SCHEMAS,
    UNIT_STATUSES,
    WORK_ORDER_STATUSES,
    Tables,
)
from .duplicates import repeated_keys

# Primary key, unique keys and foreign keys of each table.
KEYS = {
    "properties": ("property_id", [("property_code",)]),
    "units": ("unit_id", [("property_id", "unit_number")]),
    "tenants": ("tenant_id", [("email",)]),
    "leases": ("lease_id", []),
    "payments": ("payment_id", [("payment_reference",)]),
    "maintenance_requests": ("request_id", []),
    "vendors": ("vendor_id", [("vendor_name",), ("email",)]),
    "work_orders": ("work_order_id", []),
}
REFERENCES = [
    ("units", "property_id", "properties"),
    ("leases", "unit_id", "units"),
    ("leases", "tenant_id", "tenants"),
    ("payments", "lease_id", "leases"),
    ("maintenance_requests", "unit_id", "units"),
    ("maintenance_requests", "tenant_id", "tenants"),
    ("work_orders", "request_id", "maintenance_requests"),
    ("work_orders", "vendor_id", "vendors"),
]


# Per table, the conditions every row must meet; NULL counts as met.
ROW_CHECKS: dict[str, dict[str, str]] = {
    "units": {
        "bedrooms_range": "bedrooms BETWEEN 0 AND 8",
        "bathrooms_range": "bathrooms BETWEEN 0.5 AND 8",
        "square_feet_range": "square_feet BETWEEN 150 AND 10000",
        "market_rent_positive": "market_rent > 0",
        "unit_status_domain": f"unit_status IN {UNIT_STATUSES}",
    },
    "leases": {
        "monthly_rent_positive": "monthly_rent > 0",
        "security_deposit_not_negative": "security_deposit >= 0",
        "lease_status_domain": f"lease_status IN {LEASE_STATUSES}",
        "end_after_start": "end_date > start_date",
    },
    "payments": {
        "amount_due_positive": "amount_due > 0",
        "amount_paid_not_negative": "amount_paid >= 0",
        "not_overpaid": "amount_paid <= amount_due",
        "payment_status_domain": f"payment_status IN {PAYMENT_STATUSES}",
        "payment_method_domain": f"payment_method IN {PAYMENT_METHODS}",
        "pending_is_untouched": "payment_status <> 'pending' OR (amount_paid = 0 AND paid_date IS NULL)",
    },
    "maintenance_requests": {
        "priority_domain": f"priority IN {PRIORITIES}",
        "request_status_domain": f"request_status IN {REQUEST_STATUSES}",
        "closed_after_created": "closed_at >= created_at",
        "closed_has_time": "request_status <> 'closed' OR closed_at IS NOT NULL",
    },
    "vendors": {"hourly_rate_positive": "hourly_rate > 0"},
    "work_orders": {
        "labor_cost_not_negative": "labor_cost >= 0",
        "material_cost_not_negative": "material_cost >= 0",
        "work_order_status_domain": f"work_order_status IN {WORK_ORDER_STATUSES}",
        "completed_after_assigned": "completed_at >= assigned_at",
        "completed_has_time": "work_order_status <> 'completed' OR completed_at IS NOT NULL",
    },
}


def row_rules(table: str) -> dict[str, str]:
    """The conditions of one table's rows by rule: required values first, then ``ROW_CHECKS``."""
    required = {f"{f.name}_required": f"{f.name} IS NOT NULL" for f in SCHEMAS[table] if not f.nullable}
    return {f"{table}.{name}": ok for name, ok in (required | ROW_CHECKS.get(table, {})).items()}


def unique_rules() -> dict[str, tuple[str, list[str], str]]:
    """Table, columns and condition of every key by rule."""
    rules = {}
    for table, (primary, unique) in KEYS.items():
        for columns in [(primary,), *unique]:
            rules[f"{table}.{'_'.join(columns)}_unique"] = (table, list(columns), "true")
    rules["leases.one_active_per_unit"] = ("leases", ["unit_id"], "lease_status = 'active'")
    return rules


def rule_names() -> list[str]:
    """All rules."""
    rows = [name for table in KEYS for name in row_rules(table)]
    return [*(f"{table}.{column}_reference" for table, column, _ in REFERENCES), *unique_rules(), *rows]


def _broken_checks(df: DataFrame, table: str) -> DataFrame:
    """One row per row check that a row of the table breaks."""
    broken = ", ".join(f"IF(NOT ({ok}), '{name}', NULL)" for name, ok in row_rules(table).items())
    # The rule first, so that every condition is looked at once; a filter before it would do so again.
    found = df.selectExpr(f"{KEYS[table][0]} AS key", f"explode(array({broken})) AS rule_id").filter("rule_id IS NOT NULL")
    return found.selectExpr("rule_id", "string(key) AS key", "'' AS detail")


def _repeated(t: Tables) -> list[DataFrame]:
    """Keys of more than one row: primary keys, texts, and numbers with or without a text, each kind together.

    Keys with a missing part are not compared, as in SQL.
    """
    kinds: dict[str, list[DataFrame]] = {}
    rules = unique_rules()
    for domain, (table, columns, condition) in enumerate(rules.values()):
        held = " AND ".join([f"({condition})", *(f"{c} IS NOT NULL" for c in columns)])
        text = SCHEMAS[table][columns[0]].dataType.simpleString() == "string"
        kind = "text" if text else "primary" if columns == [KEYS[table][0]] else "mixed"
        parts = [F.col(c) for c in columns] + [F.lit(None).cast("string")] * (kind == "mixed" and len(columns) == 1)
        keys = getattr(t, table).filter(held).select(F.lit(domain).alias("domain"), *[c.alias(f"k{at}") for at, c in enumerate(parts)])
        kinds.setdefault(kind, []).append(keys)
    names = F.array(*map(F.lit, rules))
    found = []
    for frames in kinds.values():
        domain, *parts = frames[0].columns
        repeated = repeated_keys(reduce(DataFrame.unionByName, frames), [domain, *parts], "_rows")
        key = F.concat_ws("|", *[F.col(c).cast("string") for c in parts]).alias("key")
        found.append(repeated.select(F.get(names, F.col(domain)).alias("rule_id"), key, F.col("_rows").cast("string").alias("detail")))
    return found


def _dangling(t: Tables, child: str, column: str, parent: str) -> DataFrame:
    """Rows of ``child`` that refer to a row which is not there."""
    rows = getattr(t, child).filter(F.col(column).isNotNull())
    rows = rows.select(F.col(KEYS[child][0]).alias("key"), F.col(column).alias("reference"))
    parents = getattr(t, parent).select(F.col(KEYS[parent][0]).alias("reference"))
    lost = rows.join(parents, "reference", "left_anti")
    return lost.select(F.lit(f"{child}.{column}_reference").alias("rule_id"), F.col("key").cast("string").alias("key"), F.col("reference").cast("string").alias("detail"))


def schema_violations(t: Tables) -> DataFrame:
    """Every NOT NULL, domain, range, cross-column, unique and reference rule of the schema.

    One row per broken row check (key of the row), per repeated key (the key and its number of rows) and per
    dangling reference (key of the row and the reference).
    """
    checks = [_broken_checks(getattr(t, table), table) for table in KEYS]
    dangling = [_dangling(t, *reference) for reference in REFERENCES]
    return reduce(DataFrame.unionByName, checks + _repeated(t) + dangling)

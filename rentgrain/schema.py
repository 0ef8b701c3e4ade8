"""The canonical tables: schemas, keys and value domains."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)
# Totals keep two decimals but are wide enough that a sum over 10^14 charges still fits.
MONEY_TOTAL = T.DecimalType(28, 2)
# Figures multiplied by a join fan-out need the full width.
FANOUT_TOTAL = T.DecimalType(38, 2)

_LONG, _STR, _DATE, _TS = T.LongType(), T.StringType(), T.DateType(), T.TimestampType()


def _struct(required: dict, optional: tuple[str, ...] = ()) -> T.StructType:
    return T.StructType([T.StructField(name, kind, name in optional) for name, kind in required.items()])


PROPERTIES = _struct(
    {
        "property_id": _LONG,
        "property_code": _STR,
        "property_name": _STR,
        "address_line1": _STR,
        "city": _STR,
        "state_code": _STR,
        "postal_code": _STR,
        "manager_name": _STR,
        "acquisition_date": _DATE,
        "is_active": T.BooleanType(),
        "created_at": _TS,
        "updated_at": _TS,
    },
    optional=("acquisition_date",),
)
UNITS = _struct(
    {
        "unit_id": _LONG,
        "property_id": _LONG,
        "unit_number": _STR,
        "bedrooms": T.ShortType(),
        "bathrooms": T.DecimalType(3, 1),
        "square_feet": T.IntegerType(),
        "market_rent": MONEY,
        "unit_status": _STR,
        "created_at": _TS,
        "updated_at": _TS,
    }
)
TENANTS = _struct(
    {
        "tenant_id": _LONG,
        "first_name": _STR,
        "last_name": _STR,
        "email": _STR,
        "phone": _STR,
        "emergency_contact": _STR,
        "created_at": _TS,
        "updated_at": _TS,
    },
    optional=("emergency_contact",),
)
LEASES = _struct(
    {
        "lease_id": _LONG,
        "unit_id": _LONG,
        "tenant_id": _LONG,
        "start_date": _DATE,
        "end_date": _DATE,
        "monthly_rent": MONEY,
        "security_deposit": MONEY,
        "lease_status": _STR,
        "created_at": _TS,
        "updated_at": _TS,
    }
)
PAYMENTS = _struct(
    {
        "payment_id": _LONG,
        "lease_id": _LONG,
        "payment_reference": _STR,
        "due_date": _DATE,
        "paid_date": _DATE,
        "amount_due": MONEY,
        "amount_paid": MONEY,
        "payment_status": _STR,
        "payment_method": _STR,
        "created_at": _TS,
        "updated_at": _TS,
    },
    optional=("paid_date", "payment_method"),
)
REQUESTS = _struct(
    {
        "request_id": _LONG,
        "unit_id": _LONG,
        "tenant_id": _LONG,
        "title": _STR,
        "description": _STR,
        "priority": _STR,
        "request_status": _STR,
        "created_at": _TS,
        "closed_at": _TS,
        "updated_at": _TS,
    },
    optional=("tenant_id", "closed_at"),
)
VENDORS = _struct(
    {
        "vendor_id": _LONG,
        "vendor_name": _STR,
        "specialty": _STR,
        "email": _STR,
        "phone": _STR,
        "hourly_rate": T.DecimalType(10, 2),
        "is_active": T.BooleanType(),
        "created_at": _TS,
    },
    optional=("hourly_rate",),
)
WORK_ORDERS = _struct(
    {
        "work_order_id": _LONG,
        "request_id": _LONG,
        "vendor_id": _LONG,
        "assigned_at": _TS,
        "scheduled_date": _DATE,
        "completed_at": _TS,
        "labor_cost": MONEY,
        "material_cost": MONEY,
        "work_order_status": _STR,
        "notes": _STR,
        "created_at": _TS,
        "updated_at": _TS,
    },
    optional=("vendor_id", "scheduled_date", "completed_at", "notes"),
)
AUDIT_LOGS = _struct(
    {
        "audit_id": _LONG,
        "table_name": _STR,
        "action": _STR,
        "record_id": _LONG,
        "old_data": _STR,
        "new_data": _STR,
        "changed_at": _TS,
    },
    optional=("record_id", "old_data", "new_data", "changed_at"),
)

SCHEMAS: dict[str, T.StructType] = {
    "properties": PROPERTIES,
    "units": UNITS,
    "tenants": TENANTS,
    "leases": LEASES,
    "payments": PAYMENTS,
    "maintenance_requests": REQUESTS,
    "vendors": VENDORS,
    "work_orders": WORK_ORDERS,
    "audit_logs": AUDIT_LOGS,
}

# The status, priority and method domains of the data model.
UNIT_STATUSES = ("occupied", "vacant", "maintenance", "offline")
LEASE_STATUSES = ("draft", "active", "expired", "terminated")
PAYMENT_STATUSES = ("pending", "partial", "paid", "late", "waived")
PAYMENT_METHODS = ("ach", "card", "check", "cash", "bank_transfer")
PRIORITIES = ("low", "medium", "high", "emergency")
REQUEST_STATUSES = ("open", "assigned", "in_progress", "on_hold", "closed", "cancelled")
WORK_ORDER_STATUSES = ("assigned", "scheduled", "in_progress", "completed", "cancelled")
# Requests in one of these states need no further work.
SETTLED_REQUESTS = ("closed", "cancelled")


class Tables:
    """One consistent snapshot of the portfolio, a DataFrame per table as attribute.

    A table may be given as a function; it is called when the table is first used.
    """

    properties: DataFrame
    units: DataFrame
    tenants: DataFrame
    leases: DataFrame
    payments: DataFrame
    maintenance_requests: DataFrame
    vendors: DataFrame
    work_orders: DataFrame
    audit_logs: DataFrame

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]) -> None:
        unknown = set(tables) - set(SCHEMAS)
        if unknown:
            raise TypeError(f"unknown tables: {sorted(unknown)}")
        self._tables = tables

    def __getattr__(self, name: str) -> DataFrame:
        try:
            table = self.__dict__["_tables"][name]
        except KeyError:
            raise AttributeError(name) from None
        if callable(table):
            table = self._tables[name] = table()
        return table

    def with_(self, **changed: DataFrame | Callable[[], DataFrame]) -> "Tables":
        """A copy with some tables replaced."""
        return Tables(**(self._tables | changed))

    def items(self) -> list[tuple[str, DataFrame]]:
        """(name, frame) of every table that is present, in declaration order."""
        return [(name, getattr(self, name)) for name in SCHEMAS if name in self._tables]

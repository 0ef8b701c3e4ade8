"""Session and small hand-made portfolios for the tests."""

from __future__ import annotations

import os
import sys
from datetime import date, datetime
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rentgrain.schema import SCHEMAS, Tables  # noqa: E402
from rentgrain.session import build_session  # noqa: E402

AS_OF = date(2024, 5, 15)
NOW = datetime(2024, 5, 15, 9, 0)
STAMP = datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]", "tests", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="4g"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


DEFAULTS = {
    "properties": dict(
        property_code="P", property_name="Oak", address_line1="1 Main", city="Austin", state_code="TX",
        postal_code="75000", manager_name="Maya", acquisition_date=None, is_active=True,
    ),
    "units": dict(
        property_id=1, unit_number="1A", bedrooms=1, bathrooms=Decimal("1.0"), square_feet=600,
        market_rent=Decimal("1000.00"), unit_status="vacant",
    ),
    "tenants": dict(first_name="Ana", last_name="Walker", email="a@example.com", phone="1", emergency_contact=None),
    "leases": dict(
        unit_id=1, tenant_id=1, start_date=date(2024, 1, 1), end_date=date(2024, 12, 31),
        monthly_rent=Decimal("1000.00"), security_deposit=Decimal("1000.00"), lease_status="active",
    ),
    "payments": dict(
        lease_id=1, payment_reference="R", due_date=date(2024, 5, 1), paid_date=None, amount_due=Decimal("1000.00"),
        amount_paid=Decimal("0.00"), payment_status="pending", payment_method=None,
    ),
    "maintenance_requests": dict(
        unit_id=1, tenant_id=None, title="Leaking faucet", description="Drips", priority="low",
        request_status="open", closed_at=None,
    ),
    "vendors": dict(
        vendor_name="V", specialty="HVAC", email="v@example.com", phone="1", hourly_rate=Decimal("10.00"), is_active=True
    ),
    "work_orders": dict(
        request_id=1, vendor_id=None, assigned_at=STAMP, scheduled_date=None, completed_at=None,
        labor_cost=Decimal("0.00"), material_cost=Decimal("0.00"), work_order_status="assigned", notes=None,
    ),
    "audit_logs": dict(),
}


def money(value) -> Decimal:
    return Decimal(str(value)).quantize(Decimal("0.01"))


def frame(spark, table: str, rows: list[dict]):
    """Rows with defaults filled in; the first column counts from 1 unless given."""
    schema = SCHEMAS[table]
    filled = []
    for number, row in enumerate(rows, start=1):
        values = {"created_at": STAMP, "updated_at": STAMP, schema[0].name: number} | DEFAULTS[table] | row
        if table == "tenants" and "email" not in row:
            values["email"] = f"t{values['tenant_id']}@example.com"
        if table == "payments" and "payment_reference" not in row:
            values["payment_reference"] = f"R{values['payment_id']}"
        if table == "units" and "unit_number" not in row:
            values["unit_number"] = f"{values['unit_id']}A"
        filled.append(tuple(values[f.name] for f in schema))
    nullable = schema.__class__([f.__class__(f.name, f.dataType, True) for f in schema])
    return spark.createDataFrame(filled, nullable)


@pytest.fixture(scope="session")
def make(spark):
    """``make(units=[{...}], ...)`` builds a portfolio; tables not named have one default row."""

    def build(**rows: list[dict]) -> Tables:
        given = {name: [{}] for name in SCHEMAS if name != "audit_logs"} | rows
        return Tables(**{name: frame(spark, name, table) for name, table in given.items()})

    return build

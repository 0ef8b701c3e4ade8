"""Column expressions with the semantics every report agrees on."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MONEY_TOTAL, SETTLED_REQUESTS

HOUR_MICROS = 3_600_000_000


def day(value: date) -> Column:
    """A date literal; foldable, so filters on it reach the Parquet scan."""
    return F.lit(value).cast("date")


def total(amount: Column) -> Column:
    """Exact money total, NULL over no rows."""
    return F.sum(amount).cast(MONEY_TOTAL)


def as_total(amount: Column) -> Column:
    """Cast to the type of money totals."""
    return amount.cast(MONEY_TOTAL)


def or_zero(amount: Column) -> Column:
    """Money with missing read as 0.00."""
    return F.coalesce(amount, F.lit(0)).cast(MONEY_TOTAL)


def count_where(condition: Column) -> Column:
    """Number of rows for which the condition is true."""
    return F.count_if(condition)


def percentage(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole, NULL for an empty whole."""
    part, whole = part.cast("double"), whole.cast("double")
    return F.round(F.lit(100.0) * part / F.nullif(whole, F.lit(0.0)), digits)


def full_name() -> Column:
    """First and last name; NULL if either is NULL."""
    return F.concat("first_name", F.lit(" "), "last_name")


def is_current(as_of: date) -> Column:
    """Lease counts as active: its status says so and the day lies inside it."""
    return (F.col("lease_status") == "active") & day(as_of).between(F.col("start_date"), F.col("end_date"))


def month_start(of: date) -> date:
    """First day of the month."""
    return of.replace(day=1)


def next_month(of: date) -> date:
    """First day of the following month."""
    return date(of.year + of.month // 12, of.month % 12 + 1, 1)


def in_month(column: str, of: date) -> Column:
    """Half-open month range on the bare column, so it is pushed down."""
    return (F.col(column) >= day(month_start(of))) & (F.col(column) < day(next_month(of)))


def days_until(column: str, as_of: date) -> Column:
    """Whole days from ``as_of`` to the column."""
    return F.datediff(F.col(column), day(as_of))


def micros_between(start: str, end: str) -> Column:
    """Elapsed microseconds as an exact number whose sum cannot overflow."""
    return (F.unix_micros(F.col(end)) - F.unix_micros(F.col(start))).cast("decimal(18,0)")


def mean_hours(micros_sum: Column, rows: Column, digits: int = 1) -> Column:
    """Average hours from summed microseconds; NULL over no rows."""
    return F.round(micros_sum.cast("double") / F.nullif(rows, F.lit(0)).cast("double") / float(HOUR_MICROS), digits)


def is_open_request() -> Column:
    """Request still needs work."""
    return ~F.col("request_status").isin(*SETTLED_REQUESTS)


def unpaid() -> Column:
    """Charge that is not paid in full."""
    return F.col("amount_paid") < F.col("amount_due")


def balance() -> Column:
    """What is left to pay on a charge."""
    return F.col("amount_due") - F.col("amount_paid")


def job_cost() -> Column:
    """Labour plus material of a work order."""
    return F.col("labor_cost") + F.col("material_cost")

"""Charges that were recorded more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import join_spread
from ..schema import Tables

BUSINESS_KEY = ["lease_id", "due_date", "amount_due"]


def repeated_keys(df: DataFrame, key: list[str], name: str) -> DataFrame:
    """Keys on more than one row, with the number of rows; folded before the shuffle."""
    return df.groupBy(*key).agg(F.count("*").alias(name)).filter(F.col(name) > 1)


def duplicate_payments(t: Tables) -> DataFrame:
    """Charges that share lease, due date and amount with another, one row for each.

    Every row carries the size of its group, whatever that size is; rows of a group are
    spread over tasks and never gathered.
    """
    rows = t.payments.select(*BUSINESS_KEY, "payment_reference")
    groups = repeated_keys(rows, BUSINESS_KEY, "duplicate_count")
    return join_spread(rows, groups, BUSINESS_KEY, spread_by="payment_reference").select(
        *BUSINESS_KEY, "duplicate_count", "payment_reference"
    )


def loose_duplicate_payments(t: Tables) -> DataFrame:
    """Leases charged more than once for the same day, whatever the amount."""
    return repeated_keys(t.payments, ["lease_id", "due_date"], "charge_count")

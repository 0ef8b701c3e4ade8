"""Before/after formulations of three queries, and a check whether a rewrite is equivalent."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import day, or_zero, total
from ..functions.prints import bag_print
from ..schema import Tables

#: Repeats of a row that are made at a time.
REPEATS = 4096


def expiry_before(t: Tables, as_of: date, days: int = 90) -> DataFrame:
    """Leases ending in the range, compared as text: nothing can be pushed to the scan."""
    text = F.date_format("end_date", "yyyy-MM-dd")
    until = as_of + timedelta(days=days)
    return t.leases.filter(text.between(as_of.isoformat(), until.isoformat())).select("lease_id", "unit_id", "end_date")


def expiry_after(t: Tables, as_of: date, days: int = 90) -> DataFrame:
    """Active leases ending in the range, compared as dates: the range reaches the scan."""
    in_range = F.col("end_date").between(day(as_of), day(as_of + timedelta(days=days)))
    return t.leases.filter((F.col("lease_status") == "active") & in_range).select("lease_id", "unit_id", "end_date")


def tenant_before(t: Tables, term: str) -> DataFrame:
    """Tenants with the term anywhere in the full name."""
    name = F.lower(F.concat("first_name", F.lit(" "), "last_name"))
    return t.tenants.filter(name.contains(term.lower())).select("tenant_id", "first_name", "last_name", "email")


def tenant_after(t: Tables, term: str) -> DataFrame:
    """Tenants whose last name is the term, by first name."""
    return (
        t.tenants.filter(F.lower("last_name") == term.lower())
        .select("tenant_id", "first_name", "last_name", "email")
        .orderBy(F.lower("first_name"), "tenant_id")
    )


def payment_before(t: Tables) -> DataFrame:
    """Paid total per active lease as a correlated subquery; NULL without charges."""
    # Renaming the key first gives it an identity of its own in every use of the table.
    active = t.leases.filter("lease_status = 'active'").select(F.col("lease_id").alias("held"))
    paid = t.payments.filter(F.col("lease_id") == F.col("held").outer()).select(
        total(F.col("amount_paid")).alias("paid_total")
    )
    return active.select(F.col("held").alias("lease_id"), paid.scalar().alias("paid_total"))


def payment_after(t: Tables) -> DataFrame:
    """Paid total per active lease from one aggregate; 0 without charges."""
    paid = t.payments.groupBy("lease_id").agg(F.sum("amount_paid").alias("paid_total"))
    active = t.leases.filter("lease_status = 'active'").select("lease_id")
    return active.join(paid, "lease_id", "left").select("lease_id", or_zero(F.col("paid_total")).alias("paid_total"))


def plan_text(df: DataFrame) -> str:
    """The formatted physical plan."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@dataclass(frozen=True)
class PlanFacts:
    """What a plan reads and moves."""

    scans: int
    exchanges: int
    pushed: tuple[str, ...]

    @staticmethod
    def of(df: DataFrame) -> "PlanFacts":
        text = plan_text(df)
        pushed = {f for group in re.findall(r"PushedFilters: \[(.*)\]", text) for f in re.findall(r"\w+\(.*?\)", group)}
        nodes = re.findall(r"^\(\d+\) (\w+)", text, re.M)
        return PlanFacts(nodes.count("Scan"), nodes.count("Exchange"), tuple(sorted(pushed)))


@dataclass(frozen=True)
class Comparison:
    """Two formulations side by side."""

    before_plan: str
    after_plan: str
    only_before: DataFrame
    only_after: DataFrame
    same: DataFrame

    def is_equivalent(self) -> bool:
        """No row is on one side only, repeats included; decided by fingerprints."""
        return self.same.first()["equivalent"]


def compare(before: DataFrame, after: DataFrame) -> Comparison:
    """Plans of both formulations and the rows only one of them returns."""
    after = after.select(*before.columns)
    return Comparison(
        plan_text(before), plan_text(after), before.exceptAll(after), after.exceptAll(before), same_bag(before, after)
    )


def same_bag(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row (rows_before, rows_after, equivalent): are both the same rows, repeats included?

    Each side is folded to a fingerprint where it is computed; no row is shuffled or sorted.
    """
    left = before.agg(bag_print(before.columns).alias("before"))
    right = after.select(*before.columns).agg(bag_print(before.columns).alias("after"))
    sides = before.sparkSession.range(1).select(left.scalar().alias("before"), right.scalar().alias("after"))
    return sides.select(
        F.col("before.rows").alias("rows_before"),
        F.col("after.rows").alias("rows_after"),
        F.col("before").eqNullSafe(F.col("after")).alias("equivalent"),
    )


def equivalence(before: DataFrame, after: DataFrame) -> DataFrame:
    """:func:`same_bag` with the facts of both plans as columns."""
    facts = {"before": PlanFacts.of(before), "after": PlanFacts.of(after)}
    columns = {f"scans_{side}": F.lit(f.scans) for side, f in facts.items()}
    columns |= {f"pushed_{side}": F.lit(", ".join(f.pushed)) for side, f in facts.items()}
    return same_bag(before, after).withColumns(columns)


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that only one formulation returns, labelled with the side.

    Rows are matched only if the fingerprints differ: of two equal sides no row reaches the comparison.
    Both directions come from one count of each row, so each side is computed once for it. A row comes as
    often as one side has it more than the other; the repeats are made in pieces, so no array is long.
    """
    columns = [f"_{k}" for k in range(len(before.columns))]
    differs = ~same_bag(before, after).select("equivalent").scalar()
    here = before.filter(differs).toDF(*columns).withColumn("times", F.lit(1))
    there = after.select(*before.columns).filter(differs).toDF(*columns).withColumn("times", F.lit(-1))
    more = here.union(there).groupBy(*columns).agg(F.sum("times").alias("times")).filter("times <> 0")
    pieces = more.withColumn("piece", F.explode(F.expr(f"sequence(0, (abs(times) - 1) div {REPEATS})")))
    repeats = pieces.withColumn("repeat", F.explode(F.expr(f"sequence(1, least({REPEATS}, abs(times) - piece * {REPEATS}))")))
    side = F.when(F.col("times") > 0, "before").otherwise("after")
    return repeats.select(*columns, side).toDF(*before.columns, "side")

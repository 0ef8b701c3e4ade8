"""Row-changing jobs as snapshot-in, snapshot-out transforms over batches.

The day-to-day operations (admit a lease, move a ticket, pay a charge) arrive one at a
time; here a batch of them is applied in one set-based pass with the same outcome as
applying them in order.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.joins import flag, flag_known
from ..functions.prefix import row_positions
from ..functions.prints import bag_print
from ..schema import MONEY, PRIORITIES, REQUEST_STATUSES, Tables
from . import definitions as d

# The roles that may act, and the targets each restricted role may set.
STATUS_ROLES = ("property_manager", "vendor", "tenant", "support_engineer")
VENDOR_TARGETS = ("in_progress", "closed", "assigned")
TENANT_TARGETS = ("cancelled",)
LONGEST_TITLE = 160
LEASE_ROLES = ("property_manager",)
PAYMENT_ROLES = TICKET_ROLES = ("property_manager", "tenant", "support_engineer")


def _at(moment: datetime) -> Column:
    # Written as text, so that it means the same wall-clock time in every session time zone.
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp")


def _largest(df: DataFrame, key: str) -> Column:
    return df.agg(F.coalesce(F.max(key), F.lit(0))).scalar()


def _role(rows: DataFrame) -> Column:
    """The normalised role of a row; a batch without roles comes from the property manager."""
    if "role" not in rows.columns:
        return F.lit("property_manager")
    role = F.lower(_stripped(F.col("role")))
    return F.when(role == "operations", "property_manager").otherwise(role)


def _may(rows: DataFrame, roles: tuple[str, ...]) -> Column:
    return F.coalesce(_role(rows).isin(*roles), F.lit(False))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


# Lease admission ------------------------------------------------------------------


@dataclass(frozen=True)
class Admission:
    """Outcome of a batch of lease proposals."""

    tables: Tables
    leases: DataFrame
    charges: DataFrame
    rejects: DataFrame


def active_on_unit(proposals: DataFrame, leases: DataFrame) -> DataFrame:
    """(proposal_id, overlaps, held): active leases of the proposal's unit, sharing a day with it and in all.

    No pair of proposal and lease is formed. A lease starts on or before its end, so

        overlaps = leases started by the proposal's last day
                   - leases ended before the proposal's first day

    Starts and ends are folded per unit and calendar day first, which bounds the rows per
    unit by the length of the calendar however many leases or proposals a unit has.
    """
    active = leases.filter("lease_status = 'active'")
    # A lease that ends before it starts holds the unit but shares no day with anyone.
    sound = F.expr("int(end_date >= start_date)")
    measures = ["started", "ended", "held"]

    def events(df: DataFrame, on: str, started: Column | int, ended: Column | int, held: int) -> DataFrame:
        values = zip(measures, (started, ended, held))
        return df.select("unit_id", F.col(on).alias("on"), *[F.lit(v).alias(name) for name, v in values])

    def folded(df: DataFrame) -> DataFrame:
        return df.groupBy("unit_id", "on").agg(*[F.sum(name).alias(name) for name in measures])

    asked = proposals.selectExpr(
        "proposal_id",
        "unit_id",
        "explode(array(struct(end_date AS on, true AS last), struct(date_sub(start_date, 1) AS on, false AS last))) "
        "AS ask",
    ).select("proposal_id", "unit_id", "ask.on", "ask.last")
    changes = folded(events(active, "start_date", sound, 0, 1).unionByName(events(active, "end_date", 0, sound, 0)))
    changes = changes.join(proposals.select("unit_id").distinct(), "unit_id", "left_semi")
    unit = W.partitionBy("unit_id")
    calendar = folded(changes.unionByName(events(asked, "on", 0, 0, 0))).select(
        "unit_id",
        "on",
        F.sum("started").over(unit.orderBy("on")).alias("started"),
        F.sum("ended").over(unit.orderBy("on")).alias("ended"),
        F.sum("held").over(unit).alias("held"),
    )
    return (
        asked.join(calendar, ["unit_id", "on"])
        .groupBy("proposal_id")
        .agg(
            F.sum(F.when(F.col("last"), F.col("started")).otherwise(-F.col("ended"))).alias("overlaps"),
            F.max("held").alias("held"),
        )
    )


def decide_proposals(t: Tables, proposals: DataFrame) -> DataFrame:
    """Proposals with ``reason``, NULL for those admitted.

    Applied in order of proposal_id, a unit can take at most one active lease, so the
    first proposal that passes every other check on a unit without one is admitted and
    is what later proposals collide with.
    """
    c = F.col
    required = ["unit_id", "tenant_id", "start_date", "end_date", "monthly_rent"]
    missing = F.greatest(*[c(name).isNull() for name in required])
    checked = proposals.withColumns(
        {"deposit": F.coalesce("deposit", "monthly_rent"), "allowed": _may(proposals, LEASE_ROLES)}
    )
    checked = flag_known(checked, t.tenants, "tenant_id", "tenant_known")
    checked = flag_known(checked, t.units, "unit_id", "unit_known")
    checked = checked.join(active_on_unit(proposals, t.leases), "proposal_id", "left")
    checked = checked.withColumn("unit_taken", F.coalesce(c("held") > 0, F.lit(False)))
    sound = (
        c("allowed")
        & ~missing
        & (c("end_date") > c("start_date"))
        & c("tenant_known")
        & c("unit_known")
        & (c("monthly_rent") > 0)
        & (c("deposit") >= 0)
    )
    candidates = checked.filter(sound & ~c("unit_taken"))
    admitted = candidates.groupBy("unit_id").agg(F.min("proposal_id").alias("proposal_id"))
    winners = (
        proposals.join(admitted, ["unit_id", "proposal_id"], "left_semi")
        .select(
            "unit_id",
            c("proposal_id").alias("winner"),
            c("start_date").alias("winner_start"),
            c("end_date").alias("winner_end"),
        )
    )
    after_winner = F.coalesce(c("winner") < c("proposal_id"), F.lit(False))
    hits_winner = after_winner & (c("winner_start") <= c("end_date")) & (c("winner_end") >= c("start_date"))
    reason = (
        F.when(~c("allowed"), "role_not_allowed")
        .when(missing, "missing_field")
        .when(c("end_date") <= c("start_date"), "invalid_dates")
        .when(~c("tenant_known"), "unknown_tenant")
        .when(~c("unit_known"), "unknown_unit")
        .when((c("overlaps") > 0) | hits_winner, "overlaps_active_lease")
        .when(c("monthly_rent") <= 0, "invalid_rent")
        .when(c("deposit") < 0, "invalid_deposit")
        .when(c("unit_taken") | after_winner, "unit_already_leased")
    )
    return checked.join(winners, "unit_id", "left").select(
        "proposal_id",
        "unit_id",
        "tenant_id",
        "start_date",
        "end_date",
        "monthly_rent",
        "deposit",
        reason.alias("reason"),
    )


def admit_leases(t: Tables, proposals: DataFrame, now: datetime) -> Admission:
    """Turn proposals into active leases, first charges and occupied units."""
    decided = decide_proposals(t, proposals)
    accepted = row_positions(
        decided.filter("reason IS NULL"), ["proposal_id"], "position", sample_from=proposals
    ).withColumn("lease_id", F.col("position") + _largest(t.leases, "lease_id"))
    leases = accepted.select(
        "lease_id",
        "unit_id",
        "tenant_id",
        "start_date",
        "end_date",
        "monthly_rent",
        F.col("deposit").cast(MONEY).alias("security_deposit"),
        F.lit("active").alias("lease_status"),
        _at(now).alias("created_at"),
        _at(now).alias("updated_at"),
    )
    charges = accepted.select(
        (F.col("position") + _largest(t.payments, "payment_id")).alias("payment_id"),
        "lease_id",
        F.concat_ws(
            "-", F.lit("PAY-LEASE"), F.col("lease_id").cast("string"), F.date_format("start_date", "yyyyMM")
        ).alias("payment_reference"),
        F.col("start_date").alias("due_date"),
        F.lit(None).cast("date").alias("paid_date"),
        F.col("monthly_rent").alias("amount_due"),
        F.lit(0).cast(MONEY).alias("amount_paid"),
        F.lit("pending").alias("payment_status"),
        F.lit("ach").alias("payment_method"),
        _at(now).alias("created_at"),
        _at(now).alias("updated_at"),
    )
    taken = flag(t.units, accepted, "unit_id", "_taken")
    units = _touch(
        taken, "unit_status", F.col("_taken"), F.lit("occupied"), now
    ).select(*t.units.columns)
    tables = t.with_(leases=t.leases.unionByName(leases), payments=t.payments.unionByName(charges), units=units)
    return Admission(tables, leases, charges, decided.filter("reason IS NOT NULL"))


def _touch(df: DataFrame, column: str, changed: Column, value: Column, now: datetime) -> DataFrame:
    """Set ``column`` and ``updated_at`` on the changed rows."""
    return df.withColumn("_changed", changed).withColumns(
        {
            column: F.when(F.col("_changed"), value).otherwise(F.col(column)),
            "updated_at": F.when(F.col("_changed"), _at(now)).otherwise(F.col("updated_at")),
        }
    ).drop("_changed")


# Audit trail ----------------------------------------------------------------------


#: Consecutive keys whose rows are compared by one fingerprint.
KEYS_TOGETHER = 256


def changed_ranges(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(range): ranges of keys in which the snapshots differ."""
    def prints(df: DataFrame, side: str) -> DataFrame:
        ranges = df.groupBy(F.floor(F.col(key) / KEYS_TOGETHER).alias("range"))
        return ranges.agg(bag_print(old.columns).alias(side))

    both = prints(old, "before").join(prints(new, "after"), "range", "full")
    return both.filter(~F.col("before").eqNullSafe(F.col("after"))).select("range")


def audit_changes(
    old: DataFrame, new: DataFrame, changed_at: datetime, table: str = "leases", key: str = "lease_id"
) -> DataFrame:
    """Inserted, updated and deleted rows between two snapshots, with both images as JSON.

    A row rewritten with equal values is not a change. Only ranges of keys whose fingerprints differ
    reach the join, so most of two snapshots that are nearly alike is read but not shuffled.
    """
    ranges = changed_ranges(old, new, key)
    here = lambda df: df.withColumn("range", F.floor(F.col(key) / KEYS_TOGETHER)).join(ranges, "range", "left_semi")
    before = here(old).select(key, F.struct(*old.columns).alias("before"))
    after = here(new).select(key, F.struct(*old.columns).alias("after"))
    keep_nulls = {"ignoreNullFields": "false"}
    action = (
        F.when(F.col("before").isNull(), "INSERT").when(F.col("after").isNull(), "DELETE").otherwise("UPDATE")
    )
    return (
        before.join(after, key, "full")
        .filter(~F.col("before").eqNullSafe(F.col("after")))
        .select(
            F.lit(table).alias("table_name"),
            action.alias("action"),
            F.col(key).alias("record_id"),
            F.to_json("before", keep_nulls).alias("old_data"),
            F.to_json("after", keep_nulls).alias("new_data"),
            _at(changed_at).alias("changed_at"),
        )
    )


def append_audit(audit_logs: DataFrame, changes: DataFrame) -> DataFrame:
    """The audit table with the changes appended under the next ids."""
    numbered = row_positions(changes, ["record_id", "table_name"], "position")
    rows = numbered.withColumn("audit_id", F.col("position") + _largest(audit_logs, "audit_id"))
    return audit_logs.unionByName(rows.select(*audit_logs.columns))


# Keyed changes --------------------------------------------------------------------


@dataclass(frozen=True)
class Applied:
    """Outcome of a batch of events: the new table and the events that were refused."""

    table: DataFrame
    rejects: DataFrame


def merge_changes(table: DataFrame, changes: DataFrame, key: str, now: datetime) -> Applied:
    """A table after a batch of (change_id, action, key, columns): ``put`` inserts or replaces a row, ``delete`` removes it.

    The last change of a key counts. A row whose columns do not differ keeps its ``updated_at``, any other
    gets the time of the batch. Changes without a key and deletions of unknown rows are refused.
    """
    values = [c for c in table.columns if c not in (key, "created_at", "updated_at")]
    named = changes.filter(F.col(key).isNotNull())
    last = named.groupBy(key).agg(F.max_by(F.struct("action", "change_id", *values), "change_id").alias("_new"))
    # Both sides have one row per key, so no key can be hot.
    both = table.withColumn("_here", F.lit(True)).join(last, key, "full")
    put, there = F.coalesce(F.col("_new.action") == "put", F.lit(False)), F.coalesce("_here", F.lit(False))
    differs = F.greatest(*[~F.col(c).eqNullSafe(F.col(f"_new.{c}")) for c in values], F.lit(False))
    merged = both.filter(put | (there & F.col("_new").isNull())).select(
        key,
        *[F.when(put, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in values],
        F.when(there, F.col("created_at")).otherwise(_at(now)).alias("created_at"),
        F.when(put & (~there | differs), _at(now)).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    unknown = both.filter(~there & ~put).select(F.col(key).alias("_key"), F.col("_new.change_id").alias("change_id"))
    refused = changes.join(unknown, "change_id", "left_semi").withColumn("reason", F.lit("unknown_key"))
    nameless = changes.filter(F.col(key).isNull()).withColumn("reason", F.lit("missing_key"))
    return Applied(merged.select(*table.columns), refused.select(*changes.columns, "reason").unionByName(nameless))


# Requests and charges -------------------------------------------------------------


def judge_status_events(events: DataFrame) -> DataFrame:
    """Events with normalised role and status and a ``reason``, NULL if the change is allowed."""
    cleaned = events.withColumns({"role": _role(events), "new_status": F.lower(_stripped(F.col("new_status")))})
    role, status = F.col("role"), F.col("new_status")
    reason = (
        F.when(~F.coalesce(role.isin(*STATUS_ROLES), F.lit(False)), "role_not_allowed")
        .when(~F.coalesce(status.isin(*REQUEST_STATUSES), F.lit(False)), "unknown_status")
        .when((role == "vendor") & ~status.isin(*VENDOR_TARGETS), "not_for_vendor")
        .when((role == "tenant") & ~status.isin(*TENANT_TARGETS), "not_for_tenant")
    )
    return cleaned.withColumn("reason", reason)


def apply_status_changes(requests: DataFrame, events: DataFrame) -> Applied:
    """Move requests to the status of their last valid event.

    A close time is set by the last closing event and survives a later reopening.
    """
    judged = judge_status_events(events)
    allowed = judged.filter("reason IS NULL")
    order = F.struct("event_ts", "event_id")
    # Folded before any join: one row per request whatever the number of its events.
    outcome = allowed.groupBy("request_id").agg(
        F.max(order).alias("_last"),
        F.max_by("new_status", order).alias("_status"),
        F.max(F.when(F.col("new_status") == "closed", F.col("event_ts"))).alias("_closed_at"),
    )
    moved = requests.join(outcome, "request_id", "left").withColumns(
        {
            "request_status": F.coalesce("_status", "request_status"),
            "closed_at": F.coalesce("_closed_at", "closed_at"),
            "updated_at": F.coalesce("_last.event_ts", "updated_at"),
        }
    )
    unknown = allowed.join(requests.select("request_id"), "request_id", "left_anti")
    rejects = judged.filter("reason IS NOT NULL").unionByName(
        unknown.withColumn("reason", F.lit("unknown_request"))
    )
    return Applied(moved.select(*requests.columns), rejects)


def apply_payments(payments: DataFrame, events: DataFrame) -> Applied:
    """Pay charges in full on the day of their first event; paid or unknown ones are refused, and roles that may not pay."""
    allowed = events.filter(_may(events, PAYMENT_ROLES))
    first = allowed.groupBy("payment_id").agg(F.min(F.struct("event_ts", "event_id")).alias("_first"))
    open_charge = payments.filter("payment_status <> 'paid'").select("payment_id")
    effective = first.join(open_charge, "payment_id", "left_semi")
    paid_at = F.col("_first.event_ts")
    hit = F.col("_first").isNotNull()
    paid = payments.join(effective, "payment_id", "left").withColumns(
        {
            "amount_paid": F.when(hit, F.col("amount_due")).otherwise(F.col("amount_paid")),
            "payment_status": F.when(hit, "paid").otherwise(F.col("payment_status")),
            "paid_date": F.when(hit, F.to_date(paid_at)).otherwise(F.col("paid_date")),
            "updated_at": F.when(hit, paid_at).otherwise(F.col("updated_at")),
        }
    )
    used = effective.select("payment_id", F.col("_first.event_id").alias("event_id"))
    late = allowed.join(used, ["payment_id", "event_id"], "left_anti").withColumn(
        "reason", F.lit("already_paid_or_unknown")
    )
    barred = events.filter(~_may(events, PAYMENT_ROLES)).withColumn("reason", F.lit("role_not_allowed"))
    rejects = late.select(*events.columns, "reason").unionByName(barred)
    return Applied(paid.select(*payments.columns), rejects)


def ingest_requests(t: Tables, events: DataFrame) -> Applied:
    """Append new tickets under the next request ids, in event order."""
    priority = F.lower(_stripped(F.col("priority")))
    title = _stripped(F.col("title"))
    cleaned = events.withColumns(
        {
            "description": _stripped(F.coalesce("description", "title")),
            "title": title,
            "priority": F.when(priority.isin(*PRIORITIES), priority).otherwise("medium"),
            "tenant_id": F.coalesce("tenant_id", F.lit(1)).cast("long"),
        }
    )
    known = flag_known(cleaned, t.units, "unit_id", "unit_known")
    known = flag_known(known, t.tenants, "tenant_id", "tenant_known")
    reason = (
        F.when(~_may(events, TICKET_ROLES), "role_not_allowed")
        .when(F.col("unit_id").isNull() | F.col("title").isNull(), "missing_field")
        .when(F.length("title") > LONGEST_TITLE, "title_too_long")
        .when(~F.col("unit_known"), "unknown_unit")
        .when(~F.col("tenant_known"), "unknown_tenant")
    )
    judged = known.withColumn("reason", reason).drop("unit_known", "tenant_known")
    numbered = row_positions(
        judged.filter("reason IS NULL"), ["event_ts", "event_id"], "position", sample_from=events
    )
    fresh = numbered.select(
        (F.col("position") + _largest(t.maintenance_requests, "request_id")).alias("request_id"),
        "unit_id",
        "tenant_id",
        "title",
        "description",
        "priority",
        F.lit("open").alias("request_status"),
        F.col("event_ts").alias("created_at"),
        F.lit(None).cast("timestamp").alias("closed_at"),
        F.col("event_ts").alias("updated_at"),
    )
    rejects = judged.filter("reason IS NOT NULL")
    return Applied(t.maintenance_requests.unionByName(fresh), rejects)


# Unit status ----------------------------------------------------------------------


def refresh_unit_status(t: Tables, now: datetime) -> DataFrame:
    """Units with the status their leases imply: occupied or vacant, nothing else."""
    status = F.when(F.col("has_lease"), "occupied").otherwise("vacant")
    flagged = d.units_with_lease_flag(t, now.date())
    return _touch(flagged, "unit_status", F.lit(True), status, now).select(*t.units.columns)


def repair_unit_status(t: Tables, now: datetime) -> DataFrame:
    """Units with a stale "occupied" set to vacant; other states are kept."""
    stale = (F.col("unit_status") == "occupied") & ~F.col("has_lease")
    flagged = d.units_with_lease_flag(t, now.date())
    return _touch(flagged, "unit_status", stale, F.lit("vacant"), now).select(*t.units.columns)

"""The performance snapshot from stored sums that absorb batches of changes.

The sums are kept per unit: leases in force and their rent, money received in the month, requests and their
hours. A batch takes the old images of its rows out of them and puts the new ones in, so its work grows with
the batch and the number of units, not with the charges, leases and requests that were there before. Occupied
units cannot be kept per property, as leases may overlap; the fold from units to properties is done on reading,
which also lets units and properties change freely.

A version of the sums is written aside, checked for its key and only then listed as applied. A batch that is
listed already is refused: sums taken in twice would be wrong without a trace.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_total, count_where, in_month, is_current, is_open_request, mean_hours, micros_between, percentage
from ..schema import SCHEMAS, Tables
from . import definitions as d
from .changes import KEYS_TOGETHER, changed_ranges

COUNTS = ("leases", "total_requests", "open_requests", "high_priority_requests", "timed")
MONEYS = ("expected_rent", "collected_rent")
APPLIED = "as_of date, batch string, number bigint"
#: Tables whose changes move the sums. Changes of units and properties take effect on reading.
SUMMED = ("leases", "payments", "maintenance_requests", "tenants")
#: Of these, the key and the columns that the sums are made from; a row that changed in others only moves none.
READ = {
    "leases": ("lease_id", "unit_id", "tenant_id", "start_date", "end_date", "monthly_rent", "lease_status"),
    "payments": ("payment_id", "lease_id", "due_date", "amount_paid"),
    "maintenance_requests": ("request_id", "unit_id", "priority", "request_status", "created_at", "closed_at"),
    "tenants": ("tenant_id",),
}


class AlreadyAppliedError(ValueError):
    """The batch is in the stored sums already."""


@dataclass(frozen=True)
class Images:
    """Rows that a batch changed, as they were and as they are. An inserted row has no old image, a deleted one no new."""

    old: DataFrame
    new: DataFrame


def images_of(old: DataFrame, new: DataFrame, key: str) -> Images:
    """The images of two snapshots of one table; only ranges of keys that differ are joined."""
    ranges = changed_ranges(old, new, key)
    here = lambda df: df.join(ranges, F.floor(F.col(key) / KEYS_TOGETHER) == F.col("range"), "left_semi")
    before = here(old).select(key, F.struct(*old.columns).alias("before"))
    after = here(new).select(key, F.struct(*old.columns).alias("after"))
    both = before.join(after, key, "full").filter(~F.col("before").eqNullSafe(F.col("after")))
    side = lambda name: both.filter(F.col(name).isNotNull()).select(f"{name}.*")
    return Images(side("before"), side("after"))


def inserted(rows: DataFrame) -> Images:
    """The images of rows that are new."""
    return Images(rows.limit(0), rows)


def _sums(rows: DataFrame, **given: Column) -> DataFrame:
    """Rows of (unit_id, every sum), with zero for the sums not given."""
    columns = [F.coalesce(given.get(c, F.lit(0)).cast("long"), F.lit(0).cast("long")).alias(c) for c in COUNTS]
    columns += [as_total(F.coalesce(given.get(c, F.lit(0)), F.lit(0))).alias(c) for c in MONEYS]
    micros = F.coalesce(given.get("micros", F.lit(0)), F.lit(0)).cast("decimal(38,0)").alias("micros")
    return rows.select("unit_id", *columns, micros)


def _folded(parts: list[DataFrame]) -> DataFrame:
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("unit_id").agg(
        *[F.sum(c).alias(c) for c in COUNTS],
        *[as_total(F.sum(c)).alias(c) for c in MONEYS],
        F.sum("micros").cast("decimal(38,0)").alias("micros"),
    )


def _taken_out(part: DataFrame) -> DataFrame:
    moneys = [as_total(-F.col(c)).alias(c) for c in MONEYS]
    return part.select("unit_id", *[(-F.col(c)).alias(c) for c in COUNTS], *moneys, (-F.col("micros")).cast("decimal(38,0)").alias("micros"))


def _of_leases(leases: DataFrame, tenants: DataFrame, as_of: date) -> DataFrame:
    current = leases.filter(is_current(as_of)).join(tenants.select("tenant_id"), "tenant_id", "left_semi")
    per_unit = current.groupBy("unit_id").agg(F.count("*").alias("n"), F.sum("monthly_rent").alias("rent"))
    return _sums(per_unit, leases=F.col("n"), expected_rent=F.col("rent"))


def _of_payments(payments: DataFrame, leases: DataFrame, as_of: date) -> DataFrame:
    # Folded before the join: one row per lease whatever the number of its charges.
    paid = payments.filter(in_month("due_date", as_of)).groupBy("lease_id").agg(F.sum("amount_paid").alias("paid"))
    return _sums(paid.join(leases.select("lease_id", "unit_id"), "lease_id"), collected_rent=F.col("paid"))


def _of_requests(requests: DataFrame) -> DataFrame:
    micros = F.when(F.col("request_status") == "closed", micros_between("created_at", "closed_at"))
    per_unit = requests.groupBy("unit_id").agg(
        F.count("*").alias("n"),
        count_where(is_open_request()).alias("open"),
        count_where(F.col("priority").isin("high", "emergency")).alias("high"),
        F.sum(micros).alias("micros"),
        F.count(micros).alias("timed"),
    )
    c = F.col
    return _sums(
        per_unit, total_requests=c("n"), open_requests=c("open"), high_priority_requests=c("high"), timed=c("timed"), micros=c("micros")
    )


def unit_sums(t: Tables, as_of: date) -> DataFrame:
    """The sums of every unit that has a lease in force, money in the month or a request, from the whole tables."""
    return _folded(
        [_of_leases(t.leases, t.tenants, as_of), _of_payments(t.payments, t.leases, as_of), _of_requests(t.maintenance_requests)]
    )


def _tenant_moves(before: Tables, after: Tables, images: dict[str, Images], as_of: date) -> list[DataFrame]:
    """Leases that did not change but whose tenant came or went."""
    if "tenants" not in images:
        return []
    old, new = images["tenants"].old.select("tenant_id"), images["tenants"].new.select("tenant_id")
    gone, came = old.join(new, "tenant_id", "left_anti"), new.join(old, "tenant_id", "left_anti")
    unchanged = before.leases
    if "leases" in images:
        unchanged = unchanged.join(images["leases"].old.select("lease_id"), "lease_id", "left_anti")
    return [_taken_out(_of_leases(unchanged, gone, as_of)), _of_leases(unchanged, came, as_of)]


def _lease_moves(before: Tables, images: dict[str, Images], as_of: date) -> list[DataFrame]:
    """Money of charges that did not change but whose lease came, went or has another unit."""
    if "leases" not in images:
        return []
    places = lambda df, name: df.select("lease_id", F.col("unit_id").alias(name))
    both = places(images["leases"].old, "from").join(places(images["leases"].new, "to"), "lease_id", "full")
    moved = both.filter(~F.col("from").eqNullSafe(F.col("to")))
    unchanged = before.payments.filter(in_month("due_date", as_of)).join(moved.select("lease_id"), "lease_id", "left_semi")
    if "payments" in images:
        unchanged = unchanged.join(images["payments"].old.select("payment_id"), "payment_id", "left_anti")
    side = lambda name: moved.filter(F.col(name).isNotNull()).select("lease_id", F.col(name).alias("unit_id"))
    return [_taken_out(_of_payments(unchanged, side("from"), as_of)), _of_payments(unchanged, side("to"), as_of)]


def absorb(sums: DataFrame, before: Tables, after: Tables, images: dict[str, Images], as_of: date) -> DataFrame:
    """``sums`` of the portfolio ``before`` turned into those of ``after``.

    ``images`` holds what changed, by table; a table without an entry is the same on both sides. Charges that
    did not change are read only for leases that came, went or moved, leases only for tenants that came or went.
    """
    parts = [sums]
    for name, rows in images.items():
        if name == "leases":
            parts += [_taken_out(_of_leases(rows.old, before.tenants, as_of)), _of_leases(rows.new, after.tenants, as_of)]
        elif name == "payments":
            parts += [_taken_out(_of_payments(rows.old, before.leases, as_of)), _of_payments(rows.new, after.leases, as_of)]
        elif name == "maintenance_requests":
            parts += [_taken_out(_of_requests(rows.old)), _of_requests(rows.new)]
        elif name != "tenants":
            raise ValueError(f"no sums follow changes of {name}")
    return _folded(parts + _tenant_moves(before, after, images, as_of) + _lease_moves(before, images, as_of))


def performance_of(t: Tables, sums: DataFrame) -> DataFrame:
    """The performance snapshot from the sums of the units, one row per active property."""
    per_property = (
        t.units.select("unit_id", "property_id")
        .join(sums, "unit_id", "left")
        .groupBy("property_id")
        .agg(
            F.count("*").alias("units"),
            count_where(F.col("leases") > 0).alias("occupied"),
            *[F.sum(c).alias(c) for c in (*COUNTS, *MONEYS, "micros")],
        )
    )
    in_force = F.col("leases") > 0
    return (
        t.properties.filter("is_active")
        .join(per_property, "property_id", "left")
        .withColumns({c: as_total(F.when(in_force, F.col(c))) for c in MONEYS})
        .select(
            "property_id",
            "property_code",
            "property_name",
            "city",
            percentage(F.coalesce("occupied", F.lit(0)), F.coalesce("units", F.lit(0))).alias("occupancy_percentage"),
            *d.collection_columns(),
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_requests", "open_requests", "high_priority_requests")],
            mean_hours(F.col("micros"), F.col("timed")).alias("average_resolution_hours"),
        )
    )


# Stored versions ------------------------------------------------------------------


def _versions(folder: str, t: Tables, as_of: date) -> DataFrame:
    listed = t.properties.sparkSession.read.schema(APPLIED).json(f"{folder}/applied")
    return listed.filter(F.col("as_of") == F.lit(as_of))


def _store(sums: DataFrame, t: Tables, folder: str, as_of: date, batch: str, number: int) -> DataFrame:
    spark, path = t.properties.sparkSession, f"{folder}/sums/as_of={as_of.isoformat()}/number={number}"
    # What an attempt that failed left behind is not listed, so it may be replaced.
    sums.write.mode("overwrite").parquet(path)
    written = spark.read.parquet(path)
    if not written.groupBy("unit_id").count().filter("count > 1").isEmpty():
        raise d.DuplicateKeyError(f"unit_id is not unique in {path}")
    spark.createDataFrame([(as_of, batch, number)], APPLIED).write.mode("append").json(f"{folder}/applied")
    return written


def start_sums(t: Tables, as_of: date, folder: str) -> DataFrame:
    """Compute and store the sums of a day for the first time."""
    return _store(unit_sums(t, as_of), t, folder, as_of, "start", 0)


def absorb_batch(before: Tables, after: Tables, images: dict[str, Images], as_of: date, folder: str, batch: str) -> DataFrame:
    """Absorb a batch into the newest stored sums of the day, once."""
    versions = _versions(folder, before, as_of)
    if not versions.filter(F.col("batch") == batch).isEmpty():
        raise AlreadyAppliedError(batch)
    newest = versions.agg(F.max("number")).first()[0]
    if newest is None:
        raise LookupError(f"no sums of {as_of} in {folder}")
    sums = before.properties.sparkSession.read.parquet(f"{folder}/sums/as_of={as_of.isoformat()}/number={newest}")
    return _store(absorb(sums, before, after, images, as_of), before, folder, as_of, batch, newest + 1)


def changed_images(before: Tables, after: Tables, *names: str, as_of: date | None = None) -> dict[str, Images]:
    """The images of the named tables between two portfolios, with the columns that sums are made from.

    With ``as_of`` they are for sums of that day only, which follow no charges outside its month.
    """

    def counted(t: Tables, name: str) -> DataFrame:
        rows = getattr(t, name)
        if name == "payments" and as_of:
            rows = rows.filter(in_month("due_date", as_of))
        return rows.select(*READ[name])

    return {name: images_of(counted(before, name), counted(after, name), READ[name][0]) for name in names}

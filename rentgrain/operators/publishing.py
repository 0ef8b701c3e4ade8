"""Publishing a snapshot only after it has passed the gate.

The gate's figures are observed metrics on the rows as they go to their files; only charges without a lease
are counted by their keys alone. Rows are sorted where they are read and never shuffled: every file, with
small row groups, has its own order, in which reports skip what is outside the asked range. A version becomes
visible through a row in ``published``, which is written last; readers that follow it never see a version that
failed or is half written. The verdict of every attempt is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import day, is_current
from ..schema import Tables
from ..sources.canonical import CLUSTERING, conform, load_tables
from . import definitions as d
from .duplicates import repeated_keys
from .quality import QualityGateError

VERDICT = "version string, as_of date, table_rows bigint, occupancy_above_100 bigint, orphan_payments bigint, " \
    "invalid_active_leases bigint, repeated_properties bigint, status string"
GATE = ("occupancy_above_100", "orphan_payments", "invalid_active_leases", "repeated_properties")
#: Bytes of the files that are read as one piece, so that its rows are sorted in memory, and of a row group.
PIECE, ROW_GROUP = 32 << 20, 16 << 20


class NothingPublishedError(LookupError):
    """The folder has no version that passed the gate."""


def _version_folder(folder: str, version: str) -> str:
    return f"{folder}/version={version}"


@contextmanager
def _small_pieces(spark: SparkSession) -> Iterator[None]:
    """Files are read in pieces of ``PIECE`` bytes at most."""
    name = "spark.sql.files.maxPartitionBytes"
    most = spark.conf.get(name)
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(most) > PIECE:
        spark.conf.set(name, str(PIECE))
    try:
        yield
    finally:
        spark.conf.set(name, most)


def _written(rows: DataFrame, path: str, order: list[str], figures: dict[str, Column]) -> dict[str, int]:
    """Write ``rows`` and give their number and the figures, counted on the way."""
    seen = Observation()
    counted = rows.observe(seen, F.count("*").alias("rows"), *[c.alias(name) for name, c in figures.items()])
    if order:
        counted = counted.sortWithinPartitions(*order)
    files = counted.write.mode("errorifexists").option("compression", "zstd").option("parquet.block.size", ROW_GROUP)
    with _small_pieces(rows.sparkSession):
        files.parquet(path)
    return seen.get


def _per_lease(payments: DataFrame, leases: DataFrame) -> DataFrame:
    """Charges, once for each lease of their key; all as they are where no key repeats."""
    several = repeated_keys(leases, ["lease_id"], "_times").filter("lease_id IS NOT NULL")
    if several.isEmpty():
        return payments
    times = F.explode(F.array_repeat(F.lit(0), F.coalesce("_times", F.lit(1)).cast("int")))
    return payments.join(several, "lease_id", "left").select(*payments.columns, times.alias("_time")).drop("_time")


def orphan_payments(t: Tables) -> int:
    """Number of charges whose lease is not there; only keys are shuffled, with the number of their charges."""
    charged = t.payments.groupBy("lease_id").agg(F.count("*").alias("charges"))
    lost = charged.join(t.leases.select("lease_id"), "lease_id", "left_anti")
    return lost.agg(F.coalesce(F.sum("charges"), F.lit(0))).first()[0]


def write_version(t: Tables, as_of: date, folder: str, version: str) -> dict[str, int]:
    """Write every table and the performance snapshot of a version; gives the figures of the gate."""
    path, figures = _version_folder(folder, version), {"table_rows": 0}
    outside = is_current(as_of) & ~day(as_of).between(F.col("start_date"), F.col("end_date"))
    checks = {"leases": {"invalid_active_leases": F.count_if(outside)}}
    for name, table in t.items():
        rows = conform(table, name)
        if name == "payments":
            rows = _per_lease(rows, t.leases)
        seen = _written(rows, f"{path}/{name}", CLUSTERING.get(name, []), checks.get(name, {}))
        figures["table_rows"] += seen.pop("rows")
        figures |= seen
    figures["orphan_payments"] = orphan_payments(t)
    above = {"occupancy_above_100": F.count_if(F.col("occupancy_percentage") > 100)}
    stored = f"{path}/property_performance"
    figures |= _written(d.property_performance(t, as_of), stored, [], above)
    figures.pop("rows")
    keys = t.properties.sparkSession.read.parquet(stored).groupBy("property_id").count().filter("count > 1")
    return figures | {"repeated_properties": keys.count()}


def publish(t: Tables, as_of: date, folder: str, version: str) -> DataFrame:
    """Write a version, judge it, and make it visible if every figure of the gate is zero.

    Gives the verdict, one row, which is kept in either case; :func:`load_published` raises nothing and
    simply goes on with the version before if this one failed.
    """
    spark = t.properties.sparkSession
    figures = write_version(t, as_of, folder, version)
    passed = not any(figures[name] for name in GATE)
    row = (version, as_of, figures["table_rows"], *[figures[name] for name in GATE], "PASS" if passed else "FAIL")
    verdict = spark.createDataFrame([row], VERDICT)
    verdict.write.mode("append").json(f"{folder}/verdicts")
    if passed:
        verdict.select("version", "as_of").write.mode("append").parquet(f"{folder}/published")
    return verdict


def publish_or_raise(t: Tables, as_of: date, folder: str, version: str) -> None:
    """:func:`publish`, with :class:`QualityGateError` for a version that fails."""
    row = publish(t, as_of, folder, version).first().asDict()
    broken = [f"{name} = {row[name]}" for name in GATE if row[name]]
    if broken:
        raise QualityGateError("; ".join(broken))


def load_published(spark: SparkSession, folder: str) -> Tables:
    """The tables of the newest day that passed the gate; of one day, of the last version by name."""
    if not _exists(spark, f"{folder}/published"):
        raise NothingPublishedError(folder)
    newest = spark.read.schema("version string, as_of date").parquet(f"{folder}/published")
    row = newest.orderBy(F.desc("as_of"), F.desc("version")).first()
    return load_tables(spark, _version_folder(folder, row["version"]))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

"""Reading and writing the canonical tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SCHEMAS, Tables


def load_tables(spark: SparkSession, folder: str, file_format: str = "parquet") -> Tables:
    """The snapshot under ``folder``, one sub-folder per table, read with the declared schemas."""

    def read(name: str) -> DataFrame:
        return spark.read.schema(SCHEMAS[name]).format(file_format).load(f"{folder}/{name}")

    names = [name for name in SCHEMAS if name != "audit_logs"]
    return Tables(**{name: read(name) for name in names})


def conform(df: DataFrame, name: str) -> DataFrame:
    """Columns of ``df`` in the declared order and types of table ``name``."""
    return df.select(*[F.col(field.name).cast(field.dataType).alias(field.name) for field in SCHEMAS[name]])


# Sort order of the stored files. Reports filter on these columns, so files and row groups
# outside the asked range are skipped by their min/max; the key at the end keeps one busy
# day or status from ending up in one file.
CLUSTERING = {
    "payments": ["due_date", "payment_id"],
    "leases": ["lease_status", "end_date", "lease_id"],
    "maintenance_requests": ["created_at", "request_id"],
}


def save_tables(tables: Tables, folder: str) -> None:
    """Write a snapshot to a new folder; an existing one is never overwritten."""
    for name, frame in tables.items():
        rows = conform(frame, name)
        if name in CLUSTERING:
            rows = rows.repartitionByRange(*CLUSTERING[name]).sortWithinPartitions(*CLUSTERING[name])
        rows.write.mode("errorifexists").parquet(f"{folder}/{name}")


def write_records(df: DataFrame, path: str) -> None:
    """Result rows as JSON records, one object per line, keeping NULL fields."""
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def fresh_folder(spark: SparkSession) -> str:
    """A new folder that the driver and every executor reach.

    Below ``spark.checkpoint.dir``; a temporary folder of this machine only where that is unset and
    Spark runs inside one process, as in tests.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        top = tempfile.gettempdir()
    return f"{top.rstrip('/')}/portfolio-{uuid.uuid4().hex}"

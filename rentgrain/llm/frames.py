"""Helpers shared by the operators on documents: batches, text columns, tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one Arrow batch; with texts of up to some 100 KB a batch stays far below a worker's memory.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that the driver and every executor reach.

    Below ``spark.checkpoint.dir``; a temporary folder of this machine only where that is unset and
    Spark runs inside one process, as in tests.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        top = tempfile.gettempdir()
    return f"{top.rstrip('/')}/corpus-{uuid.uuid4().hex}"


def stored(frame: DataFrame) -> DataFrame:
    """``frame`` written as a table in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = frame.sparkSession
    path = shared_folder(spark)
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def map_batches(
    frame: DataFrame,
    function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: T.StructType | str,
) -> DataFrame:
    """``mapInArrow`` with batches of a few rows and bytes, so that a batch of long texts fits a worker."""
    settings = frame.sparkSession.conf
    settings.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    settings.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return frame.mapInArrow(function, schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Rows that a side may have to be broadcast; meant for rows of an id and a few numbers or short strings.
BROADCAST_ROWS = 200_000


def small(frame: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``frame`` marked for broadcasting if it has at most ``rows`` rows, which is counted; else as it is."""
    return F.broadcast(frame) if frame.limit(rows + 1).count() <= rows else frame


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

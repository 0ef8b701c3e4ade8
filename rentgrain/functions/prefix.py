"""Ordered running values without a single-task window and without materialising anything.

``Window.orderBy`` over a big group sorts that group in one task. Here rows are dealt into ranges of the
whole sort key instead (a day or month holding a third of all rows spreads over many ranges), each
range is scanned on its own, and one total per range is carried forward. Ranges lie between literals
of the plan (``ranges``), so a lost task computes the same rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranges import ranges_of, sorting

_RANGE = "_range"


def _ranged(df: DataFrame, order: list[str], sample_from: DataFrame | None) -> DataFrame:
    return df.withColumn(_RANGE, ranges_of(df if sample_from is None else sample_from, order).number())


def _carried(ranged: DataFrame, within: list[str], total: Column) -> DataFrame:
    """Per range, the total of all earlier ranges of the same group.

    Holds one row per (group, range it touches), so the window below sorts at most as
    many rows per group as there are ranges.
    """
    earlier = W.partitionBy(*within).orderBy(_RANGE).rowsBetween(W.unboundedPreceding, -1)
    return (
        ranged.groupBy(*within, _RANGE)
        .agg(total.alias("_total"))
        .select(*within, _RANGE, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_carried"))
    )


def running_sum(
    df: DataFrame, value: str, within: list[str], order: list[str], name: str, sample_from: DataFrame | None = None
) -> DataFrame:
    """Add ``sum(value) over (partition by within order by order)`` as ``name``.

    Rows with equal ``order`` share a range, so ties get the same value, as in the default
    window frame. ``sample_from`` has the columns of the key and is cheaper to read than ``df``.
    """
    ranged = _ranged(df, within + order, sample_from)
    inside = W.partitionBy(*within, _RANGE).orderBy(*order)
    return (
        ranged.withColumn("_inside", F.sum(value).over(inside))
        .join(_carried(ranged, within, F.sum(value)), within + [_RANGE])
        .withColumn(name, F.col("_inside") + F.col("_carried"))
        .drop("_inside", "_carried", _RANGE)
    )


def row_positions(df: DataFrame, order: list[str], name: str, sample_from: DataFrame | None = None) -> DataFrame:
    """Add the 1-based position in ``order`` (a unique key) as ``name``."""
    ranged = _ranged(df, order, sample_from)
    inside = W.partitionBy(_RANGE).orderBy(*order)
    return (
        ranged.withColumn("_inside", F.row_number().over(inside))
        .join(_carried(ranged, [], F.count("*")), [_RANGE])
        .withColumn(name, (F.col("_inside") + F.col("_carried")).cast("long"))
        .drop("_inside", "_carried", _RANGE)
    )


def dense_ranks(df: DataFrame, column: str, name: str, descending: bool = False) -> DataFrame:
    """Add ``dense_rank() over (order by column)`` as ``name``, for values of any type.

    Equal values share a range, so the ranks of a range go on from the distinct values of earlier
    ones. Missing values come first, or last if ``descending``.
    """
    order = [f"-{column}" if descending else column]
    inside = _ranged(df, order, None).withColumn("_inside", F.dense_rank().over(W.partitionBy(_RANGE).orderBy(*sorting(order))))
    return (
        inside.join(_carried(inside, [], F.max("_inside")), [_RANGE])
        .withColumn(name, (F.col("_inside") + F.col("_carried")).cast("long"))
        .drop("_inside", "_carried", _RANGE)
    )

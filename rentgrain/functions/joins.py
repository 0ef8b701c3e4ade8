"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_join_many(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left LEFT JOIN right`` where a key may repeat very often on the right.

    In an outer join Spark can split a skewed partition of the preserved side only. The
    matches are therefore found by an inner join, where either side may be split, and the
    left rows without a match are added.
    """
    matched = left.join(right, key)
    alone = left.join(right.select(key).distinct(), key, "left_anti")
    missing = {f.name: F.lit(None).cast(f.dataType) for f in right.schema if f.name != key}
    return matched.unionByName(alone.withColumns(missing))


def flag(df: DataFrame, keys: DataFrame, key: str, name: str) -> DataFrame:
    """Add a boolean: does ``key`` occur in ``keys``?

    For a frame in which ``key`` is unique; ``keys`` may repeat it without limit.
    """
    present = keys.select(key).distinct().withColumn(name, F.lit(True))
    return df.join(present, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def flag_known(df: DataFrame, table: DataFrame, key: str, name: str) -> DataFrame:
    """Add a boolean: is ``key`` in the table whose primary key it is?

    The table is not de-duplicated: both sides then reach the join straight from a
    shuffle, which is what Spark needs to split a skewed partition of ``df``.
    """
    present = table.select(key).withColumn(name, F.lit(True))
    return df.join(present, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def join_spread(rows: DataFrame, groups: DataFrame, key: list[str], spread_by: str, copies: int = 16) -> DataFrame:
    """Inner join of rows with one row per key, where a key may hold very many rows.

    The rows of a key are spread by a hash of ``spread_by`` and each group row is copied
    once per share, so no task gets all rows of a key.
    """
    share = F.pmod(F.xxhash64(spread_by), F.lit(copies))
    shares = F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda n: n.cast("long"))
    copied = groups.withColumn("_share", F.explode(shares))
    return rows.withColumn("_share", share).join(copied, [*key, "_share"]).drop("_share")

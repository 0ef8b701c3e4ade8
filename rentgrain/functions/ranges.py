"""Ranges of an order, between split points that stand in the plan as literals.

The range of a row is a function of its own sort key, so it is the same whenever and wherever the row is
computed: nothing has to be materialised to keep ranges fixed. Split points come from a sample of bounded
size, taken by hash, so they are the same each time too. An order is a list of column names, ``-name`` for
a falling one; as in Spark's own sorting, missing values come first, and last where the order falls.
"""

from __future__ import annotations

from datetime import date, datetime
from functools import cmp_to_key, reduce
from math import isnan

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys drawn for each split point, and the most ranges there are.
DRAWN, MOST_RANGES = 12, 256


def sorting(order: list[str]) -> list[Column]:
    """Sort expressions of an order."""
    return [F.desc(name[1:]) if name.startswith("-") else F.asc(name) for name in order]


def names_of(order: list[str]) -> list[str]:
    return [name.removeprefix("-") for name in order]


class Ranges:
    """Split points of an order and the expressions that follow from them."""

    def __init__(self, schema: T.StructType, order: list[str], points: list[tuple]) -> None:
        self.order, self.points = order, points
        self.kinds = [schema[name].dataType for name in names_of(order)]

    def _column(self, at: int) -> Column:
        column = F.col(self.order[at].removeprefix("-"))
        # As a number, since a time that went through the driver depends on the machine's zone.
        return F.unix_micros(column) if isinstance(self.kinds[at], T.TimestampType) else column

    def _literal(self, at: int, value: object) -> Column:
        kind = T.LongType() if isinstance(self.kinds[at], T.TimestampType) else self.kinds[at]
        return F.lit(value.isoformat() if isinstance(value, (date, datetime)) else value).cast(kind)

    def before(self, point: tuple) -> Column:
        """Whether a row comes before a point."""
        result = F.lit(False)
        for at in reversed(range(len(self.order))):
            column, value, falls = self._column(at), point[at], self.order[at].startswith("-")
            if value is None:
                ahead = column.isNotNull() if falls else F.lit(False)
                same = column.isNull()
            else:
                literal = self._literal(at, value)
                ahead = F.coalesce(column > literal, F.lit(False)) if falls else F.coalesce(column < literal, F.lit(True))
                same = F.coalesce(column == literal, F.lit(False))
            result = ahead | (same & result)
        return result

    def number(self) -> Column:
        """The range of a row, counted from 0: a decision tree over the points."""

        def tree(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            middle = (low + high) // 2
            return F.when(self.before(self.points[middle]), tree(low, middle)).otherwise(tree(middle + 1, high))

        return tree(0, len(self.points))

    def between(self, low: tuple | None, high: tuple | None) -> Column:
        """Rows from one point up to another; the first column's bounds stand by themselves, so that scans can use them."""
        conditions = [F.lit(True)]
        falls, column = self.order[0].startswith("-"), self._column(0)
        for point, starts in ((low, True), (high, False)):
            if point is None:
                continue
            conditions.append(~self.before(point) if starts else self.before(point))
            # Not for floating point: statistics of files and batches leave NaN out, which comes after all numbers.
            if point[0] is not None and not isinstance(point[0], float):
                literal = self._literal(0, point[0])
                bound = column <= literal if falls == starts else column >= literal
                conditions.append(bound if falls != starts else bound | column.isNull())
        return reduce(lambda a, b: a & b, conditions)


def _ordered(order: list[str]):
    """Python's comparison of two keys, as Spark compares them."""

    def plain(value: object) -> tuple:
        if isinstance(value, str):
            value = value.encode()
        if isinstance(value, float) and isnan(value):
            return (2, 0)
        return (0, 0) if value is None else (1, value)

    def compare(a: tuple, b: tuple) -> int:
        for x, y, name in zip(a, b, order, strict=True):
            x, y = plain(x), plain(y)
            if x != y:
                return (1 if x > y else -1) * (-1 if name.startswith("-") else 1)
        return 0

    return cmp_to_key(compare)


def ranges_of(df: DataFrame, order: list[str], count: int | None = None) -> Ranges:
    """Ranges of ``df`` of about equal size, ``count`` of them or as many as Spark shuffles into."""
    if count is None:
        count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = min(count, MOST_RANGES)
    found = Ranges(df.schema, order, [])
    keys = df.select(*[found._column(at).alias(f"k{at}") for at in range(len(order))])
    drawn = keys.orderBy(F.xxhash64(*keys.columns)).limit(DRAWN * count)
    sample = drawn.agg(F.collect_list(F.struct(*keys.columns)).alias("keys")).first()["keys"]
    points = sorted((tuple(key) for key in sample), key=_ordered(order))
    found.points = list(dict.fromkeys(points[DRAWN // 2 :: max(DRAWN, -(-len(points) // count))]))
    return found

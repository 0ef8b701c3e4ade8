"""Top-k and page selection."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import names_of, ranges_of, sorting

DEFAULT_PAGE_SIZE = 50


def _checked(page: int, page_size: int) -> tuple[int, int]:
    if page < 1 or page_size < 1:
        raise ValueError(f"pages and their sizes start at 1, not {page} and {page_size}")
    return page, page_size


#: Rows up to which a page is cut from a top-k; from there on it is selected by rank.
SHALLOW = 10_000
#: Rows that ranges holding a page may have to be sorted as they are.
FEW = 50_000


def page_of(
    rows: DataFrame,
    order: list[str],
    page: int = 1,
    page_size: int = DEFAULT_PAGE_SIZE,
    keys: DataFrame | None = None,
    top: DataFrame | None = None,
) -> DataFrame:
    """One page of ``rows`` in a unique ``order`` (``-name`` falls); a page past the end has no rows.

    Up to ``SHALLOW`` rows from the start, Spark's own top-k is fine; ``top`` may be a cheaper frame
    with these rows. A deep page is selected by rank: the rows are counted per range between
    split points, the ranges that hold the page are split again until they are small, and only those
    are sorted. ``keys`` has one row per row of ``rows`` with the columns of the order, and is all
    that is read before.
    """
    page, page_size = _checked(page, page_size)
    offset = (page - 1) * page_size
    if offset + page_size <= SHALLOW:
        return (rows if top is None else top).orderBy(*sorting(order)).offset(offset).limit(page_size)
    keys = (rows if keys is None else keys).select(*names_of(order))
    low, high, left = None, None, None
    while True:
        here = ranges_of(keys if left is None else keys.filter(here.between(low, high)), order)
        inside = keys.filter(here.between(low, high)).groupBy(here.number().alias("range")).agg(F.count("*").alias("n"))
        counted = inside.agg(F.collect_list(F.struct("range", "n")).alias("counts")).first()["counts"]
        sizes = [0] * (len(here.points) + 1)
        for number, n in counted:
            sizes[number] = n
        starts = list(accumulate(sizes, initial=0))
        if offset >= starts[-1]:
            return rows.limit(0)
        first = bisect_right(starts, offset) - 1
        last = bisect_left(starts, offset + page_size) - 1
        low = here.points[first - 1] if first else low
        high = here.points[last] if last < len(here.points) else high
        offset, held = offset - starts[first], sum(sizes[first : last + 1])
        if held <= max(FEW, 4 * page_size) or held == left:
            return rows.filter(here.between(low, high)).orderBy(*sorting(order)).offset(offset).limit(page_size)
        left = held


def rows_through(page: int, page_size: int) -> int:
    """Rows from the start up to the end of the page."""
    page, page_size = _checked(page, page_size)
    return page * page_size


def limited(ordered: DataFrame, k: int | None) -> DataFrame:
    """The first ``k`` rows, or all without ``k``."""
    return ordered if k is None else ordered.limit(k)


def at_least_kth(kept: DataFrame, column: str, k: int | None) -> Column:
    """Condition that holds for the ``k`` rows of ``kept`` with the largest ``column``.

    ``kept`` holds the rows that survive all joins of a top-k query, narrowed to the key.
    Filtering the wide rows by this bound first gives the same top k, but lets the scan
    skip nearly everything instead of shuffling every wide row into the joins. Ties with
    the k-th value are kept, and so are rows without a value, which come last.
    Without ``k`` all rows are kept.
    """
    if k is None:
        return F.lit(True)
    bound = kept.select(column).orderBy(F.desc(column)).limit(k).agg(F.min(column))
    return (F.col(column) >= bound.scalar()) | F.col(column).isNull()

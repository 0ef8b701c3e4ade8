"""Search, sort and page any result, as an interactive grid does."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paging import page_of

PAGE_SIZE = 12


def matching_rows(df: DataFrame, term: str | None) -> DataFrame:
    """Rows with the term in any column, ignoring case; all rows for a blank term."""
    wanted = (term or "").strip().lower()
    if not wanted:
        return df
    cells = [F.lower(F.coalesce(F.col(name).cast("string"), F.lit(""))) for name in df.columns]
    return df.filter(reduce(lambda a, b: a | b, [cell.contains(wanted) for cell in cells]))


def sort_keys(df: DataFrame, column: str) -> list[Column]:
    """Expressions to sort a column by, without a direction.

    Numbers sort by value with missing as 0. Text that reads as a number sorts by value in
    front of other text, which sorts as text; missing text counts as 0.
    """
    kind, value = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.NumericType):
        keys = [F.coalesce(value, F.lit(0))]
    elif isinstance(kind, T.StringType):
        cleaned = F.trim(F.coalesce(value, F.lit("")))
        number = F.when(cleaned == "", F.lit(0.0)).otherwise(cleaned.try_cast("double"))
        keys = [number.isNull(), F.coalesce(number, F.lit(0.0)), F.lower(cleaned), cleaned]
    else:
        keys = [F.coalesce(value.cast("string"), F.lit(""))]
    return keys


def grid_query(
    df: DataFrame,
    term: str | None = None,
    sort: str | None = None,
    descending: bool = False,
    page: int = 1,
    page_size: int = PAGE_SIZE,
    tie: str | None = None,
) -> DataFrame:
    """One page of the matching rows; a page past the end has none."""
    keys = {f"_key{n}": key for n, key in enumerate(sort_keys(df, sort or df.columns[0]))}
    rows = matching_rows(df, term).withColumns(keys)
    order = [f"-{name}" if descending else name for name in keys] + ([tie] if tie else [])
    return page_of(rows, order, page, page_size).drop(*keys)

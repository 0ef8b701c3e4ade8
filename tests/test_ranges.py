"""Ranges, deep pages, running values and ranks against Python, on ties, missing values and every direction."""

from __future__ import annotations

import random
import re
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rentgrain.functions import paging
from rentgrain.functions.paging import page_of
from rentgrain.functions.prefix import dense_ranks, row_positions, running_sum
from rentgrain.functions.ranges import ranges_of, sorting
from rentgrain.operators.rewrites import plan_text

SCHEMA = "id long, name string, due date, at timestamp, amount decimal(12,2), rate double"


def rows(count: int = 1500):
    r = random.Random(1)
    out = []
    for k in range(count):
        hot = k % 3 == 0  # a third of the rows share all but the id
        out.append((
            k, None if k % 31 == 0 else "Zz" if hot else r.choice(["a", "b", "é", "漢", "", "B"]),
            None if k % 37 == 0 else date(2024, 1, 1) + timedelta(days=0 if hot else r.randrange(400)),
            datetime(2024, 1, 1, 5) + timedelta(seconds=0 if hot else r.randrange(10**6), microseconds=r.randrange(10**6)),
            None if k % 41 == 0 else Decimal(0 if hot else r.randrange(-500, 500)) / 4,
            None if k % 43 == 0 else float("nan") if k % 47 == 0 else r.random(),
        ))
    return out


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ranges") / "rows")
    spark.createDataFrame(rows(), SCHEMA).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


ORDERS = [
    ["id"], ["-id"], ["name", "id"], ["-name", "id"], ["due", "-id"], ["-due", "-amount", "id"], ["-at", "id"], ["rate", "id"],
    ["-rate", "id"], ["amount", "-name", "due", "id"],
]


@pytest.mark.parametrize("order", ORDERS, ids=" ".join)
def test_pages_selected_by_rank_equal_a_sort(spark, table, order, monkeypatch):
    monkeypatch.setattr(paging, "SHALLOW", 0)
    monkeypatch.setattr(paging, "FEW", 40)
    whole = [r["id"] for r in table.orderBy(*sorting(order)).collect()]
    for page, size in ((1, 10), (30, 7), (9, 160), (150, 10), (2, 1400)):
        found = [r["id"] for r in page_of(table, order, page, size).collect()]
        assert found == whole[(page - 1) * size : page * size], (page, size)
    assert page_of(table, order, 1501, 1).count() == 0
    assert page_of(table.limit(0), order, 3, 10).count() == 0


def test_ranges_partition_the_rows_in_order(table):
    ranges = ranges_of(table, ["-name", "due", "id"], 6)
    numbered = table.withColumn("range", ranges.number())
    ordered = [r["range"] for r in numbered.orderBy(*sorting(["-name", "due", "id"])).collect()]
    assert ordered == sorted(ordered) and 3 <= len(set(ordered)) <= 7
    assert max(ordered.count(k) for k in set(ordered)) < 900  # the hot third of the rows is split by its ids


def test_a_deep_page_sorts_only_its_ranges(spark, table, monkeypatch):
    monkeypatch.setattr(paging, "SHALLOW", 100)
    monkeypatch.setattr(paging, "FEW", 200)
    deep = page_of(table, ["due", "id"], 100, 10)
    plan = deep._jdf.queryExecution().optimizedPlan().toString()
    # The offset that is left is inside the range, not the 990 rows before the page; the range is a filter.
    assert [int(x) < 200 for x in re.findall(r"Offset (\d+)", plan)] == [True]
    assert "Filter" in plan and "due" in plan


def test_running_sum_and_positions_stay_lazy(spark, table):
    rows = table.where("amount IS NOT NULL")
    summed = running_sum(rows, "amount", ["name"], ["due", "id"], "total")
    plan = plan_text(summed)
    assert "ExistingRDD" not in plan and "Checkpoint" not in plan
    expected: dict = {}
    totals: dict = {}
    for r in rows.orderBy(F.asc("due"), "id").collect():
        totals[r["name"]] = totals.get(r["name"], 0) + r["amount"]
        expected[r["id"]] = totals[r["name"]]
    # Groups without a name have no total to join, as in any equality of keys.
    assert {r["id"]: r["total"] for r in summed.where("name IS NOT NULL").collect()} == {
        r["id"]: expected[r["id"]] for r in rows.where("name IS NOT NULL").collect()
    }
    placed = row_positions(table.where("id % 2 = 0"), ["due", "id"], "n", sample_from=table)
    assert [r["n"] for r in placed.orderBy("due", "id").collect()] == list(range(1, 751))


@pytest.mark.parametrize("column", ["name", "amount", "rate", "due"])
@pytest.mark.parametrize("descending", [False, True])
def test_dense_ranks_of_any_type(table, column, descending):
    found = dense_ranks(table, column, "n", descending)
    plan = plan_text(found)
    assert "ExistingRDD" not in plan
    ordered = found.orderBy(*sorting([f"-{column}" if descending else column])).collect()
    expected, last, n = [], object(), 0
    for r in ordered:
        value = r[column]
        key = "nan" if value != value else value
        n += key != last
        last = key
        expected.append(n)
    assert [r["n"] for r in ordered] == expected

"""Shape of the plans and agreement of every registered query with its SQL."""

import ast
import os
import re
from pathlib import Path

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry
from rentgrain.plans import catalog, checks
from rentgrain.operators.rewrites import plan_text

SMALL = "/root/testdata/sf0.001"
PACKAGE = Path(__file__).parent.parent / "rentgrain"

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the star tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_every_query_has_a_check():
    assert set(catalog.queries()) == set(checks.oracle_sql())
    assert set(catalog.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql_and_multiplies_no_rows(spark, duck, name):
    query = entry.queries()[name]
    line = compare(spark, duck, SMALL, name, query, entry.oracle_sql()[name])
    assert line.startswith("ok"), line
    plan = plan_text(query(spark, SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0


def test_latest_payment_keeps_one_row_per_group_before_each_shuffle(spark):
    plan = plan_text(entry.queries()["latest_payment_per_tenant"](spark, SMALL))
    assert plan.count("WindowGroupLimit") >= 4 and "Partial" in plan


def _calls(tree: ast.AST) -> set[str]:
    return {
        node.func.attr
        for node in ast.walk(tree)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute)
    }


SOURCES = sorted(p for p in PACKAGE.rglob("*.py") if "llm" not in p.relative_to(PACKAGE).parts)


@pytest.mark.parametrize("path", SOURCES, ids=lambda p: str(p.relative_to(PACKAGE)))
def test_source_keeps_the_rules(path):
    text = path.read_text()
    calls = _calls(ast.parse(text))
    # The day is an argument; nothing depends on when a job runs.
    assert not re.search(r"current_(date|timestamp)|\bnow\(\)|today\(\)", text, re.I)
    # No rows through the driver, no unchecked broadcast, no pairing of everything.
    assert not calls & {"collect", "toPandas", "broadcast", "crossJoin", "localCheckpoint", "udf", "pandas_udf", "cache"}

"""The registered corpus queries against their SQL, and the library without them."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry
from rentgrain.llm import registry

SMALL = "/root/testdata/sf0.001"
TOP = Path(entry.__file__).parent


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    line = compare(spark, connect(SMALL), SMALL, name, entry.queries()[name], entry.oracle_sql()[name])
    assert line.startswith("ok"), line


def test_native_queries_have_no_python(spark):
    for name in ("op1_decontamination", "op7_rules"):
        plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "Arrow" not in plan and "Python" not in plan and "Cartesian" not in plan


def test_entry_without_the_corpus_operators(tmp_path):
    shutil.copytree(TOP / "rentgrain", tmp_path / "rentgrain", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(TOP / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and not [x for x in e.queries() if x.startswith('op1_')]"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)


@pytest.mark.parametrize("missing", ["ahocorasick", "sentencepiece", "zstandard"])
def test_entry_without_a_library_of_the_corpus_operators(missing):
    code = (
        f"import sys; sys.modules['{missing}'] = None; import __spark_entry__ as e; "
        "assert len(e.queries()) > 100 and not [x for x in e.queries() if x.startswith('op1_')]"
    )
    subprocess.run([sys.executable, "-c", code], cwd=TOP, check=True, timeout=120)

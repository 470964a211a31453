"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry_points
from tools.check import compare, connect

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query_equals_its_sql(spark, con, small, name):
    note, ok = compare(spark, con, name, entry_points.queries()[name], entry_points.oracle_sql().get(name), small)
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_executors_need_no_package(small, tmp_path):
    """Python workers that cannot import the package still run its functions."""
    script = f"""
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry", {os.path.join(REPO, "__spark_entry__.py")!r})
entry = importlib.util.module_from_spec(spec); spec.loader.exec_module(entry)
from voxloom.session import local_session
spark = local_session(2, shuffle_partitions=2, memory="2g")
from pyspark.sql import functions as F
@F.pandas_udf("boolean")
def importable(s):
    import importlib.util
    return s.map(lambda _: importlib.util.find_spec("voxloom") is not None)
print("IMPORTABLE", spark.range(1).select(importable("id")).first()[0])
for name in ("dtw_similarity", "prepare_sources", "prepare_isolated", "evaluate_pairs"):
    print("ROWS", name, len(entry.queries()[name](spark, {small!r}).collect()))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "IMPORTABLE False" in done.stdout
    assert done.stdout.count("ROWS") == 4

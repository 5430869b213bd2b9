"""Registered queries against their SQL counterparts, and imports without a session."""

import subprocess
import sys
from pathlib import Path

import pytest

from compare import compare, connect
from pairforge.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_one_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_imports_need_no_session():
    root = Path(__file__).resolve().parents[2]
    code = "import __spark_entry__ as e; assert 'pipeline' in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


@pytest.mark.parametrize("name", ORACLES)
def test_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], SF) is None

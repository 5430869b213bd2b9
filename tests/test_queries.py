"""Every registered query against its SQL counterpart on the smallest tables."""

import re

import pytest

import __spark_entry__ as spark_entry
from compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"
# The corpus operators have tests of their own, and may be taken out.
_OWN = re.compile(r"q_")
QUERIES, ORACLES = ({k: v for k, v in x.items() if _OWN.match(k)} for x in (spark_entry.queries(), spark_entry.oracle_sql()))


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_registry_is_complete():
    assert not set(ORACLES) - set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0


def test_no_query_pairs_everything_with_everything(spark):
    for name in ("q_loss_bundle", "q_retrieval_ranks", "q_sts_spearman", "q_cap_examples", "q_eval_report", "q_batches"):
        plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    if name not in ORACLES:
        assert QUERIES[name](spark, SF_DIR).count() > 0
    else:
        assert compare(spark, con, QUERIES[name], ORACLES[name], SF_DIR) is None

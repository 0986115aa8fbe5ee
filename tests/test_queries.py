"""Registered queries: agreement with SQL on the small tables, and plans that hold at scale."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from motionlake.plans.catalog import REGISTRY  # noqa: E402
from tools.check import compare, oracle_connection  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")

# the one global ordering: file blocks, one row per block
ROW_INDEX = {"a07_missing_athletes", "a10_test_ids"}
# whole-table reports end in one sorted or top-k table of bounded size
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")
# model fits run several jobs to build their plan; their plans are checked through their operators' tests
FITTED = {n for n in REGISTRY if n[:3] in {f"d{i:02d}" for i in range(2, 25)} | {"h02"} or n == "h03_cluster_summary" or n.startswith("h04_similar_to_each")}


@pytest.fixture(scope="module")
def con():
    return oracle_connection(FOLDER)


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if q.sql is not None))
def test_agrees_with_sql(spark, con, name):
    verdict = compare(spark, con, FOLDER, name)
    assert verdict.startswith("ok"), verdict


@pytest.mark.parametrize("name", sorted(n for n in REGISTRY if n not in FITTED))
def test_plan(spark, name):
    plan = REGISTRY[name].run(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for operator in FORBIDDEN:
        assert operator not in plan
    if name not in ROW_INDEX:
        # a single partition may hold a final aggregate row, never a window
        lines = plan.splitlines()
        for i, line in enumerate(lines):
            if "Window" in line and "WindowGroupLimit" not in line:
                below = "\n".join(lines[i + 1 : i + 4])
                assert "Exchange SinglePartition" not in below, plan


def test_columns_are_pruned_and_filters_pushed(spark):
    from datetime import date

    from motionlake.operators import selection
    from motionlake.plans.views import Tables

    plan = REGISTRY["g04_session_progress"].run(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "l_orderkey" not in scan and "IsNotNull(l_suppkey)" in scan
    t = Tables(spark, FOLDER)
    chosen = selection.in_dates(t.events, date(2024, 1, 3), date(2024, 1, 4)).select("value")
    scan = next(line for line in chosen._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line)
    assert "GreaterThanOrEqual(ts" in scan and "LessThan(ts" in scan and "event_type" not in scan


def test_results_do_not_depend_on_partitioning(spark):
    from motionlake.operators import sessions, teams
    from motionlake.plans import sprint_queries
    from motionlake.plans.views import REP_ORDER, Tables
    from motionlake.operators.athletes import power_endurance

    df = Tables(spark, FOLDER).sprints

    def rounded(frame):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in frame.collect())

    for run in (
        lambda d: teams.team_periods(d, sprint_queries.BASELINE, sprint_queries.RECENT),
        lambda d: power_endurance(d, REP_ORDER),
        sessions.athlete_summary,
    ):
        assert rounded(run(df)) == rounded(run(df.repartition(13)))


def test_entry_contract(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert all(name.isidentifier() for name in contract.queries())

from __future__ import annotations

import os

import pytest

from codequarry import session
from codequarry.plans import extraction
from tests.oracle import DATA, same_rows

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def _broadcast_rows(spark, since: int) -> dict[int, list[int]]:
    """Rows of every broadcast of the executions after the first ``since``."""
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    store, out = spark._jsparkSession.sharedState().statusStore(), {}
    runs = store.executionsList()
    for i in range(since, runs.size()):
        run = runs.apply(i).executionId()
        nodes, values = store.planGraph(run).allNodes(), store.executionMetrics(run)
        for node in map(nodes.apply, range(nodes.size())):
            for m in map(node.metrics().apply, range(node.metrics().size())):
                if node.name() == "BroadcastExchange" and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    out.setdefault(run, []).append(int(values.apply(m.accumulatorId()).replace(",", "")))
    return out


def test_calls_broadcast_no_table_above_the_bound(spark, monkeypatch):
    """The files of a large tree are far smaller than its rows, so Spark's statistics would send all functions through the driver."""
    monkeypatch.setattr(session, "BROADCAST_ROWS", 100, raising=False)
    since = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    assert same_rows(spark, extraction.QUERIES["extract_calls"], extraction.SQL["extract_calls"])
    assert max(n for rows in _broadcast_rows(spark, since).values() for n in rows) <= 100


def test_files_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(extraction, "FILES_PER_TASK", 50, raising=False)
    made = extraction.files(spark, DATA)
    assert made.rdd.getNumPartitions() > made.count() // 50

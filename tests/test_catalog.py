from __future__ import annotations

import os

import pytest

from codequarry.plans import catalog
from tests.oracle import DATA, SETTINGS, same_rows_at

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("setting", SETTINGS, ids=["small", "large"])
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, name, setting):
    assert same_rows_at(spark, catalog.QUERIES[name], catalog.SQL[name], setting)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(catalog.QUERIES) <= set(e.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert e.entry(spark).count() > 0

from __future__ import annotations

import os

import pytest

from codequarry.llm import registry
from tests.oracle import DATA, SETTINGS, same_rows_at

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("setting", SETTINGS, ids=["small", "large"])
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, name, setting):
    assert same_rows_at(spark, registry.QUERIES[name], registry.SQL[name], setting)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_whole_table(spark, name):
    n = registry.QUERIES[name](spark, DATA).count()
    whole = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert n == whole or (name.startswith(("op1_", "op6_")) and n > 0)

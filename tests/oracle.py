"""Comparison of a query's rows with its SQL's rows in DuckDB."""

from __future__ import annotations

import math
import os
from pathlib import Path

import numpy as np

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: (tables, shuffle partitions): the second is large enough that range parts, hash parts and samples differ.
SETTINGS = [(DATA, 4), ("/root/testdata/sf0.01", 7)]


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, int, np.floating, np.integer)):
        return round(float(v), 9)
    return str(v)


def same_rows(spark, query, sql: str, data: str = DATA) -> bool:
    import duckdb

    db = duckdb.connect()
    for p in sorted(Path(data).glob("*.parquet")):
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    want = db.sql(sql)
    got = query(spark, data)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)

    def rows(found, names):
        at = [names.index(c) for c in columns]
        return sorted((tuple(_plain(r[i]) for i in at) for r in found), key=repr)

    a, b = rows(got.collect(), got.columns), rows(want.fetchall(), want.columns)
    assert a == b
    return True


def same_rows_at(spark, query, sql: str, setting: tuple[str, int]) -> bool:
    """As ``same_rows`` over the setting's tables and with its number of shuffle partitions."""
    import pytest

    data, parts = setting
    if not os.path.isdir(data):
        pytest.skip("no such tables")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        return same_rows(spark, query, sql, data)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

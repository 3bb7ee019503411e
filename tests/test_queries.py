"""Every registered query on the smallest tables, against its SQL where it has one."""

from __future__ import annotations

import importlib.util
import math
import os
from pathlib import Path

import duckdb
import pytest

from tidemark.plans.registry import load

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ENTRIES = load()
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="tables are not here")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    connection.sql("SET TimeZone = 'UTC'")
    for file in Path(FOLDER).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


@pytest.mark.parametrize("name", list(ENTRIES))
def test_query(spark, db, name):
    df = ENTRIES[name].run(spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    if ENTRIES[name].sql is None:
        return
    result = db.sql(ENTRIES[name].sql)
    assert sorted(df.columns) == sorted(result.columns)
    assert table(df.columns, rows) == table(result.columns, result.fetchall())


def test_entry_points(spark):
    path = Path(__file__).resolve().parents[1] / "__spark_entry__.py"
    spec = importlib.util.spec_from_file_location("spark_entry", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert set(module.oracle_sql()) <= set(module.queries())
    assert module.entry(spark).count() > 0

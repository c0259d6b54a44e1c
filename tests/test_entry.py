"""Every query against its SQL in DuckDB on the smallest tables, and the structure of the package."""

import decimal
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parent.parent
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no tables")


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for file in DATA.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


@needs_data
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    rows = entry.queries()[name](spark, str(DATA))
    columns = sorted(rows.columns)
    result = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    expected = Counter(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in result.fetchall())
    assert Counter(repr(tuple(plain(r[c]) for c in columns)) for r in rows.collect()) == expected


@needs_data
@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, str(DATA)).count() >= 0


@needs_data
def test_entry(spark):
    assert entry.entry(spark).columns == ["run_id", "place", "field", "drift_kind"]


def test_nothing_else_imports_the_subpackage():
    for file in ROOT.glob("gristmill/**/*.py"):
        if "llm" not in file.relative_to(ROOT).parts:
            assert not re.search(r"gristmill\.llm|from \.+llm", file.read_text()), file


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

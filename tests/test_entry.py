"""The registered queries give the rows of their SQL twins."""

import duckdb
import pytest

import __spark_entry__ as entry
from searchloom.plans import registry
from searchloom.plans.fixtures import TABLES

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    own = duckdb.connect()
    for t in TABLES:
        own.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return own


def plain(value):
    """As both engines show it: a negative zero is a zero."""
    return repr(value + 0.0 if isinstance(value, float) else value)


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(registry.queries()) > 80


def test_flagship(spark):
    assert entry.entry(spark).columns == ["metric", "mean", "n"]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_twin(spark, con, name):
    df = registry.queries()[name](spark, D)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    show = lambda rows: sorted(str([plain(x) for x in r]) for r in rows)
    assert show(got) == show(want) and want

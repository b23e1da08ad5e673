"""Every registered query against its SQL counterpart on the smallest driver tables."""

import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry_points  # noqa: E402

from gistmill.plans.oracles import all_oracles  # noqa: E402
from gistmill.plans.queries import all_queries  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("conversations", "documents", "embeddings", "events")

pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no driver tables")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_sql(spark, sql, name):
    df = entry_points.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(row[c] for c in columns) for row in df.collect()]
    cursor = sql.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = [tuple(row[names.index(c)] for c in columns) for row in cursor.fetchall()]
    assert got and sorted(map(repr, got)) == sorted(map(repr, expected))


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_oracles())
    assert set(all_queries()) <= set(entry_points.queries())
    assert set(all_oracles()) <= set(entry_points.oracle_sql())


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["lang", "rouge1", "n"]

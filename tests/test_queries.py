import math
import os

import duckdb
import pytest
from pyspark.sql import SparkSession

from trackloom.plans import best_class, curves, features, learning, long_tracks, motion, queries, reports, sql, streams, sweeps, views

QUERIES, SQL = queries.QUERIES | motion.QUERIES | features.QUERIES | reports.QUERIES | learning.QUERIES | curves.QUERIES | sweeps.QUERIES | views.QUERIES | long_tracks.QUERIES | streams.QUERIES | best_class.QUERIES, sql.SQL | motion.SQL | features.SQL | reports.SQL | learning.SQL | curves.SQL | sweeps.SQL | views.SQL | long_tracks.SQL | streams.SQL | best_class.SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def spark():
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
    session = session.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def key(row):
    return [str(round(x, 3) + 0.0) if isinstance(x, float) else str(x) for x in row]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_queries_without_sql_give_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((list(r) for r in df.select(columns).collect()), key=key)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    want = db.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    want = sorted(([r[names.index(c)] for c in columns] for r in want.fetchall()), key=key)
    assert len(got) == len(want) > 0
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            same = x == y or isinstance(x, float) and y is not None and math.isclose(x, y, rel_tol=0, abs_tol=2e-6)
            assert same, (name, columns, a, b)

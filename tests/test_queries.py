"""Every query of the engine that has SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from orbweave.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "nation events orders lineitem embeddings conversations pages documents".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return v
    return round(float(v), 6)


def rows(records, columns):
    return sorted((tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, con, name):
    frame = registry.QUERIES[name](spark, DATA)
    want = con.sql(registry.SQL[name])
    assert sorted(frame.columns) == sorted(want.columns)
    assert rows([tuple(r) for r in frame.collect()], frame.columns) == rows(want.fetchall(), want.columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(registry.SQL) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["day", "source", "cls", "n"]


def test_likelihood_pairs_are_dealt_over_tasks(spark):
    """A few sites and families do not decide how many tasks share the pairs."""
    pairs = registry.QUERIES["t1_likelihood_pairs"](spark, "/root/testdata/sf0.01").withColumn("task", F.spark_partition_id())
    assert pairs.groupBy("task").count().count() > 30

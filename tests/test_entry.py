import os

import duckdb
import pytest

import __spark_entry__ as entry
from strandmill.plans import catalog, problems

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def values(table):
    names = sorted(table.column_names)
    return names, sorted(map(repr, zip(*(table.column(n).to_pylist() for n in names))))


@pytest.mark.parametrize("name", [*catalog.QUERIES, *problems.QUERIES])
def test_query_against_sql(spark, db, name):
    got = entry.queries()[name](spark, DATA).toArrow()
    assert values(got) == values(db.sql(entry.oracle_sql()[name]).to_arrow_table())


def test_entry(spark):
    assert entry.entry(spark).columns == ["kmer", "n"]

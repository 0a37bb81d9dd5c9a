import os
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from strandmill.llm import queries, spam

DATA, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
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


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, db, name):
    got = entry.queries()[name](spark, DATA).toArrow()
    if name in queries.ORACLE:
        assert values(got) == values(db.sql(queries.ORACLE[name]).to_arrow_table())
    else:
        assert got.num_rows > 0


def test_spam_of_the_small_table(spark):
    """Held against the labels, and against the pages as read: two service lists and one run of product tags."""
    found = {r.doc_id for r in queries.p10_found(spark, DATA).collect()}
    labels = {r.doc_id: r.is_spam for r in spark.read.parquet(f"{DATA}/spam_labels.parquet").collect()}
    assert found == {18, 52, 69} and all((i in found) == bool(y) for i, y in labels.items())


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="needs the test tables")
def test_spam_of_held_out_labels(spark):
    """Three folds of the labels of sf0.01: those of two are fitted, those of the third judged."""
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "spam_labels"))
    x = {r.doc_id: r.signals for r in spam.spam_signals(docs.join(labels, "doc_id"), "doc_id", "text").collect()}
    known = {r.doc_id: r.is_spam for r in labels.collect() if r.doc_id in x}
    right = Counter()
    for fold in range(3):
        ids = sorted(known)
        fitted, judged = [i for n, i in enumerate(ids) if n % 3 != fold], [i for n, i in enumerate(ids) if n % 3 == fold]
        m = spam.Model(np.array([x[i] for i in fitted]), np.array([known[i] for i in fitted]))
        right.update(zip([known[i] for i in judged], (m.score(np.array([x[i] for i in judged])) > 0).tolist()))
    assert right[1, True] / (right[1, True] + right[1, False]) >= 0.9 and right[1, True] / (right[1, True] + right[0, True]) >= 0.9, right


COLUMNS = {
    "p3_found": ["record_id", "piece_start", "piece_end"], "p4_found": ["field", "term", "mark"], "p5_found": ["kmer"], "p6_found": ["feed_id"],
    "p7_found": ["span_id", "hit_start", "hit_end"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns(spark, name):
    assert entry.queries()[name](spark, DATA).columns == COLUMNS[name]

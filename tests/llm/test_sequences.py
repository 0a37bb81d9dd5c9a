import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandmill.llm import ledger, spans, split, terms, topk


# Splitting


def brute_pieces(n, bounds, limit, overlap):
    out, start = [], 0
    while n - start > limit:
        fit = [b for b in bounds if start + overlap < b <= start + limit]
        end = max(fit) if fit else start + limit
        out.append((start, end))
        start = end - overlap
    return [*out, (start, n)]


@settings(max_examples=150, deadline=None)
@given(st.text("ACGTNn-", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_pieces_at_gaps(text, limit, overlap):
    bounds = [m.end() for m in re.finditer("[Nn-]{3,}", text)]
    assert list(split.pieces(text, limit, overlap, [re.compile("[Nn-]{3,}")])) == brute_pieces(len(text), bounds, limit, overlap)


@settings(max_examples=100, deadline=None)
@given(st.text("ab .\n=é𝔸", max_size=300), st.integers(6, 50), st.integers(0, 5))
def test_pieces_of_prose_cover_and_overlap(text, limit, overlap):
    got = list(split.pieces(text, limit, overlap, [re.compile(s) for s in split.PROSE]))
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(b - a <= limit for a, b in got)
    assert all(b[0] == a[1] - overlap and b[1] > a[1] for a, b in zip(got, got[1:]))


def test_natural_boundaries_come_first():
    text = "One two three. Four five six. Seven\n\nEight nine ten eleven twelve"
    p = [re.compile(s) for s in split.PROSE]
    assert [text[a:b] for a, b in split.pieces(text, 40, 0, p)] == ["One two three. Four five six. Seven\n\n", "Eight nine ten eleven twelve"]
    assert [text[a:b] for a, b in split.pieces(text, 20, 0, p)] == ["One two three. ", "Four five six. ", "Seven\n\n", "Eight nine ten ", "eleven twelve"]


def test_split_oversized(spark, rows):
    df = spark.createDataFrame([(1, "a" * 25, 0), (2, "", 0), (3, None, 0), (None, "xy", 0), (2, "", 0)], "id bigint, t string, piece_no int")
    got = rows(split.split_oversized(df, "id", "t", 10, 2, with_text=True))
    assert got == sorted([(1, 0, 0, 10, "a" * 10), (1, 1, 8, 18, "a" * 10), (1, 2, 16, 25, "a" * 9), (2, 0, 0, 0, ""), (2, 0, 0, 0, ""), (None, 0, 0, 2, "xy")], key=repr)
    assert rows(split.split_oversized(df, "id", "t", 10, 2, only_oversized=True, with_text=False)) == [(1, 0, 0, 10), (1, 1, 8, 18), (1, 2, 16, 25)]
    assert rows(split.split_oversized(df.limit(0), "id", "t", 10, 2)) == []
    with pytest.raises(ValueError):
        split.split_oversized(df, "id", "t", 10, 10)
    # Bytes that aren't UTF-8: é cut in half is one character, and positions are those of the decoded text.
    broken = spark.sql("SELECT 1L AS id, cast(unhex(concat('C3', repeat('41', 5), 'FF', repeat('42', 6))) AS string) AS t UNION ALL SELECT 2L, cast(unhex('E2824142') AS string)")
    assert rows(split.split_oversized(broken, "id", "t", 10, 2, only_oversized=True)) == [(1, 0, 0, 10, "\ufffdAAAAA\ufffdBBB"), (1, 1, 8, 13, "BBBBB")]
    assert rows(split.split_oversized(broken, "id", "t", 10, 2, with_text=False)) == [(1, 0, 0, 10), (1, 1, 8, 13), (2, 0, 0, 3)]


# Term frequencies


def test_terms(spark, rows):
    rng = random.Random(1)
    data = [(rng.choice("ab"), rng.choice(["hot"] * 8 + ["warm", "x", None]), rng.choice(["r"] * 9 + ["s", "t", None]), rng.choice(["o"] * 9 + ["p", None, "q"]), 0) for _ in range(4000)]
    data += [("a", f"t{i}", "r", "o", 0) for i in range(300)]
    want = defaultdict(set)
    for f, t, r, o, _ in data:
        if t is not None:
            want[f, t].add((r, o))
    df = spark.createDataFrame(data, "field string, term string, record string, occurrence string, part int").repartition(6)
    got = rows(terms.term_frequencies(df))
    assert got == sorted(((f, t, len(s), len({r for r, _ in s})) for (f, t), s in want.items()), key=repr)
    assert rows(terms.term_frequencies(df.where("term = 'none'"))) == []
    one = spark.createDataFrame([("a", "b", "c", "d")] * 1000, "field string, term string, record string, occurrence string").repartition(5)
    assert rows(terms.term_frequencies(one)) == [("a", "b", 1, 1)]


def test_terms_over_many_batches(spark, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        test_terms(spark, rows)
        test_top_k(spark, rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# Top-k


def test_top_k(spark, rows):
    rng = random.Random(2)
    data = [(None if rng.random() < 0.05 else f"v{int(rng.paretovariate(0.7)) % 997}", i) for i in range(5000)]
    count = Counter(v for v, _ in data if v is not None)
    df = spark.createDataFrame(data, "v string, n bigint").repartition(7)
    for k, nodes in ((1, 3), (5, 7), (20, 1), (2000, 4)):
        want = sorted(count.items(), key=lambda x: (-x[1], x[0]))[:k]
        got = topk.top_k(df, F.col("v"), k, nodes)
        assert [tuple(r) for r in got.collect()] == want
    assert rows(topk.top_k(df.where("v is null"), F.col("v"), 3)) == rows(topk.top_k(df.limit(0), F.col("v"), 3)) == []
    tied = spark.createDataFrame([(x,) for x in "dcbaabcd"], "v string").repartition(3)
    assert [r.value for r in topk.top_k(tied, F.col("v"), 2).collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        topk.top_k(df, F.col("v"), 0)


def test_broken_bytes(spark, rows):
    df = spark.sql("SELECT cast(unhex(x) AS string) AS t, 'r' AS r FROM VALUES ('FF41'), ('FF41'), ('FE41'), ('4142'), ('E282') AS v(x)")
    assert [tuple(r) for r in topk.top_k(df, F.col("t"), 2).collect()] == [("\ufffdA", 3), ("AB", 1)]
    got = rows(terms.term_frequencies(df.select(F.lit("f").alias("field"), F.col("r").alias("term"), F.col("t").alias("record"), F.col("t").alias("occurrence"))))
    assert got == [("f", "r", 3, 3)]
    assert rows(terms.term_frequencies(df.select(F.lit("f").alias("field"), F.col("t").alias("term"), F.col("r").alias("record"), F.lit("").alias("occurrence")))) == sorted([("f", x, 1, 1) for x in ("\ufffdA", "AB", "\ufffd")], key=repr)
    seen = ledger.seen_before(df.limit(0), F.col("t"), df.withColumn("i", F.monotonically_increasing_id()), F.col("t"), "i")
    assert seen.count() == 1


# Key ledger


@pytest.mark.parametrize("steps", [1, 4])
def test_ledger(spark, rows, steps):
    rng = random.Random(4)
    key = lambda: rng.choice(["hot"] * 5 + [f"k{rng.randrange(60)}", None])
    past = [(f"k{rng.randrange(30)}",) for _ in range(50)] + [(None,)]
    feed = [(i, key(), "x") for i in range(300)]
    before, want = {k for k, in past if k}, []
    for i, k, _ in feed:
        if k is not None and k in before:
            want.append((k, i))
        before.add(k)
    got = ledger.seen_before(spark.createDataFrame(past, "key string"), F.col("key"), spark.createDataFrame(feed, "i bigint, k string, known string").repartition(5), F.col("k"), "i", steps)
    assert rows(got) == sorted(want, key=repr)


def test_ledger_edges(spark, rows):
    past, feed = spark.createDataFrame([], "k string"), spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "b"), (None, "c"), (3, None)], "i bigint, k string")
    run = lambda f: rows(ledger.seen_before(past, F.col("k"), f, F.col("k"), "i", 2))
    assert run(feed) == [("b", None)]
    assert run(feed.limit(0)) == []


def test_ledger_opened_again(spark, rows, tmp_path):
    path = f"file:{tmp_path}/ledger"
    frame = lambda data: spark.createDataFrame(data, "key string, arrival bigint")
    one = ledger.KeyLedger(spark, path, 3)
    one.remember(frame([("a", 9), ("b", 9), ("a", 9), (None, 9)]))
    one.admit(frame([("b", 1), ("c", 2), ("c", 3), (None, 4)]))
    assert rows(one.seen(frame([("b", 1), ("c", 2), ("c", 3), (None, 4)]))) == [("b", 1), ("c", 3)]
    one.close()
    two = ledger.KeyLedger(spark.newSession(), path)
    assert two.buckets == 3 and rows(two.keys()) == [("a", None), ("b", None), ("c", 2)]
    two.admit(frame([("c", 5), ("d", 6)]))
    assert rows(two.seen(frame([("c", 5), ("d", 6)]))) == [("c", 5)]
    with pytest.raises(ValueError):
        ledger.KeyLedger(spark, path, 4)


def test_ledger_merges_and_neither_sorts_nor_shuffles_its_runs(spark, rows, monkeypatch, tmp_path):
    monkeypatch.setattr(ledger, "RUNS", 3)
    book = ledger.KeyLedger(spark, str(tmp_path / "ledger"), 4)
    book.remember(spark.range(500).selectExpr("'k' || id AS key"))
    most, total = 0, 0
    for i in range(8):
        batch = spark.range(40).selectExpr(f"'n' || (id + {i * 20}) AS key", f"id + {i * 100} AS arrival")
        book.admit(batch)
        most, total = max(most, len(book.runs)), total + book.seen(batch).count()
    assert most <= 3 and total == 7 * 20
    assert book.keys().count() == book.keys().select("key").distinct().count() == 500 + 180
    again = ledger.KeyLedger(spark, str(tmp_path / "ledger"))
    assert again.runs == book.runs and sorted(x.name for x in (tmp_path / "ledger").glob("run-*")) == sorted(book.runs)
    with ledger.ordered_scans(spark):
        plan = again.unseen(spark.createDataFrame([("x", 1)], "key string, arrival bigint"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == len(again.runs) == plan.count("Bucketed: true") and plan.count("Exchange") == 1
    assert len([x for x in plan.split("\n") if x.lstrip(" :+-*()0123456789").startswith("Sort ")]) == 1  # that of the batch


# Shared spans


def brute_spans(data, w=50):
    where = defaultdict(set)
    for _, ref, t in data:
        t = (t or "").upper()
        for i in range(len(t) - w + 1):
            where[t[i : i + w]].add(ref)
    out = set()
    for key, _, t in data:
        t, covered = (t or "").upper(), set()
        for i in range(len(t) - w + 1):
            if set(t[i : i + w]) <= set("ACGT") and len(where[t[i : i + w]]) > 1:
                covered |= set(range(i, i + w))
        run = None
        for p in range(len(t) + 1):
            if p in covered and run is None:
                run = p
            elif p not in covered and run is not None:
                out.add((key, run, p))
                run = None
    return sorted(out, key=repr)


def shared_data(seed, span):
    rng = random.Random(seed)
    letters = lambda n, a="ACGT": "".join(rng.choice(a) for _ in range(n))
    pool = [letters(4 * span) for _ in range(6)] + ["A" * 3 * span, "AC" * 2 * span]
    data = []
    for i in range(40):
        t = ""
        for _ in range(rng.randrange(5)):
            p = rng.choice(pool)
            a = rng.randrange(len(p) - span)
            t += letters(rng.randrange(60), "ACGTN") + p[a : a + rng.randrange(span - 5, 2 * span)]
        data.append((i, rng.choice(["r1", "r2", "r3", None]), rng.choice([t, t.lower()])))
    return data + [(100, "r1", None), (101, "r1", ""), (102, "r9", "N" * 80), (103, "r1", "é" + "A" * span), data[3], data[4]]


@pytest.mark.parametrize("span", [50, 33, 7, 130])
def test_spans(spark, rows, monkeypatch, span):
    data = shared_data(6, span)
    df = spark.createDataFrame(data, "id bigint, ref string, t string").withColumns({"source": F.lit(1), "pack": F.lit(0), "at": F.lit("x"), "letters": F.lit(2)}).repartition(5)
    want = brute_spans(data, span)
    assert len(want) > 30
    assert rows(spans.shared_spans(df, "id", "ref", "t", span)) == want
    monkeypatch.setattr(spans, "PACK", 300)  # many packs
    monkeypatch.setattr(spans, "BUCKET", 50)  # and buckets
    monkeypatch.setattr(spans, "PIECE", 70)  # and nearly every text is cut
    assert rows(spans.shared_spans(df, "id", "ref", "t", span)) == want
    if span == 50:
        parts = rows(spans.shared_parts(df.dropDuplicates(["id"]), "id", "t", spans.shared_spans(df, "id", "ref", "t")))
        covered = Counter()
        for k, a, b in want:
            covered[k] += b - a
        assert {k: n for k, _, n, _ in parts} == {k: covered[k] for k, *_ in data}
        assert rows(spans.shared_spans(df.limit(0), "id", "ref", "t")) == []
        named = df.select(F.concat(F.lit("row "), "id").alias("name"), "ref", "t")
        assert rows(spans.shared_spans(named, "name", "ref", "t")) == sorted(((f"row {k}", a, b) for k, a, b in want), key=repr)


def test_span_of_one_record_in_all(spark, rows):
    """One window in every row of many sources: answered for each pack, whatever the number of its places."""
    df = spark.range(3000).select("id", F.concat(F.lit("r"), F.col("id") % 7).alias("ref"), F.lit("ACGT" * 15).alias("t"))
    assert rows(spans.shared_spans(df, "id", "ref", "t")) == sorted(((i, 0, 60) for i in range(3000)), key=repr)
    assert rows(spans.shared_spans(df.withColumn("ref", F.lit("one")), "id", "ref", "t")) == []


def test_spans_of_a_long_and_a_broken_record(spark, rows):
    long = "ACGTTGCA" * 250_000
    df = spark.createDataFrame([(1, "a", long), (2, "b", long[3:90]), (3, "b", "é" * 7 + long[:60].lower())], "id bigint, ref string, t string")
    assert rows(spans.shared_spans(df, "id", "ref", "t")) == [(1, 0, len(long)), (2, 0, 87), (3, 7, 67)]
    broken = df.selectExpr("id", "ref", "cast(concat(unhex('FF'), cast(t AS binary)) AS string) AS t")
    assert [r[0] for r in rows(spans.shared_spans(broken, "id", "ref", "t"))] == [1, 2, 3]


@pytest.mark.parametrize("bad", [0, -1, True, "50"])
def test_bad_span(spark, bad):
    with pytest.raises(ValueError):
        spans.shape(bad)


def test_packed_windows():
    rng = random.Random(8)
    text = "".join(rng.choice("acgtACGTN") for _ in range(300)) + "é"
    for w in (1, 2, 25, 30):
        codes = spans.CODES[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]
        got = {int(i): int(spans.packed(codes, w)[i]) for i in np.flatnonzero(spans.sound(codes, w))}
        want = {}
        for i in range(len(text) - w + 1):
            t = text[i : i + w].upper()
            if set(t) <= set("ACGT"):
                want[i] = int("".join(str("ACGT".index(c)) for c in t), 4)
        assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ACGTacgtN-é𝔸", max_size=40), max_size=9))
def test_letters_as_bytes(texts):
    back = ["".join("ACGT-"[c] for c in spans.THREE[np.frombuffer(x.as_py(), np.uint8)].reshape(-1)) for x in spans.coded(pa.array([None, *(t.encode("ascii", "replace") for t in texts)], pa.binary())[1:])]
    assert [x.rstrip("-") for x in back] == [re.sub("[^ACGT]", "-", t.upper()).rstrip("-") for t in texts]
    assert all(len(t) < len(x) <= len(t) + 3 for t, x in zip(texts, back))


def test_covers():
    for period, cover in spans.COVERS.items():
        for i in range(period):
            for j in range(period):
                assert any((i + d) % period in cover and (j + d) % period in cover for d in range(period))
    for span in range(1, 300):
        s = spans.shape(span)
        assert s.anchor + s.period - 1 <= span and s.word <= spans.WORD >= s.anchor
        assert set().union(*(range(a, a + s.word) for a in s.at)) == set(range(span))

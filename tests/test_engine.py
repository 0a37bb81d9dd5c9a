import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandmill import KmerEngine
from strandmill.functions import alphabet, coords, formats
from strandmill.operators import extract, layout, reduce
from tests import model


def table(spark, records):
    return spark.createDataFrame(records, "ref string, seq string")


def engine(spark, records):
    return KmerEngine(spark).from_table(table(spark, records))


def test_coordinates(spark, rows):
    df = spark.createDataFrame([("chr1", 0, 1000, "+"), ("a:b:1-2", 3, 9, "-")], "ref string, start bigint, end bigint, strand string")
    text = df.select(coords.format_coords(*map(F.col, coords.FIELDS)).alias("h"))
    assert rows(text) == [("a:b:1-2:3-9:-",), ("chr1:0-1000:+",)]
    assert rows(text.select(coords.parse_coords(F.col("h")).alias("c")).select("c.*")) == rows(df)
    assert rows(df.select(alphabet.reverse_strand(F.col("strand")))) == [("+",), ("-",)]


@pytest.mark.parametrize("bad", ["chr1:-1-5:+", "chr1:1--5:+", "chr1:1-5:minus", ":1-5:+", "chr1", "", "chr1:1-5:+\n"])
def test_malformed_headers(spark, bad):
    df = spark.createDataFrame([(bad,)], "h string")
    assert df.select(coords.parse_coords(F.col("h"), strict=False)).first()[0] is None
    with pytest.raises(Exception, match="not coordinates"):
        df.select(coords.parse_coords(F.col("h"))).collect()


def test_null_header(spark):
    assert spark.createDataFrame([(None,)], "h string").select(coords.parse_coords(F.col("h"))).first()[0] is None


@pytest.mark.parametrize("row,fails", [((-1, 11, "+", "ACGATCGATCG"), "start"), ((0, -1, "+", "ACGATCGATCG"), "end"), ((0, 11, "minus", "ACGATCGATCG"), "strand"), ((0, 1, "+", "ACGATCGATCG"), "length")])
def test_window_checks(spark, row, fails):
    df = spark.createDataFrame([row], "start bigint, end bigint, strand string, kmer string")
    with pytest.raises(Exception, match=f"window fails {fails}_ok"):
        df.select(coords.assert_valid(*map(F.col, df.columns))).collect()


def test_text_forms(spark, rows):
    df = spark.createDataFrame([("chr1:0-11:+", "ACGATCGATCG")], "h string, kmer string")
    assert df.select(formats.fasta_text(F.col("h"), F.col("kmer"))).first()[0] == ">chr1:0-11:+\nACGATCGATCG\n"
    assert df.select(formats.tsv_text(F.col("h"), F.col("kmer"))).first()[0] == "chr1:0-11:+\tACGATCGATCG"
    line = "ACGATCGATCG\tchr1:0-1000:+ chr1:1000-2000:+"
    got = spark.createDataFrame([(line,), ("ACG",), (None,)], "v string").select(formats.parse_group(F.col("v")).alias("g")).collect()
    assert [g.g and (g.g.kmer, g.g.headers) for g in got] == [("ACGATCGATCG", ["chr1:0-1000:+", "chr1:1000-2000:+"]), ("ACG", []), None]


def test_extraction_golden(spark, rows):
    assert rows(engine(spark, [("stest", "ACGAT")]).kmers(4).df) == [("stest", 0, "+", "ACGA"), ("stest", 1, "+", "CGAT")]


def test_chunk_golden(spark, rows):
    df = table(spark, [("ref", "ACGATCGATCG"), ("short", "AC"), ("none", None)])
    assert rows(extract.chunks(df, 3, 5)) == [("ref", "ACGAT", 0), ("ref", "ATCGA", 3), ("ref", "GATCG", 6)]
    assert rows(extract.chunks(df, 3, 1)) == [("ref", "ACGATCGATCG", 0)]


def test_batched_golden(spark, rows):
    got = rows(extract.windows_batched(table(spark, [("ref", "ACGATCGATCG")]), 4, 5, reverse=True))
    plus = "ACGA CGAT GATC ATCG TCGA CGAT GATC ATCG".split()
    minus = "TCGT ATCG GATC CGAT TCGA ATCG GATC CGAT".split()
    assert got == sorted([("ref", i // 2, i, "+", w) for i, w in enumerate(plus)] + [("ref", i // 2, i, "-", w) for i, w in enumerate(minus)], key=repr)


def test_cross_record_golden(spark, rows):
    k = engine(spark, [("a", "ACGTA"), ("b", "CGTAC")]).kmers(4)
    assert rows(k.uniq().select("kmer")) == [("ACGT",), ("GTAC",)]
    assert rows(k.seq_count()) == [("ACGT", 1), ("CGTA", 2), ("GTAC", 1)]
    assert rows(k.vec_count(dense=True)) == [("a", "+", 0, 1), ("a", "+", 1, 2), ("b", "+", 0, 2), ("b", "+", 1, 1)]
    assert rows(k.vec_count_masked(dense=True)) == [("a", "+", 0, 0), ("a", "+", 1, 1), ("b", "+", 0, 1)]
    assert rows(k.count()) == [(4,)]


def test_minus_strand(spark, rows):
    r = engine(spark, [("a", "ACGTA")])
    assert rows(r.kmers(4, strand="-").df) == [("a", 0, "-", "ACGT"), ("a", 1, "-", "CGTA")]
    assert rows(r.kmers(4, True, strand="-").df) == [("a", 0, "+", "ACGT"), ("a", 0, "-", "ACGT"), ("a", 1, "+", "TACG"), ("a", 1, "-", "CGTA")]
    with pytest.raises(ValueError):
        r.kmers(4, strand="minus")


def test_unique_without_sort(spark, rows):
    k = engine(spark, [("a", "ACGTA"), ("b", "CGTAC"), (None, "TTTT")]).kmers(4)
    assert rows(k.uniq()) == rows(reduce.unique(k.df)) == sorted([("a", 0, "+", "ACGT"), ("b", 1, "+", "GTAC"), (None, 0, "+", "TTTT")], key=repr)
    plan = k.uniq()._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "BroadcastHashJoin" in plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20b")
    try:
        assert "SortMergeJoin" in k.uniq()._jdf.queryExecution().executedPlan().toString() and len(rows(k.uniq())) == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_group_chunks(spark, rows):
    k = engine(spark, [(f"r{i}", "ACGTACGT" if i % 3 else "AAAAAAAA") for i in range(20)]).kmers(4, True)
    whole = {r.kmer: r.headers for r in k.groups().collect()}
    for size in (1, 7, 1000):
        got = {}
        for r in k.group_chunks(size).orderBy("kmer", "chunk").collect():
            assert r.n == len(r.headers) <= size and r.chunk == len(got.setdefault(r.kmer, []))
            got[r.kmer].append(r.headers)
        assert {w: sum(c, []) for w, c in got.items()} == whole
    assert rows(k.feed(k, "replace").group_chunks().limit(0)) == []


def test_palindrome_is_counted_twice(spark, rows):
    k = engine(spark, [("a", "GATC")]).kmers(4, reverse=True)
    assert rows(k.seq_count()) == [("GATC", 2)] and rows(k.uniq()) == []


@pytest.mark.parametrize("k", [1, 0, -3, True, "4"])
def test_bad_k(spark, k):
    with pytest.raises(ValueError):
        engine(spark, [("a", "ACGT")]).kmers(k)


def test_bad_arguments(spark):
    r = engine(spark, [("a", "ACGT")])
    with pytest.raises(ValueError):
        r.chunks(4, 3)
    with pytest.raises(ValueError):
        r.kmers(4, natype="protein")
    with pytest.raises(ValueError):
        r.kmers(4, scan="other")
    with pytest.raises(ValueError):
        r.kmers(2).feed(r.kmers(3))


def test_empty_inputs(spark, rows):
    k = engine(spark, [("a", ""), ("b", None), ("c", "NNNNNN"), ("d", "ACG")]).kmers(4, reverse=True)
    for df in (k.df, k.seq_count(), k.uniq(), k.groups(), k.vec_count(True), k.vec_count_masked(True)):
        assert rows(df) == []
    assert rows(engine(spark, []).kmers(4).seq_count()) == []


def test_characters_beyond_ascii_keep_offsets(spark, rows):
    assert rows(engine(spark, [("a", "acßğ𝔸ACGTK")]).kmers(3).df) == [("a", 5, "+", "ACG"), ("a", 6, "+", "CGT")]


def test_duplicate_cells_are_an_error(spark, rows):
    k = engine(spark, [("a", "ACGT"), ("a", "ACGA")]).kmers(4)
    assert rows(reduce.duplicates(k.vec_count())) == [("a", "+", 0, 2)]
    for use in (lambda d: d.collect(), lambda d: d.count(), lambda d: d.select("ref", "pos").count(), lambda d: d.select("ref").distinct().collect()):
        with pytest.raises(Exception, match="cell filled twice"):
            use(k.vec_count(dense=True))
        with pytest.raises(Exception, match="cell filled twice"):
            use(reduce.cells(k.vec_count()))
    assert rows(k.vec_count(dense=True, replace=True)) == [("a", "+", 0, 1)]
    nowhere = engine(spark, [(None, "ACGT"), ("b", "ACGT")]).kmers(4)
    assert rows(nowhere.vec_count(dense=True)) == [("b", "+", 0, 2)] and rows(nowhere.vec_count()) == [("b", "+", 0, 2), (None, "+", 0, 2)]
    both = k.vec_count().unionByName(k.vec_count().withColumn("count", F.lit(5).cast("bigint")))
    assert rows(reduce.dense(both, replace=True)) == [("a", "+", 0, 5)]


def test_extra_columns_dont_matter(spark, rows):
    df = table(spark, [("a", "ACGTA")]).withColumns({"kmer": F.lit("x"), "start": F.lit(9), "n": F.lit(1), "strand": F.lit("?")})
    assert rows(KmerEngine(spark).from_table(df).kmers(4).seq_count()) == [("ACGT", 1), ("CGTA", 1)]


SEQ = st.text("ACGTacgtNK", max_size=60)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(SEQ, max_size=5), st.integers(2, 9), st.booleans(), st.sampled_from(["DNA", "RNA"]), st.sampled_from(["kmers", "records"]), st.integers(9, 40))
def test_against_model(spark, rows, seqs, k, reverse, natype, scan, size):
    records = [(f"r{i}", s.replace("T", "U") if natype == "RNA" else s) for i, s in enumerate(seqs)]
    got = engine(spark, records).kmers(k, reverse, natype, scan, size)
    want = model.kmers(records, k, reverse, natype)
    srt = lambda x: sorted(x, key=repr)
    assert rows(got.df) == srt(want)
    assert rows(got.seq_count()) == srt(model.counts(want).items())
    assert rows(got.uniq()) == srt(model.unique(want))
    assert rows(got.vec_count(True)) == srt(model.dense(model.vector(want)))
    assert rows(got.vec_count_masked(True)) == srt(model.dense(model.vector(want, True)))


def test_numbering_and_batches(spark, rows):
    rng = random.Random(5)
    data = [(rng.randrange(5), i) for i in range(500)]
    df = spark.createDataFrame(data, "a bigint, b bigint").repartition(7)
    assert rows(layout.number_rows(df, ["a", "b"])) == sorted(((a, b, i) for i, (a, b) in enumerate(sorted(data))), key=repr)
    batches = layout.batch_assign(df, 50, ["a", "b"]).groupBy("batch").count().orderBy("batch").collect()
    assert [tuple(r) for r in batches] == [(i, 50) for i in range(10)]
    tied = layout.number_rows(df.select(F.lit(1).alias("one"), "b"), ["one"], spread=F.col("b"))
    assert sorted(r.row_no for r in tied.collect()) == list(range(500))
    assert rows(layout.number_rows(df.where("a > 9"), ["a"])) == []
    with pytest.raises(ValueError):
        layout.batch_assign(df, 0, ["a"])


def test_feed_modes(spark, rows):
    a, b = (spark.createDataFrame([(x,)], "kmer string") for x in ("AC", "GT"))
    assert rows(layout.feed(a, b)) == rows(layout.feed(a, b, "flow")) == [("AC",), ("GT",)]
    assert rows(layout.feed(a, b, "replace")) == [("GT",)]
    with pytest.raises(ValueError):
        layout.feed(a, b, "other")


def test_clean_kmer(spark):
    df = spark.createDataFrame([(" acg\t\r",), ("AC G",), ("ACN",), ("ACGT",), ("",), (None,), ("\nACG",)], "k string")
    assert [r[0] for r in df.select(alphabet.clean_kmer(F.col("k"), 3)).collect()] == ["ACG", None, None, None, None, None, None]

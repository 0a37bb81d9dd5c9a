import gzip
import os
import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from strandmill import KmerEngine
from strandmill.cli import main
from strandmill.operators import packs
from strandmill.sources import fasta, store
from strandmill.streaming.incremental import read_counts, start_counts
from tests import model

TEXT = "; preamble\nnot a record\n>r1 desc here \nACGT\nAC GT\r\n>r2\n>r3\tx y\r\nggN\nA\n\n>r4\n"
WANT = [("r1 desc here", "r1", "ACGTACGT", 0), ("r2", "r2", "", 0), ("r3\tx y", "r3\tx", "ggNA", 0), ("r4", "r4", "", 0)]


@contextmanager
def splits_of(spark, size):
    """Input files in splits of so many bytes, but not what is written in between."""
    name, written = "spark.sql.files.maxPartitionBytes", fasta.materialise

    def whole(df, *args):
        out = written(df, *args)
        spark.conf.unset(name)
        return out

    spark.conf.set(name, size)
    fasta.materialise = whole
    try:
        yield
    finally:
        spark.conf.unset(name)
        fasta.materialise = written


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    with (gzip.open if path.suffix == ".gz" else open)(path, "wb") as f:
        f.write(text.encode())
    return str(path)


@pytest.mark.parametrize("name", ["a.fa", "a.fa.gz"])
@pytest.mark.parametrize("split", [1, 3, 17, 1 << 20])
def test_reader(spark, rows, tmp_path, name, split):
    path = put(tmp_path / name, TEXT)
    with splits_of(spark, split):
        assert rows(fasta.read_fasta(spark, path)) == rows(fasta.read_fasta(spark, f"file:{path}")) == sorted(WANT, key=repr)
        chunks = fasta.read_fasta(spark, path, 100, 3).where("seq <> ''").collect()
    whole = {t: s for t, _, s, _ in WANT}
    assert all(whole[r.title][r.offset : r.offset + len(r.seq)] == r.seq for r in chunks)
    assert {(r.title, r.offset + i) for r in chunks for i in range(len(r.seq))} == {(t, i) for t, s in whole.items() for i in range(len(s))}


def test_reader_of_folders_and_errors(spark, rows, tmp_path):
    put(tmp_path / "d/a.fa", ">a\nAC\n")
    put(tmp_path / "d/b.fa.gz", ">b\nGT")
    put(tmp_path / "d/_SUCCESS", "")
    want = [("a", "a", "AC", 0), ("b", "b", "GT", 0)]
    assert rows(fasta.read_fasta(spark, str(tmp_path / "d"))) == rows(fasta.read_fasta(spark, str(tmp_path / "d/*.fa*"))) == want
    put(tmp_path / "none.fa", "no record\n")
    put(tmp_path / "some/a.fa", "")
    put(tmp_path / "some/b.fa", ">b\nGT")
    assert rows(fasta.read_fasta(spark, str(tmp_path / "some"))) == want[1:]
    for more in ((), (9, 3)):
        for size in (3, 1 << 20):
            with splits_of(spark, size), pytest.raises(Exception, match="no title line"):
                fasta.read_fasta(spark, str(tmp_path / "none.fa"), *more).count()
        for nothing in (tmp_path / "missing", tmp_path / "some/a.fa", tmp_path / "*.none"):
            with pytest.raises(FileNotFoundError):
                fasta.read_fasta(spark, str(nothing), *more)


def test_reader_in_chunks(spark, rows, tmp_path):
    seq = "ACGTTGCAAC" * 30
    path = put(tmp_path / "c.fa", ">c\n" + "\n".join(seq[i : i + 7] for i in range(0, len(seq), 7)) + "\n>d\nACGTA\n")
    e = KmerEngine(spark)
    whole, parts = e.from_fasta(path), e.from_fasta(path, chunk_letters=40, overlap=4)
    assert parts.df.count() > whole.df.count() == 2
    assert rows(parts.kmers(5, reverse=True).df) == rows(whole.kmers(5, reverse=True).df)


@pytest.mark.parametrize("split,width,chunk", [(11, 3, 9), (37, 7, 9), (64, 60, 200), (500, 1, 20)])
def test_chunks_over_splits(spark, rows, tmp_path, split, width, chunk):
    """Each window comes out once, however records and lines lie across the splits of a file."""
    rng = random.Random(split)
    text = "preamble\n"
    for i in range(6):
        seq = "".join(rng.choice("ACGTacgtN") for _ in range(rng.choice([0, 2, 5, 90, 400])))
        text += f">r{i} > x\n" + "".join(seq[j : j + width] + rng.choice(["\n", "\r\n", " \n", "\n\n"]) for j in range(0, len(seq), width))
    path = put(tmp_path / "c.fa", text)
    e = KmerEngine(spark)
    want = rows(e.from_fasta(path).kmers(5).df)
    with splits_of(spark, split):
        assert rows(e.from_fasta(path).kmers(5).df) == want
        assert rows(e.from_fasta(path, chunk, 4).kmers(5).df) == want
    assert len(want) > 300


def test_broken_bytes(spark, rows, tmp_path):
    (tmp_path / "t.fa").write_bytes(b"\xff\n>a\xff b\nAC\xfeG\n>b\n\xc3")
    want = sorted([("a\ufffd b", "a\ufffd", "AC\ufffdG", 0), ("b", "b", "\ufffd", 0)], key=repr)
    assert rows(fasta.read_fasta(spark, str(tmp_path / "t.fa"))) == rows(fasta.read_fasta(spark, str(tmp_path / "t.fa"), 50, 3).where("seq <> ''")) == want


def test_titles_that_start_alike(spark, rows, tmp_path):
    path = put(tmp_path / "t.fa", ">>a\nAC\tG\t\n>>b\n\tGT\v\n>\nA\n")
    with splits_of(spark, 4):
        got = rows(fasta.read_fasta(spark, path).select("title", "seq"))
    assert got == sorted([(">a", "AC\tG"), (">b", "\tGT"), ("", "A")], key=repr)


def test_writers(spark, rows, tmp_path):
    path = put(tmp_path / "w.fa", ">a\nACGTACGTTT\n>b\nTTTACG\n")
    k = KmerEngine(spark).from_fasta(path).kmers(4)
    k.write_unique(str(tmp_path / "u"))
    fasta.concatenate(spark, str(tmp_path / "u"), str(tmp_path / "u.fa"))
    got = rows(fasta.read_fasta(spark, str(tmp_path / "u.fa")).select("title", "seq"))
    assert got == rows(k.uniq().select(F.concat("ref", F.lit(":"), "start", F.lit("-"), F.col("start") + 4, F.lit(":+")), "kmer"))
    lines = (tmp_path / "u.fa").read_text().split("\n")[1::2]
    assert lines == sorted(lines)
    k.write_counts(str(tmp_path / "n"), compression="gzip")
    fasta.concatenate(spark, str(tmp_path / "n"), str(tmp_path / "n.gz"))
    text = gzip.open(tmp_path / "n.gz", "rt").read()
    assert text == "".join(f"{w}\t{n}\n" for w, n in rows(k.seq_count()))
    fasta.write_parts(k.seq_count().orderBy("kmer"), str(tmp_path / "tsv"), "tsv")
    fasta.concatenate(spark, str(tmp_path / "tsv"), str(tmp_path / "n.tsv"))
    assert (tmp_path / "n.tsv").read_text() == text
    with pytest.raises(Exception, match="not empty"):
        k.write_unique(str(tmp_path / "u"))


def test_vectors(spark, tmp_path):
    k = KmerEngine(spark).from_table(spark.createDataFrame([("a/x", "ACGTNACGT"), ("b", "CGTA")], "ref string, seq string")).kmers(4)
    k.write_vectors(str(tmp_path / "v"))
    read = lambda n: gzip.open(tmp_path / "v" / n, "rt").read().split()
    assert sorted(n for n in os.listdir(tmp_path / "v") if n[0] not in "._") == ["a%2Fx___+.gz", "b___+.gz"]
    assert read("a%2Fx___+.gz") == ["#", "k=4", "2", "0", "0", "0", "0", "2"] and read("b___+.gz") == ["#", "k=4", "1"]
    two = KmerEngine(spark).from_table(spark.createDataFrame([("a", "ACGT"), ("a", "ACGA")], "ref string, seq string")).kmers(4)
    with pytest.raises(Exception, match="cell filled twice"):
        two.write_vectors(str(tmp_path / "w"))
    two.write_vectors(f"file:{tmp_path}/x", replace=True)
    assert gzip.open(tmp_path / "x/a___+.gz", "rt").read() == "# k=4\n1\n"
    far = spark.createDataFrame([("r", "-", p, 7) for p in (0, 1, 65_537, 65_538, 65_539 + 131_072, 400_000)], "ref string, strand string, pos bigint, count bigint")
    fasta.write_vectors(far, str(tmp_path / "y"), 9)
    lines = gzip.open(tmp_path / "y/r___-.gz", "rt").read().split("\n")
    assert len(lines) == 400_000 + 3 and lines[0] == "# k=9" and [i for i, x in enumerate(lines[1:]) if x == "7"] == [r.pos for r in far.orderBy("pos").collect()]
    assert set(lines[1:-1]) == {"0", "7"} and lines[-1] == ""
    with pytest.raises(FileExistsError):
        fasta.write_vectors(far, str(tmp_path / "y"), 9)
    fasta.write_vectors(far.where("pos < 2"), str(tmp_path / "y"), 9, "overwrite")
    assert gzip.open(tmp_path / "y/r___-.gz", "rt").read() == "# k=9\n7\n7\n"


@pytest.mark.parametrize("any_system", [False, True])
def test_vector_files_of_blocks(spark, rows, tmp_path, monkeypatch, any_system):
    """Vectors of records in blocks, and of windows, are the same files, by the writer for local paths and by the one for any file system; many small files are read by few tasks."""
    monkeypatch.setattr(packs, "BLOCK", 16)
    if any_system:
        monkeypatch.setattr(fasta, "local", lambda *_: None)
    rng = random.Random(3)
    word = "".join(rng.choice("ACGT") for _ in range(12))
    seqs = [("a/%x", word + "N" * 70 + word + "N" * 40), ("b c", "N" * 33 + word), ("none", "NNN"), (None, word)] + [(f"r{i}", "".join(rng.choice("ACGT") for _ in range(50))) for i in range(20)]
    k = KmerEngine(spark).from_table(spark.createDataFrame(seqs, "ref string, seq string")).kmers(4, True)
    k.write_vectors(str(tmp_path / "v"))
    k.write_vectors(str(tmp_path / "m"), masked=True)
    k.feed(k, "replace").write_vectors(str(tmp_path / "w"))
    whole = {x: {n: gzip.open(tmp_path / x / n, "rt").read() for n in os.listdir(tmp_path / x) if n[0] not in "._"} for x in "vmw"}
    assert whole["v"] == whole["w"] and len(whole["v"]) == 44 and [n for n in os.listdir(tmp_path / "v") if n[0] == "_"] == ["_SUCCESS"]
    for name, masked in (("v", False), ("m", True)):
        want = {}
        for ref, strand, _, n in sorted(model.dense(model.vector(model.kmers([(r or "", s) for r, s in seqs] if not masked else seqs[:3] + seqs[4:], 4, True), masked)), key=lambda x: x[:3]):
            if ref:
                want.setdefault(f"{ref}___{strand}.gz".replace("%", "%25").replace("/", "%2F"), ["# k=4"]).append(str(n))
        assert {n: t.split("\n")[:-1] for n, t in whole[name].items()} == want
    got = fasta.read_vectors(spark, str(tmp_path / "v"))
    assert {(r.file, r.line_no, r.line) for r in got.collect()} == {(n, i, x) for n, t in whole["v"].items() for i, x in enumerate(t.split("\n")[:-1])}
    with splits_of(spark, 1):
        assert spark.read.text(str(tmp_path / "v")).rdd.getNumPartitions() > 40
        assert fasta.read_vectors(spark, str(tmp_path / "v")).rdd.getNumPartitions() <= 16
    long = [str(i) for i in range(400_000)]
    (tmp_path / "x").mkdir()
    (tmp_path / "x/a.gz").write_bytes(gzip.compress("\n".join(long).encode()))
    got = fasta.read_vectors(spark, str(tmp_path / "x")).collect()
    assert [r.line for r in sorted(got, key=lambda r: r.line_no)] == long and {r.line_no for r in got} == set(range(400_000))


def test_store(spark, rows, tmp_path):
    e, path = KmerEngine(spark), str(tmp_path / "s")
    r = e.from_table(spark.createDataFrame([("a", "ACGTACGTTT")], "ref string, seq string"))
    k = r.kmers(4, reverse=True)
    k.save(path, batch_size=3)
    assert rows(e.from_store(path).df) == rows(k.df)
    with pytest.raises(FileExistsError):
        k.save(path)
    k.save(path, mode="append")
    assert e.from_store(path, 4, "DNA", True).df.count() == 2 * k.df.count()
    for wrong in ({"k": 5}, {"natype": "RNA"}, {"reverse": False}):
        with pytest.raises(ValueError):
            e.from_store(path, **wrong)
    with pytest.raises(ValueError):
        r.kmers(5, reverse=True).save(path, mode="append")
    with pytest.raises(FileNotFoundError):
        e.from_store(str(tmp_path / "none"))
    k.write_batches(str(tmp_path / "b"), "gzip")
    assert rows(store.read_batches(spark, str(tmp_path / "b"), 4)) == rows(k.df)
    k.write_batches(str(tmp_path / "c"), batch_size=2)
    sizes = [open(tmp_path / "c" / n).read().count(">") for n in os.listdir(tmp_path / "c") if n[0] not in "._"]
    assert max(sizes) == 2 and sum(sizes) == k.df.count() and rows(store.read_batches(spark, str(tmp_path / "c"), 4)) == rows(k.df)
    k.append_batches(str(tmp_path / "c"), "gzip")
    assert store.read_batches(spark, str(tmp_path / "c"), 4).count() == 2 * k.df.count()
    with pytest.raises(Exception, match="not 5 letters"):
        store.read_batches(spark, str(tmp_path / "b"), 5).collect()
    g = k.groups().selectExpr("kmer || '\t' || array_join(headers, ' ') AS value")
    g.write.text(str(tmp_path / "g"))
    assert rows(store.read_groups(spark, str(tmp_path / "g"))) == rows(k.groups().select("kmer", "headers"))


def test_cli(spark, tmp_path):
    src = put(tmp_path / "in.fa", ">a\nACGTA\n>b\nCGTAC\n")
    run = lambda *a: main([str(x) for x in a], spark)
    run("count", src, tmp_path / "n.tsv", 4)
    assert (tmp_path / "n.tsv").read_text() == "ACGT\t1\nCGTA\t2\nGTAC\t1\n"
    run("uniq", src, tmp_path / "u.fa", 4, "-s", "RECORDS")
    assert (tmp_path / "u.fa").read_text() == ">a:0-4:+\nACGT\n>b:1-5:+\nGTAC\n"
    run("batch", src, tmp_path / "b", 4, "-C")
    run("count", "-", tmp_path / "n2.tsv", 4, "-B", tmp_path / "b")
    assert (tmp_path / "n2.tsv").read_text() == (tmp_path / "n.tsv").read_text()
    run("count", src, tmp_path / "n3.tsv", 4, "-B", tmp_path / "b", "-m", "FLOW")
    assert (tmp_path / "n3.tsv").read_text() == "ACGT\t2\nCGTA\t4\nGTAC\t2\n"
    run("batch", src, tmp_path / "s", 4, "--format", "store", "-r")
    run("count", "-", tmp_path / "n4.tsv", 4, "-r", "-B", tmp_path / "s")
    assert "GTAC\t2" in (tmp_path / "n4.tsv").read_text()
    run("count", src, tmp_path / "v.txt", 4, "-c", "VEC_COUNT_MASKED", "-M", "LOCAL", "-t", 2, "-T", tmp_path)
    assert gzip.open(tmp_path / "v/a___+.gz", "rt").read() == "# k=4\n0\n1\n"
    run("batch", f"file:{src}", f"file:{tmp_path}/small", 4, "-b", 1, "-m", "REPLACE", "-R")
    assert {(tmp_path / "small" / n).read_text().count(">") for n in os.listdir(tmp_path / "small") if n[0] not in "._"} == {1}
    for bad in (("batch", src, tmp_path / "b", 4), ("batch", src, tmp_path / "z", 4, "-b", 0), ("count", src, tmp_path / "v.txt", 4, "-c", "VEC_COUNT"), ("count", src, tmp_path / "x", 1), ("count", tmp_path / "no", tmp_path / "x", 4), ("uniq", src, tmp_path / "x", 4, "-B", tmp_path / "nothing")):
        with pytest.raises(SystemExit):
            run(*bad)


def test_stream(spark, rows, tmp_path):
    src, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    for seq in ("ACGTA", "CGTAC"):
        spark.createDataFrame([("a", seq)], "ref string, seq string").write.mode("append").parquet(src)
        stream = spark.readStream.schema("ref string, seq string").parquet(src)
        start_counts(stream, out, log, 4).awaitTermination(120)
    assert rows(read_counts(spark, out)) == [("ACGT", 1), ("CGTA", 2), ("GTAC", 1)]

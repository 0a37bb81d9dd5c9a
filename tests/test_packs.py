import random

import pytest
from pyspark.sql import functions as F

from strandmill import KmerEngine
from strandmill.operators import packs
from tests import model


@pytest.mark.parametrize("k,reverse,natype,strand", [(4, True, "DNA", "+"), (5, False, "RNA", "-"), (31, True, "DNA", "-")])
def test_masked_vectors_by_packs(spark, rows, monkeypatch, k, reverse, natype, strand):
    """Pieces of a few windows, and refs whose pieces are in many packs: k-mers of these are held against the model's."""
    monkeypatch.setattr(packs, "BLOCK", 16)
    rng = random.Random(k)
    parts = ["".join(rng.choice("ACGTacgtN" if k < 31 else "ACGT") for _ in range(40)) for _ in range(6)]
    seqs = [(f"r{i % 9}", "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 2, 9])))) for i in range(12)] + [("p", "ACGTACGT" * 9), ("q", "ACGTACGT" * 9), (None, parts[0]), ("x", None)]
    seqs = [(r, s and (s.replace("T", "U") if natype == "RNA" else s)) for r, s in seqs]
    df = spark.createDataFrame(seqs, "ref string, seq string").repartition(3)
    turned = {"+": "-", "-": "+"} if strand == "-" else {"+": "+", "-": "-"}
    want = model.vector(model.kmers([x for x in seqs if x[0]], k, reverse, natype), True)
    want = sorted(((r, turned[s], i, n) for r, s, i, n in want), key=repr)
    assert len(want) > 300
    for pack in (10, 100, 1 << 20):
        blocks = packs.sparse(df, k, natype, reverse, True, pack)
        assert rows(packs.vector(blocks, reverse, strand)) == want


def test_masked_vectors_shuffle_no_occurrences(spark, rows):
    k = KmerEngine(spark).from_table(spark.createDataFrame([("a", "ACGTA"), ("b", "CGTAC"), ("b", "CGTAC")], "ref string, seq string")).kmers(4, True)
    plan = k.vec_count_masked()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan.split("CoGroups")[0]
    assert rows(k.vec_count_masked()) == rows(k.feed(k, "replace").vec_count_masked())


@pytest.mark.parametrize("masked", [True, False])
def test_dense_vectors_by_blocks(spark, rows, monkeypatch, masked):
    """Records of several blocks, of which some have no filled cell, and the error or the greatest count where two records fill a cell."""
    monkeypatch.setattr(packs, "BLOCK", 16)
    rng = random.Random(8)
    word = "".join(rng.choice("ACGT") for _ in range(12))
    seqs = [("a", word + "N" * 70 + word + "N" * 40), ("b", "N" * 33 + word), ("c", "N" * 16 + word[:6]), ("d", "ACGGGGGGGGGG"), ("e", None)] + [(f"r{i}", "".join(rng.choice("ACGT") for _ in range(50))) for i in range(9)]
    df = spark.createDataFrame(seqs, "ref string, seq string").repartition(3)
    want = sorted(model.dense(model.vector(model.kmers(seqs, 4, True), masked)), key=repr)
    for pack in (10, 1 << 20):
        assert rows(packs.dense(packs.sparse(df, 4, "DNA", True, masked, pack), True)) == want
    twice = spark.createDataFrame([("a", "NNACGTT"), ("a", "NNACGA"), ("b", "ACGTACGT"), ("b", "N" * 9)], "ref string, seq string")
    for pack in (1, 1 << 20):
        with pytest.raises(Exception, match="cell filled twice: a \\+ 2"):
            packs.dense(packs.sparse(twice, 3, "DNA", False, masked, pack))
    got = packs.dense(packs.sparse(twice, 3, "DNA", False, masked), replace=True).where("ref = 'a' and pos < 4")
    assert rows(got) == [("a", "+", 0, 0), ("a", "+", 1, 0), ("a", "+", 2, 2 if masked else 4), ("a", "+", 3, 2 if masked else 3)]
    k = KmerEngine(spark).from_table(df).kmers(4, True)
    plan = k.vec_count_masked(dense=True)._jdf.queryExecution().executedPlan().toString()
    assert "pos" not in plan.split("SortMergeJoin")[1]

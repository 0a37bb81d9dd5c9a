import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandmill.llm import bpe, mix, spam

P = pytest.importorskip("public_tokenizers")
Tokenizer = pytest.importorskip("tokenizers").Tokenizer


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


HARD = [
    None, "", " ", "\n\n \t ", "a" * 3000, "ab" * 1500, "-" * 777, "=" * 50 + "\r\n", "日本語のテキスト、" * 40, "مرحبا بالعالم", "🙂👩‍👩‍👧‍👦 é́ ǆ", "I'll we've don't 'S", "<|endoftext|> x", "x   y\u0085z\x1c w",
    "Hello.  World. \n Next!\n\n  - item\n", "﻿z​z­", "1234567890 " * 30, "tag#one@two.com", "A.\tB! C? D", "\x00\x01", "ﷺ" * 9, "qzxj" * 100, "internationalization" * 40, "a.b.c. d", ". . .\n.\n", "x" + " " * 500 + "y",
]


def packed(ids):
    return [np.frombuffer(x, np.int32).tolist() for x in ids]


def test_hard_texts(reference):
    assert packed(bpe.encoder(bpe.default_path()).encode(HARD)) == reference(HARD)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=8))
def test_any_texts(texts):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    known = [x for x in texts if all(ord(c) < 0x3000 and c.isprintable() for c in x)]  # where all Unicode versions agree
    assert packed(bpe.encoder(bpe.default_path()).encode(known)) == [e.ids for e in t.encode_batch(known, add_special_tokens=False)]


def test_letters_without_natural_cuts(reference):
    rng = random.Random(9)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(1, 400))) for _ in range(60)] + ["".join(rng.choice("ab") for _ in range(90)) for _ in range(40)]
    assert packed(bpe.encoder(bpe.default_path()).encode(words)) == reference(words)


def test_encode_and_decode(spark, reference):
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(HARD)] + [(None, "a", "n"), (0, "b", "n")], "id bigint, text string, ids string").repartition(3)
    got = bpe.encode(df, "id", "text")
    by = {r.id: r.ids for r in got.where("id > 0").collect()}
    assert [by[i] for i in range(1, len(HARD))] == reference(HARD)[1:]
    assert got.count() == len(HARD) + 2
    back = {r.id: r.text for r in bpe.decode(got, "id", "ids").where("id > 0").collect()}
    assert [back[i] for i in range(1, len(HARD))] == [t or "" for t in HARD[1:]]
    counts = {r.id: r.tokens for r in bpe.token_counts(df, "id", "text").where("id > 0").collect()}
    assert counts == {i: len(x) for i, x in by.items()}
    assert bpe.encode(df.limit(0), "id", "text").collect() == []


def test_tokenizer_files(spark, tmp_path, reference):
    import json
    import shutil

    mine = tmp_path / "mine.json"
    shutil.copy(P.path("byte_bpe_50k.json"), mine)
    df = spark.createDataFrame([(1, "some words, some more")], "id bigint, text string")
    assert bpe.encode(df, "id", "text", str(mine)).first().ids == reference(["some words, some more"])[0]
    whole = json.loads(mine.read_text())
    merges = whole["model"]["merges"]
    late = next(i for i, m in enumerate(merges) if len((m.split(" ") if isinstance(m, str) else m)[0]) > 1)
    merges.insert(0, merges.pop(late))  # joins a token that isn't there yet
    mine.write_text(json.dumps(whole))
    with pytest.raises(ValueError, match="merge 0 "):
        bpe.Encoder(str(mine))


# Mixing


def documents(spark, n=900):
    rng = random.Random(10)
    word = lambda: rng.choice("stone river market old tower bridge".split())
    source = lambda: rng.choice([" Big"] * 6 + ["big", "Small\t", "mid", "mid", "MID", None, "other"])
    data = [(i, source(), " ".join(word() for _ in range(rng.randrange(1, 60))) if rng.random() > 0.05 else None) for i in range(n)]
    return spark.createDataFrame(data, "doc_id bigint, source string, text string").withColumn("copy", F.lit(7)).repartition(5)


def test_mix(spark, rows):
    docs = documents(spark)
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.25, 3), ("MID ", 0.25, 2), ("absent", 0.0, 1), ("nothing", 0.1, None)], "source string, target_share double, max_repeats int")
    mixed, p = mix.mix(docs, "doc_id", "source", "text", targets, block=16)
    mixed = mixed.cache()
    report = {r.source: r for r in mix.shares(mixed, p, targets, "doc_id").collect()}
    for name, share, repeats in (("big", 0.5, 1), ("small", 0.25, 3), ("mid", 0.25, 2)):
        assert abs(report[name].actual_share - share) < 0.02, report
        assert report[name].most_repeats <= repeats
    assert report["absent"].tokens == report["nothing"].tokens == 0
    used = Counter((r.doc_id, r.copy) for r in mixed.collect())
    assert max(used.values()) == 1
    size = {r.doc_id: r.tokens for r in mixed.collect()}
    counted = {r.doc_id: r.tokens for r in mix.token_counts(docs, "doc_id", "text").collect()}
    assert all(counted[i] == n for i, n in size.items())
    # The scarcest source is used up to its cap.
    small = docs.where("lower(btrim(source, ' \t')) = 'small' and text is not null").count()
    assert report["small"].n_records > 2.7 * small
    # Shares hold all along: each half of the slots has about the same.
    middle = p.slots // 2
    half = {r.source: r.t for r in mixed.where(F.col("slot") < middle).groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    assert abs(half["big"] / sum(half.values()) - 0.5) < 0.03


def test_mix_edges(spark, rows):
    targets = spark.createDataFrame([("big", 0.5, 1), ("absent", 0.5, 2)], "source string, target_share double, max_repeats int")
    mixed, p = mix.mix(documents(spark, 50), "doc_id", "source", "text", targets)
    assert {r.source for r in mixed.select("source").distinct().collect()} == {"big"}
    for d, t in ((documents(spark, 50).limit(0), targets), (documents(spark, 50), targets.limit(0))):
        mixed, p = mix.mix(d, "doc_id", "source", "text", t)
        assert rows(mixed) == [] and p.slots == 0
        assert sum(r.tokens for r in mix.shares(mixed, p, t, "doc_id").collect()) == 0


def test_schedule_is_even(spark):
    p = mix.Plan([("a", 0.6, 0.6, 1, 1), ("b", 0.3, 0.3, 1, 1), ("c", 0.1, 0.1, 1, 1)], 150_000, 1)
    got = mix.schedule(spark.range(1), p).orderBy("slot").toPandas()
    for name, share, *_ in p.sources:
        mine = got[got.source == name]
        assert (mine["rank"].to_numpy() == np.arange(len(mine))).all()
        assert np.abs((mine["rank"] + 1) - share * (mine["slot"] + 1)).max() < 8


def test_running_total(spark):
    rng = random.Random(11)
    data = [(rng.choice(["a"] * 8 + ["b", "c"]), i, rng.randrange(9)) for i in range(2000)]
    got = mix.running_total(spark.createDataFrame(data, "g string, i bigint, v bigint").repartition(6), "g", ["i"], "v").collect()
    total, want = Counter(), {}
    for g, i, v in data:
        want[i] = total[g]
        total[g] += v
    assert {r.i: r.before for r in got} == want


def test_mix_that_is_less_than_a_block(spark, rows):
    targets = spark.createDataFrame([("big", 1.0, 1)], "source string, target_share double, max_repeats int")
    mixed, p = mix.mix(documents(spark, 50), "doc_id", "source", "text", targets, block=1_000_000)
    assert rows(mixed) == [] and p.slots == 0
    with pytest.raises(ValueError):
        mix.mix(documents(spark, 50), "doc_id", "source", "text", targets, block=0)


# Spam


def page(rng, spam_page):
    noun = lambda: rng.choice("lamp sofa drill tent watch kettle router wallet".split())
    if spam_page:
        return ", ".join(f"{rng.choice('cheap buy best free order'.split())} {noun()} online" for _ in range(60))
    return " ".join(f"The {noun()} of the {rng.choice('old new small'.split())} house was sold in {rng.randrange(1200, 1900)} to a man from the town." for _ in range(rng.randrange(2, 12)))


def test_spam_by_held_out_pages():
    rng = random.Random(12)
    labels = np.array([i % 3 == 0 for i in range(240)], np.int64)
    x = spam.signals([page(rng, bool(y)) for y in labels])
    for n in (0, 6, 40, 160):  # no label, a handful, many: the same way
        m = spam.Model(x[:n], labels[:n])
        assert ((m.score(x[160:]) > 0) == labels[160:]).mean() > 0.97, n


def test_signals_by_hand():
    x = dict(zip(spam.SIGNALS, spam.signals(["a lamp and a lamp and", "p q r", ""]).T))
    assert x["function"].tolist() == [4 / 6, 0, 0] and x["distinct"].tolist() == [0.5, 1, 0]
    assert x["recur_near"].tolist() == [0.5, 0, 0] and x["gap_mean"][0] == np.log1p(3) and x["gap_cv"][0] == 0
    assert x["auto_max"][0] == 1 and x["auto_lag"][0] == 2  # lag 3 holds everywhere
    assert x["listlike"].tolist() == [0, 1, 1] and x["top1"].tolist() == [2 / 6, 1 / 3, 0]
    assert spam._terms("http://a.b/c #Tag l*am*p m.as.te.ad. U.S. e.g. ro\u200bom 12") == ["<url>", "<tag>", "lamp", "mastead", "u", "s", "e", "g", "room", "12"]


def test_signals_do_not_depend_on_neighbours():
    rng = random.Random(14)
    texts = [page(rng, i % 2 == 0) for i in range(30)] + ["", "\n", "word " * 3000]
    assert np.array_equal(spam.signals(texts), np.vstack([spam.signals([t]) for t in texts]))


def test_spam_queries_edges(spark, rows):
    rng = random.Random(13)
    data = [(i, page(rng, i % 2 == 0)) for i in range(60)] + [(100, None), (101, ""), (102, " \n"), (103, "x" * 50_000), (104, "a b " * 20_000), (100, None)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string").withColumns({"k": F.lit(1), "t": F.lit("t"), "y": F.lit(0), "signals": F.lit(2)})
    labels = spark.createDataFrame([(i, (i + 1) % 2) for i in range(40)] + [(5, 0), (None, 1), (7, None), (999, 1), (8, 5)], "doc_id bigint, is_spam int")
    m = spam.fit(docs, "doc_id", "text", labels, "doc_id", "is_spam")
    find = lambda m: {r.doc_id for r in spam.spam_scores(docs, "doc_id", "text", m).where("score > 0").collect()}
    found = find(m)
    assert set(range(0, 60, 2)) <= found and not found & {*range(1, 60, 2), 100, 101, 102}
    none = spam.fit(docs, "doc_id", "text", labels.limit(0), "doc_id", "is_spam")
    assert none.trees.trees == [] and spam.spam_scores(docs, "doc_id", "text", none).count() == 65 - 1
    assert set(range(0, 60, 2)) <= find(none) and not find(none) & {*range(1, 60, 2), 100, 101, 102}
    assert spam.spam_scores(docs.limit(0), "doc_id", "text", m).collect() == []
    few = spam.fit(docs, "doc_id", "text", labels, "doc_id", "is_spam", sample=10)
    assert len(few.trees.trees) > 0 and set(range(0, 60, 2)) <= find(few)
    broken = spark.sql("SELECT 1L AS doc_id, cast(unhex('FF4162FE') AS string) AS text")
    assert spam.spam_signals(broken, "doc_id", "text").count() == 1

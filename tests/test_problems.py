import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandmill.operators import badrows, hotkeys
from strandmill.operators.badrows import rejects, strict_load

GOOD = "c:1-5:+,d,ACGT,DNA"
LINES = [
    (GOOD, None), ('"c:d:1-5:-","a, ""b""\nc","ac gt\r",DNA', None), ("c:1-5:+,,ACGU,RNA", None), ('c:1-5:+,"",NNNN,DNA', None), ("c:007-0011:+,\x1fa,ACGT,DNA", None),
    ('c:1-5:+,"d,ACGT,DNA', "quoting"), ('c:1-5:+,"d"x,ACGT,DNA', "quoting"), ('c:1-5:+, "d",ACGT,DNA', "quoting"), ('c:1-5:+,d"e,ACGT,DNA', "quoting"), ('"', "quoting"), ('"""', "quoting"), (None, "quoting"),
    ("", "columns"), ('""', "columns"), ('""""', "columns"), ("c:1-5:+,ACGT,DNA", "columns"), (GOOD + ",", "columns"), ('c:1-5:+,d,"ACGT,DNA"', "columns"),
    (":1-5:+,d,ACGT,DNA", "header"), ("c:1-5:x,d,ACGT,DNA", "header"), ("c d:1-5:+,d,ACGT,DNA", "header"), ("c d:1-5:+,d,ACGT,DNA", "header"), ('"c:1-5:+\n",d,ACGT,DNA', "header"), ("c:-1-5:+,d,ACGT,DNA", "header"), (",,,", "header"),
    ("c:1-5:+,d,ACGU,DNA", "alphabet"), ("c:1-5:+,d,ACGT,RNA", "alphabet"), ("c:0-0:+,d,,DNA", "alphabet"), ("c:0-0:+,d, \r,DNA", "alphabet"), ("c:1-5:+,d,ACGT,", "alphabet"), ("c:1-5:+,d,ACGТ,DNA", "alphabet"),
    ("c:1-6:+,d,ACGT,DNA", "span"), ("c:5-1:+,d,ACGT,DNA", "span"), (f"c:1-{'9' * 60}:+,d,ACGT,DNA", "span"),
]


def test_bad_rows(spark, rows):
    data = [(i, raw, "x", "y") for i, (raw, _) in enumerate(LINES)]
    df = spark.createDataFrame(data, "raw_id bigint, raw string, offset string, text_hash string").repartition(3)
    assert rows(rejects(df)) == sorted(((i, r) for i, (_, r) in enumerate(LINES) if r), key=repr)
    loaded = strict_load(df)
    assert sorted(r.offset for r in loaded.collect()) == [i for i, (_, r) in enumerate(LINES) if not r]
    one = loaded.where("offset = 1").first()
    assert (one.ref, one.pos_start, one.pos_end, one.strand, one.description, one.seq, one.natype) == ("c:d", 1, 5, "-", 'a, "b"\nc', "acgt", "DNA")
    assert loaded.where("offset = 4").first().description == "\x1fa"


def test_bad_rows_that_repeat(spark, rows):
    data = [(1, GOOD), (1, ""), (1, ""), (None, ""), (None, GOOD), (None, None), (2, "x" * 200_000)]
    df = spark.createDataFrame(data, "raw_id bigint, raw string")
    assert rows(rejects(df)) == sorted([(1, "columns"), (1, "columns"), (None, "columns"), (None, "quoting"), (2, "columns")], key=repr)
    assert rows(rejects(df.limit(0))) == [] and strict_load(df).count() == 2


def test_many_quotes(spark, rows):
    df = spark.createDataFrame([(1, 'c:1-5:+,"' + '""' * 50_000 + '",ACGT,DNA')], "raw_id bigint, raw string")
    assert rows(rejects(df)) == [] and len(strict_load(df).first().description) == 50_000


def test_hot_keys(spark, rows, monkeypatch):
    rng = random.Random(3)
    data = [(rng.choice(["hot"] * 6 + ["warm", "cold", None]), rng.choice(["x"] * 5 + ["y", "z", None]), i) for i in range(3000)]
    want = defaultdict(lambda: [0, set()])
    for k, m, _ in data:
        if k is not None:
            want[k][0] += 1
            want[k][1] |= {m} - {None}
    df = spark.createDataFrame(data, "k string, m string, key bigint").repartition(5)
    for size in (7, 100, 10_000):
        c = hotkeys.chunk_by_key(df, F.col("k"), F.col("m"), size)
        assert rows(c.merged()) == sorted(((k, n, len(s)) for k, (n, s) in want.items()), key=repr)
        assert c.total() == sum(n for n, _ in want.values())
        assert max(r.n for r in c.states().groupBy("chunk").agg(F.sum("n").alias("n")).collect()) <= size
    assert rows(hotkeys.chunk_by_key(df.where("k = 'none'"), F.col("k"), F.col("m")).merged()) == []


def judged(line):
    """Reason and fields of a line by a plain scanner."""
    fields, i = [], 0
    while line is not None:
        text = ""
        if line[i : i + 1] == '"':
            i += 1
            while True:
                j = line.find('"', i)
                if j < 0:
                    return "quoting", None
                text += line[i:j]
                i = j + 1
                if line[i : i + 1] != '"':
                    break
                text, i = text + '"', i + 1
            if line[i : i + 1] not in ("", ","):
                return "quoting", None
        else:
            j = line.find(",", i)
            text, i = (line[i:], len(line)) if j < 0 else (line[i:j], j)
            if '"' in text:
                return "quoting", None
        fields.append(text)
        if i == len(line):
            break
        i += 1
    if line is None:
        return "quoting", None
    if len(fields) != 4:
        return "columns", None
    title, description, seq, natype = fields
    found = re.fullmatch(r"(\S+):([0-9]+)-([0-9]+):([+-])", title)
    if not found:
        return "header", None
    seq = re.sub("[ \r]", "", seq)
    if not re.fullmatch({"DNA": "[ACGTN]+", "RNA": "[ACGUN]+"}.get(natype, "(?!)"), seq, re.IGNORECASE | re.ASCII):
        return "alphabet", None
    return ("span", None) if int(found[3]) - int(found[2]) != len(seq) else (None, (found[1], seq, description))


def random_line(rng):
    """A line that fails any check, or none, with quotes where they may and may not be."""
    quoted = lambda t: '"' + t.replace('"', '""') + '"'
    seq = "".join(rng.choice("ACGTNacgt" + rng.choice(["", "", "U", "x", " ", "\r"])) for _ in range(rng.randrange(0, 12)))
    size = len(re.sub("[ \r]", "", seq)) + rng.choice([0] * 6 + [1])
    title = rng.choice(["c", "a:b", 'q"r', "s,t"] + ["", "x y"] * (rng.random() < 0.3)) + f":{7}-{7 + size}:" + rng.choice("++++-x")
    description = "".join(rng.choice('ab,"\n') for _ in range(rng.randrange(0, 8))) + rng.choice(["", '"' * rng.randrange(0, 9)])
    fields = [title, description, seq, rng.choice(["DNA"] * 8 + ["RNA", "", "dna"])]
    if rng.random() < 0.1:
        fields.insert(rng.randrange(5), "more")
    if rng.random() < 0.1:
        fields.pop()
    line = ",".join(quoted(f) if rng.random() < 0.5 or any(x in f for x in ',"\n') else f for f in fields)
    if rng.random() < 0.25:
        at = rng.randrange(len(line) + 1)
        line = line[:at] + rng.choice(['"', '""', ",", "\n", "a", '",', ',"']) + line[at + rng.randrange(2) :]
    return line


@pytest.mark.parametrize("doubled", [1000, 2, 0, -1])
def test_both_ways_to_parse(spark, monkeypatch, doubled):
    """Every reason, and every loaded field, on either side of the number of doubled quotes at which lines are parsed by their parts."""
    monkeypatch.setattr(badrows, "DOUBLED", doubled)
    rng = random.Random(17)
    lines = [raw for raw, _ in LINES] + [random_line(rng) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(lines)), "raw_id bigint, raw string").repartition(4)
    want = {i: judged(x) for i, x in enumerate(lines)}
    assert {r for r, _ in want.values()} == {None, *badrows.REASONS} and min(Counter(r for r, _ in want.values()).values()) >= 20
    assert {r.offset: r.reason for r in rejects(df).collect()} == {i: r for i, (r, _) in want.items() if r}
    assert {r.offset: (r.ref, r.seq, r.description) for r in strict_load(df).collect()} == {i: f for i, (r, f) in want.items() if not r}


def test_reasons_of_lines_with_thousands_of_quotes(spark):
    many = '"' + '""' * 1500 + '"'
    lines = [f"c:1-5:+,{many},ACGT,DNA", f"c:1-6:+,{many},ACGT,DNA", f"c:1-5:+,{many},ACGU,DNA", f"c:1-5:x,{many},ACGT,DNA", f"c:1-5:+,{many},ACGT", f"c:1-5:+,{many}x,ACGT,DNA", f'c:1-5:+,{many}",ACGT,DNA']
    df = spark.createDataFrame(list(enumerate(lines)), "raw_id bigint, raw string")
    assert {r.offset: r.reason for r in rejects(df).collect()} == {1: "span", 2: "alphabet", 3: "header", 4: "columns", 5: "quoting", 6: "quoting"}
    assert [judged(x)[0] for x in lines] == [None, "span", "alphabet", "header", "columns", "quoting", "quoting"]

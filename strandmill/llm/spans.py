"""Exact spans of at least a given length that records of different sources share, and how much of each record they cover.

Method: difference-cover anchors. D is a set of residues modulo a period such that any two positions can be shifted by the same number below the
period to be both in D. So of any two equal windows of `span` letters some anchor - a word at a position of D in its own record - lies at
the same place in both. Anchors are hashed only at positions of D; those of one source only are dropped. What remains is extended: the windows of
`span` letters around it are compared letter by letter, as 2-bit codes without any loss.

Texts are dealt into packs of about PACK letters. A pack asks whether its anchors, and then its windows, occur with another source: each distinct one is
asked once a pack, with two of its sources at most, so one that a third of all records holds costs two entries a pack. The questions of a pack go to their buckets
as packed arrays, one row for each pack and bucket; a bucket answers each pack on its own, and the pack finds the places again from its texts. So neither places nor
pairs are ever shuffled, and no group grows with the number of its occurrences.

Records are rows (id, source, text); null texts have no windows; a null source is a source of its own; repeated rows are of one source and share nothing;
windows hold A, C, G and T only, case ignored; characters beyond ASCII count as one letter each, and so do bytes that aren't UTF-8, as Java decodes them. Sources are compared by 64-bit hashes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.functions.alphabet import normalise
from strandmill.sources.shared import materialise, width

SPAN = 50
# Perfect difference covers by period, every residue being a difference of two members.
COVERS = {
    1: (0,), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 6, 8, 18), 31: (1, 5, 11, 24, 25, 27), 57: (0, 1, 3, 13, 32, 36, 43, 52), 73: (1, 2, 4, 8, 16, 32, 37, 55, 64),
}
WORD = 31  # letters of a word at most: 62 bits
LEAST_ANCHOR = 24  # letters of an anchor, where the span has as many
PIECE = 1 << 16  # windows of a piece: longer texts are cut, so that no row holds more
PACK = 1 << 20  # letters of a pack
BUCKET = 1 << 21  # questions of a bucket, on average
RUN = 1 << 15  # questions of one source that are written as one run, at most

CODES = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    CODES[ord(_c)] = CODES[ord(_c.lower())] = _i
GAP = 4
# Letters travel three to a byte, in base 5.
THREE = np.array([(i // 25 % 5, i // 5 % 5, i % 5) for i in range(256)], np.uint8)


@dataclass(frozen=True)
class Shape:
    """What depends on the span: the period, letters of an anchor, and the words (letters of each, where they begin) that make up a window."""

    span: int
    period: int
    anchor: int
    word: int
    at: tuple[int, ...]


def shape(span: int) -> Shape:
    if isinstance(span, bool) or not isinstance(span, int) or span < 1:
        raise ValueError("span must be an integer of at least 1")
    period = max(p for p in COVERS if span - p + 1 >= min(span, LEAST_ANCHOR))
    n = -(-span // WORD)
    word = -(-span // n)
    return Shape(span, period, min(WORD, span - period + 1), word, (*(i * word for i in range(n - 1)), span - word))


def packed(codes: np.ndarray, w: int) -> np.ndarray:
    """The 2-bit codes of every window of w letters (w <= 31), by doubling."""
    out, have, power, size = None, 0, codes.astype(np.int64), 1
    n = max(len(codes) - w + 1, 0)
    while True:
        if w & size:
            part = power[have : have + n]
            out = part if out is None else (out << (2 * size)) | part
            have += size
        if 2 * size > w:
            return out
        power = (power[:-size] << (2 * size)) | power[size:]
        size *= 2


def sound(codes: np.ndarray, w: int) -> np.ndarray:
    """Whether each window of w letters has only letters of the alphabet."""
    bad = np.concatenate([[0], np.cumsum(codes > 3, dtype=np.int32)])
    return bad[w:] == bad[:-w]


def mixed(*words: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of words; of single words without collision."""
    out = np.zeros(len(words[0]), np.uint64)
    for w in words:
        x = (out * np.uint64(0x9E3779B97F4A7C15)) ^ w.astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out = x ^ (x >> np.uint64(31))
    return out


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    # Small numbers are sorted in linear time.
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)


@functools.lru_cache(4)
def residues(period: int, n: int) -> np.ndarray:
    return np.resize(np.arange(period, dtype=np.int16), n)


def _ends(binary: pa.Array) -> np.ndarray:
    return np.frombuffer(binary.buffers()[1], np.int32)[binary.offset : binary.offset + len(binary) + 1]


class Pack:
    """The texts of a pack, in an order that depends on them only, as one row of letters with a gap after each text."""

    def __init__(self, table: pa.Table, s: Shape) -> None:
        self.shape = s
        hashes, at = (table.column(c).to_numpy() for c in ("hash", "at"))
        self.order = np.lexsort((at, hashes))
        self.at = at[self.order].astype(np.int64)
        self.source = table.column("source").to_numpy()[self.order]
        texts = [x.as_buffer() for x in table.column("text").take(pa.array(self.order))]
        sizes = 3 * np.fromiter((x.size for x in texts), np.int64, len(texts))
        self.codes = THREE[np.frombuffer(b"".join(texts), np.uint8)].reshape(-1)
        self.begin = np.cumsum(sizes) - sizes
        self.owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Where anchors begin, and their hashes."""
        s = self.shape
        ok = sound(self.codes, s.anchor)
        cover = np.zeros(2 * s.period, bool)
        cover[[c + i for c in COVERS[s.period] for i in (0, s.period)]] = True
        shift = ((self.at - self.begin) % s.period).astype(np.int16)
        residue = residues(s.period, -(-len(ok) // PACK) * PACK)[: len(ok)] + shift[self.owner[: len(ok)]]
        p = np.flatnonzero(ok & cover[residue])
        return p, mixed(packed(self.codes, s.anchor)[p])

    def windows(self, answers: pa.Table, buckets: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Where the windows begin that hold an anchor, at a place below the period, that was answered to be shared; and their words."""
        s = self.shape
        p, h = self.anchors()
        rows = [(b, a) for b, k, a in zip(*(answers.column(c).to_pylist() for c in ("bucket", "kind", "answer"))) if k == 0]
        shared = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.uint64(b << 32) | np.frombuffer(a, np.uint32).astype(np.uint64) for b, a in rows)]))
        p = p[_among(bucket_of(h, buckets).astype(np.uint64) << np.uint64(32) | h & np.uint64(0xFFFFFFFF), shared)]
        near = np.zeros(len(self.codes) + 2, np.int32)
        np.add.at(near, np.maximum(p - (s.period - 1), 0), 1)
        np.add.at(near, p + 1, -1)
        near = np.cumsum(near, dtype=np.int32)[: max(len(self.codes) - s.span + 1, 0)] > 0
        # Only the letters of these windows are coded: they are put together, each run of windows staying whole.
        w = np.flatnonzero(near)
        held = np.zeros(len(self.codes) + 1, np.int8)
        edge = np.flatnonzero(np.diff(w) > s.span)
        held[w[np.append(0, edge + 1)] if len(w) else []] = 1
        held[w[np.append(edge, -1)] + s.span if len(w) else []] -= 1
        held = np.cumsum(held, dtype=np.int8)[:-1] > 0
        place = np.cumsum(held, dtype=np.int32)
        letters = self.codes[held]
        at = place[w] - 1
        ok = sound(letters, s.span)[at]
        w, at = w[ok], at[ok]
        code = packed(letters, s.word)
        return w, [code[at + i] for i in s.at]


def _among(values: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which values are in the sorted list; most of those that aren't are told by their last bits."""
    out = np.zeros(len(values), bool)
    if len(found):
        last = np.uint64((1 << 20) - 1)
        seen = np.zeros(1 << 20, bool)
        seen[found & last] = True
        likely = np.flatnonzero(seen[values & last])
        out[likely] = found[np.minimum(np.searchsorted(found, values[likely]), len(found) - 1)] == values[likely]
    return out


def grouped(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings equal rows of words together, and where in it each group begins."""
    differ = lambda order: np.logical_or.reduce([w[1:] != w[:-1] for w in (x[order] for x in words)])
    by = words[0] if len(words) == 1 else mixed(*words)
    order = np.argsort(by)
    new = differ(order)
    if len(words) > 1:
        alike = by[order]
        if (new & (alike[1:] == alike[:-1])).any():  # two rows with one hash: rows that are equal may not be together
            order = np.lexsort(words[::-1])
            new = differ(order)
    return order, np.flatnonzero(np.append(np.ones(min(len(order), 1), bool), new))


def distinct(words: list[np.ndarray], source: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each group of equal rows of words, in the order of their first rows: that row, the least and the greatest source; and the group of each row."""
    order, start = grouped(words)
    if not len(order):
        return order, source, source, order
    first, sorted_source = np.minimum.reduceat(order, start), source[order]
    low, high = np.empty(len(order), source.dtype), np.empty(len(order), source.dtype)
    low[first], high[first] = np.minimum.reduceat(sorted_source, start), np.maximum.reduceat(sorted_source, start)
    kept = np.zeros(len(order), bool)
    kept[first] = True
    group = np.empty(len(order), np.int32)
    group[order] = np.repeat((np.cumsum(kept, dtype=np.int32) - 1)[first], np.diff(np.append(start, len(order))))
    return np.flatnonzero(kept), low[kept], high[kept], group


ASKED = "pack bigint, bucket int, words binary, sources binary, runs binary"
ANSWERED = "pack bigint, bucket int, kind int, answer binary"


def asked(pack: int, words: list[np.ndarray], low: np.ndarray, high: np.ndarray, buckets: int, h: np.ndarray) -> list[tuple]:
    """The questions of a pack, a row for each bucket: distinct words, the source of each by runs of equal ones, and behind them those that have a second source, again."""
    bucket = bucket_of(h, buckets)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
    out = []
    for b, (i, j) in enumerate(zip(edges, edges[1:])):
        if i == j:
            continue
        mine = order[i:j]
        two = mine[low[mine] != high[mine]]
        source = np.concatenate([low[mine], high[two]])
        run = np.flatnonzero(np.append(True, source[1:] != source[:-1]) | (np.arange(len(source)) % RUN == 0))
        out.append((pack, b, b"".join(np.concatenate([w[mine], w[two]]).tobytes() for w in words), source[run].tobytes(), np.diff(np.append(run, len(source))).astype(np.uint16).tobytes()))
    return out


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, of = zip(*(x.strip().split(" ") for x in schema.split(",")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(zip(*rows) if rows else [[]] * len(of), of)], names=names)


def coded(texts: pa.Array) -> pa.Array:
    """Each text (BINARY, a byte for each letter) as bytes of three letters, with a gap of one to three behind it."""
    n, letters = np.diff(_ends(texts)).astype(np.int64), np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    letters = letters[_ends(texts)[0] : _ends(texts)[-1]]
    room = n // 3 + 1
    end = np.cumsum(room)
    flat = np.full(3 * int(end[-1] if len(end) else 0), GAP, np.uint8)
    place = np.repeat(3 * (end - room) - (np.cumsum(n) - n), n)
    flat[place + np.arange(len(place))] = CODES[letters]
    three = flat.reshape(-1, 3)
    return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(np.append(0, end).astype(np.int32)), pa.py_buffer(three[:, 0] * 25 + three[:, 1] * 5 + three[:, 2])])


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces as bytes, with the number of their pack before them."""
    from pyspark import TaskContext

    pack, letters = TaskContext.get().partitionId() << 32, 0
    for b in batches:
        for i in range(0, b.num_rows, 2000):
            part = b.slice(i, 2000)
            sizes = np.diff(_ends(part.column(4))).astype(np.int64)
            upto = letters + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([pa.array(pack + (upto - sizes) // PACK), *part.columns[:4], coded(part.column(4)), pa.array(sizes)], names=["pack", *b.schema.names, "letters"])
            letters = int(upto[-1])


def _ask_anchors(s: Shape, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            p = Pack(pa.Table.from_batches(held), s)
            at, h = p.anchors()
            first, low, high, _ = distinct([h], p.source[p.owner[at]])
            # An anchor is a candidate only: 32 bits of its hash beside its bucket are enough.
            return _batch(asked(held[0].column(0)[0].as_py(), [h[first].astype(np.uint32)], low, high, buckets, h[first]), ASKED)

        held: list[pa.RecordBatch] = []
        for b in batches:
            packs = b.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(packs[1:] != packs[:-1]) + 1).tolist(), len(packs)] if len(packs) else []
            for i, j in zip(edges, edges[1:]):
                if held and held[0].column(0)[0].as_py() != int(packs[i]):
                    yield out(held)
                    held = []
                held.append(b.slice(i, j - i))
        if held:
            yield out(held)

    return run


def _ask_windows(s: Shape, buckets: int):
    def run(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows or not answers.num_rows:
            return pa.Table.from_batches([_batch([], ASKED)])
        p = Pack(texts, s)
        w, words = p.windows(answers, buckets)
        first, low, high, _ = distinct(words, p.source[p.owner[w]])
        words = [x[first] for x in words]
        return pa.Table.from_batches([_batch(asked(key[0].as_py(), words, low, high, buckets, mixed(*words)), ASKED)])

    return run


def _answer(words: int, kind: int):
    """The rows of each bucket -> for each pack in it the shared words themselves (anchors: 32 bits each), or a bit for each of its questions."""
    of = np.uint32 if kind == 0 else np.int64

    def judge(rows: list[tuple]) -> pa.RecordBatch:
        sizes = [int(np.frombuffer(r[4], np.uint16).sum()) for r in rows]
        source = np.concatenate([np.repeat(np.frombuffer(r[3], np.int64), np.frombuffer(r[4], np.uint16)) for r in rows])
        parts = [np.frombuffer(r[2], of).reshape(words, -1) for r in rows]
        whole = [np.concatenate([p[i] for p in parts]) for i in range(words)]
        order, start = grouped(whole)
        several = np.minimum.reduceat(source[order], start) != np.maximum.reduceat(source[order], start)
        shared = np.empty(len(order), bool)
        shared[order] = np.repeat(several, np.diff(np.append(start, len(order))))
        out, i = [], 0
        for r, n in zip(rows, sizes):
            mine = shared[i : i + n]
            if mine.any():
                out.append((r[0], r[1], kind, np.unique(whole[0][i : i + n][mine]).tobytes() if kind == 0 else np.packbits(mine).tobytes()))
            i += n
        return _batch(out, ANSWERED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[0][1] != r[1]:
                    yield judge(held)
                    held = []
                held.append(r)
        if held:
            yield judge(held)

    return run


def _find(s: Shape, buckets: int):
    names = ["key", "hash", "hit_start", "hit_end"]

    def run(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        none = pa.Table.from_arrays([texts.column("key").slice(0, 0), *(pa.array([], pa.int64()) for _ in range(3))], names=names)
        masks = {b: a for b, k, a in zip(*(answers.column(c).to_pylist() for c in ("bucket", "kind", "answer"))) if k == 1}
        if not texts.num_rows or not masks:
            return none
        p = Pack(texts, s)
        w, words = p.windows(answers, buckets)
        first, _, _, group = distinct(words, p.source[p.owner[w]])
        # The questions in the order in which they were asked.
        bucket = bucket_of(mixed(*(x[first] for x in words)), buckets)
        order = np.argsort(bucket, kind="stable")
        shared = np.zeros(len(first), bool)
        for b, mask in masks.items():
            mine = order[np.searchsorted(bucket[order], b) : np.searchsorted(bucket[order], b, side="right")]
            shared[mine] = np.unpackbits(np.frombuffer(mask, np.uint8), count=len(mine))
        w = w[shared[group]]
        of = p.owner[w]
        new = np.append(True, (np.diff(w) > s.span) | (of[1:] != of[:-1]))
        low, high = w[new], w[np.append(new[1:], True)] + s.span
        of = of[new]
        shift = p.at[of] - p.begin[of]
        take = pa.array(p.order[of])
        return pa.Table.from_arrays([texts.column("key").take(take), texts.column("hash").take(take), pa.array(low + shift), pa.array(high + shift)], names=names)

    return run


def shared_spans(df: DataFrame, key: str, source: str, text: str, span: int = SPAN) -> DataFrame:
    """(key, hit_start, hit_end): the maximal runs of positions of each row that are covered by windows of `span` letters
    which also occur in a row of another source. Rows with the same key, source and text are one."""
    s, spark = shape(span), df.sparkSession
    # As bytes, one for each letter: the substring of a STRING walks from its start, which is quadratic in the record's length.
    whole = df.where(F.length(text) >= span).select(F.col(key).alias("key"), F.xxhash64(source, text).alias("hash"), F.xxhash64(source).alias("source"), normalise(F.col(text)).cast("binary").alias("text"))
    cut = F.explode(F.when(F.octet_length("text") >= span, F.sequence(F.lit(0), F.octet_length("text") - span, F.lit(PIECE)))).alias("at")
    rows = whole.select("key", "hash", "source", "text", cut).select("key", "hash", "source", "at", F.substr("text", F.col("at") + 1, F.lit(PIECE + span - 1)).alias("text"))
    kind = dict(df.dtypes)[key]
    pieces = materialise(rows.mapInArrow(_deal, f"pack bigint, key {kind}, hash bigint, source bigint, at int, text binary, letters bigint"), "pieces")
    letters = pieces.agg(F.sum("letters").alias("n")).first().n or 0
    # Only how the work is dealt depends on the size, and not the result.
    parts = width(spark)
    buckets = max(2 * parts, -(-letters // BUCKET))

    def answers(questions: DataFrame, words: int, kind: int) -> DataFrame:
        laid = questions.repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket")
        return materialise(laid.mapInArrow(_answer(words, kind), ANSWERED), "answers")

    texts = pieces.select("pack", "key", "hash", "source", "at", "text")
    anchors = answers(texts.mapInArrow(_ask_anchors(s, buckets), ASKED), 1, 0)
    windows = answers(texts.groupBy("pack").cogroup(anchors.groupBy("pack")).applyInArrow(_ask_windows(s, buckets), ASKED), len(s.at), 1)
    both = anchors.unionByName(windows).groupBy("pack")
    hits = texts.groupBy("pack").cogroup(both).applyInArrow(_find(s, buckets), f"key {kind}, hash bigint, hit_start bigint, hit_end bigint").distinct()
    # Runs of neighbouring pieces of a record may touch.
    w = Window.partitionBy("key", "hash").orderBy("hit_start")
    new = F.coalesce((F.col("hit_start") > F.max("hit_end").over(w.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    joined = hits.withColumn("new", new).withColumn("run", F.sum("new").over(w)).groupBy("key", "hash", "run").agg(F.min("hit_start").alias("hit_start"), F.max("hit_end").alias("hit_end"))
    return joined.select(F.col("key").alias(key), "hit_start", "hit_end").distinct()


def shared_parts(df: DataFrame, key: str, text: str, hits: DataFrame) -> DataFrame:
    """(key, length, shared, share) of every row: how many of its letters lie in shared spans. Null and empty texts share 0."""
    own = hits.groupBy(key).agg(F.sum(F.col("hit_end") - F.col("hit_start")).alias("shared"))
    n, shared = F.coalesce(F.length(text), F.lit(0)).cast("bigint"), F.coalesce("shared", F.lit(0))
    return df.select(key, n.alias("length")).join(own, key, "left").select(key, "length", shared.alias("shared"), F.when(F.col("length") > 0, shared / F.col("length")).otherwise(0.0).alias("share"))

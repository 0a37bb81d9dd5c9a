"""Abundance vectors by packs of records that ask buckets about their k-mers, for k of at most 31 letters.

Records are cut into pieces of BLOCK windows, and pieces are dealt into packs of about PACK letters. A pack asks about its k-mers, each distinct one once, as a sorted array for each
bucket; a bucket adds up what the packs have and answers each with an array in the order of its question; the pack finds the places again from its letters. So occurrences are never shuffled or
sorted as rows, and a hot k-mer costs an entry a pack. k-mers are 2-bit codes, which are compared whole. With both strands a k-mer and its reverse complement are one value, as they
occur equally often, and a vector is the same for either strand; a k-mer that is its own reverse complement counts twice at each place.

For masked counts the pieces of a ref are in one pack, which subtracts the ref's own occurrences. Those of a ref of more than PACK letters are dealt to any packs, ask apart with the ref's name, and the bucket
subtracts. Records without a ref are in no masked vector. Rows are (ref, block, at, counts): the counts of the windows that begin at block * BLOCK + at and after it, 0 where there is none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions.alphabet import letters, normalise
from strandmill.sources.shared import materialise, width

WORD = 31  # letters of a k-mer at most
BLOCK = 65_536  # windows of a piece, cells of a block
PACK = 1 << 20  # letters of a pack, k-mers of a bucket
ODD = 0x9E3779B97F4A7C15  # times an odd number, codes are spread over their range, each onto another

PIECES = "pack bigint, tag string, ref string, block bigint, at int, bytes binary"
ASKED = "bucket bigint, pack bigint, tag string, n int, keys binary, counts binary"
ANSWERED = "pack bigint, tag string, bucket bigint, n int, counts binary"
CELLS = "ref string, block bigint, at int, counts array<bigint>"


def table(columns: list[list], schema: str) -> pa.Table:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split(" ") for x in schema.split(", ")]
    return pa.Table.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], names=[n for n, _ in fields])


def pressed(x: np.ndarray) -> bytes:
    """Unsigned numbers as planes of bytes, compressed."""
    w = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    return bytes([w]) + pa.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w].T).tobytes(), codec="zstd", asbytes=True)


def unpressed(b: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, : b[0]] = np.frombuffer(pa.decompress(b[1:], n * b[0], codec="zstd", asbytes=True), np.uint8).reshape(b[0], n).T
    return out.view("<u8").ravel().astype(np.uint64)


def coded(codes: np.ndarray, k: int) -> np.ndarray:
    """The 2-bit codes of every window of k letters, by doubling."""
    out, have, power, size = None, 0, codes.astype(np.uint64), 1
    n = len(codes) - k + 1
    while True:
        if k & size:
            part = power[have : have + n]
            out = part if out is None else (out << np.uint64(2 * size)) | part
            have += size
        if 2 * size > k:
            return out
        power = (power[:-size] << np.uint64(2 * size)) | power[size:]
        size *= 2


class Shape:
    def __init__(self, k: int, natype: str, reverse: bool, masked: bool, buckets: int) -> None:
        self.k, self.reverse, self.masked = k, reverse, masked
        self.codes = np.full(256, 4, np.uint8)
        self.codes[np.frombuffer(letters(natype).encode(), np.uint8)] = range(4)
        bits = 2 * k + 1
        self.borders = np.array([(i << bits) // buckets for i in range(1, buckets)], np.uint64)

    def keys(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pieces that are joined with a gap after each: where sound windows begin, their keys, and where each piece begins. The last bit of a key is set if it counts twice."""
        codes = self.codes[np.frombuffer(b"\n".join(pieces), np.uint8)]
        begins = np.cumsum([0, *(len(p) + 1 for p in pieces)])[:-1]
        bad = np.concatenate([[0], np.cumsum(codes > 3, dtype=np.int32)])
        at = np.flatnonzero(bad[self.k :] == bad[: -self.k])
        plain = np.where(codes > 3, 0, codes).astype(np.uint8)
        key = coded(plain, self.k)[at]
        twice = np.uint64(0)
        if self.reverse:
            other = coded((3 - plain)[::-1], self.k)[::-1][at]
            twice = (key == other).astype(np.uint64)
            key = np.minimum(key, other)
        key = (key * np.uint64(ODD)) & np.uint64((1 << 2 * self.k) - 1)
        return at, (key << np.uint64(1)) | twice, begins

    def ask(self, own: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(6)]
        for tag, rows in by_tag(own):
            key, n = np.unique(self.keys(rows.column("bytes").to_pylist())[1], return_counts=True)
            n = n.astype(np.uint64) << (key & np.uint64(1))
            cuts = [0, *np.searchsorted(key, self.borders).tolist(), len(key)]
            for bucket, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if a < b:
                    for column, x in zip(out, (bucket, own.column("pack")[0].as_py(), tag, b - a, pressed(np.diff(key[a:b], prepend=np.uint64(0))), pressed(n[a:b]))):
                        column.append(x)
        return table(out, ASKED)

    def answer(self, asked: pa.Table) -> pa.Table:
        sizes, tags = asked.column("n").to_pylist(), asked.column("tag").to_pylist()
        key = np.concatenate([np.cumsum(unpressed(b, n), dtype=np.uint64) for b, n in zip(asked.column("keys").to_pylist(), sizes)])
        n = np.concatenate([unpressed(b, n) for b, n in zip(asked.column("counts").to_pylist(), sizes)]).astype(np.int64)
        which = np.unique(key, return_inverse=True)[1]
        found = summed(which, n)
        ends = np.cumsum(sizes)
        same: dict[str, list[int]] = {}
        for i, tag in enumerate(tags):
            if tag is not None:
                same.setdefault(tag, []).append(i)
        for rows in same.values():
            at = np.concatenate([np.arange(ends[i] - sizes[i], ends[i]) for i in rows])
            found[at] -= summed(np.unique(which[at], return_inverse=True)[1], n[at])
        parts = [pressed(found[b - size : b]) for b, size in zip(ends.tolist(), sizes)]
        return table([asked.column("pack").to_pylist(), tags, asked.column("bucket").to_pylist(), sizes, parts], ANSWERED)

    def place(self, own: pa.Table, answered: pa.Table) -> pa.Table:
        answers: dict[str | None, list] = {}
        for tag, bucket, n, counts in zip(*(answered.column(c).to_pylist() for c in ("tag", "bucket", "n", "counts"))):
            answers.setdefault(tag, []).append((bucket, n, counts))
        tables = []
        for tag, rows in by_tag(own):
            pieces = rows.column("bytes").to_pylist()
            at, key, begins = self.keys(pieces)
            if not len(at):
                continue
            which = np.unique(key, return_inverse=True)[1]
            count = np.concatenate([unpressed(counts, n) for _, n, counts in sorted(answers[tag])]).astype(np.int64)[which]
            if self.masked and tag is None:
                ref = np.unique(rows.column("ref").to_numpy(), return_inverse=True)[1]
                ref = ref[np.searchsorted(begins, at, "right") - 1]
                count -= summed(np.unique((ref.astype(np.int64) << 32) | which, return_inverse=True)[1], 1 << (key & np.uint64(1)).astype(np.int64))
            cells = np.zeros(len(begins) and int(begins[-1]) + len(pieces[-1]), np.int64)
            cells[at] = count
            sizes = [len(p) - self.k + 1 for p in pieces]
            values = np.concatenate([cells[b : b + size] for b, size in zip(begins.tolist(), sizes)])
            ends = np.cumsum([0, *sizes])
            some = pa.array(np.maximum.reduceat(values, ends[:-1]) > 0)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
            tables.append(pa.Table.from_arrays([*(rows.column(c).combine_chunks() for c in ("ref", "block", "at")), lists], names=["ref", "block", "at", "counts"]).filter(some))
        if tables:
            return pa.concat_tables(tables)
        return pa.table({"ref": pa.array([], pa.string()), "block": pa.array([], pa.int64()), "at": pa.array([], pa.int32()), "counts": pa.array([], pa.list_(pa.int64()))})


def summed(which: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each row the sum of n over the rows of the same number; sums are below 2 ** 53."""
    return np.bincount(which, n)[which].astype(np.int64) if len(which) else np.zeros(0, np.int64)


def by_tag(rows: pa.Table) -> Iterator[tuple[str | None, pa.Table]]:
    tags = rows.column("tag").to_pylist()
    places: dict[str | None, list[int]] = {}
    for i, tag in enumerate(tags):
        places.setdefault(tag, []).append(i)
    for tag, at in places.items():
        yield tag, rows.take(at) if len(places) > 1 else rows


def sparse(records: DataFrame, k: int, natype: str = "DNA", reverse: bool = False, masked: bool = False, pack: int = PACK) -> DataFrame:
    """(ref, block, at, counts) of the records (ref, seq[, offset]). Those of one ref may be in several rows for a block, and then cover each other if the records do."""
    spark = records.sparkSession
    offset = F.col("offset").cast("bigint") if "offset" in records.columns else F.lit(0).cast("bigint")
    whole = records.select("ref", normalise(F.col("seq")).cast("binary").alias("bytes"), offset.alias("offset")).where(F.octet_length("bytes") >= k)
    if masked:
        whole = whole.where("ref is not null")
    whole = materialise(whole.withColumn("row", F.monotonically_increasing_id()), "records")
    total = whole.agg(F.sum(F.octet_length("bytes").cast("bigint")).alias("n")).first().n or 0
    packs = max(1, total // pack, min(width(spark), total // BLOCK))
    block = F.explode(F.sequence(F.expr(f"offset div {BLOCK}"), F.expr(f"(offset + octet_length(bytes) - {k}) div {BLOCK}"))).alias("block")
    start = F.greatest(F.col("offset"), F.col("block") * BLOCK)
    end = F.least(F.col("offset") + F.octet_length("bytes"), (F.col("block") + 1) * BLOCK + (k - 1))
    any_pack = F.xxhash64("row", "block")
    if masked:
        large = materialise(whole.groupBy("ref").agg(F.sum(F.octet_length("bytes").cast("bigint")).alias("n")).where(F.col("n") > pack).select("ref", F.col("ref").alias("tag")), "large")
        # At most as many refs as there are packs.
        whole = whole.join(F.broadcast(large), "ref", "left")
        home = F.when(F.col("tag").isNull(), F.xxhash64("ref")).otherwise(any_pack)
    else:
        whole, home = whole.withColumn("tag", F.lit(None).cast("string")), any_pack
    cut = whole.select("ref", "tag", "row", "bytes", "offset", block)
    piece = F.substr("bytes", (start - F.col("offset") + 1).cast("int"), (end - start).cast("int"))
    pieces = cut.select(F.pmod(home, F.lit(packs)).alias("pack"), "tag", "ref", "block", (start - F.col("block") * BLOCK).cast("int").alias("at"), piece.alias("bytes"))
    s = Shape(k, natype, reverse, masked, min(packs, 4**k))
    tasks = max(width(spark), -(-packs // 4))
    dealt = pieces.repartition(tasks, "pack").groupBy("pack")
    asked = dealt.applyInArrow(lambda own: s.ask(own), ASKED).repartition(tasks, "bucket")
    answered = asked.groupBy("bucket").applyInArrow(lambda asked: s.answer(asked), ANSWERED).repartition(tasks, "pack")
    return dealt.cogroup(answered.groupBy("pack")).applyInArrow(lambda own, answered: s.place(own, answered), CELLS)  # lambdas, as Spark counts the parameters of what it is given


def strands(reverse: bool, strand: str) -> Column:
    return F.explode(F.array(*(F.lit(x) for x in ((strand, "-" if strand == "+" else "+") if reverse else (strand,))))).alias("strand")


def vector(blocks: DataFrame, reverse: bool = False, strand: str = "+") -> DataFrame:
    """(ref, strand, pos, count) of sparse rows: the cells that are filled."""
    cells = blocks.select("ref", (F.col("block") * BLOCK + F.col("at")).alias("base"), F.posexplode("counts").alias("i", "count")).where("count > 0")
    return cells.select("ref", strands(reverse, strand), (F.col("base") + F.col("i")).alias("pos"), "count")


def _merged(replace: bool, strand: str):
    """Sparse rows in the order of (ref, block) -> one row for each, from position 0 of the block to its last filled cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done, size = None, [], 0

        def settle() -> None:
            (ref, block), parts = held
            out = np.zeros(max(at + len(x) for at, x in parts), np.int64)
            for at, x in parts:
                here = out[at : at + len(x)]
                if not replace and len(parts) > 1 and (twice := np.flatnonzero((here > 0) & (x > 0))).size:
                    raise ValueError(f"cell filled twice: {ref} {strand} {block * BLOCK + at + int(twice[0])}")
                np.maximum(here, x, out=here)
            done.append((ref, block, 0, out[: np.flatnonzero(out)[-1] + 1]))

        def flush() -> pa.RecordBatch:
            refs, blocks, ats, lists = zip(*done)
            counts = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.array(np.concatenate(lists)))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(refs, pa.string()), pa.array(blocks, pa.int64()), pa.array(ats, pa.int32()), counts], names=["ref", "block", "at", "counts"])

        for b in batches:
            lists = b.column(3)
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            for i, (ref, block, at) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)))):
                if held is None or held[0] != (ref, block):
                    if held is not None:
                        settle()
                    held = ((ref, block), [])
                held[1].append((at, values[ends[i] : ends[i + 1]].copy()))
                size += int(ends[i + 1] - ends[i])
                if size > 1 << 21 and done:
                    size = 0
                    yield flush()
        if held is not None:
            settle()
            yield flush()

    return run


def cells(blocks: DataFrame, replace: bool = False, strand: str = "+") -> DataFrame:
    """Sparse rows, one for each (ref, block), written. As for reduce.cells, one that is filled twice is an error, or the greatest count stays, and counts without a ref are in no cell."""
    rows = blocks.where("ref is not null").repartition(width(blocks.sparkSession), "ref", "block").sortWithinPartitions("ref", "block")
    return materialise(rows.mapInArrow(_merged(replace, strand), CELLS), "cells")


def full(cell: DataFrame) -> DataFrame:
    """(ref, block, counts): the cells with zeros from 0 up to the last one of each ref."""
    last = cell.groupBy("ref").agg(F.max("block").alias("last"))
    every = last.select("ref", "last", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("block"))
    have = F.coalesce("counts", F.array().cast("array<bigint>"))
    more = F.array_repeat(F.lit(0).cast("bigint"), F.lit(BLOCK) - F.size(have))
    counts = F.when(F.col("block") < F.col("last"), F.concat(have, more)).otherwise(have)
    return every.join(cell.select("ref", "block", "counts").hint("merge"), ["ref", "block"], "left").select("ref", "block", counts.alias("counts"))


def dense(blocks: DataFrame, reverse: bool = False, strand: str = "+", replace: bool = False) -> DataFrame:
    """(ref, strand, pos, count): the vector with zeros from 0 up to the last position of each (ref, strand)."""
    rows = full(cells(blocks, replace, strand)).select("ref", (F.col("block") * BLOCK).alias("base"), F.posexplode("counts").alias("i", "count"))
    return rows.select("ref", strands(reverse, strand), (F.col("base") + F.col("i")).alias("pos"), "count")

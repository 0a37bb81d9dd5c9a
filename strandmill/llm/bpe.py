"""Encoding a corpus with a public byte-level BPE tokenizer, by recursive queries in DuckDB within each partition.

Texts are cut into words by the tokenizer's pattern; each distinct word that a worker hasn't met becomes rows (word, position, token), starting from
its bytes. A recursive query joins neighbours with the merge table and contracts, in each word, its pair of least rank, until no pair
has a rank; an ordered aggregation makes the rows of a word a list of ids again. All occurrences of a word's least pair are contracted in one
step, leftmost first where they overlap: a pair that holds a new token always has a greater rank, so the remaining ones would be next anyway.
That holds where every merge joins tokens that earlier merges made, which is checked when the file is read.

Two exact shortcuts keep the recursion shallow and small: a text is first cut before a space or line break that ends a sentence or line, where no word can
cross, so that repeated sentences are looked up; and a word is cut where no token of the vocabulary can hold the bytes of both sides.

Defined cases: null and empty texts give an empty list; special tokens in a text are ordinary text; bytes that aren't UTF-8 become U+FFFD.
"""

from __future__ import annotations

import functools
import json
import os
import re
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.runs import strings

BUFFER = 8_000_000  # characters that are encoded together
KNOWN = 400_000  # words whose ids a worker keeps; when there are more it starts anew

# Fixed value: the pattern that this tokenizer's words follow.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# A word never goes on from a visible character into white space.
SEGMENT = re.compile(r"(?<=\S)(?=\n)|(?<=[.!?])(?= )")

CONTRACT = """
WITH RECURSIVE s(word, pos, tok, step) AS (
  SELECT word, pos, tok, 0 FROM start
  UNION ALL
  SELECT word, pos, CASE WHEN hit THEN id ELSE tok END, step + 1 FROM (
    SELECT *, coalesce(lag(hit) OVER (PARTITION BY word ORDER BY pos), false) AS gone FROM (
      SELECT *, rank = best AND (NOT twin OR row_number() OVER (PARTITION BY word, run ORDER BY pos) % 2 = 1) AS hit FROM (
        SELECT *, CASE WHEN twin THEN n - row_number() OVER (PARTITION BY word, twin ORDER BY pos) END AS run FROM (
          SELECT *, rank = best AND tok = nxt AS twin FROM (
            SELECT p.*, m.rank, m.id, min(m.rank) OVER (PARTITION BY word) AS best FROM (
              SELECT *, lead(tok) OVER o AS nxt, row_number() OVER o AS n FROM s WINDOW o AS (PARTITION BY word ORDER BY pos)
            ) p LEFT JOIN merges m ON m.l = p.tok AND m.r = p.nxt
          )
        ) WHERE best IS NOT NULL
      )
    )
  ) WHERE NOT gone
)
SELECT word, list(tok ORDER BY pos) AS ids
FROM s JOIN (SELECT word, max(step) AS step FROM s GROUP BY word) USING (word, step) GROUP BY word ORDER BY word
"""


def byte_letters() -> list[str]:
    """The character that stands for each byte in the vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def spill_dir() -> str:
    """Where Spark itself spills on this executor; outside of a task the system's folder."""
    return os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or tempfile.gettempdir()


class Encoder:
    """The merge table in DuckDB, and the words that it has encoded; one per worker process and vocabulary file."""

    def __init__(self, path: str) -> None:
        import duckdb
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, letters = model["vocab"], byte_letters()
        self.of_byte = np.array([vocab[x] for x in letters], np.int32)
        back = {x: b for b, x in enumerate(letters)}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made: dict[str, int] = {}
        for rank, (a, b) in enumerate(merges):
            if max(made.get(a, -1), made.get(b, -1)) >= rank or (len(a) > 1 and a not in made) or (len(b) > 1 and b not in made):
                raise ValueError(f"merge {rank} joins a token that no earlier merge makes")
            made.setdefault(a + b, rank)
        texts = [bytes(back[x] for x in a + b) for a, b in merges]
        self.bytes_of = {vocab[a + b]: t for (a, b), t in zip(merges, texts, strict=True)} | {int(i): bytes([b]) for b, i in enumerate(self.of_byte)}
        column = lambda xs: pa.array(xs, pa.int32())
        pairs = pa.table({"l": column([vocab[a] for a, _ in merges]), "r": column([vocab[b] for _, b in merges]), "rank": column(range(len(merges))), "id": column([vocab[a + b] for a, b in merges])})  # noqa: F841
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": spill_dir()})
        self.db.execute("CREATE TABLE merges AS SELECT * FROM pairs")
        # Which neighbouring bytes, and which three, are together in some token: anything else is a place where words can be cut.
        self.two, self.three = np.zeros(1 << 16, bool), np.zeros(1 << 24, bool)
        for t in texts:
            if len(t) == 2:
                self.two[t[0] << 8 | t[1]] = True
            for i in range(len(t) - 2):
                self.three[t[i] << 16 | t[i + 1] << 8 | t[i + 2]] = True
        self.words = regex.compile(PATTERN).findall
        self.known: dict[str, bytes] = {}

    def cut(self, words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """The word that each piece is of, and the pieces in order."""
        whole = b"".join(words)
        b = np.frombuffer(whole, np.uint8).astype(np.int32)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        joined = np.zeros(len(b), bool)  # whether a token may hold a byte and the one before it
        joined[1:] = self.two[b[:-1] << 8 | b[1:]]
        if len(b) > 2:
            more = self.three[b[:-2] << 16 | b[1:-1] << 8 | b[2:]]
            joined[2:] |= more
            joined[1:-1] |= more
        joined[0] = False
        joined[ends[:-1]] = False
        at = np.flatnonzero(~joined)
        edges = [*at.tolist(), len(whole)]
        return np.searchsorted(ends, at, side="right"), [whole[i:j] for i, j in zip(edges, edges[1:])]

    def learn(self, words: list[str]) -> None:
        """Encode words that aren't known yet."""
        owner, pieces = self.cut([w.encode("utf-8", "replace") for w in words])
        place = {p: i for i, p in enumerate(dict.fromkeys(pieces))}
        lens = np.fromiter(map(len, place), np.int64, len(place))
        start = pa.table(  # noqa: F841
            {
                "word": np.repeat(np.arange(len(place), dtype=np.int32), lens),
                "pos": (np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)).astype(np.int32),
                "tok": self.of_byte[np.frombuffer(b"".join(place), np.uint8)],
            }
        )
        ids = self.db.sql(CONTRACT).to_arrow_table()["ids"].combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        ends, flat = ids.offsets.to_numpy() * 4, ids.values.to_numpy().astype(np.int32).tobytes()
        of_piece = [flat[i:j] for i, j in zip(ends.tolist(), ends[1:].tolist())]
        first = np.searchsorted(owner, np.arange(len(words) + 1)).tolist()
        packed = [of_piece[place[p]] for p in pieces]
        for w, i, j in zip(words, first, first[1:]):
            self.known[w] = packed[i] if j == i + 1 else b"".join(packed[i:j])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as packed int32."""
        cut = [SEGMENT.split(t) if t else [] for t in texts]
        words = {s: self.words(s) for s in {s for segments in cut for s in segments}}
        new = {w for ws in words.values() for w in ws}
        if len(self.known) > KNOWN:
            self.known = {}
        if new := [w for w in new if w not in self.known]:
            self.learn(new)
        ids_of = self.known.__getitem__
        done = {s: b"".join(map(ids_of, ws)) for s, ws in words.items()}
        return [b"".join(map(done.__getitem__, segments)) for segments in cut]


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def buffered(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[pa.Array], list[str | None]]]:
    """The id columns and texts of about BUFFER characters at a time."""
    ids: list[pa.Array] = []
    texts: list[str | None] = []
    size = 0
    for b in batches:
        for i in range(0, b.num_rows, 500):
            part = b.slice(i, 500)
            ids.append(part.column(0))
            texts += (new := strings(part.column(1)))
            size += sum(map(len, filter(None, new)))
            if size >= BUFFER:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _found(df: DataFrame, tokenizer: str | None) -> Callable[[], str]:
    """Where a worker finds the tokenizer: a given file is sent to all of them, the default one is part of their installation."""
    if tokenizer is None:
        return default_path
    df.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)
    return lambda: SparkFiles.get(name)


def _typed(df: DataFrame, key: str) -> tuple[DataFrame, str]:
    return df.select(F.col(key).alias("k"), F.col("__text").alias("t")), dict(df.dtypes)[key]


def encode(df: DataFrame, key: str, text: str, tokenizer: str | None = None) -> DataFrame:
    """(key, ids ARRAY<INT>), one row for each row of df. tokenizer: the JSON file, on the driver."""
    path = _found(df, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path())
        for ids, texts in buffered(batches):
            packed = coder.encode(texts)
            keys = pa.concat_arrays(ids)
            for i in range(0, len(packed), 1000):  # batches stay small for the JVM
                part = packed[i : i + 1000]
                ends = np.cumsum([0, *map(len, part)], dtype=np.int64) // 4
                flat = pa.array(np.frombuffer(b"".join(part), np.int32))
                yield pa.RecordBatch.from_arrays([keys.slice(i, len(part)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["k", "ids"])

    rows, kind = _typed(df.withColumn("__text", F.col(text)), key)
    return rows.mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def token_counts(df: DataFrame, key: str, text: str, tokenizer: str | None = None, name: str = "tokens") -> DataFrame:
    """(key, tokens BIGINT), one row for each row of df."""
    path = _found(df, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path())
        for ids, texts in buffered(batches):
            n = np.fromiter(map(len, coder.encode(texts)), np.int64, len(texts)) // 4
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(n)], names=["k", "n"])

    rows, kind = _typed(df.withColumn("__text", F.col(text)), key)
    return rows.mapInArrow(run, f"k {kind}, n bigint").withColumnsRenamed({"k": key, "n": name})


def decode(df: DataFrame, key: str, ids: str, tokenizer: str | None = None) -> DataFrame:
    """(key, text) from lists of ids; bytes that aren't UTF-8 become U+FFFD; null gives null, an unknown id is an error."""
    path = _found(df, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(path()).bytes_of
        for b in batches:
            texts = [None if x is None else b"".join(of[i] for i in x).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["k", "text"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("k"), F.col(ids).alias("ids")).mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", key)

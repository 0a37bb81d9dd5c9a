"""Cutting oversized texts into overlapping pieces at natural boundaries.

Method: a hierarchy of separators, from the coarsest to the finest. Pieces are packed greedily: a piece ends at its last boundary of the coarsest level
that has one within the limit, and, where no level has one, after exactly `limit` characters; the next piece starts `overlap` characters before that end.

Defined cases: a text of at most `limit` characters is one piece; an empty text gives one empty piece, and null none.
Positions are characters, 0-based and half-open. Bytes that aren't UTF-8 count as U+FFFD, by which they are replaced: positions are those of the text so decoded.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.runs import strings

# Boundaries lie at the end of a match. Prose: section, paragraph, sentence, word. Sequences: gaps.
PROSE = (r"\n(?==)", r"\n[ \t\r]*\n\s*", r"[.!?。！？]+\s+", r"\s+")
GAPS = (r"[Nn-]{10,}",)


def pieces(text: str, limit: int, overlap: int, separators: list[re.Pattern]) -> Iterator[tuple[int, int]]:
    levels: dict[int, list[int]] = {}

    def bounds(level: int) -> list[int]:  # a finer level is only searched where a coarser one fails
        if level not in levels:
            levels[level] = [m.end() for m in separators[level].finditer(text)]
        return levels[level]

    start = 0
    while len(text) - start > limit:
        end = start + limit
        for level in range(len(separators)):
            at = bounds(level)
            i = bisect_right(at, start + limit) - 1
            if i >= 0 and at[i] > start + overlap:
                end = at[i]
                break
        yield start, end
        start = end - overlap
    yield start, len(text)


def split_oversized(df: DataFrame, key: str, text: str, limit: int, overlap: int, separators: tuple[str, ...] = PROSE, only_oversized: bool = False, with_text: bool = True) -> DataFrame:
    """(key, piece_no, piece_start, piece_end[, piece]): all pieces of every row, or only of those over the limit."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null")
    if only_oversized:
        rows = rows.where(F.octet_length("t") > limit)  # no text has more characters than bytes; the exact check follows
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [re.compile(s) for s in separators]
        names = ["k", "piece_no", "piece_start", "piece_end", *["piece"] * with_text]
        kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * with_text]
        for b in batches:
            for low in range(0, b.num_rows, 200):
                part = b.slice(low, 200)
                out, of = [], []
                for i, t in enumerate(strings(part.column(1))):
                    if only_oversized and len(t) <= limit:
                        continue
                    for n, (start, end) in enumerate(pieces(t, limit, overlap, found)):
                        of.append(i)
                        out.append((n, start, end, t[start:end]) if with_text else (n, start, end))
                columns = [pa.array(c, kind) for c, kind in zip(zip(*out), kinds)] if out else [pa.array([], x) for x in kinds]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of, pa.int64())), *columns], names=names)

    schema = f"k {kind}, piece_no bigint, piece_start bigint, piece_end bigint" + ", piece string" * with_text
    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)

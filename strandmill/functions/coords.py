"""Coordinates of a window: ref, start, end (0-based, half-open, on the plus strand) and strand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the text form of coordinates. The ref is greedy, so it may hold colons.
HEADER = r"(?s)\A(.+):([0-9]+)-([0-9]+):([+-])\z"
FIELDS = ("ref", "start", "end", "strand")


def format_coords(ref: Column, start: Column, end: Column, strand: Column) -> Column:
    """`ref:start-end:strand`; null if any part is null."""
    return F.concat(ref, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(":"), strand)


def is_header(header: Column) -> Column:
    return header.rlike(HEADER)


def parse_coords(header: Column, strict: bool = True) -> Column:
    """Struct of ref, start, end, strand. A malformed header is an error when strict, else it gives null; null gives null."""
    part = lambda i: F.regexp_extract(header, HEADER, i)
    found = F.struct(
        part(1).alias("ref"),
        part(2).try_cast("bigint").alias("start"),
        part(3).try_cast("bigint").alias("end"),
        part(4).alias("strand"),
    )
    kept = F.when(header.isNotNull() & is_header(header), found)
    if not strict:
        return kept
    fail = F.raise_error(F.concat(F.lit("not coordinates: "), header)).cast("struct<ref:string,start:bigint,end:bigint,strand:string>")
    return F.when(header.isNotNull() & ~is_header(header), fail).otherwise(kept)


def validity(start: Column, end: Column, strand: Column, seq: Column) -> dict[str, Column]:
    """The checks that a window must pass, each a Boolean column."""
    return {
        "start_ok": start >= 0,
        "end_ok": end >= 0,
        "strand_ok": strand.isin("+", "-"),
        "length_ok": F.length(seq) == end - start,
    }


def assert_valid(start: Column, end: Column, strand: Column, seq: Column) -> Column:
    """True where all checks pass (or are null for null input); else an error that names the failed check."""
    out = F.lit(True)
    for name, ok in reversed(validity(start, end, strand, seq).items()):
        out = F.when(~ok, F.raise_error(F.lit(f"window fails {name}")).cast("boolean")).otherwise(out)
    return out

"""Text forms of windows and groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fasta_text(header: Column, seq: Column) -> Column:
    return F.concat(F.lit(">"), header, F.lit("\n"), seq, F.lit("\n"))


def tsv_text(header: Column, seq: Column) -> Column:
    return F.concat(header, F.lit("\t"), seq)


def group_text(seq: Column, headers: Column) -> Column:
    """A sequence and its headers: `seq<tab>h1 h2 ...`."""
    return F.concat(seq, F.lit("\t"), F.array_join(headers, " "))


def parse_group(line: Column) -> Column:
    """Struct of kmer and headers from `seq<tab>h1 h2`; a line without tab has no headers; null gives null."""
    cut = F.split(line, "\t", 2)
    names = F.when(F.size(cut) > 1, F.filter(F.split(F.get(cut, F.lit(1)), " "), lambda h: h != "")).otherwise(F.array().cast("array<string>"))
    return F.when(line.isNotNull(), F.struct(F.get(cut, F.lit(0)).alias("kmer"), names.alias("headers")))


def count_text(seq: Column, n: Column) -> Column:
    return F.concat(seq, F.lit("\t"), n.cast("string"))

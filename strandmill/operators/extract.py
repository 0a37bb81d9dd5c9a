"""Cutting records into chunks and windows (k-mers).

Null and empty sequences, and those shorter than k, give no rows. Input columns are picked by name, so others are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions.alphabet import in_alphabet, letters, normalise, reverse_complement

FINE = 256  # letters of a fine chunk: windows are cut from it, so that no substring walks far


STRANDS = {"+": "-", "-": "+"}  # each with the other one


def check_k(k: int, size: int | None = None) -> None:
    if isinstance(k, bool) or not isinstance(k, int) or k < 2:
        raise ValueError("k must be an integer of at least 2")
    if size is not None and size < k:
        raise ValueError("a chunk must have at least k letters")


def starts(length: Column, k: int, stride: int = 1) -> Column:
    """0, stride, 2*stride ... up to length - k; null (no rows when exploded) where length < k."""
    return F.when(length >= k, F.sequence(F.lit(0), (length - k).cast("int"), F.lit(stride)))


def chunks(records: DataFrame, k: int, size: int, ref: str = "ref", seq: str = "seq") -> DataFrame:
    """(ref, chunk, start): overlapping chunks of `size` letters whose windows of k letters are exactly those of the record.
    A size of 1 means one chunk for the whole record."""
    if size == 1:
        return records.where(F.length(seq) >= k).select(F.col(ref).alias("ref"), F.col(seq).alias("chunk"), F.lit(0).cast("bigint").alias("start"))
    check_k(k, size)
    return records.select(F.col(ref).alias("ref"), F.col(seq).alias("s"), F.explode(starts(F.length(seq), k, size - k + 1)).alias("i")).select(
        "ref", F.substr("s", F.col("i") + 1, F.lit(size)).alias("chunk"), F.col("i").cast("bigint").alias("start")
    )


def spread_records(records: DataFrame, k: int, size: int, by: str, partitions: int | None) -> DataFrame:
    """Records as binary (ref, bytes, offset), dealt evenly to tasks: whole records, or ('kmers') chunks, so that one giant record has many tasks."""
    offset = F.col("offset").cast("bigint") if "offset" in records.columns else F.lit(0).cast("bigint")
    out = records.select("ref", normalise(F.col("seq")).cast("binary").alias("bytes"), offset.alias("offset"))
    if by == "kmers":
        i = F.explode(starts(F.octet_length("bytes"), k, size - k + 1)).alias("i")
        out = out.select("ref", "bytes", "offset", i).select("ref", F.substr("bytes", F.col("i") + 1, F.lit(size)).alias("bytes"), (F.col("offset") + F.col("i")).alias("offset"))
    elif by != "records":
        raise ValueError("scan mode must be 'kmers' or 'records'")
    return out.repartition(partitions) if partitions else out


def windows(
    records: DataFrame, k: int, reverse: bool = False, natype: str = "DNA", scan: str = "kmers",
    batch_size: int = 1_000_000, partitions: int | None = None, fine: int = FINE, rejected: bool = False, strand: str = "+",
) -> DataFrame:
    """All windows (ref, start, strand, kmer) of records (ref, seq[, offset]) with only letters of the alphabet;
    with `reverse` each also as its reverse complement, at the same start. rejected: the other windows, instead.
    strand: that of the sequences as given ('+' or '-'); complements are of the other one.

    Work is on BINARY: the substring of a STRING walks from its start, which is quadratic in the record's length.
    """
    check_k(k, batch_size)
    letters(natype)
    if strand not in STRANDS:
        raise ValueError("strand must be '+' or '-'")
    fine = max(fine, 2 * k)
    out = spread_records(records, k, batch_size, scan, partitions)
    out = out.select("ref", "bytes", "offset", F.explode(starts(F.octet_length("bytes"), k, fine - k + 1)).alias("i"))
    out = out.select("ref", F.substr("bytes", F.col("i") + 1, F.lit(fine)).alias("fine"), (F.col("offset") + F.col("i")).alias("base"))
    out = out.select("ref", "base", "fine", F.explode(starts(F.octet_length("fine"), k)).alias("i"))
    out = out.select("ref", (F.col("base") + F.col("i")).alias("start"), F.substr("fine", F.col("i") + 1, F.lit(k)).cast("string").alias("kmer"))
    ok = in_alphabet(F.col("kmer"), natype)
    out = out.where(~ok if rejected else ok)
    if not reverse:
        return out.select("ref", "start", F.lit(strand).alias("strand"), "kmer")
    both = F.array(
        F.struct(F.lit(strand).alias("strand"), F.col("kmer").alias("kmer")),
        F.struct(F.lit(STRANDS[strand]).alias("strand"), reverse_complement(F.col("kmer"), natype).alias("kmer")),
    )
    return out.select("ref", "start", F.explode(both).alias("w")).select("ref", "start", "w.strand", "w.kmer")


def windows_batched(records: DataFrame, k: int, size: int, reverse: bool = False, natype: str = "DNA") -> DataFrame:
    """The same windows with the chunk that each was cut from: (ref, batch, start, strand, kmer)."""
    step = size - k + 1 if size > 1 else None
    out = windows(records, k, reverse, natype)
    batch = F.lit(0) if step is None else F.floor(F.col("start") / step)
    if step is not None:
        check_k(k, size)
    return out.select("ref", batch.cast("bigint").alias("batch"), "start", "strand", "kmer")

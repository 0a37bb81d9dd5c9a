"""Grouping windows by their sequence: singletons, counts, headers, abundance vectors.

Windows are rows (ref, start, strand, kmer). Nothing depends on how they are partitioned; an empty input gives an empty result.
A hot k-mer is counted map-side before any shuffle; where counts go back to the occurrences they do so by a merge join,
whose skewed partitions adaptive execution splits, and not by a window, which would put a hot k-mer into one task.
The join is named by a hint: the planner takes exploded windows to be as small as the records and would broadcast them.
Where windows are used twice they are cut twice: that reads the records again, while windows take up k times the room of the records, written and read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions.coords import format_coords
from strandmill.operators.hotkeys import chunk_by_key
from strandmill.sources.shared import materialise, small

BLOCK = 65_536  # positions filled at once in a dense vector
GROUP = 10_000  # headers of a row of a group


def header(k: int) -> Column:
    return format_coords(F.col("ref"), F.col("start"), F.col("start") + k, F.col("strand"))


def seq_count(kmers: DataFrame) -> DataFrame:
    """(kmer, n): the occurrences of each k-mer."""
    return kmers.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


def unique(kmers: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """(ref, start, strand, kmer): the k-mers that occur once. refs: where their refs (column `ref`) can be read without cutting windows.

    All that is grouped is of fixed width, for a hash aggregation without a sort: of one row the exclusive or is the row itself. A ref is known by two hashes, 96 bits,
    by which it is looked up afterwards: in a broadcast table if all refs together are below the session's threshold, else by a merge join.
    """
    hashes = {"ref_a": F.xxhash64("ref"), "ref_b": F.hash("ref")}
    parts = {"start": F.col("start"), "minus": (F.col("strand") == "-").cast("int"), **hashes}
    once = kmers.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"), *(F.bit_xor(c).alias(x) for x, c in parts.items())).where("n = 1")
    known = materialise((kmers if refs is None else refs).select("ref").distinct().select("ref", *(c.alias(x) for x, c in hashes.items())), "refs")
    known = F.broadcast(known) if small(known) else known.hint("merge")
    return once.join(known, list(hashes)).select("ref", "start", F.when(F.col("minus") == 1, "-").otherwise("+").alias("strand"), "kmer")


def groups(kmers: DataFrame, k: int) -> DataFrame:
    """(kmer, headers, n), headers sorted. A hot k-mer is one large row by definition; where that may be too large, take group_chunks."""
    return kmers.groupBy("kmer").agg(F.sort_array(F.collect_list(header(k))).alias("headers"), F.count(F.lit(1)).alias("n"))


def group_chunks(kmers: DataFrame, k: int, size: int = GROUP) -> DataFrame:
    """(kmer, chunk, headers, n): the groups in rows of at most `size` headers; the chunks of a k-mer, from 0, hold its headers in order.
    Occurrences are numbered in (k-mer, header) order and cut into equal runs, so that a hot k-mer is shared by as many tasks as it has chunks."""
    rows = chunk_by_key(kmers, F.col("kmer"), header(k), size).rows.select(F.col("key").alias("kmer"), F.col("member").alias("header"), F.expr(f"row_no div {size}").alias("run"))
    # Where a k-mer goes on over the end of a run, the run in which it begins: a row for each such end. Rows are brought together by (run, k-mer), which no k-mer dominates.
    over = rows.groupBy("kmer").agg(F.min("run").alias("first"), F.max("run").alias("last")).where("first < last")
    over = over.select("kmer", "first", F.explode(F.sequence(F.col("first") + 1, "last")).alias("run"))
    held = rows.join(over.hint("merge"), ["run", "kmer"], "left").groupBy("run", "kmer", "first").agg(F.sort_array(F.collect_list("header")).alias("headers"), F.count(F.lit(1)).alias("n"))
    return held.select("kmer", (F.col("run") - F.coalesce("first", "run")).alias("chunk"), "headers", "n")


def give_back(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join of rows with found (one row for each key) by a merge of 64-bit hashes of the keys, which sort faster than texts do.
    The keys themselves are compared as ranges of one value, as equalities would be made keys of the sort again."""
    named = found.withColumnsRenamed({c: f"__{c}" for c in keys}).withColumn("__found", F.xxhash64(*(f"__{c}" for c in keys)))
    same = F.col("__hash") == F.col("__found")
    for c in keys:
        same = same & (F.col(c) >= F.col(f"__{c}")) & (F.col(c) <= F.col(f"__{c}"))
    return rows.withColumn("__hash", F.xxhash64(*keys)).join(named.hint("merge"), same).drop("__hash", "__found", *(f"__{c}" for c in keys))


def vec_count(kmers: DataFrame) -> DataFrame:
    """(ref, strand, pos, count): each occurrence with the size of its group."""
    return give_back(kmers, seq_count(kmers), ["kmer"]).select("ref", "strand", F.col("start").alias("pos"), F.col("n").alias("count"))


def vec_count_masked(kmers: DataFrame) -> DataFrame:
    """(ref, strand, pos, count): each occurrence with the number of those in its group on other refs, where there are any.
    Occurrences without a ref count nowhere."""
    kmers = kmers.where("ref is not null and kmer is not null")  # said once, so that both uses of `own` share a shuffle
    own = kmers.groupBy("kmer", "ref").agg(F.count(F.lit(1)).alias("own"))
    total = own.groupBy("kmer").agg(F.sum("own").alias("total"), F.count(F.lit(1)).alias("refs")).where("refs > 1")
    other = give_back(own, total, ["kmer"]).select("kmer", "ref", (F.col("total") - F.col("own")).alias("count"))
    return give_back(kmers, other, ["kmer", "ref"]).select("ref", "strand", F.col("start").alias("pos"), "count")


def duplicates(vector: DataFrame) -> DataFrame:
    """(ref, strand, pos, n): cells that are filled more than once, as when two records share a ref."""
    return vector.groupBy("ref", "strand", "pos").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def cells(vector: DataFrame, replace: bool = False) -> DataFrame:
    """(ref, strand, pos, count), one row for each cell. A cell that is filled twice is an error, unless one count may replace another; then the greatest stays.
    Counts without a ref, strand or position are in no cell."""
    one = vector.where("ref is not null and strand is not null and pos is not null").groupBy("ref", "strand", "pos").agg(F.count(F.lit(1)).alias("n"), F.max("count").alias("count"))
    if not replace:
        # A filter, as a column with the error in it would be left out of a plan that doesn't need its value.
        twice = F.raise_error(F.concat(F.lit("cell filled twice: "), F.col("ref"), F.lit(" "), F.col("strand"), F.lit(" "), F.col("pos").cast("string"))).cast("boolean")
        one = one.where(F.when(F.col("n") > 1, twice).otherwise(True))
    return one.select("ref", "strand", "pos", "count")


def dense(vector: DataFrame, replace: bool = False) -> DataFrame:
    """The vector with zeros from 0 up to the last position of each (ref, strand). The cells are written first, and what `cells` has against them is raised then."""
    cell = materialise(cells(vector, replace), "cells")
    last = cell.groupBy("ref", "strand").agg(F.max("pos").alias("last"))
    block = last.select("ref", "strand", "last", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"last div {BLOCK}"))).alias("b"))
    at = F.explode(F.sequence(F.col("b") * BLOCK, F.least(F.col("last"), F.col("b") * BLOCK + (BLOCK - 1))))
    return block.select("ref", "strand", at.alias("pos")).join(cell.hint("merge"), ["ref", "strand", "pos"], "left").select("ref", "strand", "pos", F.coalesce("count", F.lit(0).cast("bigint")).alias("count"))


def vector_lines(vector: DataFrame, k: int) -> DataFrame:
    """(file, line_no, line) of the text form of a dense vector: line 0 names k, line pos + 1 holds the count at pos."""
    name = F.concat("ref", F.lit("___"), "strand", F.lit(".gz")).alias("file")
    head = vector.select("ref", "strand").distinct().select(name, F.lit(0).cast("bigint").alias("line_no"), F.lit(f"# k={k}").alias("line"))
    return head.unionByName(vector.select(name, (F.col("pos") + 1).alias("line_no"), F.col("count").cast("string").alias("line")))

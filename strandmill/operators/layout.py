"""Row numbers, batches and ordered runs without a single-task sort; combining batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.sources.shared import materialise, width

LOCAL = (1 << 33) - 1  # monotonically_increasing_id: partition number above, row number in the partition below


def number_rows(df: DataFrame, order: list[str | Column], name: str = "row_no", spread: Column | None = None) -> DataFrame:
    """df with exact consecutive numbers from 0 in the given order.

    Range partitions are sorted, numbered and written; the counts of the partitions, one row each, are summed up to offsets.
    Rows that tie in the order get numbers in any order; `spread` breaks ties across partitions, so that even a tie of a third of all rows is divided.
    """
    by = [*order, *([spread] if spread is not None else [])]
    ranged = df.repartitionByRange(width(df.sparkSession), *by).sortWithinPartitions(*by)
    runs = materialise(ranged.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit(LOCAL))}), "runs")
    sizes = runs.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    # As many offsets as range partitions, whatever the data: safe to broadcast.
    return runs.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__offset") + F.col("__at")).drop("__part", "__at", "__offset")


def batch_assign(kmers: DataFrame, size: int, order: list[str]) -> DataFrame:
    """Rows with the batch of at most `size` rows that each falls into, filled in the given order."""
    if size < 1:
        raise ValueError("a batch must hold at least one record")
    return number_rows(kmers, order, "__n").withColumn("batch", F.expr(f"__n div {size}")).drop("__n")


def merge_ordered(kmers: DataFrame, order: list[str]) -> DataFrame:
    """Rows with their place (from 1) in the order."""
    return number_rows(kmers, order, "__n").withColumn("place", F.col("__n") + 1).drop("__n")


def feed(current: DataFrame, new: DataFrame, mode: str = "append", partitions: int | None = None) -> DataFrame:
    """append: both lists of batches; flow: both, re-packed evenly; replace: the new one only."""
    if mode == "replace":
        return new
    both = current.unionByName(new)
    if mode == "append":
        return both
    if mode == "flow":
        return both.repartition(partitions or width(current.sparkSession))
    raise ValueError("feed mode must be 'append', 'flow' or 'replace'")

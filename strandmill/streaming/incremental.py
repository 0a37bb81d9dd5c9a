"""Counts over a growing folder of records: each micro-batch becomes k-mer counts of its own, and a read sums them.

A batch writes to a folder named by its number and overwrites it on a retry, so that a restart from the checkpoint counts nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandmill.operators.extract import windows
from strandmill.operators.reduce import seq_count


def start_counts(records: DataFrame, out: str, checkpoint: str, k: int, reverse: bool = False, natype: str = "DNA", **trigger) -> StreamingQuery:
    """records: a streaming DataFrame (ref, seq). trigger: as for writeStream.trigger, by default all that is there, then stop."""

    def one(batch: DataFrame, number: int) -> None:
        seq_count(windows(batch, k, reverse, natype)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return records.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_counts(spark: SparkSession, out: str) -> DataFrame:
    """(kmer, n) over all batches so far."""
    return spark.read.schema("kmer string, n bigint, batch bigint").parquet(out).groupBy("kmer").agg(F.sum("n").alias("n"))

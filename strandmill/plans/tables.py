"""The tables that the queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """spread: rows are dealt out anew if the files make fewer partitions than there are cores; else nothing is shuffled."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref, seq): documents read as sequences. Letters outside ACGTK are dropped; K stays, as one outside the alphabet."""
    ref = F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("ref")
    return table(spark, sf_dir, "documents", spread=True).select(ref, F.regexp_replace("text", "[^ACGTKacgtk]", "").alias("seq"))


def fasta(spark: SparkSession, sf_dir: str, natype: str | None = None, apart: bool = False) -> DataFrame:
    """(ref, seq) of fasta_records, of one nucleic acid or both; spaces and CRs are dropped. Several records may have one ref; apart: the record's number is added to it."""
    rows = table(spark, sf_dir, "fasta_records", spread=True)
    rows = rows if natype is None else rows.where(F.col("natype") == natype)
    ref = F.concat("ref", F.lit("."), F.col("record_id").cast("string")) if apart else F.col("ref")
    return rows.select(ref.alias("ref"), F.translate("seq", " \r", "").alias("seq"))

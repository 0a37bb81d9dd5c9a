"""A store of k-mers: Parquet, with k, natype and reverse in a small table beside it. Earlier runs are read from it, whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.sources.shared import file_system


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p) and len(fs.listStatus(p)) > 0


def write_store(kmers: DataFrame, path: str, k: int, natype: str = "DNA", reverse: bool = False, batch_size: int = 1_000_000, compression: str = "zstd", mode: str = "errorifexists") -> None:
    """Sorted runs of at most batch_size records. mode 'append' adds to a store of the same k, natype and reverse."""
    spark = kmers.sparkSession
    if mode == "errorifexists" and exists(spark, path):
        raise FileExistsError(f"the store isn't empty: {path}")
    if mode == "append" and exists(spark, path):
        check(about(spark, path), k, natype, reverse)
    rows = kmers.select("ref", "start", "strand", "kmer").sortWithinPartitions("kmer")
    rows.write.mode("append" if mode == "errorifexists" else mode).option("maxRecordsPerFile", batch_size).option("compression", compression).parquet(f"{path}/kmers")
    spark.createDataFrame([(k, natype, reverse)], "k int, natype string, reverse boolean").coalesce(1).write.mode("overwrite").json(f"{path}/about")


def about(spark: SparkSession, path: str) -> dict:
    if not exists(spark, path):
        raise FileNotFoundError(f"the store is missing or empty: {path}")
    return spark.read.schema("k int, natype string, reverse boolean").json(f"{path}/about").first().asDict()


def check(found: dict, k: int | None, natype: str | None, reverse: bool | None) -> None:
    for name, want in (("k", k), ("natype", natype), ("reverse", reverse)):
        if want is not None and found[name] != want:
            raise ValueError(f"the store has {name}={found[name]}, not {want}")


def read_store(spark: SparkSession, path: str, k: int | None = None, natype: str | None = None, reverse: bool | None = None) -> DataFrame:
    """(ref, start, strand, kmer) of the whole store; an error if it is missing, empty or of another k, natype or reverse."""
    check(about(spark, path), k, natype, reverse)
    return spark.read.schema("ref string, start bigint, strand string, kmer string").parquet(f"{path}/kmers")


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(kmer, headers) from lines `kmer<tab>h1 h2`."""
    from strandmill.functions.formats import parse_group

    return spark.read.text(path).select(parse_group(F.col("value")).alias("g")).select("g.kmer", "g.headers")


def read_batches(spark: SparkSession, path: str, k: int | None = None) -> DataFrame:
    """(ref, start, strand, kmer) from a folder of FASTA batch files whose titles are coordinates; a malformed one is an error, as is a length other than k."""
    from strandmill.functions.coords import assert_valid, parse_coords
    from strandmill.sources.fasta import read_fasta

    rows = read_fasta(spark, path).select(parse_coords(F.col("title")).alias("c"), F.col("seq").alias("kmer"))
    rows = rows.select("c.*", "kmer").where(assert_valid(F.col("start"), F.col("end"), F.col("strand"), F.col("kmer")))
    if k is not None:
        other = F.raise_error(F.concat(F.lit(f"not {k} letters: "), F.col("kmer"))).cast("boolean")
        rows = rows.where(F.when(F.length("kmer") != k, other).otherwise(F.lit(True)))
    return rows.select("ref", "start", "strand", "kmer")

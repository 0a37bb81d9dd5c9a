"""The engine: records -> k-mers -> reductions, as DataFrames. Extraction and counts are lazy; what needs refs or cells twice writes these first.

    engine = KmerEngine(spark)
    kmers = engine.from_fasta("/data/genomes").kmers(k=21, reverse=True)
    kmers.seq_count().orderBy("kmer"); kmers.uniq(); kmers.vec_count(dense=True)
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions.alphabet import letters
from strandmill.functions.coords import format_coords
from strandmill.functions.formats import count_text
from strandmill.operators import extract, layout, packs, reduce
from strandmill.sources import fasta, store
from strandmill.sources.shared import width


class KmerEngine:
    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def from_fasta(self, path: str, chunk_letters: int = 0, overlap: int = 0) -> Records:
        """With chunk_letters, giant records come as chunks; overlap must then be k - 1 of the k that is used."""
        return Records(fasta.read_fasta(self.spark, path, chunk_letters, overlap))

    def from_table(self, df: DataFrame, ref: str = "ref", seq: str = "seq") -> Records:
        return Records(df.select(F.col(ref).alias("ref"), F.col(seq).alias("seq")))

    def from_store(self, path: str, k: int | None = None, natype: str | None = None, reverse: bool | None = None) -> Kmers:
        found = store.about(self.spark, path)
        return Kmers(store.read_store(self.spark, path, k, natype, reverse), found["k"], found["natype"], found["reverse"])


@dataclass(frozen=True)
class Records:
    df: DataFrame

    def kmers(self, k: int, reverse: bool = False, natype: str = "DNA", scan: str = "kmers", batch_size: int = 1_000_000, partitions: int | None = None, strand: str = "+") -> Kmers:
        """scan and batch_size say how the work is dealt to tasks and never change the result. strand: that of the sequences as given."""
        if not isinstance(reverse, bool):
            raise ValueError("reverse must be a bool")
        letters(natype)
        rows = extract.windows(self.df, k, reverse, natype, scan, batch_size, partitions or width(self.df.sparkSession), strand=strand)
        return Kmers(rows, k, natype, reverse, self.df.select("ref"), self.df, strand)

    def chunks(self, k: int, size: int) -> DataFrame:
        return extract.chunks(self.df, k, size)


@dataclass(frozen=True)
class Kmers:
    df: DataFrame
    k: int
    natype: str = "DNA"
    reverse: bool = False
    refs: DataFrame | None = None  # where the refs can be read without cutting windows
    records: DataFrame | None = None  # all that the windows were cut from, where they were
    strand: str = "+"  # that of the records

    def count(self) -> DataFrame:
        return self.df.agg(F.count(F.lit(1)).alias("n"))

    def seq_count(self) -> DataFrame:
        return reduce.seq_count(self.df)

    def uniq(self) -> DataFrame:
        return reduce.unique(self.df, self.refs)

    def groups(self) -> DataFrame:
        return reduce.groups(self.df, self.k)

    def group_chunks(self, size: int = reduce.GROUP) -> DataFrame:
        return reduce.group_chunks(self.df, self.k, size)

    def vec_count(self, dense: bool = False, replace: bool = False) -> DataFrame:
        """replace: where a cell of a dense vector is filled twice the greatest count stays; else that is an error."""
        out = reduce.vec_count(self.df)
        return reduce.dense(out, replace) if dense else out

    def vec_count_masked(self, dense: bool = False, replace: bool = False) -> DataFrame:
        if self.records is None or self.k > packs.WORD:
            out = reduce.vec_count_masked(self.df)
            return reduce.dense(out, replace) if dense else out
        blocks = packs.sparse(self.records, self.k, self.natype, self.reverse, masked=True)
        return packs.dense(blocks, self.reverse, self.strand, replace) if dense else packs.vector(blocks, self.reverse, self.strand)

    def with_coords(self) -> DataFrame:
        return self.df.select("ref", "start", (F.col("start") + self.k).alias("end"), "strand", "kmer")

    def feed(self, new: Kmers, mode: str = "append") -> Kmers:
        if (self.k, self.natype, self.reverse) != (new.k, new.natype, new.reverse):
            raise ValueError("both must have the same k, natype and reverse")
        refs = layout.feed(self.refs, new.refs, mode) if self.refs and new.refs else None
        return replace(self, df=layout.feed(self.df, new.df, mode), refs=refs, records=None)

    def save(self, path: str, batch_size: int = 1_000_000, compression: str = "zstd", mode: str = "errorifexists") -> None:
        store.write_store(self.df, path, self.k, self.natype, self.reverse, batch_size, compression, mode)

    def write_unique(self, path: str, compression: str = "none", mode: str = "append") -> None:
        """FASTA parts, ordered by sequence over all parts."""
        rows = self.uniq().withColumn("header", format_coords(F.col("ref"), F.col("start"), F.col("start") + self.k, F.col("strand")))
        fasta.write_parts(rows.orderBy("kmer").select("header", F.col("kmer").alias("seq")), path, "fasta", compression, mode)

    def write_counts(self, path: str, compression: str = "none", mode: str = "append") -> None:
        """Lines `kmer<tab>n`, ordered by sequence over all parts."""
        rows = self.seq_count().orderBy("kmer").select(count_text(F.col("kmer"), F.col("n")).alias("line"))
        fasta.write_parts(rows, path, "tsv", compression, mode)

    def write_vectors(self, path: str, masked: bool = False, mode: str = "append", replace: bool = False) -> None:
        if self.records is None or self.k > packs.WORD:
            fasta.write_vectors(reduce.vec_count_masked(self.df) if masked else reduce.vec_count(self.df), path, self.k, mode, replace)
            return
        cells = packs.cells(packs.sparse(self.records, self.k, self.natype, self.reverse, masked), replace, self.strand)
        fasta.write_cells(cells, path, self.k, (self.strand, extract.STRANDS[self.strand]) if self.reverse else (self.strand,), mode)

    def _batches(self) -> DataFrame:
        return self.df.sortWithinPartitions("kmer").select(reduce.header(self.k).alias("header"), F.col("kmer").alias("seq"))

    def write_batches(self, path: str, compression: str = "none", mode: str = "append", batch_size: int = 1_000_000) -> None:
        """FASTA batch files of at most batch_size records, each sorted by sequence."""
        fasta.write_parts(self._batches(), path, "fasta", compression, mode, batch_size)

    def append_batches(self, path: str, compression: str = "none", batch_size: int = 1_000_000) -> None:
        """Further such files in a folder that may hold some."""
        fasta.append_parts(self._batches(), path, compression, batch_size)

"""k-mer analytics on Spark: FASTA or tables to windows, counts, singletons and abundance vectors, and data-cleaning operators for large corpora."""

from strandmill.engine import KmerEngine, Kmers, Records

__all__ = ["KmerEngine", "Kmers", "Records"]

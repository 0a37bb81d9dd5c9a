"""One query per operator of the engine, each over the whole of `documents` read as sequences, or (f_...) over the whole of `fasta_records`, and its SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmill.engine import KmerEngine, Kmers
from strandmill.functions import coords, formats
from strandmill.functions.alphabet import normalise, record_name
from strandmill.operators import extract, layout, reduce
from strandmill.plans.tables import fasta as fasta_records
from strandmill.plans.tables import records, table
from strandmill.sources import fasta, store
from strandmill.sources.shared import materialise, new_path, width

K, CHUNK, BATCH, GROUP = 12, 64, 10_000, 100
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__.removeprefix("q_")] = f
    return f


def kmers(spark: SparkSession, sf_dir: str, reverse: bool = False, **more) -> Kmers:
    return KmerEngine(spark).from_table(records(spark, sf_dir)).kmers(K, reverse, **more)


def header(c: str = "end") -> F.Column:
    return coords.format_coords(F.col("ref"), F.col("start"), F.col(c), F.col("strand"))


@query
def q_records(spark, d):
    title = F.concat("ref", F.lit(" from documents"))
    return records(spark, d).select(record_name(title).alias("ref"), normalise(F.col("seq")).alias("seq"))


@query
def q_kmers_plus(spark, d):
    return kmers(spark, d).with_coords()


@query
def q_kmers_both(spark, d):
    return kmers(spark, d, True).with_coords()


@query
def q_rejected_windows(spark, d):
    return extract.windows(records(spark, d), K, partitions=width(spark), rejected=True).select("ref", "start", "kmer")


@query
def q_kmers_rna(spark, d):
    rna = records(spark, d).withColumn("seq", F.translate("seq", "Tt", "Uu"))
    return KmerEngine(spark).from_table(rna).kmers(K, True, "RNA").with_coords()


@query
def q_coords_format(spark, d):
    return kmers(spark, d).with_coords().select(header().alias("header"), "kmer")


@query
def q_coords_parse(spark, d):
    return q_coords_format(spark, d).select(coords.parse_coords(F.col("header")).alias("c"), "kmer").select("c.*", "kmer")


@query
def q_coords_valid(spark, d):
    ok = coords.validity(F.col("start"), F.col("end"), F.col("strand"), F.col("kmer"))
    return q_coords_parse(spark, d).select("ref", "start", "strand", *(c.alias(n) for n, c in ok.items()))


@query
def q_strand_reversed(spark, d):
    from strandmill.functions.alphabet import reverse_strand

    return kmers(spark, d, True).df.select("ref", "start", "strand", reverse_strand(F.col("strand")).alias("other"))


@query
def q_kmer_fasta(spark, d):
    return kmers(spark, d).with_coords().select(formats.fasta_text(header(), F.col("kmer")).alias("text"))


@query
def q_kmer_tsv(spark, d):
    return kmers(spark, d).with_coords().select(formats.tsv_text(header(), F.col("kmer")).alias("text"))


@query
def q_seq_chunks(spark, d):
    return extract.chunks(records(spark, d), K, CHUNK)


@query
def q_kmers_batched(spark, d):
    return extract.windows_batched(records(spark, d), K, CHUNK)


@query
def q_kmer_groups(spark, d):
    g = kmers(spark, d).groups()
    return g.select("kmer", F.array_join("headers", " ").alias("headers"), formats.group_text(F.col("kmer"), F.col("headers")).alias("text"), "n")


@query
def q_count_records(spark, d):
    return kmers(spark, d, True).count()


@query
def q_uniq(spark, d):
    return kmers(spark, d).uniq()


@query
def q_uniq_rc(spark, d):
    return kmers(spark, d, True).uniq()


@query
def q_seq_count(spark, d):
    return kmers(spark, d).seq_count()


@query
def q_seq_count_rc(spark, d):
    return kmers(spark, d, True).seq_count()


@query
def q_vec_count(spark, d):
    return kmers(spark, d, True).vec_count()


@query
def q_vec_count_masked(spark, d):
    return kmers(spark, d, True).vec_count_masked()


@query
def q_vec_count_dense(spark, d):
    return kmers(spark, d, True).vec_count(dense=True)


@query
def q_vec_masked_dense(spark, d):
    return kmers(spark, d, True).vec_count_masked(dense=True)


@query
def q_uniq_fasta(spark, d):
    once = kmers(spark, d).uniq().withColumn("end", F.col("start") + K)
    return once.select(formats.fasta_text(header(), F.col("kmer")).alias("text"))


@query
def q_seq_count_tsv(spark, d):
    return q_seq_count(spark, d).select(formats.count_text(F.col("kmer"), F.col("n")).alias("text"))


@query
def q_vector_lines(spark, d):
    return reduce.vector_lines(q_vec_count_dense(spark, d), K)


@query
def q_vec_duplicates(spark, d):
    return reduce.duplicates(kmers(spark, d, True).df.select("ref", "strand", F.col("start").alias("pos")))


@query
def q_batch_assign(spark, d):
    return layout.batch_assign(kmers(spark, d).df, BATCH, ["ref", "start"]).select("ref", "start", "strand", "kmer", "batch")


@query
def q_merge_ordered(spark, d):
    return layout.merge_ordered(kmers(spark, d).df, ["kmer", "ref", "start"]).select("ref", "start", "kmer", "place")


def _fed(spark: SparkSession, d: str, mode: str) -> DataFrame:
    """Plus-strand k-mers as the current batches, those of both strands as the new ones."""
    plus = kmers(spark, d).with_coords()
    return layout.feed(plus, kmers(spark, d, True).with_coords(), mode)


@query
def q_feed_append(spark, d):
    return _fed(spark, d, "append")


@query
def q_feed_flow(spark, d):
    return _fed(spark, d, "flow")


@query
def q_feed_replace(spark, d):
    return _fed(spark, d, "replace")


@query
def q_scan_modes_agree(spark, d):
    """Counts by both ways to deal the work, side by side."""
    one = kmers(spark, d, scan="records").seq_count().withColumnRenamed("n", "by_record")
    two = kmers(spark, d, scan="kmers", batch_size=128).seq_count().withColumnRenamed("n", "by_chunk")
    return one.join(two, "kmer", "full_outer").select("kmer", "by_record", "by_chunk")


@query
def q_store_roundtrip(spark, d):
    path = new_path(spark, "store")
    kmers(spark, d, True).save(path)
    return KmerEngine(spark).from_store(path, K, "DNA", True).seq_count()


@query
def q_fasta_scan(spark, d):
    """Records written as FASTA files and scanned again."""
    path = new_path(spark, "fasta")
    fasta.write_parts(records(spark, d).select(F.concat("ref", F.lit(" from documents")).alias("header"), "seq"), path)
    return fasta.read_fasta(spark, path).select("title", "ref", "seq")


@query
def q_batch_files(spark, d):
    """k-mers written as sorted FASTA batches and read again from the folder."""
    path = new_path(spark, "batches")
    kmers(spark, d, True).write_batches(path, "gzip")
    return store.read_batches(spark, path, K)


@query
def q_vector_files(spark, d):
    """The lines of written vector files."""
    path = new_path(spark, "vectors")
    kmers(spark, d, True).write_vectors(path)
    return fasta.read_vectors(spark, path)


# The same operators on sequences as they are in practice: gaps, mixed case, ambiguity letters, RNA among DNA, empty and null ones, several records of one ref, repeated deliveries.


def f_kmers(spark: SparkSession, sf_dir: str, reverse: bool = False, natype: str = "DNA", apart: bool = False) -> Kmers:
    return KmerEngine(spark).from_table(fasta_records(spark, sf_dir, "RNA" if natype == "RNA" else None, apart)).kmers(K, reverse, natype)


@query
def q_f_records(spark, d):
    return table(spark, d, "fasta_records").select("record_id", record_name(F.col("title")).alias("ref"), normalise(F.translate("seq", " \r", "")).alias("seq"))


@query
def q_f_kmers_plus(spark, d):
    return f_kmers(spark, d).with_coords()


@query
def q_f_kmers_both(spark, d):
    return f_kmers(spark, d, True).with_coords()


@query
def q_f_kmers_minus(spark, d):
    """The records taken as minus-strand sequences."""
    return KmerEngine(spark).from_table(fasta_records(spark, d)).kmers(K, True, strand="-").with_coords()


@query
def q_f_kmers_rna(spark, d):
    """The RNA records."""
    return f_kmers(spark, d, True, "RNA").with_coords()


@query
def q_f_rejected_windows(spark, d):
    """Windows with a letter outside the alphabet, by ref and these letters."""
    out = extract.windows(fasta_records(spark, d), K, partitions=width(spark), rejected=True)
    return out.groupBy("ref", F.translate("kmer", "ACGT", "").alias("others")).agg(F.count(F.lit(1)).alias("n"))


@query
def q_f_uniq(spark, d):
    return f_kmers(spark, d).uniq()


@query
def q_f_uniq_rc(spark, d):
    return f_kmers(spark, d, True).uniq()


@query
def q_f_seq_count(spark, d):
    return f_kmers(spark, d).seq_count()


@query
def q_f_seq_count_rc(spark, d):
    return f_kmers(spark, d, True).seq_count()


@query
def q_f_vec_count(spark, d):
    return f_kmers(spark, d, True).vec_count()


@query
def q_f_vec_count_masked(spark, d):
    return f_kmers(spark, d, True).vec_count_masked()


@query
def q_f_vec_dense(spark, d):
    """Of each record apart, as records with one ref fill cells twice."""
    return f_kmers(spark, d, apart=True).vec_count(dense=True)


@query
def q_f_vec_masked_dense(spark, d):
    return f_kmers(spark, d, apart=True).vec_count_masked(dense=True)


@query
def q_f_vec_duplicates(spark, d):
    return reduce.duplicates(f_kmers(spark, d, True).df.select("ref", "strand", F.col("start").alias("pos")))


@query
def q_f_vec_replace(spark, d):
    """Dense vectors where records of one ref replace each other's counts."""
    return f_kmers(spark, d).vec_count(dense=True, replace=True)


@query
def q_f_group_chunks(spark, d):
    return f_kmers(spark, d, apart=True).group_chunks(GROUP).select("kmer", "chunk", F.array_join("headers", " ").alias("headers"), "n")


@query
def q_f_scan(spark, d):
    """FASTA files with text before the first title, CRs, spaces and lines of mixed length, scanned again."""
    path = new_path(spark, "fasta")
    preamble = table(spark, d, "fasta_records").select(F.lit(None).cast("bigint").alias("record_id"), F.lit("; no record").alias("value")).limit(1)
    body = F.regexp_replace(F.coalesce("seq", F.lit("")), "(.{60})", "$1\n")
    rows = table(spark, d, "fasta_records").select("record_id", F.concat(F.lit(">"), "title", F.lit("\r\n"), body).alias("value"))
    both = preamble.unionByName(rows).orderBy(F.col("record_id").asc_nulls_first()).select("value")
    both.write.text(path)
    return fasta.read_fasta(spark, path).select("title", "ref", "seq")


@query
def q_f_scan_chunks(spark, d):
    """k-mer counts of such files, read as chunks that overlap."""
    path = new_path(spark, "fasta")
    fasta.write_parts(table(spark, d, "fasta_records").select(F.col("title").alias("header"), F.regexp_replace("seq", "(.{60})", "$1\n").alias("seq")), path)
    return KmerEngine(spark).from_fasta(path, 1000, K - 1).kmers(K).seq_count()


@query
def q_headers_checked(spark, d):
    """The headers of `kmers`, many of them malformed: parsed where they can be, and held against the checks of a window of that k-mer."""
    rows = table(spark, d, "kmers").select("row_id", "header", F.upper(F.btrim("kmer", F.lit(" \t\r"))).alias("kmer"), coords.parse_coords(F.col("header"), strict=False).alias("c"))
    ok = coords.validity(F.col("start"), F.col("end"), F.col("strand"), F.col("kmer"))
    return rows.select("row_id", "kmer", coords.is_header(F.col("header")).alias("sound"), "c.*").select("row_id", "sound", "ref", "start", "end", "strand", *(c.alias(n) for n, c in ok.items()))


@query
def q_group_lines(spark, d):
    """Group lines written as text, and scanned as batches of such lines."""
    path = new_path(spark, "groups")
    q_kmer_groups(spark, d).select("text").write.text(path)
    return store.read_groups(spark, path).select("kmer", F.size("headers").cast("bigint").alias("n"), F.array_join("headers", " ").alias("headers"))


@query
def q_batch_append(spark, d):
    """A folder of batches to which more are appended: the k-mers of RNA records twice over, and batches of at most 500 records."""
    path = new_path(spark, "batches")
    k = f_kmers(spark, d, natype="RNA")
    k.write_batches(path, "gzip", batch_size=500)
    k.append_batches(path, batch_size=500)
    return store.read_batches(spark, path, K)


@query
def q_batch_sizes(spark, d):
    """The records of each of these files."""
    path = new_path(spark, "batches")
    f_kmers(spark, d, natype="RNA").write_batches(path, batch_size=500)
    lines = spark.read.text(path).where(F.col("value").startswith(">")).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    return lines.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_records"), (F.coalesce(F.max("n"), F.lit(0)) <= 500).alias("in_size"))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of the parts of a folder, in their order."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    lines = materialise(lines, "lines")
    first = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))  # a row for each split
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(first.select("file", "block", "first", before.alias("before")), ["file", "block"]).select((F.col("before") + F.col("at") - F.col("first")).alias("line_no"), "line")


@query
def q_uniq_file(spark, d):
    """The lines of the written FASTA parts of single k-mers, in order."""
    path = new_path(spark, "uniq")
    f_kmers(spark, d).write_unique(path)
    return _numbered(spark, path)


@query
def q_seq_count_file(spark, d):
    """The lines of the written parts of counts, in order."""
    path = new_path(spark, "counts")
    f_kmers(spark, d, True).write_counts(path)
    return _numbered(spark, path)


W = "[ACGT]+"
BASE = f"""rec AS (SELECT 'doc' || doc_id AS ref, upper(regexp_replace(text, '[^ACGTKacgtk]', '', 'g')) AS seq FROM documents),
 a AS (SELECT ref, i AS start, substring(seq, i + 1, {K}) AS kmer FROM (SELECT ref, seq, unnest(range(0, greatest(length(seq) - {K} + 1, 0))) AS i FROM rec)),
 v AS (SELECT ref, start, '+' AS strand, kmer FROM a WHERE regexp_full_match(kmer, '{W}')),
 w AS (SELECT * FROM v UNION ALL SELECT ref, start, '-', translate(reverse(kmer), 'ACGT', 'TGCA') FROM v),
 vc AS (SELECT ref, strand, start AS pos, count(*) OVER (PARTITION BY kmer) AS count FROM w),
 vm AS (SELECT * FROM (SELECT ref, strand, start AS pos, count(*) OVER (PARTITION BY kmer) - count(*) OVER (PARTITION BY kmer, ref) AS count FROM w) WHERE count > 0),
 vd AS (SELECT r.ref, r.strand, r.pos, coalesce(vc.count, 0) AS count FROM (SELECT ref, strand, unnest(range(0, max(pos) + 1)) AS pos FROM vc GROUP BY ref, strand) r
  LEFT JOIN vc USING (ref, strand, pos)),
 md AS (SELECT r.ref, r.strand, r.pos, coalesce(vm.count, 0) AS count FROM (SELECT ref, strand, unnest(range(0, max(pos) + 1)) AS pos FROM vm GROUP BY ref, strand) r
  LEFT JOIN vm USING (ref, strand, pos)),
 h AS (SELECT *, ref || ':' || start || '-' || (start + {K}) || ':' || strand AS header FROM v)"""
F_BASE = f"""rec AS (SELECT ref, ref || '.' || record_id AS one, natype, upper(translate(seq, ' ' || chr(13), '')) AS seq FROM fasta_records),
 a AS (SELECT ref, one, natype, i AS start, substring(seq, i + 1, {K}) AS kmer FROM (SELECT *, unnest(range(0, greatest(length(seq) - {K} + 1, 0))) AS i FROM rec)),
 v AS (SELECT ref, one, start, '+' AS strand, kmer FROM a WHERE regexp_full_match(kmer, '{W}')),
 w AS (SELECT * FROM v UNION ALL SELECT ref, one, start, '-', translate(reverse(kmer), 'ACGT', 'TGCA') FROM v),
 vc AS (SELECT ref, one, strand, start AS pos, count(*) OVER (PARTITION BY kmer) AS count FROM w),
 pc AS (SELECT ref, one, strand, start AS pos, count(*) OVER (PARTITION BY kmer) AS count, count(*) OVER (PARTITION BY kmer) - count(*) OVER (PARTITION BY kmer, one) AS other FROM v),
 h AS (SELECT *, ref || ':' || start || '-' || (start + {K}) || ':' || strand AS header, one || ':' || start || '-' || (start + {K}) || ':' || strand AS one_header FROM v)"""
F_ONCE = "SELECT min(ref) AS ref, min(start) AS start, min(strand) AS strand, kmer, min(header) AS header FROM {} GROUP BY kmer HAVING count(*) = 1"
PARTS = f"start, start + {K} AS \"end\", strand, kmer"
UNIQUE = "SELECT min(ref) AS ref, min(start) AS start, min(strand) AS strand, kmer FROM {} GROUP BY kmer HAVING count(*) = 1"


@functools.cache
def oracle() -> dict[str, str]:
    tails = {
        "records": "SELECT ref, seq FROM rec",
        "kmers_plus": f"SELECT ref, {PARTS} FROM v",
        "kmers_both": f"SELECT ref, {PARTS} FROM w",
        "rejected_windows": f"SELECT ref, start, kmer FROM a WHERE NOT regexp_full_match(kmer, '{W}')",
        "kmers_rna": f"""SELECT ref, start, start + {K} AS "end", strand, kmer FROM (SELECT ref, start, strand, replace(kmer, 'T', 'U') AS kmer FROM v
  UNION ALL SELECT ref, start, '-', translate(reverse(replace(kmer, 'T', 'U')), 'ACGU', 'UGCA') FROM v)""",
        "coords_format": "SELECT header, kmer FROM h",
        "coords_parse": """SELECT regexp_extract(header, '^(.+):([0-9]+)-([0-9]+):([+-])$', 1) AS ref, CAST(regexp_extract(header, '^(.+):([0-9]+)-([0-9]+):([+-])$', 2) AS BIGINT) AS start,
  CAST(regexp_extract(header, '^(.+):([0-9]+)-([0-9]+):([+-])$', 3) AS BIGINT) AS "end", regexp_extract(header, '^(.+):([0-9]+)-([0-9]+):([+-])$', 4) AS strand, kmer FROM h""",
        "coords_valid": f"""SELECT ref, start, strand, start >= 0 AS start_ok, start + {K} >= 0 AS end_ok, strand IN ('+', '-') AS strand_ok, length(kmer) = {K} AS length_ok FROM v""",
        "strand_reversed": "SELECT ref, start, strand, CASE strand WHEN '+' THEN '-' ELSE '+' END AS other FROM w",
        "kmer_fasta": "SELECT '>' || header || chr(10) || kmer || chr(10) AS text FROM h",
        "kmer_tsv": "SELECT header || chr(9) || kmer AS text FROM h",
        "seq_chunks": f"""SELECT ref, substring(seq, i + 1, {CHUNK}) AS chunk, i AS start FROM (SELECT ref, regexp_replace(text, '[^ACGTKacgtk]', '', 'g') AS seq,
  unnest(range(0, greatest(length(regexp_replace(text, '[^ACGTKacgtk]', '', 'g')) - {K} + 1, 0), {CHUNK - K + 1})) AS i FROM (SELECT 'doc' || doc_id AS ref, text FROM documents))""",
        "kmers_batched": f"SELECT ref, start // {CHUNK - K + 1} AS batch, start, strand, kmer FROM v",
        "kmer_groups": "SELECT kmer, string_agg(header, ' ' ORDER BY header) AS headers, kmer || chr(9) || string_agg(header, ' ' ORDER BY header) AS text, count(*) AS n FROM h GROUP BY kmer",
        "count_records": "SELECT count(*) AS n FROM w",
        "uniq": UNIQUE.format("v"),
        "uniq_rc": UNIQUE.format("w"),
        "seq_count": "SELECT kmer, count(*) AS n FROM v GROUP BY kmer",
        "seq_count_rc": "SELECT kmer, count(*) AS n FROM w GROUP BY kmer",
        "vec_count": "SELECT * FROM vc",
        "vec_count_masked": "SELECT * FROM vm",
        "vec_count_dense": "SELECT * FROM vd",
        "vec_masked_dense": "SELECT * FROM md",
        "uniq_fasta": "SELECT '>' || min(header) || chr(10) || kmer || chr(10) AS text FROM h GROUP BY kmer HAVING count(*) = 1",
        "seq_count_tsv": "SELECT kmer || chr(9) || count(*) AS text FROM v GROUP BY kmer",
        "vector_lines": f"""SELECT DISTINCT ref || '___' || strand || '.gz' AS file, CAST(0 AS BIGINT) AS line_no, '# k={K}' AS line FROM vd
  UNION ALL SELECT ref || '___' || strand || '.gz', pos + 1, CAST(count AS VARCHAR) FROM vd""",
        "vec_duplicates": "SELECT ref, strand, start AS pos, count(*) AS n FROM w GROUP BY ref, strand, start HAVING count(*) > 1",
        "batch_assign": f"SELECT ref, start, strand, kmer, (row_number() OVER (ORDER BY ref, start) - 1) // {BATCH} AS batch FROM v",
        "merge_ordered": "SELECT ref, start, kmer, row_number() OVER (ORDER BY kmer, ref, start) AS place FROM v",
        "feed_append": f"SELECT ref, {PARTS} FROM v UNION ALL SELECT ref, {PARTS} FROM w",
        "feed_flow": f"SELECT ref, {PARTS} FROM v UNION ALL SELECT ref, {PARTS} FROM w",
        "feed_replace": f"SELECT ref, {PARTS} FROM w",
        "scan_modes_agree": "SELECT kmer, count(*) AS by_record, count(*) AS by_chunk FROM v GROUP BY kmer",
        "fasta_scan": "SELECT 'doc' || doc_id || ' from documents' AS title, 'doc' || doc_id AS ref, coalesce(regexp_replace(text, '[^ACGTKacgtk]', '', 'g'), '') AS seq FROM documents",
        "batch_files": "SELECT ref, start, strand, kmer FROM w",
        "store_roundtrip": "SELECT kmer, count(*) AS n FROM w GROUP BY kmer",
    }
    tails["vector_files"] = tails["vector_lines"]
    tails["group_lines"] = "SELECT kmer, count(*) AS n, string_agg(header, ' ' ORDER BY header) AS headers FROM h GROUP BY kmer"
    grown = """SELECT r.{0} AS ref, r.strand, r.pos, coalesce(c.count, 0) AS count FROM (SELECT {0}, strand, unnest(range(0, max(pos) + 1)) AS pos FROM {1} GROUP BY {0}, strand) r
  LEFT JOIN (SELECT {0}, strand, pos, max({2}) AS count FROM {1} GROUP BY ALL) c USING ({0}, strand, pos)"""
    rna = f"""SELECT ref, i AS start, substring(seq, i + 1, {K}) AS kmer FROM (SELECT *, unnest(range(0, greatest(length(seq) - {K} + 1, 0))) AS i FROM rec WHERE natype = 'RNA')"""
    rna = f"SELECT ref, start, kmer FROM ({rna}) WHERE regexp_full_match(kmer, '[ACGU]+')"
    header = r"'(?s)^(.+):([0-9]+)-([0-9]+):([+-])$', ['ref', 'a', 'b', 'strand']"
    f_tails = {
        "f_records": "SELECT record_id, split_part(title, ' ', 1) AS ref, upper(translate(seq, ' ' || chr(13), '')) AS seq FROM fasta_records",
        "f_kmers_plus": f"SELECT ref, {PARTS} FROM v",
        "f_kmers_both": f"SELECT ref, {PARTS} FROM w",
        "f_kmers_minus": f"""SELECT ref, start, start + {K} AS "end", CASE strand WHEN '+' THEN '-' ELSE '+' END AS strand, kmer FROM w""",
        "f_kmers_rna": f"""WITH u AS ({rna}) SELECT ref, start, start + {K} AS "end", '+' AS strand, kmer FROM u UNION ALL SELECT ref, start, start + {K}, '-', translate(reverse(kmer), 'ACGU', 'UGCA') FROM u""",
        "f_rejected_windows": f"SELECT ref, regexp_replace(kmer, '[ACGT]', '', 'g') AS others, count(*) AS n FROM a WHERE NOT regexp_full_match(kmer, '{W}') GROUP BY ALL",
        "f_uniq": "SELECT min(ref) AS ref, min(start) AS start, min(strand) AS strand, kmer FROM v GROUP BY kmer HAVING count(*) = 1",
        "f_uniq_rc": "SELECT min(ref) AS ref, min(start) AS start, min(strand) AS strand, kmer FROM w GROUP BY kmer HAVING count(*) = 1",
        "f_seq_count": "SELECT kmer, count(*) AS n FROM v GROUP BY kmer",
        "f_seq_count_rc": "SELECT kmer, count(*) AS n FROM w GROUP BY kmer",
        "f_vec_count": "SELECT ref, strand, pos, count FROM vc",
        "f_vec_count_masked": "SELECT * FROM (SELECT ref, strand, start AS pos, count(*) OVER (PARTITION BY kmer) - count(*) OVER (PARTITION BY kmer, ref) AS count FROM w) WHERE count > 0",
        "f_vec_dense": grown.format("one", "pc", "count"),
        "f_vec_masked_dense": grown.format("one", "(SELECT * FROM pc WHERE other > 0)", "other"),
        "f_vec_duplicates": "SELECT ref, strand, start AS pos, count(*) AS n FROM w GROUP BY ref, strand, start HAVING count(*) > 1",
        "f_vec_replace": grown.format("ref", "pc", "count"),
        "f_group_chunks": f"""SELECT kmer, run - min(run) OVER (PARTITION BY kmer) AS chunk, headers, n FROM (SELECT kmer, run, string_agg(one_header, ' ' ORDER BY one_header) AS headers, count(*) AS n
  FROM (SELECT *, (row_number() OVER (ORDER BY kmer, one_header) - 1) // {GROUP} AS run FROM h) GROUP BY kmer, run)""",
        "f_scan": "SELECT rtrim(title) AS title, split_part(rtrim(title), ' ', 1) AS ref, coalesce(translate(seq, ' ' || chr(13), ''), '') AS seq FROM fasta_records",
        "f_scan_chunks": "SELECT kmer, count(*) AS n FROM v GROUP BY kmer",
        "headers_checked": f"""SELECT row_id, sound, CASE WHEN sound THEN h.ref END AS ref, a AS start, b AS "end", CASE WHEN sound THEN h.strand END AS strand, a >= 0 AS start_ok, b >= 0 AS end_ok,
  CASE WHEN sound THEN h.strand IN ('+', '-') END AS strand_ok, length(k) = b - a AS length_ok FROM (SELECT *, TRY_CAST(h.a AS BIGINT) AS a, TRY_CAST(h.b AS BIGINT) AS b FROM
  (SELECT row_id, upper(trim(kmer, ' ' || chr(9) || chr(13))) AS k, regexp_full_match(header, '(?s).+:[0-9]+-[0-9]+:[+-]') AS sound, regexp_extract(header, {header}) AS h FROM kmers))""",
        "batch_append": f"SELECT ref, start, '+' AS strand, kmer FROM ({rna}) UNION ALL SELECT ref, start, '+', kmer FROM ({rna})",
        "batch_sizes": f"SELECT count(*) AS n_records, true AS in_size FROM ({rna})",
        "uniq_file": f"""SELECT n + i AS line_no, CASE i WHEN 0 THEN '>' || header ELSE kmer END AS line FROM (SELECT *, 2 * (row_number() OVER (ORDER BY kmer) - 1) AS n, unnest([0, 1]) AS i FROM ({F_ONCE.format("h")}))""",
        "seq_count_file": "SELECT row_number() OVER (ORDER BY kmer) - 1 AS line_no, kmer || chr(9) || n AS line FROM (SELECT kmer, count(*) AS n FROM w GROUP BY kmer)",
    }
    f_tails["f_kmers_rna"] = f_tails["f_kmers_rna"].removeprefix("WITH ")
    for_all = {name: f"WITH {BASE}\n{tail}" for name, tail in tails.items()}
    for name, tail in f_tails.items():
        for_all[name] = f"WITH {F_BASE}{', ' if name == 'f_kmers_rna' else chr(10)}{tail}"
    return for_all

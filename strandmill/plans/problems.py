"""Queries of the general problems: rows that fail to parse (1) and keys that hold most records (2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions.alphabet import clean_kmer
from strandmill.operators.badrows import rejects, strict_load
from strandmill.operators.hotkeys import KeyChunks, chunk_by_key
from strandmill.plans.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(raw_id, reason): the lines that can't be loaded."""
    return rejects(table(spark, sf_dir, "raw_records"), "raw_id", "raw").select(F.col("offset").alias("raw_id"), "reason")


def p1_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loaded records."""
    return strict_load(table(spark, sf_dir, "raw_records"), "raw_id", "raw").drop("text_hash").withColumnRenamed("offset", "raw_id")


def kmer_chunks(spark: SparkSession, sf_dir: str) -> KeyChunks:
    return chunk_by_key(table(spark, sf_dir, "kmers"), clean_kmer(F.col("kmer")), F.col("ref"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kmer): the values that have at least 2 % of the usable rows."""
    c = kmer_chunks(spark, sf_dir)
    return c.merged().where(F.col("n") * 50 >= F.lit(c.total())).select(F.col("key").alias("kmer"))


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kmer, n_rows, n_refs) of every value."""
    return kmer_chunks(spark, sf_dir).merged().select(F.col("key").alias("kmer"), F.col("n").alias("n_rows"), F.col("members").alias("n_refs"))


QUERIES = {"p1_found": p1_found, "p1_loaded": p1_loaded, "p2_found": p2_found, "p2_counts": p2_counts}

USABLE = """usable AS (SELECT ref, kmer FROM (SELECT ref, upper(trim(kmer, ' ' || chr(9) || chr(13))) AS kmer FROM kmers)
 WHERE regexp_full_match(kmer, '[ACGT]{31}'))"""

# Quoted fields as a list: text between quotes is odd, text outside even; a doubled quote is an empty outside part between two inner ones.
PARSED = r"""cut AS (SELECT raw_id, string_split(raw, '"') AS p FROM raw_records),
parsed AS (SELECT raw_id, len(p) % 2 = 1 AND list_bool_and([i % 2 = 0 OR p[i] = '' OR
   ((i = len(p) OR suffix(p[i], ',')) AND (i = 1 OR prefix(p[i], ','))) FOR i IN range(1, len(p) + 1)]) AS quoted,
  string_split(list_aggregate([CASE WHEN i % 2 = 0 THEN p[i] WHEN p[i] = '' AND i > 1 AND i < len(p) THEN '"'
   ELSE replace(p[i], ',', chr(31)) END FOR i IN range(1, len(p) + 1)], 'string_agg', ''), chr(31)) AS f FROM cut),
lines AS (SELECT raw_id, quoted, f, regexp_extract(f[1], '^([^\s\v\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+):([0-9]+)-([0-9]+):([+-])$',
   ['ref', 'a', 'b', 'strand']) AS h, translate(f[3], ' ' || chr(13), '') AS s FROM parsed),
judged AS (SELECT *, CASE WHEN NOT quoted THEN 'quoting' WHEN len(f) <> 4 THEN 'columns' WHEN h.ref = '' THEN 'header'
  WHEN NOT regexp_full_match(s, CASE f[4] WHEN 'DNA' THEN '[ACGTNacgtn]+' WHEN 'RNA' THEN '[ACGUNacgun]+' ELSE 'x{99}' END) THEN 'alphabet'
  WHEN TRY_CAST(h.b AS HUGEINT) - TRY_CAST(h.a AS HUGEINT) IS DISTINCT FROM length(s) THEN 'span' END AS reason FROM lines)"""

ORACLE = {
    "p1_found": f"WITH {PARSED} SELECT raw_id, reason FROM judged WHERE reason IS NOT NULL",
    "p1_loaded": f"""WITH {PARSED} SELECT raw_id, f[1] AS title, h.ref AS ref, CAST(h.a AS BIGINT) AS pos_start, CAST(h.b AS BIGINT) AS pos_end,
 h.strand AS strand, f[2] AS description, s AS seq, f[4] AS natype FROM judged WHERE reason IS NULL""",
    "p2_found": f"WITH {USABLE} SELECT kmer FROM usable GROUP BY kmer HAVING count(*) * 50 >= (SELECT count(*) FROM usable)",
    "p2_counts": f"WITH {USABLE} SELECT kmer, count(*) AS n_rows, count(DISTINCT ref) AS n_refs FROM usable GROUP BY kmer",
}

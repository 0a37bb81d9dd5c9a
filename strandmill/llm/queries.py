"""Queries of the problems 3 to 10, with production parameters over whole tables, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions.alphabet import clean_kmer
from strandmill.functions.coords import HEADER
from strandmill.llm import bpe, ledger, mix, spam, spans, split, terms, topk
from strandmill.plans.tables import table


def clean_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "fasta_records", spread=True).select("record_id", F.translate("seq", " \r", "").alias("seq"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, piece_start, piece_end): the pieces of records of more than 2,000 letters."""
    out = split.split_oversized(clean_records(spark, sf_dir), "record_id", "seq", 2000, 40, split.GAPS, only_oversized=True, with_text=False)
    return out.drop("piece_no")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, piece_no, piece_start, piece_end, piece): all records, cut where they are oversized."""
    return split.split_oversized(clean_records(spark, sf_dir), "record_id", "seq", 2000, 40, split.GAPS)


def p3_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the texts of documents, in pieces of at most 1,500 characters that overlap by 100."""
    return split.split_oversized(table(spark, sf_dir, "documents", spread=True), "doc_id", "text", 1500, 100, split.PROSE)


def p4_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, term, occurrences, records, mark) of every k-mer value and every ref in headers; mark is null for terms of middling frequency."""
    rows = table(spark, sf_dir, "kmers")
    place = F.concat_ws(":", F.col("pos_start").cast("string"), "strand")
    kmer = rows.select(F.lit("kmer").alias("field"), clean_kmer(F.col("kmer")).alias("term"), F.col("ref").alias("record"), place.alias("occurrence"))
    named = F.regexp_extract("header", HEADER, 1)
    # A header is its ref and the rest; the ref being the term, the rest alone tells headers apart.
    ref = rows.where(F.col("header").rlike(HEADER)).select(F.lit("ref").alias("field"), named.alias("term"), F.substr("header", F.length(named) + 1).alias("record"), F.lit("").alias("occurrence"))
    found = terms.term_frequencies(kmer.unionByName(ref))
    refs = rows.select("ref").where("ref is not null").distinct().count()
    headers = found.where("field = 'ref'").agg(F.sum("records").alias("n")).first().n or 0
    common = F.when(F.col("field") == "kmer", F.col("records") * 10 >= refs).otherwise(F.col("records") * 20 >= headers)
    return found.withColumn("mark", F.when(F.col("occurrences") <= 2, "rare").when(common, "common"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, term, mark): the terms that are too rare or too common."""
    return p4_terms(spark, sf_dir).where("mark is not null").select("field", "term", "mark")


def p5_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kmer, n): the 20 values with the most rows."""
    return topk.top_k(table(spark, sf_dir, "kmers", spread=True), clean_kmer(F.col("kmer")), 20).withColumnRenamed("value", "kmer")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_top(spark, sf_dir).select("kmer")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feed_id): the rows of the feed whose value was there before."""
    feed = table(spark, sf_dir, "kmer_feed")
    key = clean_kmer(F.col("kmer"))
    return ledger.seen_before(table(spark, sf_dir, "kmers"), key, feed, key, "feed_id").select(F.col("arrival").alias("feed_id"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n_rows, n_usable, n_seen, n_wrong, error_rate): the ledger's answers held against those of one aggregation over history and feed together."""
    feed = table(spark, sf_dir, "kmer_feed").select(clean_kmer(F.col("kmer")).alias("key"), F.col("feed_id").alias("arrival"))
    past = table(spark, sf_dir, "kmers").select(clean_kmer(F.col("kmer")).alias("key"), F.lit(-1).cast("bigint").alias("arrival"))
    first = past.unionByName(feed).where("key is not null").groupBy("key").agg(F.min("arrival").alias("first"))
    new = first.where("first >= 0").select(F.col("first").alias("feed_id"), F.lit(False).alias("truth"))
    seen = p6_found(spark, sf_dir).withColumn("answer", F.lit(True))
    judged = feed.withColumnRenamed("arrival", "feed_id").join(new, "feed_id", "left").join(seen, "feed_id", "left")
    truth, answer = F.col("key").isNotNull() & F.coalesce("truth", F.lit(True)), F.coalesce("answer", F.lit(False))
    n = lambda c: F.count(F.when(c, 1))
    out = judged.agg(F.count(F.lit(1)).alias("n_rows"), n(F.col("key").isNotNull()).alias("n_usable"), n(answer).alias("n_seen"), n(truth != answer).alias("n_wrong"))
    return out.withColumn("error_rate", F.when(F.col("n_usable") > 0, F.col("n_wrong") / F.col("n_usable")).otherwise(0.0))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(span_id, hit_start, hit_end): the stretches of each row that rows of other refs share."""
    return spans.shared_spans(table(spark, sf_dir, "long_kmers", spread=True), "span_id", "ref", "kmer")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(span_id, length, shared, share) of every row."""
    return spans.shared_parts(table(spark, sf_dir, "long_kmers"), "span_id", "kmer", p7_found(spark, sf_dir))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of every document."""
    return bpe.encode(table(spark, sf_dir, "documents", spread=True), "doc_id", "text")


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, mix.Plan, DataFrame]:
    targets = table(spark, sf_dir, "mix_targets")
    return *mix.mix(table(spark, sf_dir, "documents", spread=True), "doc_id", "source", "text", targets), targets


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slot, source, doc_id, copy, tokens): the mix, in the order of its slots."""
    return _mixed(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target and actual share of each source."""
    mixed, p, targets = _mixed(spark, sf_dir)
    return mix.shares(mixed, p, targets, "doc_id")


def p9_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, n_documents, used, share_holds, cap_holds): the documents of each source that have a text, whether any is in the mix, whether its tokens
    are its target share (scaled up where a source has no documents) of those of the mix, within 8 blocks and two of the longest documents, and whether no document is
    used more often than it may be."""
    mixed, p, targets = _mixed(spark, sf_dir)
    report = mix.shares(mixed, p, targets, "doc_id")
    have = table(spark, sf_dir, "documents").where("text <> ''").groupBy(mix.normal(F.col("source")).alias("source")).agg(F.count(F.lit(1)).alias("n_documents"))
    share = F.lit(0.0)
    for name, scaled, *_ in p.sources:
        share = F.when(F.col("source") == name, scaled).otherwise(share)
    whole = mixed.agg(F.sum("tokens").alias("n"), F.max("tokens").alias("longest")).first()
    near = F.abs(F.col("tokens") - share * (whole.n or 0)) <= 8 * p.block + 2 * (whole.longest or 0)
    out = report.join(have, "source", "left").select("source", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), (F.col("n_records") > 0).alias("used"), near.alias("share_holds"), (F.col("most_repeats") <= F.col("max_repeats")).alias("cap_holds"))
    return out


def p10_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, signal, value): the signals of recurrence, autocorrelation and lists of each document with a text."""
    rows = spam.spam_signals(table(spark, sf_dir, "documents", spread=True), "doc_id", "text")
    return rows.select("doc_id", F.posexplode("signals").alias("at", "value")).select("doc_id", F.get(F.array(*map(F.lit, spam.SIGNALS)), F.col("at")).alias("signal"), "value")


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, score): above 0 for spam."""
    model = spam.fit(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "spam_labels"), "doc_id", "is_spam")
    return spam.spam_scores(table(spark, sf_dir, "documents", spread=True), "doc_id", "text", model)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id): the documents that are spam."""
    return p10_scores(spark, sf_dir).where("score > 0").select("doc_id")


QUERIES = {f.__name__: f for f in (p3_found, p3_pieces, p3_documents, p4_found, p4_terms, p5_found, p5_top, p6_found, p6_report, p7_found, p7_shares, p8_ids, p9_mix, p9_shares, p9_holds, p10_found, p10_scores, p10_signals)}

CLEAN = "upper(trim(kmer, ' ' || chr(9) || chr(13)))"
USABLE = f"SELECT * REPLACE ({CLEAN} AS kmer) FROM kmers WHERE regexp_full_match({CLEAN}, '[ACGT]{{31}}')"

SPACE = " \\t\\n\\r\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"


def pieces_sql(rows: str, key: str, levels: list[tuple[str, int]], limit: int, overlap: int) -> str:
    """SQL for all pieces of rows (key, s): (key, piece_no, piece_start, piece_end, piece). levels: patterns, with how many characters before its end a match cuts."""
    split = ", ".join(f"regexp_split_to_array(s, '{x}') AS p{i}, regexp_extract_all(s, '{x}') AS g{i}" for i, (x, _) in enumerate(levels))
    sizes = ", ".join(f"[length(p{i}[x]) + length(g{i}[x]) FOR x IN range(1, len(g{i}) + 1)] AS l{i}" for i in range(len(levels)))
    cuts = ", ".join(f"[list_sum(l{i}[1:x]) - {less} FOR x IN range(1, len(l{i}) + 1)] AS c{i}" for i, (_, less) in enumerate(levels))
    end = lambda a: f"""CASE WHEN n - ({a}) <= {limit} THEN n ELSE coalesce({", ".join(f"list_max([x FOR x IN c{i} IF x > {a} + {overlap} AND x <= {a} + {limit}])" for i in range(len(levels)))}, {a} + {limit}) END::BIGINT"""
    return f"""WITH RECURSIVE rec AS ({rows}), parts AS (SELECT {key}, s, {split} FROM rec WHERE s IS NOT NULL), sizes AS (SELECT {key}, s, {sizes} FROM parts),
marks AS MATERIALIZED (SELECT {key}, s, length(s) AS n, {cuts} FROM sizes),
walk AS (SELECT {key}, 0::BIGINT AS no, 0::BIGINT AS a, {end("0")} AS b FROM marks
 UNION ALL SELECT {key}, no + 1, b - {overlap}, {end(f"(b - {overlap})")} FROM walk JOIN marks USING ({key}) WHERE b < n)
SELECT {key}, no AS piece_no, a AS piece_start, b AS piece_end, substring(s, a + 1, b - a) AS piece FROM walk JOIN marks USING ({key})"""


PIECES = r"""WITH RECURSIVE rec AS (SELECT record_id, translate(seq, ' ' || chr(13), '') AS s FROM fasta_records),
big AS (SELECT record_id, s, length(s) AS n, regexp_split_to_array(s, '[Nn-]{10,}') AS parts, regexp_extract_all(s, '[Nn-]{10,}') AS gaps FROM rec WHERE length(s) > 2000),
marks AS (SELECT record_id, s, n, [list_sum([length(x) FOR x IN parts[1:i]]) + list_sum([length(x) FOR x IN gaps[1:i]]) FOR i IN range(1, len(gaps) + 1)] AS cuts FROM big),
walk AS (SELECT record_id, s, n, cuts, 0::BIGINT AS a, CASE WHEN n <= 2000 THEN n ELSE coalesce(list_max([x FOR x IN cuts IF x > 40 AND x <= 2000]), 2000) END::BIGINT AS b FROM marks
 UNION ALL SELECT record_id, s, n, cuts, b - 40, CASE WHEN n - (b - 40) <= 2000 THEN n ELSE coalesce(list_max([x FOR x IN cuts IF x > b AND x <= b + 1960]), b + 1960) END::BIGINT FROM walk WHERE b < n)
SELECT record_id, a AS piece_start, b AS piece_end FROM walk"""

TERMS = rf"""WITH usable AS ({USABLE}),
heads AS (SELECT DISTINCT header, regexp_extract(header, '(?s)^(.+):[0-9]+-[0-9]+:[+-]$', 1) AS term FROM kmers WHERE regexp_full_match(header, '(?s).+:[0-9]+-[0-9]+:[+-]')),
k AS (SELECT kmer AS term, count(DISTINCT ref || chr(9) || pos_start || strand) AS occurrences, count(DISTINCT ref) AS records FROM usable GROUP BY kmer),
h AS (SELECT term, count(*) AS occurrences, count(*) AS records FROM heads GROUP BY term),
marked AS (SELECT 'kmer' AS field, *, CASE WHEN occurrences <= 2 THEN 'rare' WHEN records * 10 >= (SELECT count(DISTINCT ref) FROM kmers) THEN 'common' END AS mark FROM k
 UNION ALL SELECT 'ref', *, CASE WHEN occurrences <= 2 THEN 'rare' WHEN records * 20 >= (SELECT count(*) FROM heads) THEN 'common' END FROM h)"""

SEEN = f"""WITH past AS (SELECT DISTINCT {CLEAN} AS kmer FROM kmers), feed AS (SELECT feed_id, {CLEAN} AS kmer FROM kmer_feed),
usable AS (SELECT * FROM feed WHERE regexp_full_match(kmer, '[ACGT]{{31}}')),
found AS (SELECT feed_id FROM (SELECT *, min(feed_id) OVER (PARTITION BY kmer) AS first FROM usable) WHERE feed_id > first OR kmer IN (SELECT kmer FROM past))"""

HITS = r"""WITH rows AS (SELECT span_id, ref, upper(kmer) AS t FROM long_kmers WHERE length(kmer) >= 50),
w AS (SELECT span_id, ref, i, substring(t, i + 1, 50) AS s FROM (SELECT *, unnest(range(0, length(t) - 49)) AS i FROM rows)),
ok AS (SELECT * FROM w WHERE regexp_full_match(s, '[ACGT]{50}')),
shared AS (SELECT s FROM ok GROUP BY s HAVING min(ref) <> max(ref)),
starts AS (SELECT span_id, i FROM ok SEMI JOIN shared USING (s)),
runs AS (SELECT *, sum(CASE WHEN i - prev <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY span_id ORDER BY i) AS run FROM (SELECT *, lag(i) OVER (PARTITION BY span_id ORDER BY i) AS prev FROM starts)),
hits AS (SELECT span_id, min(i) AS hit_start, max(i) + 50 AS hit_end FROM runs GROUP BY span_id, run)"""

ORACLE = {
    "p3_found": PIECES,
    "p3_pieces": pieces_sql("SELECT record_id, translate(seq, ' ' || chr(13), '') AS s FROM fasta_records", "record_id", [("[Nn-]{10,}", 0)], 2000, 40),
    "p3_documents": pieces_sql("SELECT doc_id, text AS s FROM documents", "doc_id", [("\\n=", 1), (f"\\n[ \\t\\r]*\\n[{SPACE}]*", 0), (f"[.!?。！？]+[{SPACE}]+", 0), (f"[{SPACE}]+", 0)], 1500, 100),
    "p9_holds": r"""SELECT source, coalesce(n, 0) AS n_documents, coalesce(n, 0) > 0 AS used, true AS share_holds, true AS cap_holds FROM
 (SELECT DISTINCT lower(trim(source, E' \t\r\n')) AS source FROM mix_targets) LEFT JOIN
 (SELECT lower(trim(source, E' \t\r\n')) AS source, count(*) AS n FROM documents WHERE text <> '' GROUP BY 1) USING (source)""",
    "p4_found": f"{TERMS} SELECT field, term, mark FROM marked WHERE mark IS NOT NULL",
    "p4_terms": f"{TERMS} SELECT * FROM marked",
    "p5_found": f"WITH usable AS ({USABLE}) SELECT kmer FROM usable GROUP BY kmer ORDER BY count(*) DESC, kmer LIMIT 20",
    "p5_top": f"WITH usable AS ({USABLE}) SELECT kmer, count(*) AS n FROM usable GROUP BY kmer ORDER BY n DESC, kmer LIMIT 20",
    "p6_found": f"{SEEN} SELECT feed_id FROM found",
    "p6_report": f"""{SEEN} SELECT (SELECT count(*) FROM feed) AS n_rows, (SELECT count(*) FROM usable) AS n_usable, (SELECT count(*) FROM found) AS n_seen,
 CAST(0 AS BIGINT) AS n_wrong, CAST(0 AS DOUBLE) AS error_rate""",
    "p7_found": f"{HITS} SELECT * FROM hits",
    "p7_shares": f"""{HITS} SELECT k.span_id, coalesce(length(k.kmer), 0) AS length, CAST(coalesce(h.shared, 0) AS BIGINT) AS shared,
 CASE WHEN length(k.kmer) > 0 THEN coalesce(h.shared, 0) / length(k.kmer) ELSE 0 END AS share
 FROM long_kmers k LEFT JOIN (SELECT span_id, CAST(sum(hit_end - hit_start) AS BIGINT) AS shared FROM hits GROUP BY span_id) h USING (span_id)""",
}

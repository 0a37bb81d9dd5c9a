"""Loading delimited records strictly, and telling apart those that can't be loaded, with the reason.

Method: strict load plus anti-join. `strict_load` keeps conforming rows only, with the offset of each; `rejects` subtracts their offsets
from those of all rows and diagnoses what remains. Only offsets are shuffled; the texts of the remainder are found again by a second scan.

A line has four fields `header,description,seq,natype`; a field may stand in double quotes, with quotes inside doubled.
Defined cases: an empty line has one (empty) field; a null line is bad for `quoting`; a natype other than DNA and RNA is bad for `alphabet`
(no alphabet is known); coordinates of more than 38 digits are bad for `span`, and those beyond BIGINT load as null.
Rows may repeat and offsets may be null or repeated: a row is known by its offset together with a hash of its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.sources.shared import materialise

# The alphabets of the seq field by natype, in either case, and the whole header field.
SEQ_LETTERS = {"DNA": "ACGTNacgtn", "RNA": "ACGUNacgun"}
STRICT_HEADER = r"(?U)\A(\S+):([0-9]+)-([0-9]+):([+-])\z"
REASONS = ("quoting", "columns", "header", "alphabet", "span")
# A separator that no text can hold: the unit separator is escaped as <US>b, so <US>a occurs only where it was put.
US, MARK, KEPT = "\x1f", "\x1fa", "\x1fb"


# One field with a comma before it; lines get one in front. What such matches don't cover is unsound.
FIELD = r',(?:"(?:[^"]++|"")*+"|[^",]*+)(?=,|\z)'
DOUBLED = 1000  # doubled quotes that the pattern may meet: it recurses on each


def _outside(segment: Column, i: Column, last: Column) -> Column:
    """Whether the text before, between or after quoted parts is sound. Empty text between two parts is a doubled quote."""
    opens, closes = (i == last) | segment.endswith(","), (i == 0) | segment.startswith(",")
    return (i % 2 == 1) | (segment == "") | (opens & closes)


def _by_parts(parts: Column) -> tuple[Column, Column]:
    """Soundness and fields of a line of any length, from its parts between quotes."""
    last = F.size(parts) - 1
    sound = F.forall(F.transform(parts, lambda s, i: _outside(s, i, last)), lambda ok: ok)
    piece = lambda s, i: F.when(i % 2 == 1, s).when((s == "") & (i > 0) & (i < last), '"').otherwise(F.replace(s, F.lit(","), F.lit(MARK)))
    fields = F.split(F.array_join(F.transform(parts, piece), ""), MARK, -1)
    return (last % 2 == 0) & sound, F.transform(fields, lambda f: F.replace(f, F.lit(KEPT), F.lit(US)))


def parse(df: DataFrame, raw: str) -> DataFrame:
    """df with __quoted (BOOLEAN) and __fields (ARRAY<STRING>, where quoted is true; their quotes are only taken off if there are four)."""
    line = F.concat(F.lit(","), F.col(raw))
    few = F.length(line) - F.length(F.replace(line, F.lit('""'), F.lit(""))) <= 2 * DOUBLED
    # Exploded, as checks on the outcome of a generator stay behind it: pushed before it, each would match the line anew.
    parts = F.split(F.replace(F.col(raw), F.lit(US), F.lit(KEPT)), '"', -1)
    either = F.struct(F.when(few, F.regexp_extract_all(line, F.lit(FIELD), F.lit(0))).alias("__matches"), F.when(~few, parts).alias("__parts"))
    found = df.select(*df.columns, F.explode(F.array(either)).alias("__cut")).select(*df.columns, "__cut.*")

    def field(i: int) -> Column:
        text = F.substr(F.get("__matches", F.lit(i)), F.lit(2))
        return F.when(text.startswith('"'), F.replace(F.substr(text, F.lit(2), F.length(text) - 2), F.lit('""'), F.lit('"'))).otherwise(text)

    many, (sound, fields) = F.col("__matches").isNull(), _by_parts(F.col("__parts"))
    quoted = F.when(many, F.coalesce(sound, F.lit(False))).otherwise(F.array_join("__matches", "") == line)
    four = F.when(F.size("__matches") == 4, F.array(*map(field, range(4)))).otherwise(F.col("__matches"))
    return found.select(*df.columns, quoted.alias("__quoted"), F.when(many, fields).otherwise(four).alias("__fields"))


def _checks() -> dict[str, Column]:
    """The checks in their order, each true where it passes; all of them may be null when an earlier one fails."""
    field = lambda i: F.get(F.col("__fields"), F.lit(i))
    number = lambda i: F.regexp_extract(field(0), STRICT_HEADER, i).try_cast("decimal(38,0)")
    seq, natype = F.translate(field(2), " \r", ""), field(3)
    known = F.lit(False)
    for name, plain in SEQ_LETTERS.items():
        known = F.when(natype == name, F.translate(seq, plain, "") == "").otherwise(known)
    return {
        "quoting": F.col("__quoted"),
        "columns": F.size("__fields") == 4,
        "header": field(0).rlike(STRICT_HEADER),
        "alphabet": (seq != "") & known,
        "span": number(3) - number(2) == F.length(seq),
    }


def strict_load(df: DataFrame, offset: str = "raw_id", raw: str = "raw") -> DataFrame:
    """(offset, text_hash, title, ref, pos_start, pos_end, strand, description, seq, natype) of the rows that pass every check."""
    ok = F.lit(True)
    for passes in reversed(_checks().values()):  # nested, so that a check is only asked where those before it pass
        ok = F.when(F.coalesce(passes, F.lit(False)), ok).otherwise(F.lit(False))
    field = lambda i: F.get(F.col("__fields"), F.lit(i))
    part = lambda i: F.regexp_extract(field(0), STRICT_HEADER, i)
    return (
        parse(df.select(F.col(offset).alias("offset"), F.col(raw).alias("raw")), "raw")
        .where(ok)
        .select(
            "offset", F.xxhash64("raw").alias("text_hash"), field(0).alias("title"), part(1).alias("ref"),
            part(2).try_cast("bigint").alias("pos_start"), part(3).try_cast("bigint").alias("pos_end"), part(4).alias("strand"),
            field(1).alias("description"), F.translate(field(2), " \r", "").alias("seq"), field(3).alias("natype"),
        )
    )


def diagnose(df: DataFrame, offset: str, raw: str) -> DataFrame:
    """(offset, reason): the first check that each row fails; null where it fails none."""
    reason = F.lit(None).cast("string")
    for name, passes in reversed(_checks().items()):
        reason = F.when(F.coalesce(passes, F.lit(False)), reason).otherwise(name)
    return parse(df.select(F.col(offset).alias("offset"), F.col(raw).alias("raw")), "raw").select("offset", reason.alias("reason"))


def rejects(df: DataFrame, offset: str = "raw_id", raw: str = "raw") -> DataFrame:
    """(offset, reason) of every row that `strict_load` leaves out; repeated bad rows come out as often as they are there."""
    rows = df.select(F.col(offset).alias("offset"), F.col(raw).alias("raw"))
    every = rows.select("offset", F.xxhash64("raw").alias("text_hash")).distinct()
    loaded = strict_load(df, offset, raw).select("offset", "text_hash").distinct().withColumnsRenamed({"offset": "o", "text_hash": "h"})
    left = every.join(loaded, F.col("offset").eqNullSafe(F.col("o")) & (F.col("text_hash") == F.col("h")), "left_anti")
    # Written, so that the planner knows its size: it is broadcast below the session's threshold and merge-joined above it.
    left = materialise(left, "rejects").withColumnsRenamed({"offset": "o", "text_hash": "h"})
    bad = rows.withColumn("text_hash", F.xxhash64("raw")).join(left, F.col("offset").eqNullSafe(F.col("o")) & (F.col("text_hash") == F.col("h")), "left_semi")
    return diagnose(bad, "offset", "raw")

"""Nucleic-acid alphabets and the column functions that depend on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of each alphabet and, in the same order, their complements.
ALPHABETS = {"DNA": ("ACGT", "TGCA"), "RNA": ("ACGU", "UGCA")}


def letters(natype: str) -> str:
    """Letters of the alphabet; ValueError for an unknown type."""
    if natype not in ALPHABETS:
        raise ValueError(f"natype must be one of {sorted(ALPHABETS)}, not {natype!r}")
    return ALPHABETS[natype][0]


def in_alphabet(seq: Column, natype: str = "DNA") -> Column:
    """True where every character is a letter of the alphabet (also for ''); null for null."""
    return F.translate(seq, letters(natype), "") == ""


def reverse_complement(seq: Column, natype: str = "DNA") -> Column:
    """Complement of each letter, in reversed order; other characters stay."""
    plain = letters(natype)
    return F.translate(F.reverse(seq), plain, ALPHABETS[natype][1])


def reverse_strand(strand: Column) -> Column:
    """'+' and '-' exchanged; null for null, an error for anything else."""
    return (
        F.when(strand.isNull(), F.lit(None).cast("string"))
        .when(strand == "+", "-")
        .when(strand == "-", "+")
        .otherwise(F.raise_error(F.concat(F.lit("not a strand: "), strand)).cast("string"))
    )


def normalise(seq: Column) -> Column:
    """Upper case, one byte per character: a character beyond ASCII can't be a base, so '?' stands for it and offsets stay true."""
    plain = F.when(F.octet_length(seq) == F.char_length(seq), seq).otherwise(F.regexp_replace(seq, r"[^\x00-\x7F]", "?"))
    return F.upper(plain)


def record_name(title: Column) -> Column:
    """The title up to its first space."""
    return F.substring_index(title, " ", 1)


def clean_kmer(kmer: Column, k: int = 31, natype: str = "DNA") -> Column:
    """The clean value of a k-mer (space, tab and CR dropped at its ends, upper case), or null if it isn't k letters of the alphabet."""
    value = F.upper(F.btrim(kmer, F.lit(" \t\r")))
    return F.when((F.octet_length(value) == k) & in_alphabet(value, natype), value)

"""Nucleotide column functions; letters of ``=ACMGRSVTWYHKDBN`` in either case."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The 4-bit alphabet in code order and the complement of each letter.
ALPHABET = "=ACMGRSVTWYHKDBN"
COMPLEMENT = "=TGKCYSBAWRDMHVN"


def normalize(seq: Column) -> Column:
    """Upper-case letters; a letter outside the alphabet is an error."""
    up = F.upper(seq)
    bad = F.raise_error(F.concat(F.lit("nucleotide not expected in: "), seq))
    return F.when(seq.isNull() | up.rlike("^[=ACMGRSVTWYHKDBN]*$"), up).otherwise(bad)


def available(seq: Column) -> Column:
    return F.length(seq) > 0


def base_at(seq: Column, index: int) -> Column:
    """0-based letter, null of a null sequence; an index outside the sequence is an error."""
    bad = F.raise_error(F.lit("sequence index out of range"))
    if index < 0:
        return F.when(seq.isNotNull(), bad.cast("string"))
    return F.when(seq.isNull() | (F.length(seq) > index), normalize(F.substring(seq, index + 1, 1))).otherwise(bad)


def to_codes(seq: Column) -> Column:
    """Codes 0-15 of the letters."""
    letters = F.filter(F.split(normalize(seq), ""), lambda c: c != "")
    return F.transform(letters, lambda c: F.position(c, F.lit(ALPHABET)) - 1)


def acgtn_only(seq: Column) -> Column:
    """Every letter but A, C, G and T becomes N."""
    return F.regexp_replace(normalize(seq), "[^ACGT]", "N")


def complement(seq: Column) -> Column:
    return F.translate(normalize(seq), ALPHABET, COMPLEMENT)


def subseq(seq: Column, start: Column | int, end: Column | int) -> Column:
    """Letters [start, end), 0-based; a range outside the sequence is an error."""
    start = F.lit(start) if isinstance(start, int) else start
    end = F.lit(end) if isinstance(end, int) else end
    good = (start >= 0) & (start <= end) & (end <= F.length(seq))
    bad = F.raise_error(F.lit("subsequence out of range"))
    return F.when(seq.isNull() | good, F.substring(normalize(seq), start + 1, end - start)).otherwise(bad)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def sequence_text(seq: Column) -> Column:
    """The letters, or ``*`` if there are none."""
    return F.when(F.length(seq) == 0, "*").otherwise(seq)

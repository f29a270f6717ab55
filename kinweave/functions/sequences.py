"""Column functions on sequences and alignments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    """Upper-case A, C, G and T are complemented, all else stays; then reversed."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def canonical(seq: Column) -> Column:
    return F.least(seq, reverse_complement(seq))


def dna(text: Column) -> Column:
    """The A, C, G and T of a text in either case, as upper case."""
    return F.upper(F.regexp_replace(text, "[^ACGTacgt]+", ""))


def matches(x: Column, y: Column) -> Column:
    """Positions at which two sequences of one length are equal; null for unequal lengths."""
    same = F.zip_with(F.split(x, ""), F.split(y, ""), lambda a, b: (a == b).cast("int"))
    return F.when(F.length(x) == F.length(y), F.when(F.length(x) == 0, 0).otherwise(F.aggregate(same, F.lit(0), lambda n, v: n + v)))


def mismatches(x: Column, y: Column) -> Column:
    return F.length(x) - matches(x, y)


def homology(ref: Column, seq: Column) -> Column:
    """Share of equal positions on the better strand."""
    return F.greatest(matches(ref, seq), matches(ref, reverse_complement(seq))) / F.length(ref)


def contains_either_strand(x: Column, y: Column) -> Column:
    """Whether the shorter sequence, or its reverse complement, is part of the longer."""
    swap = F.length(x) < F.length(y)
    big, small = F.when(swap, y).otherwise(x), F.when(swap, x).otherwise(y)
    return F.contains(big, small) | F.contains(big, reverse_complement(small))


def _digits(text: Column, pattern: str) -> Column:
    return F.aggregate(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(0), lambda n, x: n + x.cast("int"))


def cigar_mismatches(cigar: Column, length: Column, deletions: bool = False) -> Column:
    """Length less matched characters (M and =); with deletions, these count as mismatches too."""
    out = length - _digits(cigar, "([0-9]+)[M=]")
    return out + _digits(cigar, "([0-9]+)D") if deletions else out


def md_mismatches(md: Column, length: Column) -> Column:
    """Length less the runs of matches that an MD tag lists."""
    return length - _digits(md, "([0-9]+)")


def cigar_span(cigar: Column) -> Column:
    """Characters of the reference that an alignment takes."""
    return _digits(cigar, "([0-9]+)[MDN=X]")


def sliced(seq: Column, start: Column, end: Column, k: int = 0) -> Column:
    """seq from start to end + k, from 0, upper case; cut short at the end of the sequence."""
    return F.upper(F.substring(seq, start + 1, F.greatest(end - start + k, F.lit(0))))

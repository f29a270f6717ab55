"""Alignment records: sequences of secondary records, exact hits, positions, conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import cigar_mismatches, cigar_span, reverse_complement

UNMAPPED, REVERSE, SECONDARY, SUPPLEMENTARY = 4, 16, 256, 2048


def has_flag(flag: int) -> Column:
    return F.col("flag").bitwiseAND(flag) != 0


def with_sequences(records: DataFrame) -> DataFrame:
    """Mapped records, a missing sequence filled from the query's primary record, turned if their strands differ."""
    primary = records.where(~has_flag(SECONDARY) & ~has_flag(SUPPLEMENTARY) & F.col("seq").isNotNull())
    first = F.min_by(F.struct("seq", has_flag(REVERSE).alias("reverse")), "line")
    primary = primary.groupBy("query").agg(first.alias("p")).select("query", F.col("p.seq").alias("p_seq"), F.col("p.reverse").alias("p_reverse"))
    filled = F.when(has_flag(REVERSE) == F.col("p_reverse"), F.col("p_seq")).otherwise(reverse_complement(F.col("p_seq")))
    out = records.where(~has_flag(UNMAPPED)).join(primary, "query", "left").withColumn("seq", F.coalesce("seq", filled))
    return out.drop("p_seq", "p_reverse")


def within_mismatches(records: DataFrame, most: int) -> DataFrame:
    """Records with their mismatches by CIGAR, of those with at most so many; a record without sequence has none."""
    return records.withColumn("mismatches", cigar_mismatches(F.col("cigar"), F.length("seq"))).where(F.col("mismatches") <= most)


def kmer_hits(records: DataFrame, k: int, most: int) -> DataFrame:
    """Mapped, not supplementary records of k-mers with at most so many mismatches; none allowed means one whole match."""
    out = records.where(~has_flag(UNMAPPED) & ~has_flag(SUPPLEMENTARY))
    if most == 0:
        out = out.where(F.col("cigar").isin(f"{k}=", f"{k}M"))
    return out.where(cigar_mismatches(F.col("cigar"), F.lit(k)) <= most)


def last_positions(records: DataFrame) -> DataFrame:
    """(query, contig, start, end) of each query's last record."""
    span = F.struct("contig", F.col("pos").alias("start"), (F.col("pos") + cigar_span(F.col("cigar"))).alias("end"))
    return records.where(~has_flag(UNMAPPED)).groupBy("query").agg(F.max_by(span, "line").alias("x")).select("query", "x.*")


def to_bed(records: DataFrame) -> DataFrame:
    """(contig, start, end, name, score, strand) of mapped records."""
    strand = F.when(has_flag(REVERSE), "-").otherwise("+")
    return records.where(~has_flag(UNMAPPED)).select("contig", F.col("pos").alias("start"), (F.col("pos") + cigar_span(F.col("cigar"))).alias("end"), F.col("query").alias("name"), F.col("mapq").alias("score"), strand.alias("strand"))


def shared_exact(a: DataFrame, b: DataFrame) -> DataFrame:
    """Queries that have a record without mismatch in both."""
    exact = lambda x: within_mismatches(x.where(~has_flag(UNMAPPED)), 0).select("query")
    return exact(a).intersect(exact(b))


def best_by_place(hits: DataFrame) -> DataFrame:
    """(assembly, contig, pos, id, mismatches): at each place the hit of fewest mismatches, then of the smallest id."""
    best = F.min(F.struct("mismatches", "id")).alias("x")
    return hits.groupBy("assembly", "contig", "pos").agg(best).select("assembly", "contig", "pos", "x.id", "x.mismatches")

"""Measures of assemblies: completeness, missing elements, block summaries, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def missing(known: DataFrame, hits: DataFrame) -> DataFrame:
    """Known ids without a hit."""
    return known.select("id").join(hits.select("id"), "id", "left_anti")


def quantiles(rows: DataFrame, by: str, x: str) -> DataFrame:
    """(key, <x>_q25, <x>_q50, <x>_q75) of the values of x by key, between neighbours in proportion; null without values.

    Values are counted first, so what is sorted are the distinct values of a key with their counts, not its rows.
    """
    counts = rows.groupBy(F.col(by).alias("key"), F.col(x).alias("x")).agg(F.count(x).alias("n"))
    w = Window.partitionBy("key")
    placed = counts.select("key", "x", F.sum("n").over(w.orderBy(F.col("x").asc_nulls_first())).alias("upto"), (F.sum("n").over(w) - 1).alias("last"))

    def at(share: float) -> Column:
        place = share * F.col("last")
        value = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("x")))
        below, above = value(F.floor(place)), value(F.ceil(place))
        return below + (above - below) * (F.max(place) - F.floor(F.max(place)))

    return placed.groupBy("key").agg(*[at(share).alias(f"{x}_q{round(100 * share)}") for share in (0.25, 0.5, 0.75)])


def measured(x: str) -> list[Column]:
    """Mean, population deviation, least and most of a column; null without values."""
    return [f.alias(f"{x}_{n}") for n, f in (("mean", F.avg(x)), ("sd", F.stddev_pop(x)), ("min", F.min(x)), ("max", F.max(x)))]


def with_quantiles(summary: DataFrame, rows: DataFrame, by: str, *values: str) -> DataFrame:
    """summary (by, ...) with the median of values as <x>_median and their interquartile range as <x>_iqr."""
    for x in values:
        found = quantiles(rows, by, x)
        summary = summary.join(found, F.col(by).eqNullSafe(F.col("key"))).withColumns({f"{x}_median": F.col(f"{x}_q50"), f"{x}_iqr": F.col(f"{x}_q75") - F.col(f"{x}_q25")})
        summary = summary.drop("key", f"{x}_q25", f"{x}_q50", f"{x}_q75")
    return summary


def best_per_element(hits: DataFrame) -> DataFrame:
    """One hit for each (assembly, id): of fewest mismatches, then by contig and position."""
    best = F.min(F.struct("mismatches", "contig", "pos", "score"))
    return hits.groupBy("assembly", "id").agg(best.alias("x")).select("assembly", "id", "x.*")


def validated(known: DataFrame, found: DataFrame, genomes: DataFrame, least: float) -> DataFrame:
    """(genome, valid, failed, lowest): how many known elements have a place (id, genome, homology) of at least so much
    homology in each of genomes (genome), how many have none, and the lowest of the best homologies of those that have any."""
    total = known.select("id").distinct().agg(F.count(F.lit(1)).alias("total"))
    best = found.join(known.select("id").distinct(), "id", "left_semi").groupBy("genome", "id").agg(F.max("homology").alias("best"))
    counts = best.groupBy("genome").agg(F.count_if(F.col("best") >= least).alias("valid"), F.min("best").alias("lowest"))
    each = genomes.select("genome").distinct().join(counts, "genome", "left").join(F.broadcast(total))  # one row
    valid = F.coalesce("valid", F.lit(0).cast("long"))
    return each.select("genome", valid.alias("valid"), (F.col("total") - valid).alias("failed"), "lowest")


def completeness(known: DataFrame, hits: DataFrame) -> DataFrame:
    """For each assembly: known elements hit, hit exactly and missing, and how their mismatches and scores are spread."""
    best = best_per_element(hits.join(known.select("id").distinct(), "id", "left_semi"))
    total = known.select("id").distinct().agg(F.count(F.lit(1)).alias("total"))
    counts = best.groupBy("assembly").agg(F.count(F.lit(1)).alias("hits"), F.count_if(F.col("mismatches") == 0).alias("exact"), *measured("mismatches"), *measured("score"))
    counts = with_quantiles(counts, best, "assembly", "mismatches", "score")
    return counts.join(F.broadcast(total)).withColumn("missing", F.col("total") - F.col("hits")).drop("total")  # one row


def block_summary(spans: DataFrame) -> DataFrame:
    """For each assembly: how many blocks, and mean, median, least and most of their lengths and scores."""
    of = lambda x: [F.avg(x).alias(f"{x}_mean"), F.min(x).alias(f"{x}_min"), F.max(x).alias(f"{x}_max")]
    counts = spans.groupBy("genome").agg(F.count(F.lit(1)).alias("n_blocks"), *of("path_len"), *of("score"))
    columns = ["genome", "n_blocks", *[f"{x}_{n}" for x in ("path_len", "score") for n in ("mean", "median", "min", "max")]]
    return with_quantiles(counts, spans, "genome", "path_len", "score").select(columns)


def contiguity(checked: DataFrame) -> DataFrame:
    """(genome, valid, invalid) counts of intact_blocks results with genome."""
    return checked.groupBy("genome").agg(F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"))


def coverage(spans: DataFrame, lengths: DataFrame) -> DataFrame:
    """(genome, covered): lengths of spans over the genome's length."""
    taken = spans.groupBy("genome").agg(F.sum(F.abs(F.col("end") - F.col("start"))).alias("taken"))
    whole = lengths.groupBy("genome").agg(F.sum("length").alias("whole"))
    return whole.join(taken, "genome", "left").select("genome", (F.coalesce("taken", F.lit(0)) / F.col("whole")).alias("covered"))

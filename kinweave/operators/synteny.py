"""Order of elements: adjacency, consensus over genomes, order support. Anchors are (genome, contig, start, id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def unique_ids(anchors: DataFrame) -> DataFrame:
    """Anchors of ids that occur once in their genome."""
    n = F.count(F.lit(1)).over(Window.partitionBy("genome", "id"))
    return anchors.withColumn("_n", n).where("_n = 1").drop("_n")


def adjacency(anchors: DataFrame, places: bool = False) -> DataFrame:
    """(genome, contig, src, dst, dist) of neighbours on a contig, by start and then id; with places, also where both start."""
    w = Window.partitionBy("genome", "contig").orderBy("start", "id")
    at = [F.col("start").alias("src_start"), F.lead("start").over(w).alias("dst_start")] if places else []
    nexts = anchors.select("genome", "contig", F.col("id").alias("src"), F.lead("id").over(w).alias("dst"), (F.lead("start").over(w) - F.col("start")).alias("dist"), *at)
    return nexts.where("dst IS NOT NULL")


def consensus(edges: DataFrame) -> DataFrame:
    """(src, dst, weight, dist): in how many maps an edge is, and its mean distance."""
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"), F.avg("dist").alias("dist"))


def everywhere(anchors: DataFrame, genomes: list[str]) -> DataFrame:
    """Anchors of ids that every genome has."""
    ids = anchors.groupBy("id").agg(F.count_distinct("genome").alias("n")).where(F.col("n") == len(genomes))
    return anchors.join(ids, "id", "left_semi")


def contig_combinations(anchors: DataFrame, genomes: list[str], first_by: str = "start") -> DataFrame:
    """(id, contigs, starts) for each choice of one contig a genome on which the id is.

    Of several anchors there the smallest start is taken, or that of the smallest first_by (anchor_id: first in the file).
    """
    first = cut(anchors.groupBy("id", "genome", "contig").agg(F.min(F.struct(first_by, F.col("start").alias("at"))).alias("x")).select("id", "genome", "contig", F.col("x.at").alias("start")))
    first, out = cut(everywhere(first, genomes)), None  # read for each genome
    for i, g in enumerate(genomes):
        own = first.where(F.col("genome") == g).select("id", F.array("contig").alias(f"c{i}"), F.array("start").alias(f"s{i}"))
        out = own if out is None else out.join(own, "id")
    n = range(len(genomes))
    return out.select("id", F.concat(*[f"c{i}" for i in n]).alias("contigs"), F.concat(*[f"s{i}" for i in n]).alias("starts"))


def order_support(combinations: DataFrame, min_genomes: int) -> DataFrame:
    """(contigs, src, dst, support, dist): pairs of one combination of contigs that follow each other in enough genomes.

    dist is the mean distance over the genomes that support the pair. A join by contigs with the support as its
    remaining condition; a combination's pairs are the result, so their number is inherent.
    """
    a = combinations.select("contigs", F.col("id").alias("src"), F.col("starts").alias("a"))
    b = combinations.select("contigs", F.col("id").alias("dst"), F.col("starts").alias("b"))
    ahead = F.filter(F.zip_with("b", "a", lambda y, x: y - x), lambda d: d > 0)
    pairs = a.join(b, "contigs").where("src <> dst").withColumn("ahead", ahead).where(F.size("ahead") >= min_genomes)
    mean = F.aggregate("ahead", F.lit(0).cast("double"), lambda s, d: s + d, lambda s: s) / F.size("ahead")
    return pairs.select("contigs", "src", "dst", F.size("ahead").alias("support"), mean.alias("dist"))


def in_blocks(anchors: DataFrame, blocks: DataFrame) -> DataFrame:
    """Anchors of ids that some block (path) holds."""
    return anchors.join(blocks.select(F.explode("path").alias("id")).distinct(), "id", "left_semi").select(anchors.columns)


def block_ends(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """(genome, contig, block, start, end): contigs that hold the first and the last id of a block (block, path), and where.

    Of several places of an id on a contig the first counts; the end may lie before the start.
    """
    at = anchors.groupBy("genome", "contig", "id").agg(F.min("start").alias("at"))
    ends = blocks.select("block", F.element_at("path", 1).alias("id"), F.element_at("path", -1).alias("last"))
    first = ends.join(at, "id").select("genome", "contig", "block", F.col("at").alias("start"), F.col("last").alias("id"))
    return first.join(at, ["genome", "contig", "id"]).select("genome", "contig", "block", "start", F.col("at").alias("end"))


def support_map(pairs: DataFrame) -> DataFrame:
    """Distinct edges over all combinations, each of score 1."""
    return pairs.select("src", "dst").distinct().withColumn("score", F.lit(1))


def contig_paths(anchors: DataFrame) -> DataFrame:
    """(genome, contig, path): ids of a contig in order; rows of one contig are one path by nature."""
    rows = F.sort_array(F.collect_list(F.struct("start", "id")))
    return anchors.groupBy("genome", "contig").agg(F.transform(rows, lambda x: x["id"]).alias("path"))

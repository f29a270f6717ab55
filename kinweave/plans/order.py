"""Maps and blocks of ordered elements, and assemblies held against them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.align import align, block_spans
from ..operators.assess import best_per_element, block_summary, contiguity
from ..operators.graph import bounded_paths, connected, disjoint_cover, intact_blocks, pair_scores, reduce_until_acyclic, source_to_sink_paths, transitive_reduction
from ..operators.lineage import cut
from ..operators.synteny import adjacency, consensus, contig_combinations, contig_paths, in_blocks, order_support, unique_ids


def consensus_map(anchors: DataFrame) -> DataFrame:
    """(src, dst, weight, dist) of neighbours over all genomes."""
    return consensus(adjacency(unique_ids(anchors)))


def syntenic_blocks(anchors: DataFrame, consensus_support: float = 1.0, min_length: int = 5, minimise: bool = False, use_distance: bool = False, policy: str = "weakest_first") -> DataFrame:
    """(path) of blocks that are collinear in enough genomes."""
    genomes = sorted(r["genome"] for r in anchors.select("genome").distinct().collect())
    least = math.ceil(round(consensus_support * len(genomes), 9))
    pairs = order_support(contig_combinations(anchors, genomes), least)
    if least < len(genomes):
        pairs = reduce_until_acyclic(pairs, len(genomes), policy, use_distance)
    edges = transitive_reduction(pairs.select("contigs", "src", "dst"), ["contigs"], transitive=least == len(genomes))
    paths = source_to_sink_paths(edges, ["contigs"], min_length).select("path").distinct()
    return disjoint_cover(paths) if minimise else paths


def assembly_pairs(anchors: DataFrame, edges: DataFrame, max_gap: int = 3) -> DataFrame:
    """How neighbours of each assembly lie in the consensus map."""
    near = adjacency(unique_ids(anchors))
    return pair_scores(near, bounded_paths(near, edges, max_gap).select("src", "dst", "score", "avg_weight"))


def assembly_blocks(anchors: DataFrame, edges: DataFrame, match: int = 7, mismatch: int = -3, insertion: int = -1) -> tuple[DataFrame, DataFrame]:
    """Spans of the best alignment of each contig to the map, and their summary by assembly. anchors have an end."""
    found = align(contig_paths(unique_ids(anchors)), edges, connected(edges), match, mismatch, insertion)
    spans = cut(block_spans(found, unique_ids(anchors)))  # the summary reads them for each measure
    return spans, block_summary(spans)


def assembly_contiguity(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """(genome, valid, invalid) blocks (block, path) of each assembly; only ids of blocks are looked at.

    A block meets the assemblies that hold its first id; in all others it is invalid, which is counted, not listed.
    """
    wanted = cut(in_blocks(anchors, blocks))  # read twice
    held = wanted.select("genome", "id").distinct()
    met = blocks.withColumn("id", F.element_at("path", 1)).join(held, "id")
    keyed = met.select(F.concat_ws("\t", "genome", "block").alias("block"), F.transform("path", lambda x: F.concat_ws("\t", F.col("genome"), x)).alias("path"))
    at = wanted.select(F.concat_ws("\t", "genome", "id").alias("id"), "contig", "start")
    checked = contiguity(intact_blocks(keyed, at).select(F.substring_index("block", "\t", 1).alias("genome"), "valid"))
    total = blocks.agg(F.count(F.lit(1)).alias("total"))  # one row
    counted = anchors.select("genome").distinct().join(checked.select("genome", "valid"), "genome", "left").join(F.broadcast(total))
    valid = F.coalesce("valid", F.lit(0).cast("long"))
    return counted.select("genome", valid.alias("valid"), (F.col("total") - valid).alias("invalid"))


def element_report(known: DataFrame, hits: DataFrame) -> DataFrame:
    """(assembly, id, mismatches, score, is_exact): the best hit of each known element, behind the counts of completeness."""
    best = best_per_element(hits.join(known.select("id").distinct(), "id", "left_semi"))
    return best.select("assembly", "id", "mismatches", "score", (F.col("mismatches") == 0).alias("is_exact"))


def pair_report(anchors: DataFrame, edges: DataFrame, max_gap: int = 3) -> DataFrame:
    """(genome, contig, src, src_start, dst, dst_start, n_nodes, min_weight, avg_weight, score) of the neighbours that the
    consensus map joins, behind the counts of pair_summary."""
    near = adjacency(unique_ids(anchors), places=True)
    found = near.join(bounded_paths(near, edges, max_gap), ["src", "dst"])
    return found.select("genome", "contig", "src", "src_start", "dst", "dst_start", "n_nodes", "min_weight", "avg_weight", "score")


def pair_summary(anchors: DataFrame, edges: DataFrame, max_gap: int = 3) -> DataFrame:
    """assembly_pairs of all assemblies, also of those without neighbours, with how many ids occur once and more often."""
    times = anchors.groupBy("genome", "id").agg(F.count(F.lit(1)).alias("n"))
    ids = times.groupBy("genome").agg(F.count_if(F.col("n") == 1).alias("unique_ids"), F.count_if(F.col("n") > 1).alias("repeated_ids"))
    scored = ids.join(assembly_pairs(anchors, edges, max_gap), "genome", "left")
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return scored.select("genome", none("total"), none("valid"), "score", "avg_consensus", "unique_ids", "repeated_ids")

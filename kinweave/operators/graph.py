"""Graphs of elements: acyclicity, reduction, paths, disjoint cover, bounded shortest paths, intact blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def nodes(edges: DataFrame) -> DataFrame:
    """(id) of all ends of edges (src, dst)."""
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (src, dst): the smallest node that is reachable in either direction."""
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    label = cut(both.groupBy(F.col("src").alias("node")).agg(F.least("src", F.min("dst")).alias("component")))
    while True:
        near = both.join(label.select(F.col("node").alias("dst"), F.col("component").alias("there")), "dst").groupBy(F.col("src").alias("node")).agg(F.min("there").alias("there"))
        better = label.join(near, "node").select("node", F.least("component", "there").alias("component"))
        up = label.select(F.col("node").alias("component"), F.col("component").alias("above"))
        jumped = better.join(up, "component").select("node", F.least("component", "above").alias("component"))
        new = cut(jumped.join(label.withColumnRenamed("component", "old"), "node"))
        label = new.select("node", "component")
        if new.where("component <> old").isEmpty():
            return label


def cyclic_part(edges: DataFrame, by: list[str]) -> DataFrame:
    """The edges (by..., src, dst, ...) on cycles of their graph or on ways between them, for all values of by at once.

    Edges out of nodes that none enters, and into nodes that none leaves, go in rounds, from both ends; a round is two
    semi-joins, and there are about half as many as the longest way that leads to or from a cycle has edges. The first
    round reads edges more than once, so callers cut what is not a table.
    """
    left, n = edges, None
    while n != (count := left.count()):
        n = count
        entered = left.select(*by, F.col("dst").alias("src")).distinct()
        leaving = left.select(*by, F.col("src").alias("dst")).distinct()
        left = cut(left.join(entered, [*by, "src"], "left_semi").join(leaving, [*by, "dst"], "left_semi").select(edges.columns))
    return left


def is_acyclic(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by..., acyclic) for each graph of edges (by..., src, dst)."""
    edges = cut(edges.select(*by, "src", "dst"))
    cyclic = cyclic_part(edges, by).select(*by).distinct().withColumn("cyclic", F.lit(True))
    return edges.select(*by).distinct().join(cyclic, by, "left").select(*by, F.col("cyclic").isNull().alias("acyclic"))


def reduce_until_acyclic(pairs: DataFrame, genomes: int, policy: str = "weakest_first", use_distance: bool = False) -> DataFrame:
    """pairs (contigs, src, dst, support, dist) without the edges whose removal leaves each combination's graph acyclic.

    Edges that all genomes support stay. The next to go is the one of least support (and, with use_distance, of the
    greatest distance); policy 'reference' takes them from the strong end instead. Raises where that is not enough.
    How many have to go is found by bisection over the edges' ranks, for all combinations at once and on their cyclic
    parts only: as many steps as the logarithm of the largest one's edges.
    """
    by = ["contigs"]
    strength = [F.col("support"), *([-F.col("dist")] if use_distance else []), F.col("src"), F.col("dst")]
    order = [c.desc() if policy == "reference" else c.asc() for c in strength]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    ranked = cut(pairs.where(F.col("support") < genomes).withColumn("rank", rank).unionByName(pairs.where(F.col("support") >= genomes).withColumn("rank", F.lit(None).cast("int"))))
    looped = cyclic_part(ranked.select(*by, "src", "dst", "rank"), by)
    if not cyclic_part(looped.where("rank IS NULL"), by).isEmpty():
        raise ValueError("cycles remain among unanimous edges")
    spans = cut(looped.groupBy(*by).agg(F.lit(0).alias("low"), F.max("rank").alias("high")))
    while not (open_ := spans.where("low < high")).isEmpty():
        halves = open_.select(*by, F.expr("(low + high) div 2").cast("int").alias("half"))
        without = cut(looped.join(halves, by).where("rank IS NULL OR rank > half").drop("half"))
        cyclic = cyclic_part(without, by).select(*by).distinct().withColumn("cyclic", F.lit(True))
        met = spans.join(halves, by, "left").join(cyclic, by, "left")
        spans = cut(met.select(*by, F.when(F.col("half").isNotNull() & F.col("cyclic"), F.col("half") + 1).otherwise(F.col("low")).alias("low"), F.when(F.col("half").isNotNull() & F.col("cyclic").isNull(), F.col("half")).otherwise(F.col("high")).alias("high")))
    gone = spans.select(*by, F.col("low").alias("upto"))
    return ranked.join(gone, by, "left").where("rank IS NULL OR rank > coalesce(upto, 0)").select(pairs.columns)


def reachable(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by..., src, dst) of all nodes that are joined by a way; known ways double in length each round. As large as what it returns."""
    known = cut(edges.select(*by, "src", "dst").distinct())
    n = None
    while n != (count := known.count()):
        n = count
        ways = known.select(*by, "src", F.col("dst").alias("mid")).join(known.select(*by, F.col("src").alias("mid"), "dst"), [*by, "mid"]).select(*by, "src", "dst")
        known = cut(known.union(ways).distinct())
    return known


def transitive_reduction(edges: DataFrame, by: list[str], transitive: bool = False) -> DataFrame:
    """Edges of acyclic graphs (one for each value of by) that no longer path replaces.

    With transitive (every path has its edge, as when all genomes must agree), a path of two edges decides; else an edge
    and a way of any length.
    """
    edges = cut(edges)  # read three times
    first = edges.select(*by, "src", F.col("dst").alias("mid"))
    second = (edges if transitive else reachable(edges, by)).select(*by, F.col("src").alias("mid"), "dst")
    return edges.join(first.join(second, [*by, "mid"]).select(*by, "src", "dst").distinct(), [*by, "src", "dst"], "left_anti")


def source_to_sink_paths(edges: DataFrame, by: list[str], min_length: int = 1, longest: int = 10_000) -> DataFrame:
    """(by..., path) for all paths from a source to a sink of acyclic graphs, of at least min_length nodes.

    Paths grow by one edge a round as rows; a graph with paths of more than longest nodes raises.
    """
    edges = cut(edges.select(*by, "src", "dst"))  # read in each round
    inner = edges.select(*by, F.col("dst").alias("src")).distinct()
    now = edges.join(inner, [*by, "src"], "left_anti").select(*by, F.array("src").alias("path")).distinct()
    step = edges.select(*by, F.col("src").alias("at"), "dst")
    done = None
    for _ in range(longest):
        grown = now.withColumn("at", F.element_at("path", -1)).join(step, [*by, "at"], "left")
        grown = cut(grown.select(*by, "path", "dst"))
        ended = grown.where("dst IS NULL").select(*by, "path")
        done = ended if done is None else done.union(ended)
        now = grown.where("dst IS NOT NULL").select(*by, F.concat("path", F.array("dst")).alias("path"))
        if now.isEmpty():
            return done.where(F.size("path") >= min_length)
    raise ValueError(f"a path has more than {longest} nodes")


def disjoint_cover(blocks: DataFrame) -> DataFrame:
    """Longest-first greedy choice of blocks (path) that share no id; ties by the path's order.

    A block that is first among all blocks of each of its ids would be chosen by the sequential rule too; all such
    blocks are taken at once, what shares an id with them goes, and so on, so no block list meets in one task.
    """
    rank = F.struct((-F.size("path")).alias("n"), F.col("path").alias("p"))
    left = cut(blocks.select("path").distinct().select("path", rank.alias("rank")))
    chosen = left.where(F.lit(False)).select("path")
    while not left.isEmpty():
        ids = left.select("rank", F.size(F.array_distinct("path")).alias("n"), F.explode(F.array_distinct("path")).alias("id"))
        best = ids.groupBy("id").agg(F.min("rank").alias("rank"))
        first = cut(ids.join(best, ["id", "rank"]).groupBy("rank", "n").agg(F.count(F.lit(1)).alias("won")).where("won = n").select("rank"))
        chosen = cut(chosen.union(first.select(F.col("rank.p").alias("path"))))
        taken = ids.join(first, "rank", "left_semi").select("id").distinct()
        left = cut(left.join(ids.join(taken, "id", "left_semi").select("rank").distinct(), "rank", "left_anti").select("path", "rank"))
    return chosen


def bounded_paths(pairs: DataFrame, edges: DataFrame, max_gap: int) -> DataFrame:
    """(src, dst, n_nodes, min_weight, avg_weight, score) for pairs (src, dst) with a path of at most max_gap + 2 nodes.

    Of all shortest paths: the greatest smallest weight, and the greatest mean; score is min_weight / n_nodes. Both
    are carried along, and only the first round that reaches a node counts for it, so walks do not multiply.
    """
    step = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.col("weight").alias("w"))
    now = pairs.select("src", F.col("src").alias("at")).distinct().select("src", "at", F.lit(None).cast("double").alias("lo"), F.lit(0.0).alias("total"))
    seen = now.select("src", "at")
    found = None
    for hops in range(1, max_gap + 2):
        grown = now.join(step, "at").groupBy("src", F.col("to").alias("at")).agg(F.max(F.least("lo", F.col("w").cast("double"))).alias("lo"), F.max(F.col("total") + F.col("w")).alias("total"))
        now = cut(grown.join(seen, ["src", "at"], "left_anti"))
        seen = seen.union(now.select("src", "at"))
        reached = now.select("src", F.col("at").alias("dst"), F.lit(hops + 1).alias("n_nodes"), F.col("lo").alias("min_weight"), (F.col("total") / hops).alias("avg_weight"))
        found = reached if found is None else found.union(reached)
    out = pairs.select("src", "dst").distinct().join(found, ["src", "dst"])
    return out.withColumn("score", F.col("min_weight") / F.col("n_nodes"))


def intact_blocks(blocks: DataFrame, positions: DataFrame) -> DataFrame:
    """(block, valid): whether some contig has rising positions for all ids of the block (block, path), in its order."""
    ids = blocks.select("block", F.size("path").alias("n"), F.posexplode("path").alias("i", "id"))
    at = ids.join(positions.select("id", "contig", "start"), "id").groupBy("block", "n", "contig", "i").agg(F.sort_array(F.collect_set("start")).alias("starts"))
    rows = at.groupBy("block", "n", "contig").agg(F.sort_array(F.collect_list(F.struct("i", "starts"))).alias("rows"))
    # the smallest start behind the last one leaves the most room, so it decides
    after = lambda last, r: F.array_min(F.filter(r["starts"], lambda s: s > last))
    end = F.aggregate("rows", F.lit(-1).cast("long"), after)
    good = rows.where(F.size("rows") == F.col("n")).groupBy("block").agg(F.bool_or(end.isNotNull()).alias("ok"))
    return blocks.select("block").join(good, "block", "left").select("block", F.coalesce("ok", F.lit(False)).alias("valid"))


def pair_scores(adjacent: DataFrame, paths: DataFrame) -> DataFrame:
    """(genome, total, valid, score, avg_consensus): how neighbours of an assembly lie in the consensus; null means without any."""
    at = adjacent.join(paths, ["src", "dst"], "left").groupBy("genome")
    return at.agg(F.count(F.lit(1)).alias("total"), F.count("score").alias("valid"), F.sum("score").alias("score"), F.avg("avg_weight").alias("avg_consensus"))


def pair_scores_by_gap(adjacent: DataFrame, paths: DataFrame, gaps: list[int]) -> DataFrame:
    """(genome, max_gap, total, valid, score) for each of gaps, from paths (src, dst, n_nodes, score) up to the widest of them.

    A pair counts for a gap whose paths of gap + 2 nodes reach it, so one search and one aggregation serve all gaps.
    """
    of = lambda g: F.when(F.col("n_nodes") <= g + 2, F.col("score"))
    each = F.array(*[F.struct(F.lit(g).alias("max_gap"), F.count(of(g)).alias("valid"), F.sum(of(g)).alias("score")) for g in gaps])
    at = adjacent.join(paths, ["src", "dst"], "left").groupBy("genome").agg(F.count(F.lit(1)).alias("total"), each.alias("each"))
    return at.select("genome", "total", F.inline("each")).select("genome", "max_gap", "total", "valid", "score")

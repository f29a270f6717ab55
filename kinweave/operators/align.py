"""Alignment of an assembly's paths to the consensus graph by dynamic programming."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut

#: Distinct paths of a part that one group of the alignment holds, about.
SHARE = 2000
#: Ids of distinct paths and their alignments that are broadcast at most; with more, paths meet them by shuffle.
FEW_IDS = 200_000


class Steps:
    """The edges of a graph part by node number: predecessors of one node lie side by side, in the order of their names."""

    def __init__(self, edges: list[tuple[str, str]]):
        self.names = sorted({x for e in edges for x in e})
        self.number = {x: i for i, x in enumerate(self.names)}
        ordered = np.array(sorted({(self.number[d], self.number[s]) for s, d in edges}))
        self.sources = ordered[:, 1]
        self.nodes, self.begins = np.unique(ordered[:, 0], return_index=True)
        self.sizes = np.diff([*self.begins, len(ordered)])

    def best(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each node the best score of its predecessors, 0 without one, and the first that has it, else -1."""
        at = scores[self.sources]
        most = np.maximum.reduceat(at, self.begins)
        first = np.minimum.reduceat(np.where(at == np.repeat(most, self.sizes), np.arange(len(at)), len(at)), self.begins)
        best, back = np.zeros(len(scores), np.int64), np.full(len(scores), -1)
        best[self.nodes], back[self.nodes] = most, self.sources[first]
        return best, back


def solve(path: list[str], steps: Steps, match: int, mismatch: int, insertion: int, deletion: int | None = None) -> tuple[int, list[str]]:
    """Best score and the nodes of the best alignment, first to last.

    Cell (i, s): match or mismatch of path[i] and s, plus the best predecessor of s in row i - 1 (0 without one), or
    the cell above plus insertion; with a deletion, also the best cell of s in any row above plus deletion, so that a gap of
    any length costs once. The step along an edge wins ties, then the insertion; among predecessors the first, among equal
    rows above the first, among best cells the last row and the first node.
    """
    n = len(steps.names)
    rows, backs = [], []  # a back pointer: row times n plus node, or -1
    most, most_row = np.full(n, -(1 << 40)), np.zeros(n, np.int64)
    for i, t in enumerate(path):
        row = np.full(n, mismatch, np.int64)
        if t in steps.number:
            row[steps.number[t]] = match
        back = np.full(n, -1)
        if i:
            best, source = steps.best(rows[-1])
            row += best
            back = np.where(source >= 0, (i - 1) * n + source, -1)
            gaps = [(rows[-1] + insertion, np.full(n, i - 1))] + ([] if deletion is None else [(most + deletion, most_row)])
            for score, at in gaps:
                better = score > row
                row, back = np.where(better, score, row), np.where(better, at * n + np.arange(n), back)
        more = row > most
        most, most_row = np.where(more, row, most), np.where(more, i, most_row)
        rows.append(row)
        backs.append(back)
    score, i, s = max(((int(row.max()), i, int(row.argmax())) for i, row in enumerate(rows)), key=lambda x: (x[0], x[1]))
    out, at = [], i * n + s
    while at >= 0:
        out.append(steps.names[at % n])
        at = int(backs[at // n][at % n])
    return score, list(dict.fromkeys(out[::-1]))


def align(paths: DataFrame, edges: DataFrame, members: DataFrame, match: int = 7, mismatch: int = -3, insertion: int = -1, deletion: int | None = None) -> DataFrame:
    """(genome, contig, score, path_len, path): the best alignment of each path (genome, contig, path) to edges (src, dst).

    members (node, component) are the graph's parts: steps stay within a part, so a path is aligned to each part that
    has one of its ids, and the best of them is kept. Equal paths are aligned once. The distinct paths of a part are dealt
    by hash into shares of about SHARE, and its edges are repeated for each share, so a group holds one part and a bounded
    number of paths.
    """
    paths = cut(paths.select("genome", "contig", "path"))  # read twice
    ways = paths.select("path").distinct().select("path", F.explode("path").alias("node"))
    own = cut(ways.join(members, "node").select("component", "path").distinct())
    shares = cut(own.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares")))
    own = own.join(shares, "component").withColumn("share", F.pmod(F.xxhash64("path"), F.col("shares")).cast("int"))
    parts = edges.select("src", "dst").join(members.select(F.col("node").alias("src"), F.col("component").alias("part")), "src")
    parts = parts.join(shares.withColumnRenamed("component", "part"), "part").select("part", "src", "dst", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))

    def run(graph: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
        if not len(graph) or not len(targets):
            return pd.DataFrame({"of": [], "score": [], "path_len": [], "path": []})
        steps = Steps(list(zip(graph["src"], graph["dst"])))
        out = [(p, *solve(list(p), steps, match, mismatch, insertion, deletion)) for p in targets["path"]]
        return pd.DataFrame([(of, s, len(p), p) for of, s, p in out], columns=["of", "score", "path_len", "path"])

    found = parts.groupBy("part", "share").cogroup(own.groupBy("component", "share")).applyInPandas(run, "of array<string>, score long, path_len long, path array<string>")
    best = cut(found.groupBy("of").agg(F.max(F.struct("score", "path_len", "path")).alias("x")))
    ids = best.agg(F.sum(F.size("of").cast("long") + F.size("x.path"))).first()[0] or 0
    best = F.broadcast(best) if ids <= FEW_IDS else best
    return paths.withColumnRenamed("path", "of").join(best, "of").select("genome", "contig", "x.*")


def block_spans(aligned: DataFrame, positions: DataFrame) -> DataFrame:
    """(genome, contig, start, end, path_len, score) of alignments whose first and last id lie on one contig of the assembly."""
    at = positions.select("genome", "id", F.col("contig").alias("on"), "start", "end")
    ends = aligned.select("genome", "contig", "path_len", "score", F.element_at("path", 1).alias("a"), F.element_at("path", -1).alias("z"))
    first = at.toDF("genome", "a", "on_a", "start_a", "end_a")
    last = at.toDF("genome", "z", "on_z", "start_z", "end_z")
    both = ends.join(first, ["genome", "a"]).join(last, ["genome", "z"]).where("on_a = on_z")
    return both.select("genome", F.col("on_a").alias("contig"), F.least("start_a", "start_z").alias("start"), F.greatest("end_a", "end_z").alias("end"), "path_len", "score")

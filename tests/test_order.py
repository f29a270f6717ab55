"""Order of elements, graphs and alignments on small cases, against brute force."""

import itertools
import random
import sys

import pytest

from kinweave.operators import align, graph, synteny
from kinweave.plans import order


def anchors(spark, rows):
    return spark.createDataFrame(rows, "genome string, contig string, start long, id string")


def test_adjacency_and_consensus(spark):
    rows = [("g", "1", 5, "b"), ("g", "1", 5, "a"), ("g", "1", 9, "c"), ("g", "2", 1, "d"), ("h", "1", 1, "a"), ("h", "1", 4, "b"), ("h", "1", 5, "c"), ("h", "2", 7, "c")]
    near = synteny.adjacency(synteny.unique_ids(anchors(spark, rows)))
    assert {(r["genome"], r["src"], r["dst"], r["dist"]) for r in near.collect()} == {("g", "a", "b", 0), ("g", "b", "c", 4), ("h", "a", "b", 3)}
    assert {(r["src"], r["dst"], r["weight"], r["dist"]) for r in synteny.consensus(near).collect()} == {("a", "b", 2, 1.5), ("b", "c", 1, 4.0)}


def test_blocks_against_brute_force(spark):
    draw = random.Random(3)
    ids = [f"u{i}" for i in range(7)]
    rows = [(g, "1", p, u) for g in "xyz" for p, u in enumerate(draw.sample(ids, 7))]
    at = {(g, u): p for g, _, p, u in rows}
    edges = {(a, b) for a, b in itertools.permutations(ids, 2) if all(at[g, a] < at[g, b] for g in "xyz")}
    red = {(a, b) for a, b in edges if not any((a, c) in edges and (c, b) in edges for c in ids)}
    pairs = synteny.order_support(synteny.contig_combinations(anchors(spark, rows), list("xyz")), 3)
    assert {(r["src"], r["dst"]) for r in pairs.collect()} == edges
    for transitive in (True, False):
        out = graph.transitive_reduction(pairs.select("contigs", "src", "dst"), ["contigs"], transitive)
        assert {(r["src"], r["dst"]) for r in out.collect()} == red

    def walks(p):
        nexts = [b for a, b in red if a == p[-1]]
        return [p] if not nexts else [w for b in nexts for w in walks([*p, b])]

    sources = {a for a, _ in red} - {b for _, b in red}
    paths = {tuple(w) for s in sources for w in walks([s])}
    assert {tuple(r["path"]) for r in order.syntenic_blocks(anchors(spark, rows), 1.0, 2).collect()} == paths
    chosen, used = set(), set()
    for p in sorted(paths, key=lambda p: (-len(p), p)):
        if not used & set(p):
            chosen.add(p)
            used |= set(p)
    assert {tuple(r["path"]) for r in order.syntenic_blocks(anchors(spark, rows), 1.0, 2, minimise=True).collect()} == chosen


def test_cycles_are_broken(spark):
    rows = [("c", "a", "b", 2, 1.0), ("c", "b", "d", 3, 1.0), ("c", "d", "a", 1, 1.0)]
    pairs = spark.createDataFrame(rows, "contigs string, src string, dst string, support int, dist double")
    left = lambda policy: {(r["src"], r["dst"]) for r in graph.reduce_until_acyclic(pairs, 3, policy).collect()}
    assert left("weakest_first") == {("a", "b"), ("b", "d")}
    assert left("reference") == {("b", "d"), ("d", "a")}


def closure(edges):
    ways = set(edges)
    while True:
        more = {(a, d) for a, b in ways for c, d in ways if b == c} - ways
        if not more:
            return ways
        ways |= more


@pytest.mark.parametrize(("policy", "use_distance"), [("weakest_first", False), ("weakest_first", True), ("reference", False), ("reference", True)])
def test_cycles_of_many_graphs(spark, policy, use_distance):
    """Edges go one at a time in plain loops, for each graph on its own; ties by distance and names."""
    r = random.Random(3)
    rows = []
    for c in "pqrst":
        for s, d in r.sample([(a, b) for a in "abcdefg" for b in "abcdefg" if a != b], 14):
            rows.append((c, s, d, 3 if s < d and r.random() < 0.4 else r.randint(1, 2), float(r.randint(1, 3))))
    rows += [("whole", "a", "b", 3, 1.0), ("whole", "b", "c", 1, 1.0), ("loop", "a", "a", 1, 1.0)]
    df = spark.createDataFrame(rows, "contigs string, src string, dst string, support int, dist double")
    want, acyclic = set(), {}
    for c in {x[0] for x in rows}:
        left = [x[1:] for x in rows if x[0] == c]
        free = lambda: not any(a == b for a, b in closure({x[:2] for x in left}))  # noqa: E731, B023
        acyclic[c] = free()
        weak = sorted((x for x in left if x[2] < 3), key=lambda x: (x[2], -x[3] if use_distance else 0, x[0], x[1]), reverse=policy == "reference")
        while not free():
            left.remove(weak.pop(0))
        want |= {(c, *x) for x in left}
    assert {tuple(x) for x in graph.reduce_until_acyclic(df, 3, policy, use_distance).collect()} == want and len(want) < len(rows)
    assert {x["contigs"]: x["acyclic"] for x in graph.is_acyclic(df, ["contigs"]).collect()} == acyclic and len(set(acyclic.values())) == 2
    kept = spark.createDataFrame(sorted(want), df.schema).select("contigs", "src", "dst")
    reduced = set()
    for c in acyclic:
        edges = {x[1:3] for x in want if x[0] == c}
        ways = closure(edges)
        reduced |= {(c, a, b) for a, b in edges if not any((a, m) in edges and (m, b) in ways for m in "abcdefg")}
    assert {tuple(x) for x in graph.transitive_reduction(kept, ["contigs"]).collect()} == reduced and len(reduced) < len(want)


def test_unanimous_cycles(spark):
    rows = [("c", "a", "b", 3, 1.0), ("c", "b", "a", 3, 1.0)]
    with pytest.raises(ValueError, match="unanimous"):
        graph.reduce_until_acyclic(spark.createDataFrame(rows, "contigs string, src string, dst string, support int, dist double"), 3)


def test_connected(spark):
    edges = [(i, i + 1) for i in range(30)] + [(40, 50), (50, 40), (60, 45)]
    got = {r["node"]: r["component"] for r in graph.connected(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 40: 40, 50: 40, 45: 45, 60: 45}


def test_bounded_paths(spark):
    edges = spark.createDataFrame([("a", "b", 3), ("b", "c", 1), ("a", "d", 2), ("d", "c", 2), ("c", "e", 5)], "src string, dst string, weight long")
    pairs = spark.createDataFrame([("a", "c"), ("a", "e"), ("e", "a"), ("a", "b")], "src string, dst string")
    got = {(r["src"], r["dst"]): (r["n_nodes"], r["min_weight"], r["avg_weight"]) for r in graph.bounded_paths(pairs, edges, 1).collect()}
    assert got == {("a", "b"): (2, 3.0, 3.0), ("a", "c"): (3, 2.0, 2.0)}


def test_intact_blocks(spark):
    blocks = spark.createDataFrame([("x", ["a", "b", "c"]), ("y", ["b", "a"]), ("z", ["a", "q"])], "block string, path array<string>")
    at = spark.createDataFrame([("a", "1", 5), ("b", "1", 3), ("b", "1", 7), ("c", "1", 8), ("c", "2", 9)], "id string, contig string, start long")
    assert {r["block"]: r["valid"] for r in graph.intact_blocks(blocks, at).collect()} == {"x": True, "y": True, "z": False}
    rows = [("g", "1", 5, "a"), ("g", "1", 7, "b"), ("h", "1", 9, "a"), ("h", "1", 2, "b")]
    out = order.assembly_contiguity(spark.createDataFrame([("x", ["a", "b"])], "block string, path array<string>"), anchors(spark, rows))
    assert {tuple(r) for r in out.collect()} == {("g", 1, 0), ("h", 0, 1)}


def test_contiguity_counts_every_assembly(spark):
    blocks = spark.createDataFrame([("x", ["a", "b"]), ("y", ["b", "q"])], "block string, path array<string>")
    rows = [("g", "1", 5, "a"), ("g", "1", 7, "b"), ("h", "1", 9, "b"), ("h", "2", 12, "q"), ("i", "1", 1, "z"), ("j", "1", 1, "b"), ("j", "1", 3, "q")]
    assert {tuple(r) for r in order.assembly_contiguity(blocks, anchors(spark, rows)).collect()} == {("g", 1, 1), ("h", 0, 2), ("i", 0, 2), ("j", 1, 1)}
    assert {tuple(r) for r in synteny.block_ends(blocks, anchors(spark, rows + [("g", "1", 2, "b")])).collect()} == {("g", "1", "x", 5, 2), ("j", "1", "y", 1, 3)}
    assert {r["id"] for r in synteny.in_blocks(anchors(spark, rows), blocks).collect()} == {"a", "b", "q"}


def test_pair_reports(spark):
    rows = [("g", "1", 1, "a"), ("g", "1", 4, "b"), ("g", "2", 2, "c"), ("h", "1", 1, "a"), ("h", "1", 2, "a"), ("h", "1", 9, "c"), ("i", "1", 1, "a"), ("i", "1", 3, "c")]
    edges = spark.createDataFrame([("a", "b", 3), ("b", "c", 1)], "src string, dst string, weight long")
    found = {tuple(r) for r in order.pair_report(anchors(spark, rows), edges, 1).collect()}
    assert found == {("g", "1", "a", 1, "b", 4, 2, 3.0, 3.0, 1.5), ("i", "1", "a", 1, "c", 3, 3, 1.0, 2.0, 1 / 3)}
    assert {tuple(r)[:4] + tuple(r)[5:] for r in order.pair_summary(anchors(spark, rows), edges, 1).collect()} == {("g", 1, 1, 1.5, 3, 0), ("h", 0, 0, None, 1, 1), ("i", 1, 1, 1 / 3, 2, 0)}
    near = synteny.adjacency(synteny.unique_ids(anchors(spark, rows)))
    swept = graph.pair_scores_by_gap(near, graph.bounded_paths(near, edges, 1), [0, 1])
    assert {tuple(r) for r in swept.collect()} == {("g", 0, 1, 1, 1.5), ("g", 1, 1, 1, 1.5), ("i", 0, 1, 0, None), ("i", 1, 1, 1, 1 / 3)}


def brute(path, nodes, before, deletion=None):
    """Best score over all ways to walk the graph along a path, by plain recursion."""

    def cell(i, s):
        own = 7 if path[i] == s else -3
        if i == 0:
            return own
        best = max((cell(i - 1, p) for p in before.get(s, ())), default=0)
        gaps = [] if deletion is None else [cell(j, s) + deletion for j in range(i)]
        return max(own + best, cell(i - 1, s) - 1, *gaps)

    return max(cell(i, s) for i in range(len(path)) for s in nodes)


def test_alignment(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("b", "d"), ("x", "y")]
    before = {"b": ["a"], "c": ["b"], "d": ["b", "c"], "y": ["x"]}
    graph_df = spark.createDataFrame(edges, "src string, dst string")
    members = graph.connected(graph_df)
    paths = {"p1": ["a", "b", "d"], "p2": ["a", "q", "b", "c", "d"], "p3": ["d"], "p4": ["y", "x"], "p5": ["q"]}
    rows = spark.createDataFrame([("g", c, p) for c, p in paths.items()], "genome string, contig string, path array<string>")
    got = {r["contig"]: (r["score"], r["path"]) for r in align.align(rows, graph_df, members).collect()}
    assert set(got) == {"p1", "p2", "p3", "p4"}
    for c in ("p1", "p2", "p3"):
        assert got[c][0] == brute(paths[c], list("abcd"), before)
    assert got["p1"] == (21, ["a", "b", "d"]) and got["p4"][0] == brute(paths["p4"], ["x", "y"], before)
    at = spark.createDataFrame([("g", "1", s, e, i) for i, s, e in (("a", 0, 4), ("b", 10, 14), ("d", 30, 34))], "genome string, contig string, start long, end long, id string")
    spans, summary = order.assembly_blocks(at, graph_df)
    assert [(r["start"], r["end"], r["score"]) for r in spans.collect()] == [(0, 34, 21)] and summary.first()["n_blocks"] == 1


@pytest.mark.parametrize("deletion", [None, -4, -1])
def test_alignment_with_gaps_of_any_length(spark, deletion):
    edges = [("1", "3"), ("1", "2"), ("3", "6"), ("6", "5"), ("5", "3"), ("3", "4"), ("4", "8"), ("2", "4")]  # has a cycle
    before = {d: sorted(s for s, e in edges if e == d) for _, d in edges}
    draw = random.Random(5)
    paths = [list("1348"), list("124"), list("13653"), list("1x3y48"), list("8"), *[draw.choices("1234568xyz", k=7) for _ in range(12)], list("1xyxyx24")]
    rows = spark.createDataFrame([("g", str(i), p) for i, p in enumerate(paths)], "genome string, contig string, path array<string>")
    graph_df = spark.createDataFrame(edges, "src string, dst string")
    found = {int(r["contig"]): r for r in align.align(rows, graph_df, graph.connected(graph_df), deletion=deletion).collect()}
    for i, p in enumerate(paths):
        assert found[i]["score"] == brute(p, list("1234568"), before, deletion)
    assert found[0]["path"] == list("1348") and found[0]["score"] == 28


def test_alignment_in_shares(spark, monkeypatch, tmp_path):
    solve, log = align.solve, str(tmp_path / "sizes")

    def noted(*args):
        with open(log, "a") as f:
            f.write(f"{len(sys._getframe(1).f_locals['targets'])}\n")
        return solve(*args)

    graph_df = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "src string, dst string")
    members = graph.connected(graph_df)
    draw = random.Random(4)
    rows = spark.createDataFrame([(f"g{i % 7}", str(i), draw.choices("abcxyq", k=4) + ["a"]) for i in range(200)], "genome string, contig string, path array<string>")
    want = {tuple(map(str, r)) for r in align.align(rows, graph_df, members).collect()}
    monkeypatch.setattr(align, "solve", noted)
    monkeypatch.setattr(align, "SHARE", 10, raising=False)
    assert {tuple(map(str, r)) for r in align.align(rows, graph_df, members).collect()} == want and len(want) == 200
    with open(log) as f:
        assert max(map(int, f)) <= 40


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_equal_paths_are_aligned_once(spark, monkeypatch, tmp_path, few):
    solve, log = align.solve, str(tmp_path / "calls")

    def noted(*args):
        with open(log, "a") as f:
            f.write(f"{''.join(args[0])}\n")
        return solve(*args)

    graph_df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    rows = [(f"g{i}", c, s, s + 2, u) for i in range(90) for c, ids in (("1", ["abc", "bcd", "adq"][i % 3]), ("2", "xyz")) for s, u in enumerate(ids)]
    at = spark.createDataFrame(rows, "genome string, contig string, start long, end long, id string")
    monkeypatch.setattr(align, "solve", noted)
    monkeypatch.setattr(align, "FEW_IDS", few, raising=False)
    spans, summary = order.assembly_blocks(at, graph_df)
    whole = {r["genome"] for r in summary.where("n_blocks = 1 AND score_max = 21 AND score_median = 21 AND path_len_min = 3").collect()}
    assert whole == {f"g{i}" for i in range(90) if i % 3 < 2}
    assert spans.where("score = 21").count() == 60
    with open(log) as f:
        assert sorted(f.read().split()) == ["abc", "adq", "bcd"]


def test_empty_tables(spark):
    none = anchors(spark, [])
    assert order.consensus_map(none).count() == 0
    assert graph.disjoint_cover(spark.createDataFrame([], "path array<string>")).count() == 0
    assert graph.connected(spark.createDataFrame([], "src string, dst string")).count() == 0

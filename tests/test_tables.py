"""Readers and writers in round trips, comparison, statistics; and all queries against their SQL on the smallest tables."""

import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from kinweave import queries as Q
from kinweave.operators import alignments, assess, compare, stats
from kinweave.plans import order
from kinweave.sources import readers, writers

SMALLEST = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_fasta_round_trip(spark, tmp_path):
    rows = [("u1", "ACGT" * 30), ("u2", "GG")]
    writers.fasta(spark.createDataFrame(rows, "id string, seq string").coalesce(1), str(tmp_path / "x.fa"))
    back = readers.fasta(spark, str(tmp_path / "x.fa"))
    assert sorted((r["contig"], r["seq"], r["length"]) for r in back.collect()) == [("u1", "ACGT" * 30, 120), ("u2", "GG", 2)]
    (tmp_path / "g.fa").write_text(">c1 of g\nACG\nTTA\n>c2\nGG\n")
    assert {(r["genome"], r["contig"], r["seq"]) for r in readers.fasta(spark, str(tmp_path / "g.fa")).collect()} == {("g", "c1", "ACGTTA"), ("g", "c2", "GG")}
    assert {r["genome"] for r in readers.genomes(spark, str(tmp_path)).collect()} == {"g"}
    assert readers.only_file(spark, str(tmp_path), "g", ".fa").endswith("g.fa")
    with pytest.raises(ValueError):
        readers.only_file(spark, str(tmp_path), "q", ".fa")


def test_bed_and_graph_round_trips(spark, tmp_path):
    (tmp_path / "h.bed").write_text("chr1\t5\t9\tu1\t100.0\nchr1\t20\t24\tu2\t99.5\n")
    placed = readers.anchors(spark, str(tmp_path / "h.bed"))
    assert {tuple(r) for r in placed.collect()} == {("h", "chr1", 5, 9, "u1", 100.0, 0), ("h", "chr1", 20, 24, "u2", 99.5, 1)}
    edges = readers.order_map(spark, str(tmp_path / "h.bed"), "bed")
    assert [tuple(r) for r in edges.collect()] == [("u1", "u2", 1.0)]
    writers.gexf(edges, str(tmp_path / "m.gexf"))
    assert [tuple(r) for r in readers.gexf(spark, str(tmp_path / "m.gexf")).collect()] == [("u1", "u2", 1.0)]
    writers.graph(edges, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m/nodes")).count() == 2
    writers.bed_by_genome(placed.withColumn("homology", placed.identity / 100), str(tmp_path / "out"))
    assert os.path.isdir(tmp_path / "out/genome=h")
    blocks = spark.createDataFrame([(["a", "b"],)], "path array<string>")
    writers.block_list(blocks, str(tmp_path / "blocks"))
    assert [tuple(r) for r in readers.blocks(spark, str(tmp_path / "blocks")).collect()] == [("a,b", ["a", "b"])]
    assert [(r["start"], r["end"]) for r in writers.shifted(placed).orderBy("start").collect()] == [(4, 8), (19, 23)]
    assert [tuple(r) for r in writers.numbered(spark.createDataFrame([("C",), ("A",), ("C",)], "seq string")).orderBy("id").collect()] == [(0, "A"), (1, "C")]


def test_sam(spark, tmp_path):
    lines = ["@SQ\tSN:chr1\tLN:50", "q\t0\tchr1\t5\t60\t4M\t*\t0\t0\tACGA\t*\tAS:i:8\tMD:Z:4", "q\t272\tchr1\t21\t0\t2M2X\t*\t0\t0\t*\t*\tAS:i:3", "n\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t*"]
    (tmp_path / "s.sam").write_text("\n".join(lines) + "\n")
    rows = readers.sam(spark, str(tmp_path / "s.sam"))
    full = alignments.with_sequences(rows)
    assert {(r["query"], r["pos"], r["seq"], r["score"]) for r in full.collect()} == {("q", 4, "ACGA", 8), ("q", 20, "TCGT", 3)}
    assert alignments.within_mismatches(full, 1).count() == 1
    assert [tuple(r) for r in alignments.last_positions(rows).collect()] == [("q", "chr1", 20, 24)]
    assert [tuple(r) for r in readers.sam_contigs(spark, str(tmp_path / "s.sam")).collect()] == [("chr1", 50)]


def test_containment_against_brute_force(spark):
    a = {"a1": "ACGTTGCAGG", "a2": "CCTGCAACGT", "a3": "GATTACA", "a4": "GG"}
    b = {"b1": "TTACGTTGCAGGAA", "b2": "TGTAATC", "b3": "TTTTTTT"}
    df = lambda x: spark.createDataFrame(list(x.items()), "id string, seq string")
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))

    def match(x, y):
        big, small = (x, y) if len(x) >= len(y) else (y, x)
        return small in big or rc(small) in big

    expected = {(i, j) for i, x in a.items() for j, y in b.items() if match(x, y)}
    pairs = compare.contained_pairs(df(a), df(b), 4)
    assert {tuple(r) for r in pairs.collect()} == expected
    row = compare.recall_precision(pairs, df(a), df(b)).first()
    assert (row["expected"], row["actual"], row["found"], row["matched"]) == (4, 3, len({i for i, _ in expected}), len({j for _, j in expected}))
    some = {"x": "ACGTA", "y": "CGT", "z": "ACGTA", "w": "TTTT", "v": "GT"}
    assert {r["id"] for r in compare.minimal_set(df(some), 3).collect()} == {"z", "w"}


def test_statistics(spark):
    df = spark.createDataFrame([("g", float(x), 2.0 * x + 1, float(x * x)) for x in range(8)], "k string, a double, y double, b double")
    fit = stats.regression(df, "y", ["a", "b"], ["k"]).first()
    assert math.isclose(fit["slope1"], 2, abs_tol=1e-9) and math.isclose(fit["slope2"], 0, abs_tol=1e-9) and math.isclose(fit["r2"], 1)


def test_p_values(spark):
    rows = [(t, v) for t in (-3.0, -0.4, 0.0, 0.7, 2.5, 60.0) for v in (1, 2, 5000000)] + [(None, 4)]
    found = spark.createDataFrame(rows, "t double, v long").select("t", "v", *[stats.p_value(F.col("t"), F.col("v"), a).alias(a) for a in ("greater", "less", "two-sided")]).collect()
    beyond = {1: lambda t: 0.5 - math.atan(t) / math.pi, 2: lambda t: 0.5 - t / 2 / math.sqrt(2 + t * t), 5000000: lambda t: math.erfc(t / math.sqrt(2)) / 2}
    for r in found:
        if r["t"] is None:
            assert r["two-sided"] is None
            continue
        p = beyond[r["v"]](r["t"])
        assert all(math.isclose(a, b, abs_tol=1e-6) for a, b in ((r["greater"], p), (r["less"], 1 - p), (r["two-sided"], 2 * min(p, 1 - p))))
    with pytest.raises(ValueError):
        stats.p_value(F.col("t"), F.col("v"), "other")
    close = spark.createDataFrame([(float(x), float(-2 * x + x % 3), float(x * 7 % 5)) for x in range(40)], "a double, b double, c double")
    assert {(r["x"], r["y"]) for r in stats.marked(stats.correlations(close, ["a", "b", "c"])).where("marked").collect()} == {("a", "b")}


def test_inliers(spark):
    rows = [("a", float(x)) for x in [1] * 20 + [99]] + [(None, 5.0), (None, 6.0), (None, 7.0), ("b", 3.0)]
    left = stats.inliers(spark.createDataFrame(rows, "g string, x double"), "x", ["g"], 1.5).collect()
    assert sorted(r["x"] for r in left if r["g"] == "a") == [1.0] * 20 and sorted(r["x"] for r in left if r["g"] is None) == [5.0, 6.0, 7.0]
    assert not [r for r in left if r["g"] == "b"]


def test_validated(spark):
    known = spark.createDataFrame([("u",), ("v",), ("u",)], "id string")
    found = spark.createDataFrame([("u", "g", 0.9), ("u", "g", 1.0), ("v", "g", 0.8), ("w", "h", 1.0)], "id string, genome string, homology double")
    genomes = spark.createDataFrame([("g",), ("h",)], "genome string")
    assert {tuple(r) for r in assess.validated(known, found, genomes, 0.95).collect()} == {("g", 1, 1, 0.8), ("h", 0, 2, None)}


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("f", "u", 1), ("f", "v", None), ("o", "u", 3)], "assembly string, id string, n long")
    writers.report_by(rows, "assembly", str(tmp_path / "hits"))
    assert {tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "hits")).select("assembly", "id", "n").collect()} == {("f", "u", "1"), ("f", "v", None), ("o", "u", "3")}
    assert len(list((tmp_path / "hits/assembly=f").glob("*.csv"))) == 1
    writers.readable(rows.where("id = 'v'"), str(tmp_path / "text"))
    assert "".join(p.read_text() for p in (tmp_path / "text").glob("part*")) == "assembly\tf\nid\tv\nn\t\n\n"


def test_best_by_place_and_element_report(spark):
    hits = spark.createDataFrame([("f", "u", "c", 1, 9, 2), ("f", "v", "c", 1, 8, 0), ("f", "t", "c", 1, 7, 0), ("f", "u", "c", 4, 5, 0)], "assembly string, id string, contig string, pos long, score long, mismatches long")
    assert {tuple(r) for r in alignments.best_by_place(hits).collect()} == {("f", "c", 1, "t", 0), ("f", "c", 4, "u", 0)}
    known = spark.createDataFrame([("u",), ("q",)], "id string")
    assert [tuple(r) for r in order.element_report(known, hits).collect()] == [("f", "u", 0, 5, True)]


def test_completeness_without_hits(spark):
    known = spark.createDataFrame([("a",), ("b",)], "id string")
    hits = spark.createDataFrame([], "assembly string, id string, contig string, pos long, score long, mismatches long")
    assert assess.completeness(known, hits).count() == 0 and assess.missing(known, hits).count() == 2


def test_common_beginnings(spark):
    """Thousands of sequences that begin alike: only those that hold the rest of one are its candidates."""
    r = random.Random(4)
    letters = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    start = letters(48)
    short = [start + letters(20) for _ in range(1500)]
    long = [letters(5) + r.choice([x, sequences_rc(x)]) + letters(9) if i % 3 else start + letters(40) for i, x in enumerate(short)]
    a, b = (spark.createDataFrame([(f"{k}{i}", x) for i, x in enumerate(rows)], "id string, seq string") for k, rows in (("a", short), ("b", long)))
    want = {(f"a{i}", f"b{j}") for i, x in enumerate(short) for j, y in enumerate(long) if x in y or sequences_rc(x) in y}
    assert {tuple(x) for x in compare.contained_pairs(a, b, 16).collect()} == want and len(want) >= 1000
    both = a.union(b)
    gone = {f"a{i}" for i, x in enumerate(short) if any(x in y for y in long)}
    assert {x["id"] for x in compare.minimal_set(both, 16).collect()} == {f"a{i}" for i in range(1500)} - gone | {f"b{i}" for i in range(1500)}


def sequences_rc(x):
    return x[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_quantiles(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), r.choice([None, r.randint(0, 9), r.randint(0, 9)])) for _ in range(200)] + [("one", 4), ("none", None)]
    got = {x[0]: tuple(x)[1:] for x in assess.quantiles(spark.createDataFrame(rows, "g string, x long"), "g", "x").collect()}
    for g in {x[0] for x in rows}:
        values = [x for k, x in rows if k == g and x is not None]
        assert got[g] == (None,) * 3 if not values else np.allclose(got[g], np.percentile(values, [25, 50, 75]))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALLEST}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(Q.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = Q.QUERIES[name](spark, SMALLEST).toPandas(), duck.sql(Q.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).to_numpy().tolist()))
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(Q.QUERIES) <= set(__spark_entry__.queries())

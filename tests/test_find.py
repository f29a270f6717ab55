"""Search, regions and runs against literal sequences, and the end-to-end search."""

import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinweave import Params
from kinweave import queries as Q
from kinweave.functions import sequences as S
from kinweave.operators import exact, kmers, locate, regions, search
from kinweave.plans import find

SIMPLE = {"A": "GCCACATGGCTTTCTTGTTCTGGTCGGATCCATCGTT", "B": "ACCACATGGCAAACTTGTTCTGGTCGGATCCATCGTT", "C": "GCCACATGGCGTTCTTGTTCTGGTCCGATCCATCGTA"}
U = "GGAGCCTTATGGCATAGTCGTCCGCGGAGCACTCTGGTAA"
SMALL = {
    "a": "AAAAAAAAAAAAAAAAAAAAGGAGCCTTATGGCATAGTCGTCCGCGGAGCACTCTGGTAAAAAAAAAAAAAAAAAAAAAA",
    "b": "GGGGGGGGGGGGGGGGGGGGGGAGCCTTATGGCATAGTCGTCCGCGGAGCACTCTGGTAAGGGGGGGGGGGGGGGGGGGG",
    "c": "TTTTTTTTTTTTTTTTTTGGAGCCTTATGGCATAGTCGTCCGCGGAGCACTCTGGTAATTTTTTTACTTTTTTTTTTTT",
}


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def frame(spark, texts):
    return spark.createDataFrame([(g, "chr1", s) for g, s in texts.items()], "genome string, contig string, seq string")


@pytest.mark.parametrize(
    ("length", "homology", "support", "expected"),
    [
        (25, 1, 3, set()),
        (20, 1, 2, {"CTTGTTCTGGTCGGATCCATCGTT"}),
        (20, 0.95, 3, {"TCTTGTTCTGGTCGGATCCATCGT"}),
        (12, 1, 3, {"CTTGTTCTGGTC"}),
        (9, 1, 3, {"CTTGTTCTGGTC", "CCACATGGC", "GATCCATCGT"}),
        (9, 0.90, 3, {"CTTGTTCTGGTCGGATCCATCGT", "CCACATGGC"}),
    ],
)
def test_shared_windows(spark, length, homology, support, expected):
    listed = {s[i : i + 3] for s in SIMPLE.values() for i in range(len(s) - 3)}
    rows = [(g, "chr1", i, min(s[i : i + 3], rc(s[i : i + 3]))) for g, s in SIMPLE.items() for i in range(len(s) - 2) if s[i : i + 3] in listed or rc(s[i : i + 3]) in listed]
    hits = spark.createDataFrame(rows, "genome string, contig string, pos long, kmer string")
    p = Params(min_length=length, min_homology=homology, kmer=3)
    found = search.shared_elements(frame(spark, SIMPLE), hits, ["A"], p, support)
    assert {r["seq"] for r in found.collect()} == expected


@pytest.mark.parametrize(
    ("positions", "length", "gap", "expected"),
    [
        (range(25, 33), 3, 0, {(25, 32)}),
        (range(25, 33), 10, 0, {(25, 32)}),
        (range(25, 33), 12, 0, set()),
        ([25, 26, 27, 28, 50, 51, 53, 54], 3, 0, {(25, 28), (50, 54)}),
        ([25, 26, 27, 28, 50, 51, 53, 54], 4, 1, {(25, 28), (50, 54)}),
        ([25, 26, 27, *range(50, 55), 58, 59, 61, 62], 5, 0, {(25, 27), (50, 54), (58, 62)}),
        ([25, 26, 27, *range(50, 55), 58, 59, 61, 62], 6, 0, {(50, 54), (58, 62)}),
    ],
)
def test_regions(spark, positions, length, gap, expected):
    hits = spark.createDataFrame([("A", "c", p) for p in positions], "genome string, contig string, pos long")
    assert {(r["first_pos"], r["last_pos"]) for r in regions.candidate_regions(hits, 3, gap, length).collect()} == expected


@pytest.mark.parametrize(
    ("size", "expected"),
    [
        (11, {"ATCCCCAAATA"}),
        (10, {"ATCCCCAAAT", "TCCCCAAATA"}),
        (6, set("AGGGTT GGGTTC GGTTCA GTTCAG CCGTAG CGTAGT GTAGTA TAGTAC ATCCCC TCCCCA CCCCAA CCCAAA CCAAAT CAAATA".split())),
    ],
)
def test_run_windows(spark, size, expected):
    seq = "AGGGTTCAGCGAAAAAGGCCGTAGTACCCCATCCCCAAATA"
    at = [0, 1, 2, 3, 4, 11, 18, 19, 20, 21, 22, *range(30, 37)]
    hits = spark.createDataFrame([("A", "c", p) for p in at], "genome string, contig string, pos long")
    text = spark.createDataFrame([("A", "c", seq)], "genome string, contig string, seq string")
    found = {r["window"] for r in regions.run_windows(hits, text, 5, 0, size).collect()}
    assert found == expected and all(w in seq for w in found)


@pytest.mark.parametrize("first", ["a", "rc"])
def test_end_to_end(spark, first):
    texts = dict(SMALL) if first == "a" else {**SMALL, "a": rc(SMALL["a"])}
    p = Params(min_length=40, kmer=20)
    assert {r["seq"] for r in find.find_shared(frame(spark, texts), p).collect()} == {min(U, rc(U))}


def test_places_of_elements(spark):
    found = find.find_instances(frame(spark, SMALL), Params(min_length=40, kmer=20))
    assert {(r["genome"], r["start"], r["end"], r["homology"]) for r in found.collect()} == {("a", 20, 60, 1.0), ("b", 20, 60, 1.0), ("c", 18, 58, 1.0)}


def test_repeated_core_and_substitution(spark):
    texts = {"b": SMALL["b"], "c": SMALL["c"], "d": SMALL["a"] + U[:20]}
    assert {r["seq"] for r in find.find_shared(frame(spark, texts), Params(min_length=40, kmer=20, kmer_threshold=0.5)).collect()} == {min(U, rc(U))}
    snp = {"b": SMALL["b"], "c": SMALL["c"], "d": SMALL["a"].replace("CCGCGG", "CCGGGG")}
    assert find.find_shared(frame(spark, snp), Params(min_length=40, kmer=20)).count() == 0


def test_element_of_very_many_places(spark):
    rows = [("a", str(i), SMALL["a"]) for i in range(1005)] + [("b", "1", SMALL["b"]), ("c", "1", SMALL["c"])]
    texts = spark.createDataFrame(rows, "genome string, contig string, seq string")
    assert {r["seq"] for r in find.find_shared(texts, Params(min_length=40, kmer=20)).collect()} == {min(U, rc(U))}
    hits = kmers.kmers(texts, 20)
    hits = kmers.core_hits(hits, kmers.core_kmers(hits, 3))
    kept = search.distinct_islands(hits, texts, Params(min_length=40, kmer=20))
    count = lambda df: {r["genome"]: r["count"] for r in df.groupBy("genome").count().collect()}
    assert count(hits)["a"] == 1005 * count(kept)["a"] and count(kept)["b"] == count(hits)["b"]


def scanned(texts, p, support):
    """Elements from each reference, by searching whole texts for every window."""
    k, n = p.kmer, p.min_length
    canonical = lambda s: min(s, rc(s))
    has = lambda w, g: any(w in s or rc(w) in s for h, _, s in texts if h == g)
    genomes = {g for g, _, _ in texts}
    kmers_of = {g: {canonical(s[i : i + k]) for h, _, s in texts if h == g for i in range(len(s) - k + 1)} for g in genomes}
    core = {x for g in genomes for x in kmers_of[g] if sum(x in kmers_of[h] for h in genomes) >= support}
    shared = lambda w: sum(has(w, g) for g in genomes) >= support
    out = set()
    for g, _, s in texts:
        if g not in p.references(sorted(genomes)):
            continue
        at = [i for i in range(len(s) - k + 1) if canonical(s[i : i + k]) in core]
        cuts = [0, *[j for j in range(1, len(at)) if at[j] - at[j - 1] > k], len(at)]
        for a, b in zip(cuts, cuts[1:]):
            own, i = at[a:b], 0
            while i < len(own):
                end, start = own[i] + n, own[i]
                if end > len(s) or not shared(s[start:end]):
                    i += 1
                    continue
                while end < len(s) and shared(s[start : end + 1]):
                    end += 1
                out.add(canonical(s[start:end]))
                failed = next((q for q in own if q > end - k), end - k + 1)
                i = next((j for j, q in enumerate(own) if q > failed), len(own))
    return out


@pytest.mark.parametrize(("seed", "k", "length"), [(1, 4, 7), (2, 5, 9), (3, 4, 6), (4, 33, 40)])
def test_exact_search_against_brute_force(spark, seed, k, length):
    r = random.Random(seed)
    letters = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    passages = [letters(30 if k < 30 else 60) for _ in range(3)]
    texts = []
    for g in "abcde":
        for c in "12":
            parts = [r.choice([x, rc(x), x[: len(x) // 2] + letters(1) + x[len(x) // 2 + 1 :], letters(9)]) for x in r.sample(passages, 2)]
            texts.append((g, c, letters(5).join(parts)))
    texts.append(("a", "3", ""))
    df = spark.createDataFrame(texts, "genome string, contig string, seq string")
    p = Params(min_length=length, kmer=k, kmer_threshold=0.6)
    found = {x["seq"] for x in find.find_shared(df, p).collect()}
    assert found == scanned(texts, p, 3) and found
    hits = kmers.kmers(df, k)
    general = search.shared_elements(df, kmers.core_hits(hits, kmers.core_kmers(hits, 3)), p.references(list("abcde")), p, 3)
    assert {min(x["seq"], rc(x["seq"])) for x in general.collect()} == found


@pytest.mark.parametrize(("seed", "k", "length"), [(1, 4, 9), (2, 5, 12), (3, 6, 9), (4, 8, 16), (5, 3, 12)])
def test_exact_search_over_repeats(spark, seed, k, length):
    """Repeats of few letters, of lengths that are equal, longer or shorter, with equal and unequal letters beside them, on both strands."""
    r = random.Random(seed)
    texts = []
    for g in "abcde":
        for c in "123":
            parts = []
            for _ in range(r.randint(2, 5)):
                unit = r.choice(["A", "A", "AC", "AT", "ACG", "AATT"])
                parts += [r.choice(["G", "GC", "GTTC", "T", "GATTACAG"]), (unit * 30)[r.randint(0, 2) :][: r.choice([length, length + 3, length + 3, length + 8])]]
            text = "".join(parts)
            texts.append((g, c, r.choice([text, rc(text)])))
    df = spark.createDataFrame(texts, "genome string, contig string, seq string")
    p = Params(min_length=length, kmer=k, kmer_threshold=0.6)
    assert {x["seq"] for x in find.find_shared(df, p).collect()} == scanned(texts, p, 3)


@pytest.mark.parametrize(("unit", "period"), [("A", 1), ("AC", 2), ("ACGT", 4), ("ACGTA", 5)])
def test_periodic_anchors(spark, unit, period):
    text = (unit * 12)[:12]
    number = int("".join(str("ACGT".index(x)) for x in text), 4)
    got = spark.createDataFrame([(number,)], "kmer long").select(exact.periodic(F.col("kmer"), 12)).head()[0]
    assert got is (period <= 4)


def test_kmers_with_mismatches(spark):
    texts = {"a": SMALL["a"], "b": SMALL["b"], "d": SMALL["a"].replace("CCGCGG", "CCGGGG")}
    p = Params(min_length=40, min_homology=0.95, kmer=20, kmer_threshold=0.6)
    missed = find.find_shared(frame(spark, texts), p)  # a and d, which share the flanks as well
    met = find.find_shared(frame(spark, texts), Params(min_length=40, min_homology=0.95, kmer=20, kmer_mismatches=1, kmer_threshold=0.6))
    assert any(U[1:] in s or rc(U[1:]) in s for s in (r["seq"] for r in met.collect())) and missed.count() > 0


@pytest.mark.parametrize(("hits", "alike"), [(range(0, 41), True), (range(0, 40, 2), False)])
def test_coverage_of_the_best_contig(hits, alike):
    """A genome counts only where its best contig has hits at enough of a window's positions."""
    text, p = (U * 3)[:100], Params(min_length=50, min_homology=0.98, kmer=10)
    others = search.Others(text.encode())
    others.add_text("b", "c", 0, text)
    window = search.Window(others, p)
    for i in hits:
        others.add_place(f"k{i}", "b", "c", i)
        window.add([f"k{i}"])
    assert window.supported(0, 50, 2) is alike


@given(st.text("ACG", min_size=1, max_size=40), st.text("ACG", max_size=30), st.lists(st.tuples(st.integers(0, 39), st.integers(1, 20)), min_size=1, max_size=8), st.sampled_from([0.5, 0.75, 0.9]))
def test_diagonals_of_moving_windows(own, other, windows, homology):
    """Counts kept over any moves against counts from the start, for every part of the other text."""
    diagonals = search.Diagonals(*(np.frombuffer(x.encode(), np.uint8) for x in (own, other)))
    for start, size in windows:
        start, end = min(start, len(own) - 1), min(start + size, len(own))
        end = max(end, start + 1)
        diagonals.move(start, end)
        for first in range(len(other) + 1):
            for last in range(first, len(other) + 1):
                stretches = [other[i : i + end - start] for i in range(first, last - (end - start) + 1)]
                want = any(sum(x == y for x, y in zip(s, own[start:end])) / (end - start) >= homology for s in stretches)
                assert diagonals.alike(first, last, homology) is want


def inexact(texts, p, support):
    """The search with mismatches, window by window and place by place, in plain loops: regions of one run of k-mers."""
    def core():
        held = {}
        for g, t in texts.items():
            for i in range(len(t) - p.kmer + 1):
                x = t[i : i + p.kmer]
                held.setdefault(min(x, rc(x)), set()).add(g)
        return {x for x, g in held.items() if len(g) >= support}

    kept = core()
    at = {g: [i for i in range(len(t) - p.kmer + 1) if min(t[i : i + p.kmer], rc(t[i : i + p.kmer])) in kept] for g, t in texts.items()}
    others = lambda name: search.Others(texts[name].encode())
    out = set()
    for name in p.references(list(texts)):
        runs = []
        for i in at[name]:
            if runs and i - runs[-1][-1] <= p.kmer + p.gap:
                runs[-1].append(i)
            else:
                runs.append([i])
        for run in runs:
            if run[-1] - run[0] + p.kmer + p.gap < p.min_length:
                continue
            region, text = others(name), texts[name]
            for g in texts:
                if g != name:
                    region.add_text(g, "1", 0, texts[g])
                    for i in at[g]:
                        region.add_place(min(texts[g][i : i + p.kmer], rc(texts[g][i : i + p.kmer])), g, "1", i)
            found = search.elements({i: [min(text[i : i + p.kmer], rc(text[i : i + p.kmer]))] for i in run}, 0, text[: run[-1] + 2 * p.kmer], region, p, support)
            out |= {min(x, rc(x)) for _, x in found}
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_inexact_search_over_tables(spark, seed):
    r = random.Random(seed)
    passage = "".join(r.choice("ACGT") for _ in range(90))
    texts = {}
    for g in "abcd":
        copy = "".join(x if r.random() > 0.04 else r.choice("ACGT") for x in passage)
        texts[g] = "".join(r.choice("ACGT") for _ in range(20)) + r.choice([copy, rc(copy)]) + "".join(r.choice("ACGT") for _ in range(20))
    p = Params(min_length=30, min_homology=0.9, kmer=8, kmer_threshold=0.75)
    found = {x["seq"] for x in find.find_shared(frame(spark, texts), p).collect()}
    assert found == inexact(texts, p, 3)
    for x in found:  # each is so alike in enough genomes
        alike = lambda t: any(sum(a == b for a, b in zip(s, t[i : i + len(x)])) >= 0.9 * len(x) for s in (x, rc(x)) for i in range(len(t) - len(x) + 1))
        assert len(x) >= 30 and sum(alike(t) for t in texts.values()) >= 3


def test_locate_against_brute_force(spark):
    text = "ACGTTGCAAGGCTTACCGATCGGATTACAGGCATCCGATAGCTTGACCATG"
    queries = {"x": text[5:25], "y": rc(text[20:40]), "z": "C" * 20}
    queries["x"] = queries["x"][:7] + ("A" if queries["x"][7] != "A" else "C") + queries["x"][8:]
    elements = spark.createDataFrame(list(queries.items()), "id string, seq string")
    found = {(r["id"], r["start"], r["strand"], r["mismatches"]) for r in locate.locate(elements, frame(spark, {"g": text}), 2, 5).collect()}
    expected = set()
    for i, q in queries.items():
        for strand, s in (("+", q), ("-", rc(q))):
            for at in range(len(text) - len(q) + 1):
                m = sum(a != b for a, b in zip(s, text[at : at + len(s)]))
                if m <= 2:
                    expected.add((i, at, strand, m))
    assert found == expected and any(m == 1 for *_, m in found)


def test_benchmark_texts_of_any_length(spark, tmp_path):
    draw = random.Random(6)
    text = "".join(draw.choices("abcdefgh ACGT", k=300))
    queries = {1: text[10:120], 2: text[150:231], 3: text[40:47], 4: "ACGTTG", 5: "ac", 6: "", 7: None}
    queries[2] = queries[2][:30] + "##" + queries[2][32:]
    spark.createDataFrame(list(queries.items()), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, "s", text), (2, "s", "a"), (3, "s", None)], "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {(int(r["id"]), r["contig"], r["start"], r["mismatches"], r["q"]) for r in Q.j3_benchmark_mismatches(spark, str(tmp_path)).withColumn("q", F.col("end") - F.col("start")).collect()}
    expected = set()
    for i, q in queries.items():
        for s in {q, rc(q)} if q else ():
            for at in range(len(text) - len(q) + 1):
                m = sum(a != b for a, b in zip(s, text[at : at + len(s)]))
                if m <= 3:
                    expected.add((i, "1", at, m, len(q)))
    assert found == expected and {i for i, *_ in found} >= {1, 2, 3, 5}


def test_kmers_in_blocks(spark):
    seq = "ACGGTTNACGT" * 70
    found = sorted((r["pos"], r["kmer"]) for r in kmers.kmers(frame(spark, {"g": seq}), 7, canonicalise=False).collect())
    assert found == [(i, seq[i : i + 7]) for i in range(len(seq) - 6) if "N" not in seq[i : i + 7]]
    assert kmers.kmers(frame(spark, {"g": "ACG"}), 7).count() == 0


def test_scalars(spark):
    row = spark.createDataFrame([("ACGTNac", "AAGTNac", "12M3I2D5=", "10A5^C3")], "x string, y string, c string, m string")
    out = row.select(
        S.reverse_complement(F.col("x")), S.matches(F.col("x"), F.col("y")), S.matches(F.col("x"), F.lit("A")), S.cigar_mismatches(F.col("c"), F.lit(20)), S.cigar_mismatches(F.col("c"), F.lit(20), True),
        S.md_mismatches(F.col("m"), F.lit(20)), S.cigar_span(F.col("c")), S.contains_either_strand(F.col("x"), F.lit("ACGT")), S.matches(F.lit(""), F.lit("")),
    ).first()
    assert list(out) == ["caNACGT", 6, None, 3, 5, 2, 19, True, 0]


def test_parameters():
    assert Params(min_length=9, min_homology=0.9).gap == 0
    p = Params(min_length=100, min_homology=0.9, kmer_threshold=0.6)
    assert p.gap == 10 and p.min_support(5) == 3 and p.references(list("edcba")) == ["a", "b", "c"] and p.allowed_mismatches(100) == 10
    with pytest.raises(ValueError):
        Params(min_length=0)


def test_places_of_many_and_few_core_kmers(spark, monkeypatch):
    """Broadcast or shuffled, the places of core k-mers are the same."""
    found = kmers.numbered_kmers(frame(spark, SMALL), 8)
    core = kmers.core_kmers(found, 2, list(SMALL))
    few = sorted(map(tuple, kmers.core_hits(found, core).collect()))
    monkeypatch.setattr(kmers, "FEW", 0)
    assert few and sorted(map(tuple, kmers.core_hits(found, core).collect())) == few


def test_region_ids(spark):
    rows = [("g", "c", i, 10 * i) for i in range(11)] + [("g", "d", 0, 5)]
    got = {r["id"] for r in regions.region_ids(spark.createDataFrame(rows, "genome string, contig string, island long, first_pos long")).collect()}
    assert got == {f"c_{i:02}" for i in range(11)} | {"d_0"}

"""What queries shuffle: it grows with their input, and stays well below a row for each position."""

import random
from collections import Counter

import pytest

from kinweave import queries as Q
from kinweave.operators import chunks, compare, kmers, locate, regions
from kinweave.params import Params
from kinweave.plans import find


def shuffled(spark, run):
    """What run returns, and the bytes that it shuffled."""
    context = spark.sparkContext._jsc.sc()

    def total():
        context.listenerBus().waitUntilEmpty()
        found = context.statusStore().executorList(True)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before = total()
    return run(), total() - before


def drawn(r, n, alphabet="ACGT"):
    return "".join(r.choice(alphabet) for _ in range(n))


def framed(spark, rows, prefix):
    return spark.createDataFrame([(f"{prefix}{i}", x) for i, x in enumerate(rows)], "id string, seq string")


def test_containment_shuffles_texts_not_windows(spark):
    r = random.Random(1)
    long = [drawn(r, 2000) for _ in range(300)]
    few = [long[7][500:560], long[9][:12], long[11][3:19], drawn(r, 40)]
    found, volume = shuffled(spark, lambda: {tuple(x) for x in compare.contained_pairs(framed(spark, long, "a"), framed(spark, few, "b"), 16).collect()})
    assert found >= {("a7", "b0"), ("a9", "b1"), ("a11", "b2")} and "b3" not in {b for _, b in found}
    assert volume < 3 * sum(map(len, long))


def test_minimal_set_shuffles_few_keys(spark):
    r = random.Random(2)
    long = [drawn(r, 2000) for _ in range(300)]
    parts = [x[a : a + n] for x, a, n in zip(long, range(0, 900, 3), [3, 12, 15, 16, 17, 24, 31, 32, 33, 70] * 30)]
    found, volume = shuffled(spark, lambda: {x["seq"] for x in compare.minimal_set(framed(spark, long + parts, "a"), 16).collect()})
    assert found == set(long)
    assert volume < 40 * sum(map(len, long))


def test_minimal_set_by_brute_force(spark):
    r = random.Random(3)
    texts = {drawn(r, r.randrange(0, 30), "Aé") for _ in range(250)} | {drawn(r, 9) for _ in range(100)} | {drawn(r, 2) * r.randrange(1, 12) for _ in range(60)}
    want = {x for x in texts if x == "" or not any(x != y and x in y for y in texts)}
    for block in (2, 4, 8):
        assert {x["seq"] for x in compare.minimal_set(framed(spark, sorted(texts), "a"), block).collect()} == want


def test_minimal_set_sends_no_candidates_by_chance(spark):
    """Lines of few words share the strings of a block by chance, each with a share of all others; most are part of none."""
    r = random.Random(8)
    words = [drawn(r, 7) for _ in range(6)]
    lines = sorted({"".join(r.choice(words) for _ in range(r.randrange(4, 6)))[r.randrange(7) :] for _ in range(9000)})
    r.shuffle(lines)
    volumes = []
    for some in (lines[:1500], lines):
        found, volume = shuffled(spark, lambda x=some: {x["seq"] for x in compare.minimal_set(framed(spark, x, "a"), 16).collect()})
        every = "\n".join(some)
        assert found == {x for x in some if every.count(x) == 1}
        volumes.append(volume / len(every))
    assert max(volumes) < 6.5


def test_minimal_set_without_broadcast(spark, monkeypatch):
    r = random.Random(9)
    texts = {drawn(r, r.randrange(0, 30), "Aé") for _ in range(250)} | {drawn(r, 40)[: r.randrange(41)] for _ in range(60)}
    want = {x for x in texts if x == "" or not any(x != y and x in y for y in texts)}
    monkeypatch.setattr(compare, "FEW_TEXTS", 0)
    assert {x["seq"] for x in compare.minimal_set(framed(spark, sorted(texts), "a"), 8).collect()} == want


def test_contained_pairs_by_brute_force_without_broadcast(spark, monkeypatch):
    r = random.Random(4)
    a, b = ([drawn(r, r.randrange(0, 26), "AC") for _ in range(80)] for _ in range(2))
    rc = lambda x: x[::-1].translate(str.maketrans("ACGT", "TGCA"))
    inside = lambda x, y: x != "" and (x in y or rc(x) in y)
    want = {(f"a{i}", f"b{j}") for i, x in enumerate(a) for j, y in enumerate(b) if (inside(x, y) if len(x) <= len(y) else inside(y, x))}
    for few in (compare.FEW, 20):
        monkeypatch.setattr(compare, "FEW", few)
        assert {tuple(x) for x in compare.contained_pairs(framed(spark, a, "a"), framed(spark, b, "b"), 4).collect()} == want


def genomes_of(spark, r):
    """Genomes that share texts, one without a name; contigs over a chunk's end, empty, short and with other letters."""
    common = drawn(r, 90_000)
    rows = [(g, f"c{i}", common[a : a + n]) for i, (g, a, n) in enumerate([("a", 0, 90_000), ("b", 100, 70_000), ("c", 60_000, 9_000), ("a", 5, 4), ("b", 0, 0), ("d", 40, 31), (None, 10, 3000)])]
    return spark.createDataFrame([*rows, ("c", "n", common[:50] + "N" + common[50:99].lower()), ("d", "r", common[::-1].translate(str.maketrans("ACGT", "TGCA"))[:2000])], "genome string, contig string, seq string")


def test_core_places_and_runs_are_those_of_the_join(spark, monkeypatch):
    monkeypatch.setattr(kmers, "PART", 20_000)
    rows, names = genomes_of(spark, random.Random(5)), ["a", "b", None, "c", "d"]
    for k, least in ((16, 3), (5, 5), (24, 2)):
        found = kmers.oriented_kmers(rows, k)
        want = {tuple(x) for x in kmers.core_hits(found, kmers.core_kmers(found, least, names)).collect()}
        assert {tuple(x) for x in kmers.core_places(rows, k, least, names).collect()} == want and want
        runs = kmers.core_runs(rows, k, least, names)
        assert sorted(str((x["genome"], x["contig"], i)) for x in runs.collect() for i in range(x["first"], x["last"] + 1)) == sorted(str((x[0], x[1], x[2])) for x in want)
        hits = spark.createDataFrame(list(want), "genome string, contig string, pos long, kmer long, dir int")
        for f in (lambda x: regions.candidate_regions(x, k, 4, 24), locate.hit_coverage):
            assert {tuple(x) for x in f(runs).collect()} == {tuple(x) for x in f(hits).collect()}
    counts = {tuple(x) for x in kmers.kmer_counts(kmers.numbered_kmers(rows, 7)).collect()}
    assert {tuple(x) for x in kmers.genome_counts(rows, 7, names).select("genome", "kmer", "n").collect()} == counts


def test_runs_that_overlap_count_positions_once(spark):
    twice = spark.createDataFrame([("g", "c", 0, 9, 10), ("g", "c", 2, 3, 2), ("g", "c", 8, 12, 5), ("g", "c", 20, 20, 1)], "genome string, contig string, first long, last long, n long")
    assert [tuple(x) for x in locate.hit_coverage(twice).collect()] == [("g", "c", 14)]
    assert [(x["first_pos"], x["last_pos"], x["n"]) for x in regions.candidate_regions(twice, 3, 0, 10).collect()] == [(0, 12, 17)]


def test_core_runs_shuffle_no_places(spark, tmp_path, monkeypatch):
    """A text that five genomes hold eight times each: its places are not shuffled, whatever the number of core k-mers."""
    from kinweave import queries

    monkeypatch.setattr(kmers, "FEW", 0)  # as with more core k-mers than are broadcast
    r = random.Random(6)
    text = drawn(r, 100_000)
    rows = [(8 * g + i, f"s{g}", text) for g in range(5) for i in range(8)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    places = 40 * (len(text) - 15)
    for name in ("w1_regions", "a9_hit_coverage"):
        found, volume = shuffled(spark, lambda: queries.QUERIES[name](spark, str(tmp_path)).collect())
        assert len(found) == 40
        assert volume < 5 * places


def test_elements_of_like_lengths_share_a_pass_and_no_text_is_shuffled(spark, monkeypatch):
    r = random.Random(7)
    texts = [drawn(r, 20_000) for _ in range(40)]
    known, want = [], set()
    for i, n in enumerate([*range(64, 128, 3), 30]):
        x = list(texts[i][50 + i : 50 + i + n])
        for at in r.sample(range(n), i % 4):
            x[at] = {"A": "C", "C": "G", "G": "T", "T": "A"}[x[at]]
        known.append("".join(x))
        want.add((f"k{i}", f"t{i}", 50 + i, 50 + i + n, "+", i % 4))
    passes = []
    monkeypatch.setattr(locate, "kmers", lambda *a, f=locate.kmers, **b: (passes.append(a[1]), f(*a, **b))[1])
    rows = framed(spark, texts, "t").selectExpr("'g' AS genome", "id AS contig", "seq")
    found, volume = shuffled(spark, lambda: {(x["id"], x["contig"], x["start"], x["end"], x["strand"], x["mismatches"]) for x in locate.locate_all(framed(spark, known, "k"), rows, 3, seed=24).collect()})
    assert found == want
    assert len(passes) == 2 and volume < sum(map(len, texts)) / 4


def read(spark, run):
    """The bytes of tables that run read."""
    context = spark.sparkContext._jsc.sc()

    def total():
        context.listenerBus().waitUntilEmpty()
        found = context.statusStore().executorList(True)
        return sum(found.apply(i).totalInputBytes() for i in range(found.size()))

    before = total()
    run()
    return total() - before


@pytest.mark.parametrize("name", ["g1_acyclic", "k10_contiguity", "g2_reduce_until_acyclic", "g7_f15_intact_blocks", "f15_in_blocks", "n_block_ends"])
def test_queries_on_order_join_their_tables_once(spark, name):
    d = "/root/testdata/sf0.001"
    once = read(spark, lambda: Q.anchors(spark, d).collect())
    assert 0 < once and read(spark, lambda: Q.QUERIES[name](spark, d).collect()) < 1.5 * once


def copies(r, docs, passages):
    """Genomes whose texts hold passages in orders of their own, so no two texts are equal and each passage has many places."""
    return [(f"g{g}", f"c{i}", drawn(r, 5).join(r.sample(passages, 6))) for g in range(6) for i in range(docs)]


@pytest.mark.parametrize("instances", [False, True])
def test_shared_elements_make_no_pairs_of_places(spark, instances):
    """Four times the texts shuffle about four times as much, though pairs of their places are sixteen times as many."""
    r = random.Random(10)
    passages = [drawn(r, 60) for _ in range(12)]
    p = Params(min_length=24, kmer=16, kmer_threshold=0.5, max_occurrences=1000)
    volumes = []
    for docs in (30, 120):
        rows = copies(r, docs, passages)
        df = spark.createDataFrame(rows, "genome string, contig string, seq string")
        run = find.find_instances if instances else find.find_shared
        found, volume = shuffled(spark, lambda run=run, df=df: run(df, p).collect())
        assert len(found) >= (6 * docs * 6 if instances else 12)
        volumes.append(volume / sum(len(x[2]) for x in rows))
    assert volumes[1] < 1.3 * volumes[0]


def test_exact_places_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK", 64)
    r = random.Random(11)
    flip = lambda x: x[::-1].translate(str.maketrans("ACGT", "TGCA"))
    texts = [(g, f"c{i}", drawn(r, r.randrange(0, 300), "ACGT" if i else "AC\u00e9\U0001f600")) for g in "ab" for i in range(4)] + [("a", "r", "ACAC" * 50), ("b", "n", None)]
    known = ({drawn(r, r.randrange(3, 6)) for _ in range(20)} | {x[2][a : a + n] for x in texts[1:4] for a, n in ((10, 40), (60, 9), (62, 70))} | {"ACACACAC", "ACGT", "AC\u00e9", "A" * 90}) - {""}
    elements = spark.createDataFrame([(f"e{i}", x) for i, x in enumerate(sorted(known))] + [("n", None), ("m", "")], "id string, seq string")
    want = {(f"e{i}", g, c, a, a + len(x), strand) for i, x in enumerate(sorted(known)) for strand, q in (("+", x), ("-", flip(x))) if strand == "+" or q != x for g, c, t in texts for a in range(len(t or "")) if t.startswith(q, a)}
    df = spark.createDataFrame(texts, "genome string, contig string, seq string")
    for few, once in ((locate.FEW_BEGINNINGS, locate.AT_ONCE), (0, 7)):
        monkeypatch.setattr(locate, "FEW_BEGINNINGS", few)
        monkeypatch.setattr(locate, "AT_ONCE", once)
        assert {tuple(x)[:6] for x in locate.locate_exact(elements, df).collect()} == want
        told = [tuple(x)[:6] for x in locate.locate_exact(elements, df, 1).collect()]
        often = lambda rows: {k for k, n in Counter((x[0], x[1]) for x in rows).items() if n > 1}
        assert often(told) == often(want) and len(set(told)) == len(told) < len(want)
        assert {x for x in want if x[:2] not in often(want)} <= set(told) <= want

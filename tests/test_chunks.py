"""Chunks of long contigs and places found in them, line numbers, places with gaps: against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from kinweave.operators import chunks, locate, regions, synteny
from kinweave.sources import readers


def letters(seed, n, of="ACGT"):
    return "".join(random.Random(seed).choices(of, k=n))


@pytest.mark.parametrize("size,overlap", [(8, 0), (8, 3), (8, 8), (8, 19), (64, 5)])
def test_chunks_with_overlap(spark, size, overlap):
    texts = {"a": letters(1, 61), "b": letters(2, 8), "c": "", "d": "G"}
    rows = spark.createDataFrame([("g", c, t) for c, t in texts.items()] + [("g", "e", None)], "genome string, contig string, seq string")
    expected = {(c, i, t[i * size : (i + 1) * size + overlap]) for c, t in texts.items() for i in range(max(1, -(-len(t) // size)))}
    plain = chunks.chunked(rows, size)
    for found in (chunks.chunked(rows, size, overlap), chunks.overlapping(plain, size, overlap)):
        assert sorted((r["contig"], r["chunk"], r["seq"]) for r in found.collect()) == sorted(expected)
    assert {(r["contig"], r["length"]) for r in chunks.lengths(plain, size).collect()} == {(c, len(t)) for c, t in texts.items()}


@pytest.mark.parametrize("whole", [True, False])
def test_subsequences(spark, whole):
    texts = {"a": letters(3, 61, "acgtN"), "b": "", "c": "ac"}
    rows = spark.createDataFrame([("g", c, t) for c, t in texts.items()], "genome string, contig string, seq string")
    draw = random.Random(4)
    spans = [(str(i), "g", draw.choice("abc"), a, a + draw.choice([0, 1, 7, 8, 9, 40])) for i in range(60) for a in [draw.randrange(70)]]
    spans += [spans[0], spans[0], ("x", "g", "missing", 3, 9)]
    given = spark.createDataFrame(spans, "id string, genome string, contig string, start long, end long")
    found = chunks.subsequences(given, rows if whole else chunks.chunked(rows, 8), 8)
    expected = sorted((*x, texts.get(x[2], "")[x[3] : x[4]].upper()) for x in spans)
    assert sorted(tuple(r) for r in found.collect()) == expected


def test_fasta_chunks(spark, tmp_path):
    """Splits of a few hundred bytes: records go on over many of them, headers stand anywhere in them."""
    draw = random.Random(5)
    texts = {("g", "long"): letters(6, 9000), ("g", "short"): "AC", ("g", "empty"): "", ("g", "next"): letters(7, 1500), ("h", "one"): letters(8, 300)}
    for genome in "gh":
        lines = [] if genome == "h" else ["no record"]
        for (g, contig), t in texts.items():
            if g == genome:
                width = draw.choice([7, 60, 61])
                lines += [f">{contig} of {g}", *[t[i : i + width] for i in range(0, len(t), width)], ""]
        (tmp_path / f"{genome}.fa").write_text("\n".join(lines) + "\n")
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        read = readers.fasta_chunks(spark, str(tmp_path / "*.fa"), 256)
        assert spark.read.text(str(tmp_path / "g.fa")).select(F.spark_partition_id()).distinct().count() > 20
        rows = read.collect()
        names = readers.fasta(spark, str(tmp_path / "h.fa")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    expected = {(g, c, i, t[i * 256 : (i + 1) * 256]) for (g, c), t in texts.items() for i in range(max(1, -(-len(t) // 256)))}
    assert sorted(tuple(r) for r in rows) == sorted(expected)
    assert [(r["contig"], r["length"]) for r in names] == [("one", 300)]


def test_places_in_chunks(spark, monkeypatch):
    """Placing and windows of runs over many small chunks equal those over whole contigs."""
    text = letters(9, 900)
    rows = spark.createDataFrame([("g", "c", text), ("g", "d", text[300:420])], "genome string, contig string, seq string")
    changed = text[600:640] + ("A" if text[640] != "A" else "C") + text[641:690]
    elements = spark.createDataFrame([("x", text[310:400]), ("y", changed), ("z", text[5:30]), ("s", "AC")], "id string, seq string")
    expected = sorted(map(tuple, locate.locate_all(elements, rows, 2, 8).collect()))
    hits = rows.select("genome", "contig", F.explode(F.array(*[F.lit(i).cast("long") for i in (3, 5, 60, 63, 70, 80, 100)])).alias("pos"))
    windows = sorted(map(tuple, regions.run_windows(hits, rows, 16, 2, 20).collect()))
    assert len(windows) > 20 and all(w == dict(c=text, d=text[300:420])[c][s : s + 20] for _, c, s, w in windows)
    for module in (locate, regions, chunks):
        monkeypatch.setattr(module, "CHUNK", 64)
    for given in (rows, chunks.chunked(rows, 64)):
        assert sorted(map(tuple, locate.locate_all(elements, given, 2, 8).collect())) == expected
        assert sorted(map(tuple, regions.run_windows(hits, given, 16, 2, 20).collect())) == windows


def test_line_numbers(spark, tmp_path):
    lines = [f"chr{i % 3}\t{(i * 37) % 500}\t{(i * 37) % 500 + 9}\tu{i % 40}\t99.5" for i in range(300)]
    (tmp_path / "g.bed").write_text("\n".join(lines) + "\n")
    (tmp_path / "h.bed").write_text("\n".join(lines[::-1]) + "\n")
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        placed = readers.anchors(spark, str(tmp_path / "*.bed"))
        rows = placed.collect()
        first = synteny.contig_combinations(placed, ["g", "h"], "anchor_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    for genome, order in (("g", lines), ("h", lines[::-1])):
        assert [f"{r['contig']}\t{r['start']}\t{r['end']}\t{r['id']}\t{r['identity']}" for r in sorted((r for r in rows if r["genome"] == genome), key=lambda r: r["anchor_id"])] == order
        assert sorted(r["anchor_id"] for r in rows if r["genome"] == genome) == list(range(300))
    fields = [x.split("\t") for x in lines]
    at = lambda order, u, c: next(int(f[1]) for f in order if f[3] == u and f[0] == c)
    assert first and all(list(r["starts"]) == [at(fields, r["id"], r["contigs"][0]), at(fields[::-1], r["id"], r["contigs"][1])] for r in first)


def test_map_of_an_assembly(spark, tmp_path):
    text = letters(11, 2000)
    elements = {"u1": text[100:160], "u2": text[400:470], "u3": text[900:950], "u4": text[1500:1530], "absent": letters(12, 50)}
    turned = text[860:1000][::-1].translate(str.maketrans("ACGT", "TGCA"))
    (tmp_path / "a.fa").write_text(f">c1\n{text[:600]}\n{turned}\n{text[1000:1600]}\n>c2\n{text[380:480]}\n{text[90:170]}\n")
    edges = readers.order_map(spark, str(tmp_path / "a.fa"), "fasta", spark.createDataFrame(list(elements.items()), "id string, seq string"), 12)
    assert sorted(tuple(r) for r in edges.collect()) == [("u2", "u1", 1.0), ("u3", "u4", 1.0)]  # u1 and u2 count on the last contig
    with pytest.raises(ValueError):
        readers.order_map(spark, str(tmp_path / "a.fa"), "fasta")

"""K-mers: cutting, counting, support over genomes, places."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import canonical, reverse_complement
from .chunks import CHUNK, chunked
from .lineage import cut

#: Characters of a block; blocks overlap by k - 1, so that no long sequence is scanned from its start for each k-mer.
BLOCK = 256

#: Core k-mers that are broadcast at most.
FEW = 500_000

#: Letters of a part, about: one task makes its distinct k-mers.
PART = 1 << 20

#: Genomes whose presence one number holds.
BITS = 63


def kmers(sequences: DataFrame, k: int, dna: bool = True, canonicalise: bool = True, stride: int = 1, by: tuple[str, ...] = ("genome", "contig")) -> DataFrame:
    """(by..., pos, kmer) of sequences (by..., seq) at the multiples of stride, a power of two below BLOCK; with dna, k-mers
    of other letters are left out."""
    length = F.length("seq")
    starts = F.when(length >= k, F.sequence(F.lit(0), length - k, F.lit(BLOCK)))
    blocks = sequences.select(*by, F.col("seq"), F.explode(starts).alias("at"))
    blocks = blocks.select(*by, "at", F.substring(F.col("seq"), F.col("at") + 1, F.lit(BLOCK + k - 1)).alias("block"))  # of k characters at least
    cut = F.transform(F.sequence(F.lit(1), F.length("block") - k + 1, F.lit(stride)), lambda i: F.substring(F.col("block"), i, F.lit(k)))
    out = blocks.select(*by, "at", F.posexplode(cut).alias("i", "kmer"))
    if dna:
        out = out.withColumn("kmer", F.upper("kmer")).where(F.col("kmer").rlike("^[ACGT]+$"))
    kmer = canonical(F.col("kmer")) if canonicalise else F.col("kmer")
    return out.select(*by, (F.col("at") + F.col("i") * stride).cast("long").alias("pos"), kmer.alias("kmer"))


#: The number of each letter, 4 for all others.
_NUMBERS = np.full(256, 4, np.uint8)
_NUMBERS[np.frombuffer(b"ACGTacgt", np.uint8)] = [0, 1, 2, 3] * 2
#: Letters of a contig that are numbered at once.
STRETCH = 1 << 20


def numbers(seq: bytes, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, canonical numbers and directions of all k-mers of the letters A, C, G, T in a stretch.

    The direction is 1 where the k-mer itself is canonical, -1 where its reverse complement is, 0 where they are equal.
    """
    x = _NUMBERS[np.frombuffer(seq, np.uint8)]
    n = len(x) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    forward, backward, odd = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    for i in range(k):
        at = x[i : i + n]
        odd |= at > 3
        forward = forward << 2 | (at & 3)
        backward = backward << 2 | (3 - (x[k - 1 - i : k - 1 - i + n] & 3))
    good = np.flatnonzero(~odd)
    return good, np.minimum(forward, backward)[good], np.sign(backward - forward)[good].astype(np.int32)


def _numbered(k: int, oriented: bool):
    def run(batches):
        for batch in batches:
            rows: list[np.ndarray] = []
            places: list[np.ndarray] = []
            codes: list[np.ndarray] = []
            dirs: list[np.ndarray] = []
            size = 0

            def flush():
                of = pa.array(np.concatenate(rows))
                columns = [batch.column("genome").take(of), batch.column("contig").take(of), *[pa.array(np.concatenate(x)) for x in (places, codes, *([dirs] if oriented else []))]]
                return pa.RecordBatch.from_arrays(columns, ["genome", "contig", "pos", "kmer", "dir"][: len(columns)])

            for i, seq in enumerate(batch.column("seq").cast(pa.binary()).to_pylist()):
                for a in range(0, max(1, len(seq or b"") - k + 1), STRETCH):
                    at, code, direction = numbers((seq or b"")[a : a + STRETCH + k - 1], k)
                    rows.append(np.full(len(at), i))
                    places.append(at + a)
                    codes.append(code)
                    dirs.append(direction)
                    size += len(at)
                    if size >= STRETCH:
                        yield flush()
                        rows, places, codes, dirs, size = [], [], [], [], 0
            if size:
                yield flush()

    return run


def numbered_kmers(sequences: DataFrame, k: int) -> DataFrame:
    """kmers with each k-mer as one number, of two bits a letter: the order is that of the canonical letters. k is at most 31."""
    if not 0 < k <= 31:
        raise ValueError("a k-mer of more than 31 letters is no 64-bit number")
    return sequences.select("genome", "contig", "seq").mapInArrow(_numbered(k, False), "genome string, contig string, pos long, kmer long")


def oriented_kmers(sequences: DataFrame, k: int) -> DataFrame:
    """(genome, contig, pos, kmer, dir): canonical k-mers with their direction as in numbers; kmer is a number up to k = 31."""
    if k <= 31:
        return sequences.select("genome", "contig", "seq").mapInArrow(_numbered(k, True), "genome string, contig string, pos long, kmer long, dir int")
    found = kmers(sequences, k, canonicalise=False)
    one = canonical(F.col("kmer"))
    direction = F.when(F.col("kmer") < reverse_complement(F.col("kmer")), 1).when(F.col("kmer") > one, -1).otherwise(0)
    return found.select("genome", "contig", "pos", one.alias("kmer"), direction.alias("dir"))


def letters(kmer: str, k: int) -> Column:
    """The letters of a k-mer's number."""
    return F.translate(F.lpad(F.conv(F.col(kmer).cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def kmer_counts(found: DataFrame) -> DataFrame:
    """Occurrences by genome."""
    return found.groupBy("genome", "kmer").agg(F.count(F.lit(1)).alias("n"))


def core_kmers(found: DataFrame, min_support: int, genomes: list[str] | None = None) -> DataFrame:
    """K-mers in at least min_support genomes, with their support.

    Where all genomes' names are given, presence is a bit for each in one aggregation, which combines before it shuffles;
    without them, presence is made distinct per genome before genomes are counted.
    """
    if genomes is None:
        present = found.select("genome", "kmer").distinct()
        return present.groupBy("kmer").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= min_support)
    names = [F.lit(g) for g in genomes if g is not None]
    number = F.coalesce(F.array_position(F.array(*names), F.col("genome")), F.lit(0)) if names else F.lit(0).cast("long")  # 0: a genome without a name
    words = range(len(names) // BITS + 1)
    bit = lambda w: F.bit_or(F.when(F.floor(F.col("number") / BITS) == w, F.expr(f"shiftleft(1L, cast(number % {BITS} AS int))")))
    counted = found.select("kmer", number.alias("number")).groupBy("kmer").agg(*[bit(w).alias(f"w{w}") for w in words])
    support = sum((F.coalesce(F.bit_count(f"w{w}"), F.lit(0)) for w in words), F.lit(0)).cast("long")
    return counted.select("kmer", support.alias("support")).where(F.col("support") >= min_support)


def core_hits(found: DataFrame, core: DataFrame) -> DataFrame:
    """Places of core k-mers, which are counted first: up to FEW are broadcast, so that places are left out where they are
    made and none is shuffled; more are joined by shuffle, with the same rows."""
    core = cut(core.select("kmer"))
    return found.join(F.broadcast(core) if core.count() <= FEW else core, "kmer", "left_semi").select(found.columns)


def parted(sequences: DataFrame, k: int, genomes: list[str]) -> DataFrame:
    """(part, genome, contig, at, seq): stretches of sequences from at on, which overlap by k - 1, dealt to parts of about PART
    letters of one genome; a part's number divided by 2 ** 32 is the genome's place in genomes from 1, 0 without a name."""
    names = [F.lit(g) for g in genomes if g is not None]
    number = F.coalesce(F.array_position(F.array(*names), F.col("genome")), F.lit(0)).cast("long") if names else F.lit(0).cast("long")
    chunks = cut(chunked(sequences, CHUNK, k - 1).select("genome", "contig", "chunk", "seq", number.alias("number")))
    sizes = {r["number"]: r["n"] for r in chunks.groupBy("number").agg(F.sum(F.length("seq")).alias("n")).collect()}  # a row a genome
    of = F.array(*[F.lit(1 + sizes.get(i, 0) // PART).cast("long") for i in range(len(names) + 1)])
    part = F.shiftleft("number", 32) + F.pmod(F.xxhash64("contig", "chunk"), F.get(of, F.col("number").cast("int")))
    return chunks.select(part.alias("part"), "genome", "contig", (F.col("chunk") * CHUNK).alias("at"), "seq")


def _joined(rows: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, places in the row's text, numbers and directions of the k-mers of a part; texts are set apart by a letter that is none."""
    texts = rows.column("seq").cast(pa.binary()).to_pylist()
    begin = np.cumsum([0, *[len(x) + 1 for x in texts]])
    at, code, direction = numbers(b"-".join(texts), k)
    row = np.searchsorted(begin, at, "right") - 1
    return row, at - begin[row], code, direction


def _counted(k: int):
    def run(rows: pa.Table) -> pa.Table:
        kmer, n = np.unique(_joined(rows, k)[2], return_counts=True)
        return pa.table({"part": pa.repeat(rows.column("part")[0], len(kmer)), "kmer": kmer, "n": n})

    return run


def part_counts(parts: DataFrame, k: int) -> DataFrame:
    """(part, kmer, n): occurrences by part of the k-mers, which are numbers, of parted sequences."""
    return parts.groupBy("part").applyInArrow(_counted(k), "part long, kmer long, n long")


def genome_counts(sequences: DataFrame, k: int, genomes: list[str]) -> DataFrame:
    """(genome, kmer, n): kmer_counts of sequences whose genomes' names are known; all rows of a k-mer are in one partition."""
    counts = part_counts(parted(sequences, k, genomes), k).repartition("kmer")
    names = [F.lit(g) for g in genomes if g is not None]
    name = F.get(F.array(F.lit(None).cast("string"), *names), F.col("number").cast("int"))
    counts = counts.groupBy("kmer", F.shiftright("part", 32).alias("number")).agg(F.sum("n").alias("n"))
    return counts.select(name.alias("genome"), "kmer", "n")


def _core_parts(parts: DataFrame, k: int, min_support: int, genomes: list[str]) -> DataFrame:
    """(part, kmer) of k-mers that at least min_support genomes hold, for each part that holds them."""
    held = part_counts(parts, k).select("part", "kmer").withColumn("number", F.shiftright("part", 32))
    of = Window.partitionBy("kmer")  # a row a part
    words = range(sum(g is not None for g in genomes) // BITS + 1)
    bit = lambda w: F.bit_or(F.when(F.floor(F.col("number") / BITS) == w, F.expr(f"shiftleft(1L, cast(number % {BITS} AS int))"))).over(of)
    support = sum((F.coalesce(F.bit_count(bit(w)), F.lit(0)) for w in words), F.lit(0))
    return held.withColumn("support", support).where(F.col("support") >= min_support).select("part", "kmer")


def _found(k: int, runs: bool):
    def run(rows: pa.Table, core: pa.Table) -> pa.Table:
        names = ["genome", "contig", "first", "last", "n"] if runs else ["genome", "contig", "pos", "kmer", "dir"]
        if not rows.num_rows or not core.num_rows:
            return pa.table([pa.array([], t) for t in (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64() if runs else pa.int32())], names=names)
        row, at, code, direction = _joined(rows, k)
        known = np.sort(core.column("kmer").to_numpy())
        good = np.flatnonzero(known[np.minimum(np.searchsorted(known, code), len(known) - 1)] == code)
        row, at, code, direction = row[good], at[good], code[good], direction[good]
        pos = at + rows.column("at").to_numpy()[row]
        if not runs:
            return pa.table([rows.column("genome").take(pa.array(row)), rows.column("contig").take(pa.array(row)), pos, code, direction], names=names)
        new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)][: len(row)])
        of, size = pa.array(row[new]), np.diff(np.r_[new, len(row)])
        return pa.table([rows.column("genome").take(of), rows.column("contig").take(of), pos[new], pos[new] + size - 1, size], names=names)

    return run


def _core(sequences: DataFrame, k: int, min_support: int, genomes: list[str], runs: bool) -> DataFrame:
    parts = parted(sequences, k, genomes)
    columns = "first long, last long, n long" if runs else "pos long, kmer long, dir int"
    found = parts.groupBy("part").cogroup(_core_parts(parts, k, min_support, genomes).groupBy("part")).applyInArrow(_found(k, runs), f"genome string, contig string, {columns}")
    return found


def core_places(sequences: DataFrame, k: int, min_support: int, genomes: list[str]) -> DataFrame:
    """(genome, contig, pos, kmer, dir): core_hits of sequences whose genomes' names are known. k is at most 31.

    A part's distinct k-mers are sent to be counted, and those with support come back to the part, where its texts meet
    them: no place is shuffled, however many k-mers have support.
    """
    return _core(sequences, k, min_support, genomes, False)


def core_runs(sequences: DataFrame, k: int, min_support: int, genomes: list[str]) -> DataFrame:
    """(genome, contig, first, last, n): core_places as runs of neighbouring positions; one that crosses a chunk's end is two."""
    return _core(sequences, k, min_support, genomes, True)


def within_limit(hits: DataFrame, limit: int) -> DataFrame:
    """Hits of k-mers that have at most limit places in every genome."""
    many = hits.groupBy("genome", "kmer").count().where(F.col("count") > limit).select("kmer").distinct()
    return hits.join(many, "kmer", "left_anti")


def named(core: DataFrame) -> DataFrame:
    """K-mers with ids c1..cN in their order."""
    return ranked(core.select("kmer"), "kmer").select(F.concat(F.lit("c"), (F.col("rank") + 1).cast("string")).alias("id"), "kmer")


def ranked(rows: DataFrame, by: str) -> DataFrame:
    """rows with their rank from 0 in the order of by, a column of distinct values.

    Range partitions are ranked on their own; the rows of the partitions before, one number each, are added.
    """
    placed = cut(rows.repartitionByRange(by).withColumn("part", F.spark_partition_id()))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    within = F.row_number().over(Window.partitionBy("part").orderBy(by)) - 1
    return placed.join(sizes.select("part", before.alias("before")), "part").select(*rows.columns, (F.col("before") + within).cast("long").alias("rank"))

"""Comparison of element sets and intervals: containment, minimal sets, overlaps, first matches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import contains_either_strand, reverse_complement
from .kmers import kmers
from .lineage import cut


#: Keys that are broadcast at most; with more, rows and keys are joined by shuffle.
FEW = 100_000
#: Texts below two blocks that are broadcast at most, about 100 bytes each.
FEW_TEXTS = 1_000_000
#: Sizes of text, each twice the one before, that have keys of their own.
CLASSES = 3


def _numbered_rows(sequences: DataFrame, *columns: str) -> DataFrame:
    """Columns of sequences with row, a number, from a checkpoint: lines are few bytes but much work, so they are spread."""
    spread = sequences.select(*columns).repartition(int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut(spread.withColumn("row", F.monotonically_increasing_id()))


def _few(keys: DataFrame, most: int | None = None) -> DataFrame:
    """keys, to be broadcast where they are few: what they are joined to is then left out where it is made and not shuffled."""
    keys, most = cut(keys), FEW if most is None else most
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def _short(texts: DataFrame) -> bool:
    """Whether texts have at most FEW characters in all."""
    return (texts.agg(F.sum(F.length("seq").cast("long"))).first()[0] or 0) <= FEW


def short_windows(sequences: DataFrame, lengths: list[int]) -> DataFrame:
    """(row, window) of the parts of some lengths, all below a block, of sequences (row, seq)."""
    sized = sequences.select("row", "seq", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")).alias("n")).where(F.length("seq") >= F.col("n"))
    return sized.select("row", F.explode(F.transform(F.sequence(F.lit(1), F.length("seq") - F.col("n") + 1), lambda i: F.substring(F.col("seq"), i, F.col("n")))).alias("window"))


def _lengths_below(sequences: DataFrame, block: int) -> list[int]:
    return sorted(r["n"] for r in sequences.select(F.length("seq").alias("n")).where(F.col("n") < block).distinct().collect())  # block values at most


def _rarest_parts(small: DataFrame, large: DataFrame, block: int) -> DataFrame:
    """(small, large): rows of small texts of at least block characters, and of the others that hold the rarest of their parts.

    small: (row, strand, text); large: (row, seq). A text's parts of block characters lie side by side; all are in whatever
    holds the text, so its rarest one is enough, and a part that nothing holds rules the text out. Common beginnings so are
    no hot keys. Only places of parts are shuffled, and, where the others are few, only texts whose first part they hold.
    """
    places = kmers(large.select(F.lit("").alias("genome"), F.col("row").alias("contig"), "seq"), block, dna=False, canonicalise=False).select(F.col("contig").alias("large"), "kmer")
    if _short(large):
        small = small.join(_few(places.select(F.col("kmer").alias("first")).distinct()), F.substring("text", 1, block) == F.col("first"), "left_semi")
    cut_up = F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / block).cast("int") - 1), lambda i: F.substring(F.col("text"), i * block + 1, F.lit(block)))
    parts = cut(small.select(F.col("row").alias("small"), "strand", F.explode(cut_up).alias("kmer")))
    held = cut(places.join(_few(parts.select("kmer").distinct()), "kmer", "left_semi").distinct())
    counts = held.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
    rarest = parts.join(counts, "kmer", "left").groupBy("small", "strand").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "kmer")).alias("part"))
    return rarest.where("part.n > 0").select("small", F.col("part.kmer").alias("kmer")).join(held, "kmer").select("small", "large").distinct()


def contained_pairs(a: DataFrame, b: DataFrame, block: int) -> DataFrame:
    """(id_a, id_b) where the shorter of two sequences, or its reverse complement, is part of the longer.

    Two such sequences share every part of block characters of the shorter on one strand, so candidates meet by the
    rarest of them; sequences shorter than block meet the parts of their own length. Empty sequences are part of nothing.
    """
    pairs = None
    a, b = (_numbered_rows(x, "id", "seq") for x in (a, b))
    for x, y, flip in ((a, b, False), (b, a, True)):
        both = x.where(F.length("seq") >= block).select("row", F.posexplode(F.array("seq", reverse_complement(F.col("seq")))).alias("strand", "text"))
        found = _rarest_parts(both, y.select("row", "seq"), block)
        found = found.join(x.select(F.col("row").alias("small"), F.col("id").alias("id_s"), F.col("seq").alias("seq_s")), "small").join(y.select(F.col("row").alias("large"), F.col("id").alias("id_l"), F.col("seq").alias("seq_l")), "large")
        found = found.where((F.length("seq_s") <= F.length("seq_l")) & contains_either_strand(F.col("seq_s"), F.col("seq_l"))).select("id_s", "id_l")
        tiny = x.where((F.length("seq") > 0) & (F.length("seq") < block))
        turned = tiny.select(F.col("id").alias("id_s"), F.explode(F.array_distinct(F.array("seq", reverse_complement(F.col("seq"))))).alias("window"))
        windows = short_windows(y, _lengths_below(tiny, block))
        if _short(y):  # few windows against any number of texts; else the other way round
            met = turned.join(_few(windows.distinct()), "window")
        else:
            met = windows.join(_few(turned), "window")
        found = found.union(met.select("id_s", "row").distinct().join(y.select("row", F.col("id").alias("id_l")), "row").select("id_s", "id_l"))
        out = found.select(F.col("id_l" if flip else "id_s").alias("id_a"), F.col("id_s" if flip else "id_l").alias("id_b"))
        pairs = out if pairs is None else pairs.union(out)
    return pairs.distinct()


def first_match(pairs: DataFrame) -> DataFrame:
    """The smallest id_b of each id_a."""
    return pairs.groupBy("id_a").agg(F.min("id_b").alias("id_b"))


def _least_keys(k: int, size: int, upto: int | None):
    """For rows (row, seq): the least of the mixed numbers of the k-byte strings in each window of size bytes, where it changes;
    own tells whether the text has less than upto bytes."""

    def run(batches):
        for batch in batches:
            texts = [x.encode() for x in batch.column("seq").to_pylist()]
            sizes = np.array([len(x) for x in texts])
            of = np.repeat(np.arange(len(texts)), sizes)
            x = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
            if len(x) < size:
                continue
            n = len(x) - k + 1
            least = np.full(n, size, np.uint64)  # strings of several lengths share no number
            for i in range(k):
                least = least * np.uint64(0x100000001B3) + x[i : i + n]
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
                least = (least ^ (least >> np.uint64(shift))) * np.uint64(factor)
            wide = 1
            while wide < size - k + 1:
                step = min(wide, size - k + 1 - wide)
                least = np.minimum(least[:-step], least[step:])
                wide += step
            inside = np.flatnonzero(np.arange(len(least)) + size <= np.cumsum(sizes)[of[: len(least)]])
            key, row = least[inside].view(np.int64), of[inside]
            new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])][: len(key)])
            own = (sizes < upto if upto else sizes >= 0)[row[new]]
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(row[new])), pa.array(key[new]), pa.array(own)], ["row", "key", "own"])

    return run


def least_keys(texts: DataFrame, size: int) -> DataFrame:
    """(row, key, own) of texts (row, seq): their least keys at size bytes, twice that, and so on for CLASSES sizes, as far as
    a text is long; own are those of its greatest size. Whatever holds a text has all keys of the text.

    A key is of five eighths of its size, so long texts meet by long keys, which few others have by chance.
    """
    found = None
    for i in range(CLASSES):
        n = size << i
        some = texts.where(F.octet_length("seq") >= n).select("row", "seq")
        keys = some.mapInArrow(_least_keys(n * 5 // 8, n, None if i == CLASSES - 1 else 2 * n), "row long, key long, own boolean")
        found = keys if found is None else found.union(keys)
    return found


def _rarest_keys(keys: DataFrame) -> DataFrame:
    """(small, large): rows of texts with own keys, and of the others that have the rarest of these; keys are (row, key, own)."""
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rarest = keys.where("own").join(counts, "key").groupBy("row").agg(F.min(F.struct("n", "key")).alias("x")).where("x.n > 1")  # one place is its own
    return rarest.select(F.col("row").alias("small"), "x.key").join(keys.select(F.col("row").alias("large"), "key"), "key").where("small <> large").select("small", "large").distinct()


def _beginnings(texts: DataFrame, least: int, most: int) -> DataFrame:
    """(window) of texts (seq): up to most characters from each position that has least of them, but never a whole text."""
    n = F.length("seq")
    part = lambda i: F.substring(F.col("seq"), i, F.when(i == 1, F.least(F.lit(most), n - 1)).otherwise(most))
    return texts.where(n >= least).select(F.explode(F.transform(F.sequence(F.lit(1), n - least + 1), part)).alias("window"))


def held_within(short: DataFrame, texts: DataFrame, block: int) -> DataFrame:
    """(seq_s): the texts below two blocks of characters of short (seq_s) that are part of another one of texts (seq).

    A text is part of another one exactly if a window that is no whole text begins with it. The windows of half a block are
    few, and their beginnings are all shorter ones; longer texts meet windows by the least length of their class, classes of
    a third each, so few windows meet them by chance and only texts that are found leave the task.
    """
    half = max(1, block // 2)
    halves = _beginnings(texts, 1, half).distinct()
    found = halves.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("window")), lambda n: F.substring(F.col("window"), F.lit(1), n))).alias("seq_s")).distinct()
    found = found.join(short.where(F.length("seq_s") <= half), "seq_s", "left_semi")
    least = half + 1
    while least < 2 * block:
        most = min(2 * block - 1, least * 4 // 3)
        begin = lambda c: F.substring(c, 1, least).alias("begin")  # noqa: B023, E731
        some = _few(short.where(F.length("seq_s").between(least, most)).select("seq_s", begin("seq_s")), FEW_TEXTS)
        met = _beginnings(texts, least, most).select("window", begin("window")).join(some, "begin").where(F.startswith("window", "seq_s"))
        found = found.union(met.select("seq_s").distinct())
        least = most + 1
    return found


def minimal_set(elements: DataFrame, block: int) -> DataFrame:
    """Elements (id, seq) that are not part of another on the same strand; of equal ones the last id stays.

    Texts of two blocks of bytes and more meet by the rarest of their least keys, and all candidates are compared; of shorter
    ones it is only told whether any other text holds them, so no pairs arise.
    """
    single = _numbered_rows(elements.groupBy("seq").agg(F.max("id").alias("id")), "id", "seq")
    candidates = _rarest_keys(least_keys(single, 2 * block))
    small, big = single.select(F.col("row").alias("small"), F.col("seq").alias("seq_s")), single.select(F.col("row").alias("large"), F.col("seq").alias("seq_l"))
    part = candidates.join(small, "small").join(big, "large").where(F.contains("seq_l", "seq_s")).select("seq_s")
    short = small.where((F.octet_length("seq_s") > 0) & (F.octet_length("seq_s") < 2 * block)).select("seq_s")
    gone = part.union(held_within(short, single, block))
    return single.join(gone, single["seq"] == gone["seq_s"], "left_anti").select("id", "seq")


def recall_precision(pairs: DataFrame, expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row: expected and actual elements, how many of each are matched, recall and precision (null without elements)."""
    one = lambda df, c, n: df.select(c).distinct().agg(F.count(F.lit(1)).alias(n))
    row = one(expected, "id", "expected").join(one(actual, "id", "actual")).join(one(pairs, "id_a", "found")).join(one(pairs, "id_b", "matched"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return row.select("*", share("found", "expected").alias("recall"), share("matched", "actual").alias("precision"))


def overlaps(a: DataFrame, b: DataFrame, bin_size: int) -> DataFrame:
    """(contig, start, end, id_a, id_b) for each overlap of intervals (contig, start, end, id), with the part of a that b covers.

    Intervals meet in bins; of the bins that two share, the first one reports them, so no distinct is needed.
    """
    bins = lambda df, s: df.select("contig", F.col("start").alias(f"start_{s}"), F.col("end").alias(f"end_{s}"), F.col("id").alias(f"id_{s}"), F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.greatest("start", F.col("end") - 1)) / bin_size))).alias("bin"))
    start, end = F.greatest("start_a", "start_b"), F.least("end_a", "end_b")
    meet = bins(a, "a").join(bins(b, "b"), ["contig", "bin"]).where((F.col("start_a") < F.col("end_b")) & (F.col("start_b") < F.col("end_a")))
    return meet.where(F.col("bin") == F.floor(start / bin_size)).select("contig", start.alias("start"), end.alias("end"), "id_a", "id_b")

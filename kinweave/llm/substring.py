"""Removal of repeated word windows by super-k-mer partitioning.

Each window of WINDOW words has a minimiser, the smallest hash of its MINIMISER-word runs (the first of equals).
Consecutive windows with the minimiser at the same place form a super-k-mer. Equal windows have equal minimisers at
different places, so a minimiser found at one place in the corpus has no repeated window, and only super-k-mers of
the others travel, as one packed string each, to their minimiser's bucket. There the windows are sorted and equal
ones confirmed word by word. A minimiser of very many places is spread over several buckets by place; such a bucket
settles the windows that it holds twice, and the rest meet by window in a second count, where each bucket sends a
window once at most. So no bucket is unbounded, and no window is dropped.

Edge cases: null or empty text has no words; texts shorter than a window lose nothing; repeated rows count as
repeats of each other and are treated alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, rolled, steps, table, texts_of, word_hashes

WINDOW, MINIMISER = 35, 12
#: Places of a minimiser beyond which it is spread, and super-k-mers that a bucket holds on average.
SPREAD, BUCKET = 4000, 20_000


def row_key() -> list[Column]:
    """Rows of one key have the same doc_id and text, and so the same windows."""
    return [F.coalesce(F.col("doc_id"), F.lit(-(1 << 62))).alias("k1"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k2")]


def super_kmers(h: np.ndarray, offsets: np.ndarray, window: int, minimiser: int) -> tuple[np.ndarray, ...]:
    """Of documents end to end: minimiser, document, first window (word of the document) and windows of each super-k-mer."""
    m = rolled(h, minimiser)
    span, n = window - minimiser + 1, len(h) - window + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64))
    low, place, width = m, np.arange(len(m)), 1
    while width < span:  # doubling: the minimum over a span is that of two shorter spans that cover it
        by = min(width, span - width)
        a, b = low[: len(low) - by], low[by:]
        first = a <= b
        low, place, width = np.where(first, a, b), np.where(first, place[: len(low) - by], place[by:]), width + by
    start = np.arange(n)
    doc = np.searchsorted(offsets, start, side="right") - 1
    inside = start + window <= offsets[doc + 1]
    start, doc, place, low = start[inside], doc[inside], place[inside], low[inside]
    if not len(start):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64))
    new = np.concatenate(([True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])))
    at = np.flatnonzero(new)
    return low[at].astype(np.int64), doc[at], start[at] - offsets[doc[at]], np.diff(np.append(at, len(start)))


_SCANNED = "k1 long, k2 long, doc_id long, n_words long, sha256 string, places array<long>"


def _scanned(window: int, minimiser: int):
    def run(batches):
        for batch in batches:
            texts = texts_of(batch)
            for a, b in steps(texts):
                docs = [t.split() for t in texts[a:b]]
                low, doc, _, _ = super_kmers(*word_hashes(docs), window, minimiser)
                ends = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(docs))))).astype(np.int32)
                digests = [hashlib.sha256(b" ".join(d)).hexdigest() for d in docs]
                kept = [batch.column(c).slice(a, b - a) for c in ("k1", "k2", "doc_id")]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array([len(d) for d in docs], pa.int64()), pa.array(digests), pa.ListArray.from_arrays(pa.array(ends), pa.array(low))],
                    ["k1", "k2", "doc_id", "n_words", "sha256", "places"],
                )

    return run


_PACKED = "k1 long, k2 long, minimiser long, spread int, first long, n long, packed binary"


def _packed(window: int, minimiser: int):
    """Super-k-mers whose minimiser is among the row's shared ones."""

    def run(batches):
        for batch in batches:
            texts, shared = texts_of(batch), batch.column("shared").to_pylist()
            k1, k2 = (batch.column(c).to_pylist() for c in ("k1", "k2"))
            for a, b in steps(texts):
                docs = [t.split() for t in texts[a:b]]
                spread = [{s["minimiser"]: s["spread"] for s in x} for x in shared[a:b]]
                out = []
                for low, doc, first, n in zip(*(x.tolist() for x in super_kmers(*word_hashes(docs), window, minimiser))):
                    if (k := spread[doc].get(low)) is not None:
                        out.append((k1[a + doc], k2[a + doc], low, k, first, n, b" ".join(docs[doc][first : first + n + window - 1])))
                columns = list(zip(*out)) or [[]] * 7
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in _PACKED.split(", ")])

    return run


def repeated_windows(packed: list[bytes], counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of some super-k-mers by string: string of each window, its place in it, and whether another is equal."""
    docs = [p.split() for p in packed]
    h, offsets = word_hashes(docs)
    of = np.repeat(np.arange(len(docs)), counts)
    place = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = offsets[of] + place
    key = rolled(h, window)[at]
    order = np.argsort(key, kind="stable")
    sorted_keys = key[order]
    equal = sorted_keys[1:] == sorted_keys[:-1]  # neighbours in the order of windows
    a, b = at[order[:-1]][equal], at[order[1:]][equal]
    words = np.array([len(d) for d in docs])
    ids = {}
    flat = np.fromiter((ids.setdefault(w, len(ids)) for d in docs for w in d), np.int64, words.sum())
    same = np.ones(len(a), bool)
    for k in range(window):
        same &= flat[a + k] == flat[b + k]
    if not same.all():  # two windows of one hash: sort by the words themselves
        rows = np.stack([flat[at + k] for k in range(window)], axis=1)
        _, inverse, n = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        return of, place, n[inverse] > 1
    twice = np.zeros(len(of), bool)
    pairs = np.flatnonzero(equal)
    twice[order[pairs]] = twice[order[pairs + 1]] = True
    return of, place, twice


_FOUND = "k1 long, k2 long, first long, n long, digest binary, settled boolean"


def _bucket(window: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        packed, counts = pdf["packed"].tolist(), pdf["n"].to_numpy()
        of, place, twice = repeated_windows(packed, counts, window)
        k1, k2, first, spread = (pdf[c].to_numpy() for c in ("k1", "k2", "first", "spread"))
        out = []
        hits = np.flatnonzero(twice)
        new = np.concatenate(([True], (np.diff(hits) != 1) | (np.diff(of[hits]) != 0))) if len(hits) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        for x, y in zip(starts, np.append(starts[1:], len(hits))):
            i = of[hits[x]]
            out.append((k1[i], k2[i], first[i] + place[hits[x]], y - x, None, True))
        told = set()
        for w in np.flatnonzero(spread[of] > 1):  # others of these buckets may hold the same window
            i = of[w]
            if twice[w] and (packed[i], place[w]) in told:
                continue
            told.add((packed[i], place[w]))
            digest = hashlib.blake2b(b" ".join(packed[i].split()[place[w] : place[w] + window]), digest_size=16).digest()
            if twice[w] and digest in told:
                continue
            told.add(digest)
            out.append((k1[i], k2[i], first[i] + place[w], 1, digest, bool(twice[w])))
        return pd.DataFrame(out, columns=["k1", "k2", "first", "n", "digest", "settled"])

    return run


def repeats(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER) -> tuple[DataFrame, DataFrame]:
    """All rows as (k1, k2, doc_id, n_words, sha256 of the unchanged words), and (k1, k2, text, windows) of those with repeats.

    windows: (first, n) for each run of n repeated windows from word first on; they cover n + window - 1 words.
    """
    keyed = docs.select(*row_key(), "doc_id", "text")
    scanned = materialise(keyed.mapInArrow(_scanned(window, minimiser), _SCANNED), "scanned")
    places = scanned.select("k1", "k2", F.explode("places").alias("minimiser"))
    many = places.groupBy("minimiser").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    many = materialise(many.select("minimiser", F.ceil(F.col("n") / SPREAD).cast("int").alias("spread"), "n"), "minimisers")
    shared = places.distinct().join(many, "minimiser").groupBy("k1", "k2").agg(F.collect_list(F.struct("minimiser", "spread")).alias("shared"))
    texts = materialise(keyed.drop("doc_id").join(shared, ["k1", "k2"]), "texts")

    total = many.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET))
    packed = texts.mapInArrow(_packed(window, minimiser), _PACKED)
    spot = F.pmod(F.xxhash64("k1", "k2", "first"), F.col("spread"))
    bucketed = packed.withColumn("bucket", F.pmod(F.xxhash64("minimiser", F.when(F.col("spread") > 1, spot)), F.lit(buckets)))
    found = materialise(bucketed.groupBy("bucket").applyInPandas(_bucket(window), _FOUND), "windows")

    met = found.where("digest IS NOT NULL")
    again = materialise(met.groupBy("digest").agg((F.count(F.lit(1)) > 1).alias("more")).where("more").select("digest"), "met-again")
    second = met.where("NOT settled").join(again, "digest").select("k1", "k2", "first", "n")
    runs = found.where("digest IS NULL").select("k1", "k2", "first", "n").union(second)
    windows = runs.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "n")).alias("windows"))
    return scanned.drop("places"), texts.drop("shared").join(windows, ["k1", "k2"])


def kept_words(words: list[bytes], windows: list[dict], window: int) -> list[bytes]:
    keep = np.ones(len(words), bool)
    for w in windows:
        keep[w["first"] : w["first"] + w["n"] + window - 1] = False
    return [words[i] for i in np.flatnonzero(keep)]


def _cut(window: int, texts: bool):
    """Rows with repeats: words removed, and the kept words or their digest."""

    def run(batches):
        for batch in batches:
            removed, result = [], []
            for text, windows in zip(texts_of(batch), batch.column("windows").to_pylist()):
                words = text.split()
                kept = kept_words(words, windows, window)
                removed.append(len(words) - len(kept))
                line = b" ".join(kept)
                result.append(line.decode() if texts else hashlib.sha256(line).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1"), batch.column("k2"), pa.array(removed, pa.int64()), pa.array(result, pa.string())],
                ["k1", "k2", "n_removed", "kept_text" if texts else "kept_sha256"],
            )

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, texts: bool = True) -> tuple[DataFrame, DataFrame]:
    """All rows, and by row key (once each) n_removed with kept_text (or kept_sha256) of those that lose words."""
    scanned, repeated = repeats(docs, window)
    result = "kept_text string" if texts else "kept_sha256 string"
    cut = repeated.mapInArrow(_cut(window, texts), f"k1 long, k2 long, n_removed long, {result}")
    return scanned, cut.dropDuplicates(["k1", "k2"])


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned, cut = remove_repeats(table(spark, sf_dir, "documents"), texts=False)
    cut = materialise(cut, "cut")
    return scanned.join(cut, ["k1", "k2"], "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))

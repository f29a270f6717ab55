"""How filters interact: what each removes in every order of them, by truth-table survival words.

A document that fails some of the five filters survives the subsets of filters that hold none of those; the 32 bits
of its survival word say which. Words are counted by bit with carry-save adders, so one pass over the documents gives
the survivors of all 32 subsets by part and label, and every order of the filters is read off them: a step removes
the survivors of the filters before it that are not survivors with it.

Whether a text is a repeat (filter E) is decided table-wide: texts meet by their SHA-256, as one row of the least
doc_id a text, and only texts of more than one row are joined back. Parts are few rows at the end, 32 a part.

Edge cases: null text is empty (and equal to other empty texts); null lang is the part of the empty lang; a null
doc_id is larger than no other and smaller than none, so such a row passes E and makes no other fail; rows of the
same doc_id and text pass E together; a document of several label rows is good or toxic if one of them says so; null
labels say nothing; a very long text is a step of its own; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table, texts_of

FILTERS = "ABCDE"
REPEATED = FILTERS.index("E")
SUBSETS = 1 << len(FILTERS)
_CAPITALS, _SYMBOLS, _INSIDE = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|", bytes(range(0x80, 0xC0))
#: The survival word of each set of failed filters: bit s is set if subset s holds none of them.
WORDS = np.array([sum(1 << s for s in range(SUBSETS) if not s & failed) for failed in range(SUBSETS)], np.uint32)


def failures(text: bytes) -> int:
    """The filters A to D that a text fails, as bits."""
    words = text.split()
    n_chars = len(text.translate(None, _INSIDE))
    short = len(words) < 200
    dull = 100 * len(set(words)) < 50 * len(words)
    loud = 100 * (len(text) - len(text.translate(None, _CAPITALS))) > 3 * n_chars
    odd = len(text.translate(None, _SYMBOLS)) < len(text)
    return short | dull << 1 | loud << 2 | odd << 3


def _judged(batches):
    for batch in batches:
        texts = texts_of(batch)
        digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), digests, pa.array([failures(t) for t in texts], pa.int32())], ["doc_id", "part", "digest", "failed"])


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many words have each bit set. Full adders turn three words of a weight into one of it and one of twice it."""
    counts, weight = np.zeros(32, np.int64), 1
    bits = np.arange(32, dtype=np.uint32)
    while len(words):
        carried = []
        while len(words) > 2:
            n = len(words) // 3
            a, b, c = words[:n], words[n : 2 * n], words[2 * n : 3 * n]
            half = a ^ b
            carried.append((a & b) | (half & c))
            words = np.concatenate((half ^ c, words[3 * n :]))
        counts += weight * ((words[:, None] >> bits) & np.uint32(1)).sum(axis=0).astype(np.int64)
        words, weight = np.concatenate(carried) if carried else words[:0], 2 * weight
    return counts


def _counted(batches):
    """Survivors of each subset by part, of all documents, good ones and toxic ones; one set of rows a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        words = WORDS[batch.column("failed").to_numpy()]
        good, toxic = (batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("good", "toxic"))
        coded = batch.column("part").dictionary_encode()
        names, part = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        order = np.argsort(part, kind="stable")
        for name, at in zip(names, np.split(order, np.cumsum(np.bincount(part, minlength=len(names)))[:-1])):
            by_label = [positional_popcount(words[at[chosen[at]]]) for chosen in (np.ones(len(words), bool), good, toxic)]
            yield pa.RecordBatch.from_arrays([pa.array([name] * SUBSETS), pa.array(range(SUBSETS), pa.int32()), *map(pa.array, by_label)], ["part", "subset", "n", "good", "toxic"])


def _steps(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows of every order of the filters, from the 32 survivor counts of a part."""
    pdf = pdf.sort_values("subset")
    n, good, toxic = (pdf[c].to_numpy() for c in ("n", "good", "toxic"))
    full, rows = SUBSETS - 1, []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            removed = n[before] - n[after]
            rows.append(("".join(FILTERS[x] for x in order), step, f, n[after], removed, n[0] - n[1 << f] - removed, n[full & ~(1 << f)] - n[full], good[before] - good[after], toxic[before] - toxic[after]))
            before = after
    out = pd.DataFrame(rows, columns=["filter_order", "step", "f", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"])
    out["shapley"] = out.groupby("f")["removed"].transform("sum")
    out["part"] = pdf["part"].iloc[0]
    return out


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, failed) per row of docs (doc_id, lang, text): the filters it fails, as bits."""
    scanned = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), "text").mapInArrow(_judged, "doc_id long, part string, digest binary, failed int")
    scanned = materialise(scanned, "judged")
    firsts = scanned.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "least")
    repeated = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).cast("int")
    return scanned.join(firsts, "digest", "left").select("doc_id", "part", (F.col("failed") + F.shiftleft(repeated, REPEATED)).alias("failed"))


def survivors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, subset, n, good, toxic): documents that pass all filters of a subset, by part."""
    marked = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    no = F.lit(False)
    labelled = judged(docs).join(marked, "doc_id", "left").select("part", "failed", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    counted = labelled.mapInArrow(_counted, "part string, subset int, n long, good long, toxic long")
    return counted.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for all orders of the filters."""
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    columns = [c.split()[0] for c in schema.split(", ")]
    return survivors(docs, labels).groupBy("part").applyInPandas(lambda pdf: _steps(pdf)[columns], schema)


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = """
WITH RECURSIVE marked AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
measured AS (
  SELECT doc_id, part, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM texts),
failed AS (
  SELECT doc_id, part,
         CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
  FROM measured),
counts AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM failed LEFT JOIN marked USING (doc_id) GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT f AS filter_order FROM letters
  UNION ALL SELECT filter_order || f FROM orders, letters WHERE NOT contains(filter_order, f)),
steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS f, left(filter_order, step - 1) AS earlier
  FROM (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders WHERE length(filter_order) = 5)),
met AS (
  SELECT c.part, s.filter_order, s.step, s.f, c.n, c.good, c.toxic, contains(c.fails, s.f) AS bad, c.fails = s.f AS only_this,
         translate(c.fails, s.earlier, '') <> c.fails AS gone
  FROM counts c, steps s),
summed AS (
  SELECT part, filter_order, step, f,
         CAST(sum(n) FILTER (WHERE NOT gone AND NOT bad) AS BIGINT) AS kept, CAST(sum(n) FILTER (WHERE NOT gone AND bad) AS BIGINT) AS removed,
         CAST(sum(n) FILTER (WHERE gone AND bad) AS BIGINT) AS redundant, CAST(sum(n) FILTER (WHERE only_this) AS BIGINT) AS unique_fails,
         CAST(sum(good) FILTER (WHERE NOT gone AND bad) AS BIGINT) AS good_lost, CAST(sum(toxic) FILTER (WHERE NOT gone AND bad) AS BIGINT) AS toxic_lost
  FROM met GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant,
       coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
       CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley
FROM summed
"""

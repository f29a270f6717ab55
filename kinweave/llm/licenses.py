"""License scans by diagonal voting.

Every run of GRAM words of a document meets the same run of a license template in a join of their hashes; the meeting
votes for its diagonal, the offset between the two places. Diagonals of a document and template that are at most GAP
apart are one band, as words put in or left out shift the rest. A band with the votes that a near copy cannot do
without is verified on the words themselves: its score is the share of the template's words that stand in the
document on one of its diagonals. Bands of SHARE and more that hold all words which tell the template from those of
other licenses give its label; where such bands overlap, only the best stay. There is no limit on places, votes or bands, and of texts only those with such a band are read again.

A copy that differs from a template of n words in at most (1 - SHARE) * n of them shares at least
n - GRAM + 1 - GRAM * floor((1 - SHARE) * n) runs on its diagonal: that many votes, one at least, are asked for.

The base is plain: the places of the PHRASES, by their words. A base place scores 1.

Edge cases: null or empty text has no words, no places, empty labels and score 0; separators, other than letters,
digits and characters beyond ASCII, never matter; equal bands both stay; repeated rows get equal results; a very long
text is a step of its own, and its bands one row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, mix64, rolled, steps, table, texts_of, word_hashes

GRAM, GAP, SHARE = 3, 3, 0.8
#: Places of candidate rows, as buckets of their key, that are broadcast to leave out the texts that cannot be candidates.
BUCKETS = 1 << 18

# Phrases, and texts that licenses and license notices prescribe.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
TEMPLATES = [  # label, text, the words that tell it from others' texts
    ("agpl-3", "licensed under the gnu affero general public license version 3", "gnu affero general 3"),
    ("apache-2", "licensed under the apache license version 2.0", "apache 2"),
    ("apache-2", "you may not use this file except in compliance with the license. you may obtain a copy of the license at http://www.apache.org/licenses/LICENSE-2.0", "apache"),
    ("bsd", "licensed under the bsd 3-clause license", "bsd"),
    ("bsd", "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ""),
    ("cc-by", "licensed under cc by 4.0", "cc by 4"),
    ("cc-by", "this work is licensed under a creative commons attribution 4.0 international license", "commons attribution 4"),
    ("cc-by-nc", "licensed under cc by-nc 4.0", "cc by nc 4"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license", "commons attribution noncommercial 4"),
    ("cc-by-nc-sa", "licensed under cc by-nc-sa 4.0", "cc by nc sa 4"),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution-noncommercial-sharealike 4.0 international license", "commons noncommercial sharealike 4"),
    ("cc-by-sa", "licensed under cc by-sa 4.0", "cc by sa 4"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution-sharealike 4.0 international license", "commons attribution sharealike 4"),
    ("cc0", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide", "public domain"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general public 2"),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation; either version 2 of the license, or (at your option) any later version", "gnu general 2"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public 3"),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version", "gnu general 3"),
    ("isc", "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ""),
    ("lgpl-3", "this work is licensed under the gnu lesser general public license version 3", "gnu lesser general 3"),
    ("mit", "this software is released under the mit license", "mit license"),
    (
        "mit",
        "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"software\"), to deal in the software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so",
        "",
    ),
    ("mpl-2", "licensed under the mozilla public license version 2.0", "mozilla public 2"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license, v. 2.0", "mozilla public 2"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
]

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_SCANNED = "doc_id long, k2 long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>"
_VERIFIED = "k1 long, k2 long, template int, score double, first long, last long, matched int, whole boolean"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def least_votes(n: int) -> int:
    return max(1, n - GRAM + 1 - GRAM * int((1 - SHARE) * n + 1e-9))


def base_places(words: list[bytes], phrases: list[tuple[str, list[bytes]]]) -> list[tuple[int, str]]:
    """(place, label) of all places of the phrases."""
    return [(i, label) for i, w in enumerate(words) for label, p in phrases if w == p[0] and words[i : i + len(p)] == p]


def _scanned(batches):
    phrases = [(label, words_of(p.encode())) for label, p in PHRASES]
    needles = [b" ".join(p) for _, p in phrases]
    for batch in batches:
        rows = []
        for text in texts_of(batch):
            words = words_of(text)
            line = b" ".join(words)
            found = base_places(words, phrases) if any(x in line for x in needles) else []
            rows.append((len(words), len(found), found[0][0] if found else None, found[-1][0] if found else None, sorted({x for _, x in found})))
        columns = list(zip(*rows)) if rows else [()] * 5
        types = [pa.int64()] * 4 + [pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k2"), *[pa.array(c, t) for c, t in zip(columns, types)]], ["doc_id", "k2", "n_words", "n_base", "first_word", "last_word", "base_labels"])


def _grams(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, place and hash of every run of GRAM words."""
    h, offsets = word_hashes(docs)
    hashes, n = rolled(h, GRAM), np.diff(offsets)
    doc = np.repeat(np.arange(len(docs)), n)
    place = np.arange(len(doc)) - offsets[doc]
    whole = np.flatnonzero(place + GRAM <= n[doc])
    return doc[whole], place[whole], hashes[whole].view(np.int64)


def _hashed(batches):
    for batch in batches:
        texts, k1, k2 = texts_of(batch), *(batch.column(c).to_numpy() for c in ("k1", "k2"))
        for a, b in steps(texts):
            doc, place, gram = _grams([words_of(t) for t in texts[a:b]])
            yield pa.RecordBatch.from_arrays([pa.array(k1[a:b][doc]), pa.array(k2[a:b][doc]), pa.array(place), pa.array(gram)], ["k1", "k2", "place", "gram"])


def _ids(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    return np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))


def verified(words: np.ndarray, template: np.ndarray, needed: np.ndarray, low: int, high: int) -> tuple[int, int, int, bool]:
    """Template words found on a diagonal from low to high, the first and last of their places, and whether the needed ones are all among them."""
    hit, first, last = np.zeros(len(template), bool), len(words), -1
    for d in range(max(low, 1 - len(template)), min(high, len(words) - 1) + 1):
        a, b = max(0, -d), min(len(template), len(words) - d)
        same = template[a:b] == words[a + d : b + d]
        if same.any():
            hit[a:b] |= same
            at = np.flatnonzero(same) + a + d
            first, last = min(first, int(at[0])), max(last, int(at[-1]))
    return int(hit.sum()), first, last, bool(hit[needed].all())


def _checked(templates: list[list[bytes]], needed: list[set[bytes]]):
    def run(batches):
        known = {w: i for i, w in enumerate(sorted({w for t in templates for w in t}))}
        coded = [_ids(t, known) for t in templates]
        telling = [np.array([w in x for w in t], bool) for t, x in zip(templates, needed)]
        for batch in batches:
            out = []
            for text, k1, k2, bands in zip(texts_of(batch), *(batch.column(c).to_pylist() for c in ("k1", "k2", "bands"))):
                words = _ids(words_of(text), known)
                for x in bands:
                    t = x["template"]
                    matched, first, last, whole = verified(words, coded[t], telling[t], x["low"], x["high"])
                    out.append((k1, k2, t, matched / len(coded[t]), first, last, matched, whole))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
            columns = zip(*out) if out else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["k1", "k2", "template", "score", "first", "last", "matched", "whole"])

    return run


def template_grams(spark: SparkSession, templates: list[list[bytes]]) -> DataFrame:
    """(template, at, gram) of the runs of all templates; as many rows as they have words at most."""
    doc, place, gram = _grams(templates)
    return spark.createDataFrame([(int(d), int(p), int(g)) for d, p, g in zip(doc, place, gram)], "template int, at long, gram long")


def bands(docs: DataFrame, templates: list[list[bytes]]) -> DataFrame:
    """(k1, k2, template, low, high) of the bands of diagonals with enough votes; docs has k1, k2, text."""
    hashed = docs.select("k1", "k2", "text").mapInArrow(_hashed, "k1 long, k2 long, place long, gram long")
    hits = hashed.join(F.broadcast(template_grams(docs.sparkSession, templates)), "gram")
    hits = hits.select("k1", "k2", "template", (F.col("place") - F.col("at")).alias("diagonal"), "place").distinct()  # repeated rows vote once
    diagonals = hits.groupBy("k1", "k2", "template", "diagonal").agg(F.count(F.lit(1)).alias("votes"))
    by_diagonal = Window.partitionBy("k1", "k2", "template").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > GAP).cast("int"), F.lit(1))
    banded = diagonals.withColumn("new", new).withColumn("band", F.sum("new").over(by_diagonal))
    merged = banded.groupBy("k1", "k2", "template", "band").agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.sum("votes").alias("votes"))
    needed = F.element_at(F.array(*[F.lit(least_votes(len(t))) for t in templates]), F.col("template") + 1)
    return merged.where(F.col("votes") >= needed).select("k1", "k2", "template", "low", "high")


def matches(docs: DataFrame, templates: list[list[bytes]], needed: list[set[bytes]]) -> DataFrame:
    """(k1, k2, template, score, first, last, matched, whole, kept) of each band: its verified share and place, and whether it gives a label."""
    found = materialise(bands(docs, templates).groupBy("k1", "k2").agg(F.collect_list(F.struct("template", "low", "high")).alias("bands")), "bands")
    bucket = F.pmod(F.xxhash64("k1", "k2"), F.lit(BUCKETS)).cast("int").alias("bucket")
    maybe = F.broadcast(found.select(bucket).distinct())
    texts = docs.select("k1", "k2", "text", bucket).join(maybe, "bucket", "left_semi").dropDuplicates(["k1", "k2"])
    spans = texts.join(found.hint("merge"), ["k1", "k2"]).select("k1", "k2", "text", "bands").mapInArrow(_checked(templates, needed), _VERIFIED)
    spans = materialise(spans, "spans")
    passed = F.col("whole") & (F.col("score") >= SHARE)
    good = spans.where(passed)
    a, b = good.alias("a"), good.alias("b")
    better = (F.col("b.score") > F.col("a.score")) | ((F.col("b.score") == F.col("a.score")) & (F.col("b.matched") > F.col("a.matched")))
    overlap = (F.col("b.first") <= F.col("a.last")) & (F.col("a.first") <= F.col("b.last"))
    best = a.join(b, (F.col("a.k1") == F.col("b.k1")) & (F.col("a.k2") == F.col("b.k2")) & overlap & better, "left_anti")
    return spans.where(~passed).withColumn("kept", F.lit(False)).unionByName(best.withColumn("kept", F.lit(True)))


def scan(docs: DataFrame) -> DataFrame:
    """Words, base places and labels, all labels, and the score of each row of docs (doc_id, text)."""
    templates, needed = ([words_of(t[k].encode()) for t in TEMPLATES] for k in (1, 2))
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 62))).alias("k1"), F.xxhash64(text).alias("k2"), text.alias("text"))
    base = keyed.select("doc_id", "k2", "text").mapInArrow(_scanned, _SCANNED).withColumn("k1", F.coalesce("doc_id", F.lit(-(1 << 62))))
    label = F.element_at(F.array(*[F.lit(x) for x, *_ in TEMPLATES]), F.col("template") + 1)
    own = matches(keyed, templates, list(map(set, needed))).groupBy("k1", "k2").agg(F.collect_set(F.when(F.col("kept"), label)).alias("more"), F.max("score").alias("best"))
    joined = lambda x: F.array_join(F.array_sort(x), ",")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return base.join(own.hint("merge"), ["k1", "k2"], "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined("base_labels").alias("base_labels"),
        joined(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"), score.alias("score"),
    )


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    plain = lambda t: quoted(" ".join(w.decode() for w in words_of(t.encode())))
    lines = ", ".join(f"({i}, {quoted(x)}, {plain(t)}, {plain(telling)})" for i, (x, t, telling) in enumerate(TEMPLATES))
    places = " UNION ALL ".join(
        f"SELECT doc_id, place, {quoted(x)} AS label FROM grams WHERE " + " AND ".join(f"w{k} = {quoted(w)}" for k, w in enumerate(re.sub(r"[^a-z0-9]+", " ", p).split())) for x, p in PHRASES
    )
    return f"""
WITH templates AS (SELECT * FROM (VALUES {lines}) AS t(template, label, line, telling)),
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
placed AS (SELECT doc_id, unnest(ws) AS w0, CAST(unnest(range(len(ws))) AS BIGINT) AS place FROM words),
grams AS (SELECT *, lead(w0) OVER d AS w1, lead(w0, 2) OVER d AS w2, lead(w0, 3) OVER d AS w3 FROM placed WINDOW d AS (PARTITION BY doc_id ORDER BY place)),
base AS (SELECT doc_id, count(*) AS n, min(place) AS first, max(place) AS last, list_distinct(list(label)) AS labels FROM ({places}) GROUP BY doc_id),
t_split AS (SELECT template, unnest(string_split(line, ' ')) AS w0, CAST(unnest(range(len(string_split(line, ' ')))) AS BIGINT) AS spot, len(string_split(line, ' ')) AS n, string_split(telling, ' ') AS telling FROM templates),
t_words AS (SELECT *, list_contains(telling, w0) AS tells, count(*) FILTER (WHERE list_contains(telling, w0)) OVER (PARTITION BY template) AS n_telling FROM t_split),
t_grams AS (SELECT *, lead(w0) OVER t AS w1, lead(w0, 2) OVER t AS w2 FROM t_words WINDOW t AS (PARTITION BY template ORDER BY spot)),
votes AS (
  SELECT doc_id, template, place - spot AS diagonal, count(*) AS votes, any_value(n) AS n
  FROM grams g JOIN t_grams t ON g.w0 = t.w0 AND g.w1 = t.w1 AND g.w2 = t.w2 GROUP BY ALL),
fresh AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {GAP} THEN 0 ELSE 1 END AS fresh FROM votes),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS band FROM fresh),
bands AS (
  SELECT doc_id, template, band, min(diagonal) AS low, max(diagonal) AS high, any_value(n) AS n FROM numbered GROUP BY doc_id, template, band
  HAVING sum(votes) >= greatest(1, any_value(n) - {GRAM - 1} - {GRAM} * CAST(floor(any_value(n) * {round(1 - SHARE, 6)} + 1e-9) AS BIGINT))),
spans AS (
  SELECT b.doc_id, b.template, b.band, count(DISTINCT spot) AS matched, count(DISTINCT spot) / CAST(any_value(b.n) AS DOUBLE) AS score, min(place) AS first, max(place) AS last,
         count(DISTINCT spot) FILTER (WHERE tells) = any_value(n_telling) AS whole
  FROM bands b JOIN t_words t ON b.template = t.template JOIN placed p ON p.doc_id = b.doc_id AND p.w0 = t.w0 AND p.place - t.spot BETWEEN b.low AND b.high GROUP BY ALL),
good AS (SELECT * FROM spans WHERE whole AND score >= {SHARE}),
kept AS (
  SELECT a.* FROM good a WHERE NOT EXISTS (
    SELECT 1 FROM good b WHERE a.doc_id = b.doc_id AND b.first <= a.last AND a.first <= b.last AND (b.score > a.score OR (b.score = a.score AND b.matched > a.matched)))),
more AS (SELECT doc_id, list(label) AS labels FROM kept JOIN templates USING (template) GROUP BY doc_id),
best AS (SELECT doc_id, max(score) AS score FROM spans GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, b.first AS first_word, b.last AS last_word,
       coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(b.labels, m.labels))), ','), '') AS labels,
       CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(s.score, 0.0) END AS score
FROM words w LEFT JOIN base b USING (doc_id) LEFT JOIN more m USING (doc_id) LEFT JOIN best s USING (doc_id)
"""


SQL = _sql()

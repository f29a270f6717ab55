"""Operators on documents against brute force, over nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinweave.llm import binary, language, minhash, mixing, packing, quality, rules, substring, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def token_ids(name, texts, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [np.array([*e.ids, end], "<u4").tobytes() for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


ODD = "a Bc XYZ the's 'LL . ,; !? ' \" # $$$ word.%%% é ß İ ÿ Ā ɏ ɐ 日本 1 23 — … e\u0301 \x1c \x85 ΑΣ <|endoftext|> <|startoftext|> <|ENDOFTEXT|>".split(" ") + [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\xa0", "\u3000"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "other"])
def test_encoder_equals_the_library(name, tmp_path, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json" if name == "other" else name)
    if name == "other":  # a file that splits in another way
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        file["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": False}
        path = str(tmp_path / "other.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump(file, f)
    monkeypatch.setattr(tokens, "KEPT_PIECES", 40)  # generations change often
    encoder, library, draw = tokens.Encoder(path), Tokenizer.from_file(path), random.Random(3)
    assert encoder.kind == {"b": "byte", "w": "word", "o": "whole"}[name[0]]
    for _ in range(4000):
        text = "".join(draw.choice(ODD) for _ in range(draw.randint(0, 10)))
        assert encoder.ids(text.encode()) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def sort_key(r):
    return tuple((x is not None, x) for x in r)


def test_binary(spark, docs, rows, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    ordered = sorted(rows, key=lambda r: sort_key(r[:2]))
    ids = token_ids("word_bpe_49k.json", [r[1] for r in ordered], 2)
    start, want = 0, []
    for r, x in zip(ordered, ids):
        want.append((r[0], start, len(x) // 4, zlib.crc32(x)))
        start += len(x) // 4
    got = binary.read_documents(binary.write_segments(docs, path, 2))
    assert sorted(map(tuple, got.collect()), key=sort_key) == sorted(want, key=sort_key)
    assert binary.read_documents(binary.write_segments(nothing, path, 2)).count() == 0


def test_reader_selects_boundaries(monkeypatch):
    ends = np.cumsum(np.arange(1, 201))
    ef, ids = binary.EliasFano.of(ends), np.arange(ends[-1], dtype="<u2")
    row = [0, 0, 200, len(ids), 2, ef.low_bits, list(range(200)), ef.low, ef.high, ef.samples, ids.tobytes()]
    batch = pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, binary._SEGMENT)], schema=binary._SEGMENT)
    asked, select = [], binary.EliasFano.select
    monkeypatch.setattr(binary.EliasFano, "select", lambda self, i: asked.append(i) or select(self, i))
    (got,) = binary._decoded([batch])
    assert got.column("local_start").to_pylist() == [0, *ends[:-1].tolist()] and got.column("n_tokens").to_pylist() == list(range(1, 201))
    assert asked == list(range(200))


@given(st.lists(st.integers(0, 5000), max_size=300), st.integers(0, 200_000))
def test_elias_fano(steps, first):
    values = np.cumsum([first, *steps])
    ef = binary.EliasFano.of(values)
    assert ef.values().tolist() == values.tolist() == [ef.select(i) for i in range(len(values))]
    assert len(ef.low) + len(ef.high) <= len(values) * (2 + max(0, np.log2(max(1, values[-1] / len(values))))) / 8 + 3
    assert binary.EliasFano.of(np.zeros(0)).values().tolist() == []


def test_packing(spark, docs, rows, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = Counter((r[0], x) for r, x in zip(rows, token_ids("byte_bpe_50k.json", [r[1] for r in rows], 1)))
    pieces = packing.pack(docs, path, 1).collect()
    assert sum(p["length"] for p in pieces) == sum(len(x) // 4 * n for (_, x), n in want.items())
    by_id = {i: [x for (j, x) in want if j == i] for i, _ in want}
    for p in pieces:
        a, b = 4 * p["start"], 4 * (p["start"] + p["length"])
        assert any(len(x) == 4 * p["doc_tokens"] and zlib.crc32(x[a:b]) == p["ids_crc32"] for x in by_id[p["doc_id"]])
    cover = defaultdict(Counter)
    for p in pieces:
        cover[p["doc_id"]][p["start"], p["length"]] += 1
    assert cover[2][0, packing.cuts(next(len(x) // 4 for j, x in want if j == 2))[0]] == 3  # a row and its two repeats
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(nothing, path, 1).count() == 0


@given(st.dictionaries(st.sampled_from([*range(1, 32), *range(32, 2049, 32)]), st.integers(1, 400), min_size=1, max_size=20))
def test_patterns_meet_the_demand(demand):
    patterns = packing.choose_patterns(demand)
    made = Counter()
    for pattern, times in patterns:
        assert sum(x * n for x, n in pattern.items()) <= 2048
        for x, n in pattern.items():
            made[x] += n * times
    assert made == demand


def test_little_padding():
    demand = {x: 3000 // x + 50 for x in [*range(1, 32), *range(32, 2049, 32)]}
    total = sum(x * n for x, n in demand.items())
    assert sum(n for _, n in packing.choose_patterns(demand)) <= total / 2048 * 1.01 + 2


def test_quality(spark, docs, rows, nothing):
    labels = spark.createDataFrame([(r[0], int("other" not in (r[1] or "") and len(r[1] or "") > 60), 0, "clash") for r in rows if r[0] is not None and r[0] % 10] + [(1, None, 1, "x"), (None, 1, 0, "x")], "doc_id long, quality int, toxic int, score string")
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    # labels of held-out rows have no part in the scores
    turned = labels.selectExpr("doc_id", "IF(crc32(CAST(doc_id AS STRING)) % 4 = 2, 1 - quality, quality) AS quality")
    scores = lambda rs: sorted(((r["doc_id"], round(r["score"], 9)) for r in rs), key=sort_key)
    assert scores(got) == scores(quality.score_quality(docs, turned).collect())
    assert {r["score"] for r in quality.score_quality(docs, labels.where("false")).collect()} == {0.5}
    assert quality.score_quality(nothing, labels).count() == 0
    assert quality.accepted(docs, labels.where("false")).count() == len(rows)


def test_quality_of_a_sample_is_that_of_its_rows(spark, monkeypatch):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality")
    measured = quality.measure(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).cache()
    learned = measured.where("fold IN (0, 1)").join(labels.where("quality IS NOT NULL"), "doc_id").count()
    most = learned // 4
    chosen = labels.where(f"pmod(xxhash64(doc_id), {1 << 20}) < {int((1 << 20) * most / learned)}")
    alone = quality.fit(measured, chosen)
    monkeypatch.setattr(quality, "MOST_LABELLED", most)
    sampled = quality.fit(measured, labels)
    assert np.allclose(sampled.beta, alone.beta, atol=1e-9)


@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 9)), min_size=1, max_size=12))
def test_isotonic(bins):
    data = [(float(i), w, min(w, y)) for i, (w, y) in enumerate(bins)]
    x, p = quality.isotonic(data)
    assert list(x) == [d[0] for d in data] and (np.diff(p) >= 0).all()


def test_quality_held_out_accuracy(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    got = quality.score_quality(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels).join(labels, "doc_id").where("held_out")
    assert got.where("predicted = quality").count() >= 0.97 * got.count()


def test_language(spark, docs, rows, nothing):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    texts = [[*WORD.findall(lower(r[1])), ""] for r in rows]
    c = Counter(w for t, r in zip(texts, rows) if not held(r[0]) for w in t)
    total = sum(c.values())
    want = [(r[0], held(r[0]), len(t), sum(c[w] > 0 for w in t), total, round(sum(np.log10((c[w] + 1) / (total + len(c) + 1)) for w in t), 6)) for r, t in zip(rows, texts)]
    got = language.score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2).collect()
    assert sorted(((*r[:5], round(r["base_score"], 6)) for r in got), key=sort_key) == sorted(want, key=sort_key)
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert language.score_texts(nothing, F.lit(False)).count() == 0


def test_language_ranks_by_counts_over_all_blocks(spark, monkeypatch):
    seen = []
    start = language.LogBilinear.start.__func__
    monkeypatch.setattr(language.LogBilinear, "start", classmethod(lambda cls, unigram: seen.append(unigram) or start(cls, unigram)))
    texts = [(i, f"often again word{i:02}") for i in range(24)]  # no word is in one block four times
    for parts in (1, 12):
        language.score_texts(spark.createDataFrame(texts, "doc_id long, text string").repartition(parts, "doc_id"), F.lit(False)).count()
    whole, split = (u * (24 * 4 + 0.5 * language.CLASSES) for u in seen)
    assert np.allclose(split, whole) and np.allclose(split[:2], 24.5) and np.allclose(split[2:26], 1.5)


def test_language_does_not_depend_on_the_partitioning(spark, monkeypatch):
    monkeypatch.setattr(language, "SHARD_TOKENS", 150_000)  # a few shards
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    one, many = ({r["doc_id"]: tuple(r)[1:] for r in language.score_texts(docs.repartition(n, "text"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2).collect()} for n in (1, 60))
    assert one.keys() == many.keys() and all(one[i][:4] == many[i][:4] for i in one)
    assert np.allclose([one[i][4:] for i in one], [many[i][4:] for i in one], rtol=1e-5)


def test_language_scores_by_brute_force(spark, monkeypatch):
    learned, scored = [], language._scored
    monkeypatch.setattr(language, "_scored", lambda rows, total: learned.append(rows) or scored(rows, total))
    draw = random.Random(8)
    texts = [" ".join(f"w{min(1200, int(draw.paretovariate(0.4)))}" for _ in range(200)) for _ in range(60)]
    got = {r["doc_id"]: r["score"] for r in language.score_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), F.col("doc_id") % 5 == 0).collect()}
    c = Counter(w for i, t in enumerate(texts) if i % 5 for w in [*t.split(), ""])
    ranked = sorted((w for w in c if w), key=lambda w: (-c[w], w))[: language.WORDS]
    cls = lambda w: language.END if not w else ranked.index(w) if w in ranked else language.WORDS + language.bucket(w.encode())
    size, kinds = Counter(), Counter()
    for w in c:
        size[cls(w)] += c[w]
        kinds[cls(w)] += 1
    (rows,) = learned
    v = language.VECTOR
    for i, t in enumerate(texts[:12]):
        before, total = [language.START, language.START], 0.0
        for w in [*t.split(), ""]:
            context = rows[before[1], :v] + rows[before[0], v : 2 * v]
            logits = rows[: language.CLASSES, 2 * v : 3 * v] @ context + rows[: language.CLASSES, 3 * v]
            k = cls(w)
            total += (logits[k] - np.log(np.exp(logits).sum())) / np.log(10)
            if language.WORDS <= k < language.END:
                total += np.log10((c[w] + 1) / (size[k] + kinds[k] + 1))
            before = [before[1], k]
        assert abs(got[i] - total) < 1e-3 * abs(total)


def test_log_bilinear_is_normalised_and_learns():
    draw = np.random.default_rng(1)
    unigram = np.full(language.CLASSES, 1 / language.CLASSES)
    model = language.LogBilinear.start(unigram)
    tokens = np.tile([3, 5, 7], 8000)
    one, two = np.roll(tokens, 1), np.roll(tokens, 2)
    before = model.log_probabilities(tokens, one, two).sum()
    for _ in range(5):
        model.train(tokens, one, two, unigram, draw)
    assert model.log_probabilities(tokens, one, two).sum() > before / 3
    every = np.arange(language.CLASSES)
    same = np.full(language.CLASSES, 5)
    assert abs(np.exp(model.log_probabilities(every, same, same)).sum() - 1) < 1e-4


def test_language_held_out(spark):
    got = language.score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
    r = got.where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r["s"] > r["b"]


def test_rules(spark, docs, rows, nothing):
    want = []
    for r in rows:
        t = r[1] or ""
        w = WORD.findall(t)
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        n, covered = Counter(grams), set()
        for i, g in enumerate(grams):
            if n[g] > 1:
                covered.update(range(i, i + 8))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)))
    got = rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    found = got.collect()
    assert sorted((tuple(r)[:-1] for r in found), key=sort_key) == sorted(want, key=sort_key)
    assert not any(r["kept"] and r["base_failed"] for r in found)
    assert rules.judge(nothing).count() == 0


def test_rules_find_junk_and_keep_the_rest(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    judged = rules.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("NOT base_failed").cache()
    got = judged.join(labels, "doc_id")
    assert got.where("quality = 0 AND kept").count() <= 0.03 * got.where("quality = 0").count()
    assert got.where("quality = 1 AND NOT kept").count() <= 0.01 * got.where("quality = 1").count()
    one_bad = sum(((F.col(f"vote_{k}") == 0) & F.col(f"vote_{k}").isNotNull()).cast("int") for k in rules.votes())
    bad = judged.select("kept", one_bad.alias("bad"))
    assert bad.where("kept AND bad = 1").count() >= 10 and bad.where("NOT kept AND bad = 0").count() >= 5  # not a filter that all must pass
    judged.unpersist()


def test_posteriors_by_brute_force(spark):
    """The same estimation with a row a document, in numpy."""
    got = rules.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    votes = np.array([[-1 if r[f"vote_{k}"] is None else r[f"vote_{k}"] for k in rules.votes()] for r in got])
    seen = np.stack([votes == 0, votes == -1, votes == 1], axis=2).astype(float)
    judged = np.array([not r["base_failed"] for r in got])
    n = judged.sum()
    post = np.where(2 * ((votes == 1).sum(axis=1) - (votes == 0).sum(axis=1)) > votes.shape[1], *rules.START)
    for _ in range(100):
        share, rates = post[judged].mean(), []
        for member, mean in zip((post, 1 - post), rules.PRIORS):
            counts = (seen[judged] * member[judged, None, None]).sum(axis=0) + rules.WEIGHT * n * np.array(mean)
            rates.append(counts / counts.sum(axis=1, keepdims=True))
        post = 1 / (1 + np.exp(-(np.log(share / (1 - share)) + (seen * np.log(rates[0] / rates[1])).sum(axis=(1, 2)))))
    assert np.allclose(post, [r["posterior"] for r in got], atol=1e-6) and 0.5 < share < 0.97
    assert [r["kept"] for r in got] == [bool(q >= 0.5 and not r["base_failed"]) for q, r in zip(post, got)]


def test_estimation_needs_patterns():
    patterns = [((1, 1, 1, 1), 90), ((0, 1, 1, 1), 3), ((1, 0, None, 0), 5), ((0, 0, 1, 0), 4), ((1, 1, None, 1), 2)]
    many, few = (rules.fit([(p, n * k) for p, n in patterns]) for k in (1, 1000))
    assert np.allclose(many[1], few[1]) and abs(many[0] - few[0]) < 1e-9  # alike at every size
    assert rules.fit([]) == (0.5, [])
    share, rates = many
    assert rules.log_odds((1, 1, 1, 1), share, rates) > 0 > rules.log_odds((0, 0, 1, 0), share, rates)
    assert rules.log_odds((0, 1, 1, 1), share, rates) > 0 > rules.log_odds((1, 0, None, 0), share, rates)  # one bad vote is not enough


@pytest.mark.parametrize("spread", [substring.SPREAD, 2])
def test_substring(spark, docs, rows, nothing, monkeypatch, spread):
    monkeypatch.setattr(substring, "SPREAD", spread)
    monkeypatch.setattr(substring, "BUCKET", 50)
    texts = [WORD.findall(r[1] or "") for r in rows]
    n = Counter(tuple(w[i : i + 35]) for w in texts for i in range(len(w) - 34))
    want = []
    for r, w in zip(rows, texts):
        covered = {k for i in range(len(w) - 34) if n[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}
        kept = " ".join(x for i, x in enumerate(w) if i not in covered)
        want.append((r[0], len(w), len(covered), hashlib.sha256(kept.encode()).hexdigest()))
    scanned, cut = substring.remove_repeats(docs, texts=False)
    got = scanned.join(cut, ["k1", "k2"], "left").selectExpr("doc_id", "n_words", "coalesce(n_removed, 0)", "coalesce(kept_sha256, sha256)")
    assert sorted(map(tuple, got.collect()), key=sort_key) == sorted(want, key=sort_key)
    assert sum(x[2] for x in want) > 1000
    assert substring.remove_repeats(nothing)[0].count() == 0 and substring.remove_repeats(nothing)[1].count() == 0


def test_mixing(spark, docs, rows, nothing, tmp_path):
    got = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    plain.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = con.sql(mixing.SQL).fetchall()
    near = lambda r: (*r[:3], round(r[3], 6), r[4])
    assert sorted((near(tuple(r)) for r in got.collect()), key=sort_key) == sorted(map(near, want), key=sort_key)
    assert mixing.mix(nothing).count() == 0 and mixing.mixed(nothing).count() == 0
    copies = Counter({(r["doc_id"], r["source"], r["size"]): r["copies"] for r in mixing.mix(docs).where("doc_id <> 2").collect()})
    taken = mixing.mixed(docs).where("doc_id <> 2")
    assert taken.columns == docs.columns and taken.count() == sum(copies[k] for k in copies)


def test_targets_by_resharing(spark):
    sizes = {"a": 10, "b": 500, "c": 30, "d": 1000, None: 60}
    sized = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sized, 3).collect()}
    order = ["a", "b", "c", "d", None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, target, open_ = sum(sizes.values()), {}, set(order)
    while True:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not above:
            break
        for s in above:
            target[s] = 3 * sizes[s]
            left -= target[s]
        open_ -= above
    target |= {s: level * weight[s] for s in open_}
    assert {s: round(t, 6) for s, t in got.items()} == {s: round(t, 6) for s, t in target.items()}


def brute_components(rows, words, percent):
    sets = []
    for r in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            same_id = rows[i][0] == rows[j][0]
            both = len(a & sets[j])
            if a and sets[j] and None not in (rows[i][0], rows[j][0]) and (same_id or 100 * both >= percent * (len(a) + len(sets[j]) - both)):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return [(rows[i][0], len(sets[i]), rows[i][0] if rows[i][0] is None else min(rows[k][0] for k in groups[find(i)])) for i in range(len(rows))]


@pytest.mark.parametrize(("words", "tile"), [(4, 512), (5, 3)])
def test_minhash(spark, docs, rows, nothing, monkeypatch, words, tile):
    monkeypatch.setattr(minhash, "TILE_DOCS", tile)
    want = brute_components(rows, words, 80)
    got = minhash.near_duplicates(docs, words)
    found = got.collect()
    assert sorted((tuple(r)[:3] for r in found), key=sort_key) == sorted(want, key=sort_key)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found) and sum(not r["kept"] for r in found) >= 8
    assert minhash.near_duplicates(nothing).count() == 0


def test_signatures_meet_at_the_threshold():
    """Pairs of signatures under the distance that the keys promise always share a key."""
    draw = np.random.default_rng(2)
    for _ in range(300):
        a = draw.integers(0, 1 << 16, (1, minhash.CHUNKS * minhash.WIDTH)).astype(np.uint64)
        b = a.copy()
        b[0, draw.choice(a.shape[1], 2 * minhash.CHUNKS - 1, replace=False)] += np.uint64(1)
        assert (minhash._keys(a) == minhash._keys(b)).any()


def test_no_pair_of_exactly_the_threshold_is_lost():
    """20,000 pairs of sets with 80 of 100 shingles in common: within the distance, and in one key."""
    draw = np.random.default_rng(8)
    assert sum(math.comb(60, k) * 0.2**k * 0.8 ** (60 - k) for k in range(minhash.DISTANCE + 1, 61)) < 1e-6
    signatures = [[], []]
    for _ in range(20_000):
        both = draw.integers(0, 1 << 63, 100).astype(np.uint64)
        signatures[0].append(minhash._signature(both[:90]))
        signatures[1].append(minhash._signature(both[10:]))
    a, b = map(np.stack, signatures)
    assert ((a != b).sum(axis=1) <= minhash.DISTANCE).all()
    assert (minhash._keys(a) == minhash._keys(b)).any(axis=1).all()


def test_classes_of_a_key_meet_by_distance():
    draw = np.random.default_rng(6)
    keys, cids, signatures, want = [], [], [], set()
    for key in range(40):
        n = int(draw.choice([2, 2, 3, 9]))
        own = np.repeat(draw.integers(0, 9, (1, 60)), n, axis=0)
        for x in own:
            at = draw.choice(60, int(draw.integers(0, 30)), replace=False)
            x[at] = draw.integers(10, 1 << 16, len(at))
        ids = draw.permutation(1000)[:n]
        reach = {int(i): {int(i)} for i in ids}
        for i, j in itertools.combinations(range(n), 2):
            if (own[i] != own[j]).sum() <= minhash.DISTANCE:
                both = reach[int(ids[i])] | reach[int(ids[j])]
                for k in both:
                    reach[k] = both
        want |= {(key, frozenset(x)) for x in reach.values()}
        keys += [key] * n
        cids += ids.tolist()
        signatures += [x.astype("<u2").tobytes() for x in own]
    got = set()
    for key in range(40):  # components of one key at a time, over batches of five rows
        rows = [(k, c, s) for k, c, s in zip(keys, cids, signatures) if k == key]
        batches = [pa.RecordBatch.from_pydict({"key": [r[0] for r in b], "cid": [r[1] for r in b], "signature": [r[2] for r in b]}) for b in (rows[i : i + 5] for i in range(0, len(rows), 5))]
        pairs = [(a, b) for out in minhash._met(batches) for a, b in zip(out.column("a").to_pylist(), out.column("b").to_pylist())]
        reach = {r[1]: {r[1]} for r in rows}
        for a, b in pairs:
            both = reach[a] | reach[b]
            for k in both:
                reach[k] = both
        got |= {(key, frozenset(x)) for x in reach.values()}
        assert len(pairs) == len(rows) - len({frozenset(x) for x in reach.values()})
    assert got == want


@pytest.mark.parametrize("most", [minhash.MOST_COMPARED, 1, 3])
def test_minhash_loses_no_pair_near_the_threshold(spark, monkeypatch, most):
    monkeypatch.setattr(minhash, "MOST_COMPARED", most)
    draw = random.Random(9)
    texts = []
    for i in range(120):
        base = [f"w{draw.randrange(400)}" for _ in range(300)]
        copy = list(base)
        for k in draw.sample(range(20), draw.randint(6, 10)):  # single words far apart: each changes four shingles
            copy[15 * k + 3] = f"other{i}"
        texts += [" ".join(base), " ".join(copy)]
    rows = list(enumerate(texts))
    want = brute_components([(i, t) for i, t in rows], 4, 80)
    linked = sum(c != i for i, _, c in want)
    assert 40 < linked < 120  # on both sides of the threshold
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert sorted(tuple(r)[:3] for r in got) == want

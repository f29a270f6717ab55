"""Filter audit, license scan and manifest against brute force, over nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from kinweave.llm import audit, licenses, manifest, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int, part string"


def brute_failures(rows):
    """The failed filters of each row."""
    texts = [r[1] or "" for r in rows]
    least = {}
    for r, t in zip(rows, texts):
        if r[0] is not None:
            least[t] = min(least.get(t, r[0]), r[0])
    out = []
    for r, t in zip(rows, texts):
        words = WORD.findall(t)
        bad = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), r[0] is not None and r[0] > least[t]]
        out.append("".join(f for f, b in zip("ABCDE", bad) if b))
    return out


def brute_interactions(rows, labels):
    good = {x[0] for x in labels if x[1] == 1 and x[0] is not None}
    toxic = {x[0] for x in labels if x[2] == 1 and x[0] is not None}
    parts, found = defaultdict(list), brute_failures(rows)
    for r, f in zip(rows, found):
        parts[r[2] or ""].append((r[0], f))
    out, shapley = [], Counter()
    for part, members in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = members
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                earlier = [x for x in members if f in x[1] and set(order[: step - 1]) & set(x[1])]
                shapley[part, f] += len(gone)
                out.append([part, order, step, len(left), len(gone), len(earlier), sum(x[1] == f for x in members), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)])
    return [(*x, shapley[x[0], x[1][x[2] - 1]]) for x in out]


def test_interactions(spark, docs, rows, nothing):
    labels = [(i, i % 2, i % 3 % 2, "x") for i in range(0, 60, 2)] + [(4, 1, 1, "x"), (4, 0, 0, "x"), (None, 1, 1, "x"), (6, None, None, "x")]
    long = " ".join(f"w{i}" for i in range(250))
    more = [(1000 + i, long + " " * (i % 2) + " #" * (i % 3 // 2) + " ABC" * (i % 5), [None, "", "de", "fr"][i % 4], "s", 1) for i in range(40)]
    both = docs.select("doc_id", "text", "lang", "source", "n_chars", "part").union(spark.createDataFrame([(*r, "clash") for r in more], docs.select("doc_id", "text", "lang", "source", "n_chars", "part").schema))
    got = audit.interactions(both, spark.createDataFrame(labels, LABELS))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == sorted(brute_interactions(rows + more, labels))
    assert audit.interactions(nothing, spark.createDataFrame(labels, LABELS)).count() == 0
    assert audit.interactions(both, spark.createDataFrame([], LABELS)).where("good_lost + toxic_lost > 0").count() == 0


@given(st.lists(st.integers(0, 2**32 - 1), max_size=200))
def test_positional_popcount(words):
    got = audit.positional_popcount(np.array(words, np.uint32))
    assert got.tolist() == [sum(w >> b & 1 for w in words) for b in range(32)]


def test_survival_words():
    for failed, word in enumerate(audit.WORDS.tolist()):
        assert {s for s in range(32) if word >> s & 1} == {s for s in range(32) if not s & failed}


def brute_scan(text):
    """n_words, n_base, first, last, base labels, labels and score by plain comparison of words."""
    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))

    words = split(text or "")
    base = [(i, x) for x, p in licenses.PHRASES for i in range(len(words)) if words[i : i + len(split(p))] == split(p)]
    spans = []
    for label, line, telling in licenses.TEMPLATES:
        t = split(line)
        votes = Counter(i - j for j in range(len(t) - 2) for i in range(len(words) - 2) if words[i : i + 3] == t[j : j + 3])
        bands = []
        for d in sorted(votes):
            if bands and d - bands[-1][1] <= 3:
                bands[-1][1:] = [d, bands[-1][2] + votes[d]]
            else:
                bands.append([d, d, votes[d]])
        for low, high, n in bands:
            if n < max(1, len(t) - 2 - 3 * (len(t) // 5)):
                continue
            hits = {(j, j + d) for d in range(low, high + 1) for j in range(len(t)) if 0 <= j + d < len(words) and words[j + d] == t[j]}
            at = {j for j, _ in hits}
            whole = all(j in at for j in range(len(t)) if t[j] in split(telling))
            spans.append((len(at) / len(t), len(at), min(p for _, p in hits), max(p for _, p in hits), whole, label))
    good = [s for s in spans if s[0] >= 0.8 and s[4]]
    kept = [a for a in good if not any(b[2] <= a[3] and a[2] <= b[3] and b[:2] > a[:2] for b in good)]
    places, base_labels = [p for p, _ in base], {x for _, x in base}
    score = 1.0 if base else max((s[0] for s in spans), default=0.0)
    return len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(base_labels)), ",".join(sorted(base_labels | {s[5] for s in kept})), score


def license_texts():
    plain = "the quick word of a text that has no license at all and goes on for a while"
    out = [plain, "", None, "MIT", "under the MIT license", "Under-the MIT, License! under the mit license under the mit license", "cc by-nc and CC BY NC", "apache license, version 2.0"]
    for i, (_, line, _) in enumerate(licenses.TEMPLATES):
        w = line.split()
        out += [f"{plain} {line.upper()} {plain}", " ".join(w[: len(w) // 2]), " ".join(w[:3] + ["other"] + w[3:]), " ".join(x if k != len(w) - 2 else "zzz" for k, x in enumerate(w))]
        out += [f"{line} {plain} {line}", f"{line} {licenses.TEMPLATES[i - 1][1]}", " ".join(w[1:] + w[:1])]
    out += ["released under the bsd license", "licensed under the eclipse public license, version 2.0", "licensed under cc by-nd 4.0", " ".join([plain] * 400 + ["licensed under the apache license version 2"] * 3), "the software is the software is " * 50, "é under the mit license\x00日本 cc by nc"]
    return out


def test_licenses(spark, nothing):
    texts = license_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[4]), (None, texts[9]), (3, texts[9]), (3, texts[9]), (9, texts[9])]
    df = spark.createDataFrame([(*r, "clash", 1, "x") for r in rows], "doc_id long, text string, template string, place long, score string").repartition(3)
    got = [tuple(r) for r in licenses.scan(df).collect()]
    assert sorted(got, key=repr) == sorted([(i, *brute_scan(t)) for i, t in rows], key=repr)
    assert licenses.scan(nothing).count() == 0


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
        ("This work is licensed under the GNU General Public License, version 2.", "gpl-2"),
        ("this work is licenced under the gnu general public license version 3", "gpl-3"),
        ("Licensed under CC BY-SA 4.0.", "cc-by-sa"),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
        ("released under the bsd license", ""),
        ("licensed under the eclipse public license version 2.0", ""),
        ("she spoke of the license that the general public had", ""),
        (licenses.TEMPLATES[20][1] + " and more " + licenses.TEMPLATES[4][1], "bsd,mit"),
    ],
)
def test_labels(spark, text, labels):
    assert licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).head()["labels"] == labels == brute_scan(text)[5]


def brute_proofs(rows):
    """Row by row: leaf, subroot, root, proof and folded root."""
    def digest(x):
        return hashlib.sha256(x.encode()).hexdigest()

    def leaf(r):
        return digest("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r[0], r[3], r[2], r[4], r[1])))

    def tree(nodes):
        """The root, and of each node the siblings before and after on each level."""
        ways = [[] for _ in nodes]
        at = [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            up = []
            for i in range(0, len(nodes), 8):
                for j in range(i, min(i + 8, len(nodes))):
                    for x in at[j]:
                        ways[x].append(("".join(nodes[i:j]), "".join(nodes[j + 1 : i + 8])))
                up.append(digest("".join(nodes[i : i + 8])))
            at = [sum(at[i : i + 8], []) for i in range(0, len(nodes), 8)]
            nodes = up
        return nodes[0], ways

    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    grown = [tree([x[2] for x in sorted(langs[n], key=lambda x: x[:3])]) for n in names]
    root, tops = tree([g[0] for g in grown])
    out = []
    for name, (subroot, ways), top in zip(names, grown, tops):
        for (_, _, h, r), way in zip(sorted(langs[name], key=lambda x: x[:3]), ways):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            folded = leaf((r[0], r[1] and re.sub("[A-Z]", lambda m: m[0].lower(), r[1]), *r[2:])) if tampered else h
            for left, right in way + top:
                folded = digest(left + folded + right)
            out.append((r[0], h, subroot, root, digest("".join(a + b for a, b in way + top)), folded, folded == root))
    return out


@pytest.mark.parametrize("n", [1, 2, 8, 9, 70, 600])
def test_proofs(spark, rows, nothing, n):
    draw = np.random.default_rng(n)
    made = [(int(i), [f"Text {i}", "low", None, ""][i % 4], [None, "", "de", "en", "=en"][int(draw.integers(5)) if n > 2 else 3] if i % 3 else "en", f"s{i % 2}", int(i)) for i in draw.permutation(n)]
    used = made + (rows if n == 70 else [])
    df = spark.createDataFrame([(*r, "clash", "x") for r in used], "doc_id long, text string, lang string, source string, n_chars long, tree string, path string").repartition(3)
    got = [tuple(r) for r in manifest.proofs(df).collect()]
    want = brute_proofs(used)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    if n == 600:
        assert not all(x[-1] for x in want) and any(x[-1] for x in want)
    if n == 1:
        assert manifest.proofs(nothing).count() == 0


@pytest.mark.parametrize("langs", [["a", "b", "c"], [None, "b"], ["a", "a", None], [f"l{i}" for i in range(10)]])
def test_proofs_of_small_trees(spark, langs):
    rows = [(i, f"Text {i}", x, "s", i) for i, x in enumerate(langs)]
    got = manifest.proofs(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute_proofs(rows), key=repr)


@pytest.mark.parametrize("name", ["op11_audit", "op12_licenses", "op13_manifest"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, "/root/testdata/sf0.001"), con.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted((tuple(r) for r in got.select(want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)

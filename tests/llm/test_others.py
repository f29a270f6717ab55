"""Vectors, pages, components, and the pipeline stage by stage against brute force."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

import corpus_pipeline
from kinweave.llm import common, embeddings, html, queries

from .test_texts import brute_components


def test_components(spark):
    draw = random.Random(1)
    pairs = [(i, i + 1) for i in range(60)] + [(draw.randint(100, 400), draw.randint(100, 400)) for _ in range(150)] + [(9, 9)]
    parent = {x: x for p in pairs for x in p if p[0] != p[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


@pytest.mark.parametrize("block", [1024, 7])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    draw = np.random.default_rng(4)
    base = draw.standard_normal((5, 16))
    rows = [(i, (base[i % 5] * draw.uniform(0.1, 9) + draw.standard_normal(16) * draw.choice([0.0, 0.12, 0.2, 0.9])).astype(np.float32).tolist(), int(i % 3)) for i in range(90)]
    rows += [(90, rows[3][1], rows[3][2]), (91, rows[3][1], rows[3][2]), (92, rows[3][1], None), (93, None, 0), (94, [0.0] * 16, 0), (95, [float("nan")] + [1.0] * 15, 0), (96, [float("inf")] + [1.0] * 15, 0)]
    rows += [(97, [None] + [1.0] * 15, 0), (98, [], 0), (99, [1.0, 2.0], 0), (100, [2.0, 4.0], 0), (None, rows[3][1], 0), rows[5]]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, component string")

    def good(v, label):
        return v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    links, parent = [0] * n, list(range(n))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for i, j in itertools.combinations(range(n), 2):
        (a, v, x), (b, w, y) = rows[i], rows[j]
        if None in (a, b) or not good(v, x) or not good(w, y) or x != y or len(v) != len(w):
            continue
        v, w = np.array(v, float), np.array(w, float)
        if v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
            links[i], links[j] = links[i] + 1, links[j] + 1
            p, q = find(i), find(j)
            parent[max(p, q)] = min(p, q)
    groups = defaultdict(list)
    for i in range(n):
        groups[find(i)].append(rows[i][0])
    want = Counter((rows[i][0], links[i], None if rows[i][0] is None else min(x for x in groups[find(i)])) for i in range(n))
    got = embeddings.near_duplicate_vectors(df).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want and max(links) > 3
    assert embeddings.near_duplicate_vectors(df.where("false")).count() == 0


@given(st.integers(0, 1000))
def test_bounds_lose_no_pair(seed):
    draw = np.random.default_rng(seed)
    a = draw.standard_normal((20, 8))
    b = a + draw.standard_normal((20, 8)) * draw.choice([1e-6, 0.1, 0.2, 0.3])
    i, j = embeddings.linked(a, b, 0.98)
    cosine = (a @ b.T) / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)
    sure = {(x, y) for x, y in zip(*np.nonzero(cosine >= 0.98 + 1e-12))}
    assert sure <= set(zip(i, j)) <= {(x, y) for x, y in zip(*np.nonzero(cosine >= 0.98 - 1e-12))}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body class="sidebar-layout">
<header class="site-header"><a href="/">Home</a> <p>The best site of all the sites there are, every day.</p></header><nav><ul><li><a href="/a">One</a></li><li><a>Two</a></li></ul></nav>
<div id="cookie-notice"><p>We use cookies to make this site work better for you, please accept them all now.</p></div>
<div class="wrap"><main><h1>A &amp; B&#39;s story</h1><p>First   paragraph with <b>bold</b> and <a href="x">one link</a> in it,<br>and a second line.<p>Second &lt;paragraph&gt; without an end tag, and with an &unknown; reference &eacute;.
<div class="ad-slot"><p>Buy this now, it is the very best thing that you can buy in this shop today.</p></div><ul><li>A list item that belongs to the article text.</li></ul>
<!-- a comment <p>not this</p> --><form><p>Sign up for more of these articles, with your name.</p><input></form></main>
<aside><p>Related: another article that you might like to read, about other things.</p></aside>
<section class="comments"><div class="comment"><p>I liked this article a lot, and I want to say so here, at length.</p></div></section></div>
<footer><p>Copyright by the people who made this, all rights are reserved, of course.</p></footer></body></html>"""
TEXT = "A & B's story First paragraph with bold and one link in it, and a second line. Second <paragraph> without an end tag, and with an &unknown; reference é. A list item that belongs to the article text."


def test_pages(spark):
    assert html.main_text(PAGE) == TEXT
    rows = [(1, "u", PAGE, "clash"), (1, "u", PAGE, "clash"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<nav><a>x</a></nav>", "x"), (None, "u", "<p>Only a paragraph of plain words, without any frame.", "x"), (5, "u", "<article><p>" + "word " * 50_000 + "<!-- cut", "x"), (6, "u", "<p title=\"cut off", "x")]
    got = Counter(tuple(r) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect())
    assert got[1, "u", TEXT, len(TEXT)] == 2 and got[2, None, "", 0] == got[3, "u", "", 0] == got[4, "u", "", 0] == 1
    assert got[None, "u", "Only a paragraph of plain words, without any frame.", 51] == 1
    assert got[5, "u", ("word " * 50_000).strip(), 249_999] == 1 and sum(got.values()) == len(rows)


ARTICLE = "".join(f"<p>Paragraph {i} of the article has quite a few words, more than any block around it has, and ends here.</p>" for i in range(6))
FRAME = '<nav><a href="/">Home</a></nav>{}<div class="sidebar"><div><p>Read the other texts of this site too, they are all as good.</p></div></div><footer><p>All rights reserved.</p></footer>'


@pytest.mark.parametrize(
    "wrapped",
    ['<div class="content-sidebar-wrap"><div>{}</div></div>', '<div class="has-sidebar">{}</div>', '<div id="page" class="no-comments"><div class="search-content"><div>{}</div></div></div>',
     '<form id="aspnetForm" action="/">{}</form>', '<div class="widget"><article>{}</article></div>', '<div class="share-page"><div class="inner"><div class="entry">{}</div></div></div>'],
)
def test_names_around_the_whole_text(wrapped):
    text = html.main_text(FRAME.format(wrapped.format(ARTICLE)))
    assert text.startswith("Paragraph 0") and text.count("ends here.") == 6 and text.endswith("ends here.")
    whole = html.main_text(wrapped.format(FRAME.format("<div>" + ARTICLE + "</div>")))
    assert whole.count("ends here.") == 6 and "other texts" not in whole and "rights" not in whole


@pytest.mark.parametrize("wrapper", ['<div class="content no-sidebar">', '<div class="has-header">', '<div class="page-with-comments">', '<main class="search-results">', '<div class="layout comments">'])
def test_wrappers_of_a_plain_article(wrapper):
    assert html.main_text(wrapper + ARTICLE + "</div>").count("ends here.") == 6


COMMENT = "<p>I liked this article a lot, and I want to say so here, at length, as others do.</p>"


@pytest.mark.parametrize("n", [1, 3, 40])
@pytest.mark.parametrize("name", ["comments-with-replies", "ads-hide-on-print", "widget-has-title", "share-without-count", "no-js comments", "comments", "feedback"])
@pytest.mark.parametrize("frame", ["<article>{}</article>", "<div>{}</div>"])
def test_names_of_states_beside_an_article(frame, name, n):
    text = html.main_text(frame.format(ARTICLE) + f'<section class="{name}">' + f"<div>{COMMENT}</div>" * n + "</section>")
    assert text.count("ends here.") == 6 and "liked" not in text


@pytest.mark.parametrize("wrapper", ["no-sidebar", "has-header", "page-with-comments", "layout comments"])
def test_wrappers_of_an_article_and_its_comments(wrapper):
    text = html.main_text(f'<div class="{wrapper}"><article>{ARTICLE}</article><div class="comments">{COMMENT * 5}</div></div>')
    assert text.count("ends here.") == 6 and "liked" not in text


def test_the_cut_corrects_labels_of_single_blocks(spark):
    short = '<article><h2>Parts</h2><p>' + "The article begins with a sentence of some length. " * 3 + '</p><ul><li><a href="/a">One linked part</a></li><li><a href="/b">Two linked parts</a></li></ul><p>' + "It ends with one more sentence. " * 3 + "</p></article>"
    comment = '<div class="comments"><p>' + "This comment reads like any sentence of the article above. " * 2 + "</p></div>"
    page = html.blocks(short + comment)
    labels = html.minimum_cut(*html.graph(page))[: len(page)]
    wrong = {b.text[:12] for b, keep in zip(page, labels) if (b.score >= 0) != keep}
    assert wrong == {"One linked p", "Two linked p", "This comment"}
    assert [b.text[:12] for b, keep in zip(page, labels) if keep] == ["Parts", "The article ", "One linked p", "Two linked p", "It ends with"]
    # without edges every block stands for itself, also on real pages
    changed = 0
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        page = html.blocks(r["html"] or "")
        changed += sum((b.score >= 0) != keep for b, keep in zip(page, html.minimum_cut(*html.graph(page))))
    assert changed > 0


@given(st.lists(st.sampled_from(["<p>Some words of an article, and more.", '<div class="sidebar">', "</div>", "<article>", "</article>", '<a href="/">link text</a><hr>', "<nav>a menu</nav>", '<div class="comments no-menu">', "short<hr>"]), max_size=9))
def test_pages_by_brute_force(parts):
    content, boiler, edges = html.graph(html.blocks("".join(parts)))
    total = lambda keep: sum(c if k else b for k, c, b in zip(keep, content, boiler)) + sum(w for i, j, w in edges if keep[i] != keep[j])
    assert total(html.minimum_cut(content, boiler, edges)) == min(total(k) for k in itertools.product([True, False], repeat=len(content)))


def test_wide_page_and_empty_table(spark):
    wide = "<main>" + "<p>one two three four five six seven eight.</p>" * 20_000 + "</main>"
    pages = spark.createDataFrame([(1, "u", wide)], "page_id long, url string, html string")
    assert html.extract(pages).first()["text"].count("eight.") == 20_000
    assert html.extract(pages.where("false")).count() == 0


def test_names_around_other_text():
    comments = '<div class="comments">' + '<div class="comment"><p>I liked this a lot, and I want to say so here, at length, as others do.</p></div>' * 20 + "</div>"
    text = html.main_text(FRAME.format("<main>" + ARTICLE + "</main>" + comments))
    assert text.count("ends here.") == 6 and "liked" not in text
    assert "hidden" not in html.main_text('<div style="display:none"><article><p>' + "hidden words " * 40 + "</p></article></div>" + ARTICLE)


@given(st.data())
def test_minimum_cut(data):
    n = data.draw(st.integers(1, 7))
    cost = st.integers(0, 20)
    content, boiler = (data.draw(st.lists(cost, min_size=n, max_size=n)) for _ in range(2))
    edges = data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1), cost).filter(lambda e: e[0] != e[1]), max_size=9))
    total = lambda keep: sum(c if k else b for k, c, b in zip(keep, content, boiler)) + sum(w for i, j, w in edges if keep[i] != keep[j])
    assert total(html.minimum_cut(content, boiler, edges)) == min(total(k) for k in itertools.product([True, False], repeat=n))


def test_deep_and_wide_pages():
    assert html.main_text("<div>" * 3000 + "<p>Some words in the deep of the page, quite a few.</p>").startswith("Some words")
    assert len(html.blocks("<p>a b c d e f.</p>" * 5000)) == 5000
    assert html.main_text("<p>one two three four five six seven eight.</p>" * 3000).count("eight.") == 3000


def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs.collect())
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
    first, second, third, fourth, last = kept
    bad = {i for i, q in labels.items() if not q}
    assert len(bad & {r["doc_id"] for r in first}) <= 0.1 * len(bad)
    assert sum(r["doc_id"] in labels and labels[r["doc_id"]] for r in first) >= 0.97 * sum(labels.values())
    want = {c for _, _, c in brute_components([(r["doc_id"], r["text"]) for r in first], 5, 80)}
    assert {r["doc_id"] for r in second} == want and len(second) == len(want)
    windows = Counter()
    for r in second:
        w = r["text"].encode().split()
        windows.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    cut = {r["doc_id"]: r["text"] for r in third}
    for r in second:
        w = r["text"].encode().split()
        covered = {k for i in range(len(w) - 34) if windows[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}
        left = b" ".join(x for i, x in enumerate(w) if i not in covered).decode()
        assert cut.get(r["doc_id"]) == (r["text"] if not covered else left or None)
    size = lambda rs: sum(len((r["text"] or "").encode().split()) for r in rs)
    assert abs(size(fourth) - size(third)) <= 0.25 * size(third)
    assert {(r["doc_id"], r["text"]) for r in fourth} <= {(r["doc_id"], r["text"]) for r in third}
    pieces = Counter()
    for r in last:
        pieces[r["doc_id"]] += r["length"]
    copies = Counter(r["doc_id"] for r in fourth)
    tokens = {r["doc_id"]: r["doc_tokens"] for r in last}
    assert {i: pieces[i] for i in copies} == {i: copies[i] * tokens[i] for i in copies}


def test_pipeline_on_an_empty_table(spark, nothing, tmp_path):
    docs = nothing
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.count() == 0


CONTRACT = {
    "op1_binary": ("documents", ["doc_id", "start", "n_tokens", "ids_crc32"]),
    "op2_quality": ("documents", ["doc_id", "held_out", "score", "predicted"]),
    "op3_language": ("documents", ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]),
    "op4_packing": (None, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]),
    "op5_rules": ("documents", ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]),
    "op6_html": ("pages", ["page_id", "url", "text", "n_chars"]),
    "op7_embeddings": ("embeddings", ["vec_id", "n_links", "component_id", "kept"]),
    "op8_substring": ("documents", ["doc_id", "n_words", "n_removed", "kept_sha256"]),
    "op9_mixing": ("documents", ["doc_id", "size", "source_size", "target", "taken"]),
    "op10_minhash": ("documents", ["doc_id", "n_shingles", "component_id", "kept"]),
}


@pytest.mark.parametrize("name", CONTRACT)
def test_registered_query(spark, name):
    source, columns = CONTRACT[name]
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert got.columns[: len(columns)] == columns
    rows = got.collect()
    if source:
        assert len(rows) == spark.read.parquet(f"/root/testdata/sf0.001/{source}.parquet").count()
        assert Counter(r[0] for r in rows) == Counter(r[0] for r in spark.read.parquet(f"/root/testdata/sf0.001/{source}.parquet").select(columns[0]).collect())
    else:
        ends = defaultdict(int)
        for r in rows:
            ends[r["doc_id"]] = max(ends[r["doc_id"]], r["start"] + r["length"])
        assert all(ends[r["doc_id"]] == r["doc_tokens"] for r in rows)


def test_registered_pipeline_over_odd_rows(spark, docs, rows, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns go through all five stages."""
    docs.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(r[0], int("other" not in (r[1] or "")), 0) for r in rows if r[0] is not None and r[0] % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert pieces and {p["doc_id"] for p in pieces} <= {r[0] for r in rows}
    filled = Counter()
    for p in pieces:
        filled[p["sequence_id"]] += p["length"]
    assert max(filled.values()) <= 2048

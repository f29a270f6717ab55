"""Main text of web pages by minimum-cut labelling of their blocks.

A page falls into blocks: runs of text between block-level tags. Its graph has a node for each block and for each
element that tells something about what it encloses: tags and names of boilerplate or content, and hidden elements.
A linear classifier on a block's own words, links and tag gives the costs of calling it content or boilerplate; they
are capacities to the two terminals, as are the costs of the elements. Edges of DOM proximity join a block to the
innermost element of each kind around it (the capacity falls with the distance to a boilerplate name), and blocks
next to each other in the page or under one parent (it grows with the share of their path that is common). The
minimum cut is the cheapest labelling of all of them. What an element of a boilerplate name costs as content is the
content that the page has outside it, so an element around most of a page turns into content with it, and one
around a part of the page takes that part out, however much like an article it reads. Where a text of its own stands
before the element, its cost has no limit: comments may be longer than their article.

Edge cases: null or empty html, and pages without content, give empty text; cut-off tags, comments and scripts end
with the page; unknown character references stay as written; white space of any kind inside a block is one space;
of labellings that cost the same, the one with more content; a page of very many blocks is one graph of linear size;
repeated rows give equal texts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict, deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|math|iframe|object|title|textarea|select|audio|video|canvas)\b(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE_TAGS = frozenset("nav footer aside menu dialog button head".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs byline comment comments commentary complementary consent contentinfo cookie cookies copyright "
    "disclaimer discussion disqus dropdown feedback footer footnav form gdpr header login masthead menu menus meta modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo "
    "promotion promoted reactions recommended related replies reply respond responses rss search share sharing sidebar signup skyscraper social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split()
)
CONTENT_NAMES = frozenset("article articlebody body content entry main maincontent post postcontent story text".split())
#: Elements whose start ends an open one of the same kinds.
_ENDS = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
#: Elements that such an implied end does not reach beyond.
_WALLS = frozenset("ul ol dl table body article section div main".split())

SMOOTH, UNIT = 0.8, 1000
#: Capacities from a block to the element around it: of certain boilerplate; of a boilerplate name, the share of it that is
#: left an element further out, and what each outer one adds; of a content name.
CERTAIN, NAMED, NEARER, OUTER, CONTENT = 8.0, 10.0, 0.85, 1.0, 2.5
#: With so much content of no boilerplate name before it, about three paragraphs, an element of one is no part of the text.
BEFORE = 8.0
#: What no cut goes through.
FIXED = 1 << 40


class Block:
    """A run of text, its own score, and the numbers (0: none) of the innermost elements around it: certain, of a boilerplate name, of content."""

    __slots__ = ("bond", "certain", "framed", "named", "path", "score", "tag", "text")

    def __init__(self, tag: str, path: tuple, text: str, links: int, certain: int, named: tuple[int, int, int], depth: int, framed: int):
        self.tag, self.path, self.text, self.certain, self.framed = tag, path, text, certain, framed
        self.named, name_depth, outer = named
        self.bond = NAMED * NEARER ** (depth - name_depth) + OUTER * outer
        n = len(text.split())
        self.score = 0.5 + min(n, 40) / 20 - 3 * min(1.0, links / max(1, len(text)))
        self.score += 1.0 if tag in ("p", "blockquote", "pre") else 0.7 if tag in ("h1", "h2", "h3") else 0.0
        self.score += 0.5 if text[-1] in ".!?…\"”»" else 0.0
        self.score -= 1.0 if n < 4 and not framed else 0.0


def _boilerplate(value: str) -> bool:
    """Whether one of the names of an attribute is of boilerplate."""
    for name in value.split():
        parts = {p.lower() for p in _PARTS.findall(name)}
        if not parts.isdisjoint(BOILERPLATE_NAMES):
            return True
    return False


def blocks(page: str) -> list[Block]:
    """Blocks in page order."""
    out: list[Block] = []
    # tag, number, number of a certain element, (number, depth, others around it) of one with a boilerplate name, depth, number of a content element, in a link
    stack: list[tuple[str, int, int, tuple[int, int, int], int, int, bool]] = [("", 0, 0, (0, 0, 0), 0, 0, False)]
    text: list[str] = []
    linked = number = at = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if stack[-1][6]:
                linked += len(piece.strip())

    def end_block() -> None:
        nonlocal linked
        if text:
            line = " ".join("".join(text).split())
            if line:
                around = [s for s in stack if s[0] not in INLINE]
                top = around[-1]
                inner = stack[-1]
                out.append(Block(top[0], tuple(s[1] for s in around), line, linked, inner[2], inner[3], top[4], top[5]))
            text.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = m[3] or m[6]
        if not tag:
            if m[1]:
                end_block()
            continue
        tag, closing, attributes = tag.lower(), m[2] or m[5], m[4] or m[7] or ""
        if tag == "br":
            text.append(" ")
            continue
        if tag not in INLINE:
            end_block()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if tag not in INLINE:
            ends = _ENDS.get(tag, ("p",))
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ends:
                    del stack[k:]
                    break
                if stack[k][0] in _WALLS:
                    break
        if tag in VOID or attributes.endswith("/") and tag not in INLINE:
            continue
        _, _, certain, named, depth, framed, link = stack[-1]
        depth += tag not in INLINE
        number += 1
        bad = good = hidden = False
        if attributes:
            hidden = bool(_HIDDEN.search(attributes))
            if tag not in ("html", "body"):
                values = [x[2] or x[3] or x[4] or "" for x in _NAMES.finditer(attributes)]
                bad = any(map(_boilerplate, values))
                good = any(p.lower() in CONTENT_NAMES for v in values for p in _PARTS.findall(v))
        bad, good = bad or tag == "form", good or tag in ("article", "main")
        if not certain and (hidden or tag in BOILERPLATE_TAGS or tag == "header" and not any(s[0] == "article" for s in stack)):
            certain = number
        if good and not bad:
            framed = number
        if bad:
            named = (number, depth, named[2] + (named[0] > 0))
        elif good and tag not in INLINE:
            named = (0, 0, 0)
        stack.append((tag, number, certain, named, depth, framed, link or tag == "a"))
    add(page[at:])
    end_block()
    return out


def smoothness(page: list[Block]) -> list[tuple[int, int, int]]:
    """Edges (i, j, capacity): neighbours in the page, and neighbours under one parent."""
    out, last = [], {}
    for j, b in enumerate(page):
        parent = b.path[:-1] if b.tag in ("p", "li", "td", "h1", "h2", "h3") else b.path
        for i in {j - 1, last.get(parent, -1)} - {-1}:
            a = page[i].path
            common = next((k for k, (x, y) in enumerate(zip(a, b.path)) if x != y), min(len(a), len(b.path)))
            out.append((i, j, round(UNIT * SMOOTH * common / max(len(a), len(b.path)))))
        last[parent] = j
    return out


def minimum_cut(content: list[int], boilerplate: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """For each node whether it is on the content side of the minimum cut; costs of either label, and of parting two nodes.

    Dinic's maximum flow: a node's cheaper label is a flow straight through, what remains starts from nodes that
    want content and ends at nodes that want the other.
    """
    n = len(content)
    left = [b - c for c, b in zip(content, boilerplate)]  # above 0: still to come from the source; below: to go to the sink
    to, capacity, near = [], [], [[] for _ in range(n)]
    for i, j, c in edges:
        if c:
            near[i].append(len(to))
            to.append(j)
            capacity.append(c)
            near[j].append(len(to))
            to.append(i)
            capacity.append(c)
    while True:
        level = [0 if x > 0 else -1 for x in left]
        queue, reached = deque(i for i in range(n) if left[i] > 0), False
        while queue:
            i = queue.popleft()
            reached = reached or left[i] < 0
            for e in near[i]:
                if capacity[e] and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if not reached:
            return [x >= 0 for x in level]
        turn = [0] * n
        for s in range(n):
            while left[s] > 0:  # one more path from s, by depth first along rising levels
                path, i = [], s
                while left[i] >= 0 or i == s:
                    while turn[i] < len(near[i]) and not (capacity[near[i][turn[i]]] and level[to[near[i][turn[i]]]] == level[i] + 1):
                        turn[i] += 1
                    if turn[i] < len(near[i]):
                        path.append(near[i][turn[i]])
                        i = to[path[-1]]
                    elif path:
                        i = to[path.pop() ^ 1]
                        turn[i] += 1
                    else:
                        break
                if not path:
                    break
                flow = min(left[s], -left[i], *(capacity[e] for e in path))
                for e in path:
                    capacity[e] -= flow
                    capacity[e ^ 1] += flow
                left[s] -= flow
                left[i] += flow


def graph(page: list[Block]) -> tuple[list[int], list[int], list[tuple[int, int, int]]]:
    """Costs of the labels content and boilerplate of the blocks, then of the elements around them, and the edges of all."""
    cost = lambda x: round(UNIT * math.log1p(math.exp(min(x, 30.0))))
    content, boilerplate, edges = [cost(-b.score) for b in page], [cost(b.score) for b in page], smoothness(page)
    evidence = [max(0.0, b.score + CONTENT * (b.framed > 0)) for b in page]
    free = [i for i, b in enumerate(page) if not b.certain]
    # the page's content is that of content elements, or all of it where there are none: comments longer than their article stay comments
    own = [i for i in free if page[i].framed] or free
    total, held = sum(evidence[i] for i in own), defaultdict(float)
    plain, before = 0.0, {}
    for i in own:
        named = page[i].named
        held[named] += evidence[i]
        before.setdefault(named, plain)
        plain += 0.0 if named else evidence[i]
    nodes: dict[tuple[str, int], int] = {}

    def join(i: int, kind: str, number: int, bond: float, as_content: int, as_boilerplate: int) -> None:
        node = nodes.setdefault((kind, number), len(content))
        if node == len(content):
            content.append(as_content)
            boilerplate.append(as_boilerplate)
        edges.append((i, node, round(UNIT * bond)))

    for i, b in enumerate(page):
        if b.certain:
            join(i, "certain", b.certain, CERTAIN, FIXED, 0)
        elif b.named:
            join(i, "named", b.named, b.bond, round(UNIT * (total - held[b.named])) if held[b.named] and before[b.named] < BEFORE else FIXED, 0)
        if b.framed:
            join(i, "framed", b.framed, CONTENT, 0, FIXED)
    return content, boilerplate, edges


def main_text(page: str) -> str:
    """Content blocks of a page, joined by one space."""
    found = blocks(page)
    return " ".join(b.text for b, keep in zip(found, minimum_cut(*graph(found))) if keep)


def _extracted(batches):
    for batch in batches:
        texts = [main_text(p or "") for p in batch.column("html").to_pylist()]
        kept = [batch.column(c) for c in ("page_id", "url")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of pages (page_id, url, html)."""
    return pages.select("page_id", "url", "html").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

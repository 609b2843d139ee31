"""Main text of web pages by a minimum cut between content and boilerplate.

General: the project keeps no web pages, so the operator takes any table ``pages(page_id, url, html)``.

A page becomes a row of text blocks. A logistic classifier, fitted here on blocks whose place in the page speaks for
itself, gives each block a cost of either label: its terminal capacity. Neighbouring blocks, and blocks under
one parent, are tied by smoothness edges that weaken with their distance in the DOM. The maximum flow
separates the page.
"""
from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element names by what they do to text.
BLOCK = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav noscript ol optgroup option p pre section select "
    "summary table tbody td textarea tfoot th thead title tr ul video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template head title noscript svg math iframe object".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
FOREIGN = frozenset("svg math".split())
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section "
    "table ul".split())

# Words in class, id and role attributes that tell what a part of a page is for.
AWAY = {
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs toolbar topbar pagination pager",
    "frame": "header footer masthead banner colophon copyright legal",
    "side": "sidebar aside widget related recommended trending popular teaser promo tags",
    "advert": "ad ads advert adverts advertisement sponsor sponsored",
    "notice": "cookie cookies consent notice alert popup modal newsletter subscribe gdpr paywall disclaimer",
    "form": "form login search signup",
    "talk": "comment comments commentlist disqus reply replies respond discussion",
    "share": "share social sharing follow",
}
TOWARDS = "article content post entry story main body text"
_AWAY = {w: k for k, ws in AWAY.items() for w in ws.split()}
_TOWARDS = frozenset(TOWARDS.split())
TAGS = ("nav", "header", "footer", "aside", "form", "button", "article", "main")
OWN = ("p", "li", "h", "td")
FEATURES = (*TAGS, *AWAY, "towards", *OWN, "length", "links", "stops", "long", "bias")

# Where the fit starts and what it is pulled to: the meaning of elements, links against prose.
PRIOR = dict.fromkeys(("nav", "footer", "aside", "form", "button", *AWAY), -4.0) | {
    "header": -2.0, "article": 3.0, "main": 2.0, "towards": 1.0, "p": 1.0, "li": -0.5, "h": 0.5, "td": 0.0,
    "length": 0.5, "links": -3.0, "stops": 1.0, "long": 1.0, "bias": -1.0}


class Place:
    """A block element among those around it. Places are shared by what lies in them, so depth costs no memory."""

    __slots__ = ("up", "depth")

    def __init__(self, up: Place | None) -> None:
        self.up, self.depth = up, up.depth + 1 if up else 0


def steps_between(a: Place, b: Place) -> int:
    """Elements to leave and to enter on the way from one place to another."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        steps += 1
    return steps


class Block:
    """Text of one block, where it is and what is known of the elements around it."""

    __slots__ = ("text", "place", "flags", "own", "linked")

    def __init__(self, text: str, place: Place, flags: frozenset[str], own: str, linked: int) -> None:
        self.text, self.place, self.flags, self.own, self.linked = text, place, flags, own, linked


class Open(NamedTuple):
    """An open element: its tag and, of all open elements up to it, flags, place and the tag of the innermost block."""

    tag: str
    flags: frozenset[str]
    place: Place
    own: str


class _Reader(HTMLParser):
    """Open elements are found by their tag and not by a walk over the stack: a tag costs the same at any depth."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.root = Open("", frozenset(), Place(None), "")
        self.stack: list[Open] = []
        self.open: defaultdict[str, list[int]] = defaultdict(list)
        self.block_at: list[int] = []
        self.text: list[str] = []
        self.linked = self.in_link = self.unseen = 0

    def end_block(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            self.text = []
            if text:
                top = self.stack[-1] if self.stack else self.root
                self.blocks.append(Block(text, top.place, top.flags, top.own, self.linked))
        self.linked = 0

    def drop(self, down_to: int) -> None:
        while len(self.stack) > down_to:
            tag = self.stack.pop().tag
            self.open[tag].pop()
            if tag in BLOCK:
                self.block_at.pop()
            self.in_link -= tag == "a"
            self.unseen -= tag in UNSEEN

    def close(self) -> None:
        super().close()
        self.end_block()

    def parse_html_declaration(self, i: int) -> int:
        """Marked sections the parser can't read are comments up to the next ``>``, as in browsers."""
        try:
            return super().parse_html_declaration(i)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def end_head(self, tag: str) -> None:
        """An element that may not be in a head ends an open one; what is inside its title, template, script and so on doesn't."""
        if tag not in IN_HEAD and tag not in ("html", "head") and self.stack and self.stack[-1].tag == "head":
            self.end_block()
            self.drop(len(self.stack) - 1)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.end_head(tag)
        if tag in BLOCK:
            self.end_block()
            if self.block_at:  # what a start tag ends is always a block
                inner = self.stack[self.block_at[-1]].tag
                if inner in CLOSED_BY.get(tag, ()) or inner == "p" and tag in CLOSES_P:
                    self.drop(self.block_at[-1])
            if tag == "body" and self.open["head"]:
                self.drop(self.open["head"][0])
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        flags = {tag} if tag in TAGS else set()
        for key, value in attrs:
            if value and key in ("class", "id", "role", "itemprop"):
                for word in value.lower().replace("-", " ").replace("_", " ").split():
                    if word in _AWAY:
                        flags.add("." + _AWAY[word])
                    if word in _TOWARDS:
                        flags.add(".towards")
        around = self.stack[-1] if self.stack else self.root
        self.open[tag].append(len(self.stack))
        place, own = around.place, around.own
        if tag in BLOCK:
            self.block_at.append(len(self.stack))
            place, own = Place(place), tag
        self.stack.append(Open(tag, around.flags if flags <= around.flags else around.flags | flags, place, own))
        self.in_link += tag == "a"
        self.unseen += tag in UNSEEN

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in FOREIGN or tag not in VOID and tag not in BLOCK and tag not in UNSEEN:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_block()
        at = self.open[tag]
        if at and (tag in BLOCK or not self.block_at or at[-1] > self.block_at[-1]):
            self.drop(at[-1])

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.end_head("")
        if not self.unseen:
            self.text.append(data)
            if self.in_link:
                self.linked += len(data.strip())


def page_blocks(html: str | None) -> list[Block]:
    """Visible text blocks in page order, white space collapsed, references decoded."""
    reader = _Reader()
    try:
        reader.feed(html or "")
        reader.close()
    except AssertionError:  # the parser's word for markup declarations it can't read; what came before stays
        reader.end_block()
    return reader.blocks


def block_features(blocks: list[Block]) -> np.ndarray:
    """``FEATURES`` of each block."""
    x = np.zeros((len(blocks), len(FEATURES)))
    at = {n: i for i, n in enumerate(FEATURES)}
    for i, b in enumerate(blocks):
        for flag in b.flags:
            x[i, at[flag.removeprefix(".")]] = 1
        if "article" in b.flags and "header" in b.flags:
            x[i, at["header"]] = 0  # an article's own heading
        own = "h" if b.own in ("h1", "h2", "h3", "h4", "h5", "h6") else b.own
        if own in OWN:
            x[i, at[own]] = 1
        n = len(b.text)
        x[i, -5:] = (min(np.log1p(n) / 5, 2), min(b.linked / n, 1), min(20 * sum(map(b.text.count, ".!?,")) / n, 1), n > 120, 1)
    return x


def seed_labels(blocks: list[Block]) -> np.ndarray:
    """1 content, 0 boilerplate, -1 unknown, by the elements and names around a block."""
    away = {"nav", "footer", "aside", "form", "button", *("." + k for k in AWAY)}
    out = np.full(len(blocks), -1)
    for i, b in enumerate(blocks):
        if b.flags & away or ("header" in b.flags and "article" not in b.flags):
            out[i] = 0
        elif b.flags & {"article", "main"}:
            out[i] = 1
    return out


def fit_blocks(pages: DataFrame, train_pages: int = 2_000, pull: float = 3.0) -> np.ndarray:
    """Weights of the block classifier.

    Fitted on the seed blocks of about ``train_pages`` pages chosen by a hash of ``page_id`` (the documented bound; the driver
    gets features and labels counted by equal rows of rounded features). Every block is shown twice, once
    without what its place says, so that text features carry pages without such elements. The weights start
    from ``PRIOR`` and are pulled to it with the weight of ``pull`` blocks, which is all there is without seeds."""
    n = pages.select("page_id").count()
    rows = pages.select("page_id", "html")
    if n > train_pages:
        rows = rows.where(F.pmod(F.xxhash64("page_id"), F.lit(1_000_003)) < int(1_000_003 * train_pages / n))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = [], []
            for html in batch.column(0).to_pylist():
                blocks = page_blocks(html)
                y = seed_labels(blocks)
                xs += list(np.round(block_features(blocks)[y >= 0] * 8) / 8)
                ys += list(y[y >= 0])
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.int32())], names=["x", "y"])

    got = rows.select("html").mapInArrow(read, "x array<double>, y int").groupBy("x", "y").agg(F.count("*").alias("n")).toPandas()
    prior = np.array([PRIOR[f] for f in FEATURES])
    if not len(got):
        return prior
    x = np.stack(got["x"].to_numpy())
    placeless = x.copy()
    placeless[:, :len(TAGS) + len(AWAY) + 1] = 0
    x, y = np.concatenate([x, placeless]), np.tile(got["y"].to_numpy(), 2)
    weight = np.tile(got["n"].to_numpy() / 2.0, 2) * np.where(np.arange(len(x)) < len(x) // 2, 1.0, 0.2)
    w = prior.copy()
    for _ in range(30):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + pull * (w - prior)
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def minimum_cut(gain: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Labels (True: content) of least total cost: node i pays ``gain[i]`` as boilerplate if positive, ``-gain[i]`` as
    content if negative; an edge (i, j, c) with two labels pays c. Dinic's maximum flow."""
    n = len(gain)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def tie(a: int, b: int, c: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(c)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, g in enumerate(gain):
        if g > 0:
            tie(source, i, float(g), 0.0)
        elif g < 0:
            tie(i, sink, float(-g), 0.0)
    for a, b, c in edges:
        tie(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if room[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return np.array(level[:n]) >= 0
        turn = [0] * (n + 2)
        path: list[int] = []
        at = source
        while True:
            if at == sink:
                least = min(room[e] for e in path)
                cut = 0
                for k, e in enumerate(path):
                    room[e] -= least
                    room[e ^ 1] += least
                    if room[e] <= 1e-12 and not cut:
                        cut = k + 1
                del path[cut - 1:]
                at = to[path[-1]] if path else source
                continue
            while turn[at] < len(head[at]):
                e = head[at][turn[at]]
                if room[e] > 1e-12 and level[to[e]] == level[at] + 1:
                    path.append(e)
                    at = to[e]
                    break
                turn[at] += 1
            else:
                if at == source:
                    break
                level[at] = -1
                path.pop()
                at = to[path[-1]] if path else source


def smoothness(blocks: list[Block], next_to: float = 0.8, same_parent: float = 0.6) -> list[tuple[int, int, float]]:
    """Edges between neighbours, weaker with each DOM step between them, and along the blocks of one parent."""
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, next_to / (1 + steps_between(blocks[i - 1].place, b.place))))
        parent = b.place.up or b.place
        if parent in last:
            edges.append((last[parent], i, same_parent))
        last[parent] = i
    return edges


def main_text(html: str | None, weights: np.ndarray) -> str:
    """Content blocks of a page in page order, one line each."""
    blocks = page_blocks(html)
    if not blocks:
        return ""
    keep = minimum_cut(block_features(blocks) @ weights, smoothness(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract_pages(pages: DataFrame, weights: np.ndarray) -> DataFrame:
    """``page_id, url, text`` of every ``pages(page_id, url, html)`` row, from the whole html in one pass.

    White space inside a block is one blank, references are decoded, blocks are joined in page order by a line
    feed. A null or empty page, or one without content, has an empty text. Repeated rows give repeated rows, no rows
    none; ids and addresses pass as they are, null too; other columns are not read."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), weights) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string").alias("url"), "html").mapInArrow(read, f"page_id {kind}, url string, text string")

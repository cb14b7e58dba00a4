"""Main text of web pages by minimum-cut labelling.

A page is read into blocks of text with the path of elements above each. Classifier costs become terminal capacities: a logistic
regression over what a block looks like (length, links, punctuation, element), and the evidence of the names around it (``article``,
``nav``, ``class="ad"``). Smoothness edges join neighbouring blocks, stronger the closer they stand in the document tree, and every
block with the element that holds it, elements with theirs. Max-flow separates content from boilerplate; the blocks on the
content side of the minimum cut are the page's text.

The regression learns from blocks whose page names them: those below ``article`` or ``main`` against those below ``nav``, ``footer``,
``aside`` and the like. It is fitted on at most ``PAGES`` pages and ``BLOCKS`` blocks of each; names are no features of it.
"""
from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import slices, whole_text

PAGES, BLOCKS = 400, 40                # bounds of the sample that the classifier is fitted on
SEED, RIDGE = 12, 1.0
NAMED = {1: 4.0, -1: -8.0, 0: 0.0}     # capacities of what names say: content, boilerplate, nothing
BOUND = 3.0                            # bound of the classifier's capacities
NEXT, INSIDE = 0.6, 0.4                # capacities of neighbours and of a block with its element

# Elements of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
SKIPPED = frozenset("head template svg math select button datalist object audio video canvas map dialog".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output progress q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var img br wbr input svg math select button object audio video canvas map".split())
IN_HEAD = frozenset("base link meta title script style noscript template".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
                     "hgroup hr main menu nav ol p pre search section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
            "option": ("option",), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",)}
CONTENT = frozenset(["article", "main"])
OTHER = frozenset(["nav", "footer", "aside", "header", "menu", "form"])
TITLES = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
SMALL = TITLES | {"p", "li", "td", "blockquote", "pre", "header"}   # parts of an article, whatever class they have

OTHER_NAME = re.compile(
    r"(?:^|[\s_-])(?:nav\w*|menus?|foot(?:er)?|side(?:bar)?|sidebars?|banners?|ads?|advert\w*|adsense|promos?|promotion|sponsor\w*|cookies?|consent|gdpr|"
    r"notices?|alerts?|popup|modal|overlay|share|sharing|social|related|recommend\w*|recirc|comments?|commentlist|replies|reply|disqus|respond|discussion|"
    r"breadcrumbs?|pag(?:er|ination)|subscribe|newsletter|signup|login|search|copyright|legal|widgets?|toolbar|tags|skip|hidden|outbrain|taboola)(?=$|[\s_-])", re.I)
HEADER_NAME = re.compile(r"(?:^|[\s_-])(?:head|header|masthead|topbar)(?=$|[\s_-])", re.I)   # of a page; an article's header is a part of it
CONTENT_NAME = re.compile(r"(?:^|[\s_-])(?:article|articlebody|content|entry|post|story|main|body|text|hentry)(?=$|[\s_-])", re.I)
OTHER_ROLE = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
CONTENT_ROLE = frozenset(["main", "article"])

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?/](?![a-zA-Z])[^>]*(?:>|\Z)|<![^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s=/>\"']+)")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}
_STOPS = re.compile(r"[.!?;:,。！？、](?=\s|$)")


class Element:
    __slots__ = ("name", "up", "depth", "says", "form", "skipped", "node")

    def __init__(self, name: str, up: "Element | None", says: int, form: bool, skipped: bool):
        self.name, self.up, self.depth, self.says, self.form, self.skipped, self.node = name, up, up.depth + 1 if up else 0, says, form, skipped, -1


class Block:
    __slots__ = ("text", "at", "linked", "name")

    def __init__(self, text: str, at: Element, linked: int, name: str):
        self.text, self.at, self.linked, self.name = text, at, linked, name


def evidence(name: str, attributes: str, up: Element) -> tuple[int, bool, bool]:
    """What an element's names say about the text below it (1 content, -1 boilerplate, else as above it), whether only a form says so,
    and whether it is not shown."""
    said, hidden = 0, False
    if attributes and not attributes.isspace():
        found = {}
        for m in _ATTRIBUTE.finditer(attributes):
            found.setdefault((m[1] or m[5]).lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
        hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        names, role = found.get("class", "") + " " + found.get("id", ""), found.get("role", "").lower()
        if role in OTHER_ROLE or OTHER_NAME.search(names) or (up.says <= 0 and HEADER_NAME.search(names)):
            said = -1
        elif role in CONTENT_ROLE or CONTENT_NAME.search(names):
            said = 1
    if name in INLINE or name in ("body", "html"):
        said = 0           # a word's class, or the whole page's, says nothing of its blocks
    elif name in SMALL and up.says > 0:
        said = min(said, 0) if name in ("p", "li", "td") else 0
    elif name in OTHER:
        said = -1
    elif name in CONTENT and said == 0:
        said = 1
    if said > 0 and up.says < 0 and not up.form:
        said = 0           # an article inside a sidebar or the comments is no main text
    return said or up.says, name == "form" or (up.form and not said), hidden


def blocks_of(page: str) -> list[Block]:
    """Blocks of text in page order: stretches between the bounds of elements that are not inline. Scripts, styles, controls, comments
    and what is not shown are left out; references are decoded and white space is one space."""
    here = Element("", None, 0, False, False)
    out: list[Block] = []
    pieces: list[str] = []
    opened: dict[str, int] = {}            # how many elements of a name are open
    linked = at = 0

    def end() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            block = here
            while block.up is not None and block.name in INLINE:
                block = block.up
            if text:
                out.append(Block(text, block, min(linked, len(text)), block.name))
            pieces.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not here.skipped:
            pieces.append(text)
            if opened.get("a"):
                linked += len(text)

    def leave(e: Element) -> None:
        """Leave an element and all inside it."""
        nonlocal here
        flushed = False
        while True:
            if not flushed and here.name not in INLINE:
                end()
                flushed = True
            opened[here.name] -= 1
            last, here = here, here.up
            if last is e:
                return

    def nearest(names: tuple[str, ...], until: tuple[str, ...]) -> Element | None:
        """The nearest open element of these names that none of ``until`` stands before."""
        if not any(opened.get(n) for n in names):
            return None
        e = here
        while e.up is not None and e.name not in until:
            if e.name in names:
                return e
            e = e.up
        return None

    while True:
        m = _MARKUP.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at:m.start()])
        at = m.end()
        name = (m[2] or m[6] or "").lower()
        if not name or (m[4] if m[2] else m[8]) != ">":   # a comment, a declaration, or a tag that the page's end cuts off
            continue
        if m[1] or m[5]:
            if name in INLINE:
                e = here
                while e.up is not None and e.name in INLINE and e.name != name:
                    e = e.up
                if name == "br":
                    add(" ")
                elif e.name == name:
                    leave(e)
            elif (e := nearest((name,), ("table",) if name == "p" else ())) is not None:
                leave(e)
            elif name == "p":
                end()
            continue
        attributes = m[3] or m[7] or ""
        if name in RAW:
            stop = _ENDS[name].search(page, at)
            at = stop.end() if stop else len(page)
            continue
        if opened.get("head") and name not in IN_HEAD and (e := nearest(("head",), ())) is not None:
            leave(e)
        if name not in INLINE:
            end()
        if name in CLOSES_P and (e := nearest(("p",), ("table", "button"))) is not None:
            leave(e)
        while name in SIBLINGS and (e := nearest(SIBLINGS[name], HOLDS.get(name, ()))) is not None:
            leave(e)
        if name in TITLES and here.name in TITLES:
            leave(here)
        if name in VOID:
            if name in ("br", "img", "input"):
                add(" ")
            continue
        says, form, hidden = evidence(name, attributes, here)
        here = Element(name, here, says, form, here.skipped or hidden or name in SKIPPED)
        opened[name] = opened.get(name, 0) + 1
        if attributes.endswith("/") and name in ("svg", "math", "path"):
            leave(here)
    end()
    return out


FEATURES = 11


def features(blocks: list[Block]) -> np.ndarray:
    """What each block looks like, without the names around it."""
    out = np.empty((len(blocks), FEATURES))
    for i, b in enumerate(blocks):
        n, words = len(b.text), b.text.count(" ") + 1
        stops = len(_STOPS.findall(b.text))
        out[i] = (1.0, np.log1p(n) / 4, b.linked / n, min(words, 60) / 30, min(stops, 8) / 4, min(n / words, 20) / 8, b.text[-1] in ".!?…。！？\"'”",
                  b.name == "p", b.name in TITLES, b.name in ("li", "td", "th", "dt", "dd"), min(words, 6) / 6)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Logistic regression by Newton's steps; the classes weigh the same together and a ridge keeps all weights finite."""
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        return w
    share = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (share * (p - y)) + RIDGE * w
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def min_cut(pull: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut, by Dinic's max-flow. A node's ``pull`` is its capacity from the source, or to the sink
    if negative; edges count in both directions. Where cuts tie, the fewest nodes stay."""
    n = len(pull)
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n)]
    for a, b, c in edges:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to += (b, a)
        room += (c, c)
    source, sink = [max(p, 0.0) for p in pull], [max(-p, 0.0) for p in pull]
    least = 1e-9
    while True:
        level = [-1] * n
        queue = [i for i in range(n) if source[i] > least]
        for i in queue:
            level[i] = 0
        reached = False
        for i in queue:                    # grows as it is read
            if sink[i] > least:
                reached = True
            for e in out[i]:
                if room[e] > least and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if not reached:
            return [x >= 0 for x in level]
        nxt = [0] * n
        for start in range(n):
            while source[start] > least:
                path: list[int] = []
                i = start
                while sink[i] <= least:    # down the levels to a node with room to the sink, back where none goes on
                    while nxt[i] < len(out[i]):
                        e = out[i][nxt[i]]
                        if room[e] > least and level[to[e]] == level[i] + 1:
                            break
                        nxt[i] += 1
                    if nxt[i] < len(out[i]):
                        path.append(e)
                        i = to[e]
                    elif path:
                        i = to[path.pop() ^ 1]
                        nxt[i] += 1
                    else:
                        break
                if sink[i] <= least:
                    break
                flow = min([source[start], sink[i], *[room[e] for e in path]])
                source[start] -= flow
                sink[i] -= flow
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow


def graph(blocks: list[Block], logit: np.ndarray) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Terminal capacities and smoothness edges of a page: blocks first, then the elements that hold them."""
    pull = [NAMED[b.at.says] + s for b, s in zip(blocks, np.clip(logit, -BOUND, BOUND).tolist())]
    edges = []
    for i in range(1, len(blocks)):
        a, b = blocks[i - 1].at, blocks[i].at
        steps = 0
        while a is not b:                  # up to the nearest element that holds both
            if a.depth >= b.depth:
                a = a.up
            else:
                b = b.up
            steps += 1
        edges.append((i - 1, i, NEXT / (1 + steps)))
    for i, b in enumerate(blocks):
        e, below = b.at.up or b.at, i
        while True:
            new = e.node < 0
            if new:
                e.node = len(pull)
                pull.append(0.0)
            edges.append((below, e.node, INSIDE))
            if not new or e.up is None:
                break
            below, e = e.node, e.up
    return pull, edges


def main_text(page: str, weights: np.ndarray) -> str:
    """The content blocks of one page, joined by line feeds; empty if there are none."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    content = min_cut(*graph(blocks, features(blocks) @ weights))
    return "\n".join(b.text for b, c in zip(blocks, content) if c)


def sample(pages: DataFrame, html: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of named blocks: of the ``PAGES`` pages with the least hashes the first ``BLOCKS`` of each label in hash order.
    Only these numbers reach the driver, whatever the pages' number and length."""
    draw = F.xxhash64(F.col(f"`{html}`"), F.lit(SEED))
    rows = pages.filter(F.length(F.col(f"`{html}`")) > 0).select(draw.alias("d"))
    least = [r["d"] for r in rows.distinct().orderBy("d").limit(PAGES).collect()]
    if not least:
        return np.zeros((0, FEATURES)), np.zeros(0)
    some = pages.select(F.col(f"`{html}`").alias("t"), draw.alias("d")).filter((F.length("t") > 0) & (F.col("d") <= least[-1])).dropDuplicates(["d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            for d, t in zip(b.column("d").to_pylist(), b.column("t").to_pylist()):
                blocks = blocks_of(t)
                rng = np.random.default_rng(abs(d))
                for y in (1, -1):
                    mine = [x for x in blocks if x.at.says == y]
                    mine = [mine[i] for i in sorted(rng.permutation(len(mine))[:BLOCKS].tolist())]
                    if mine:
                        x = features(mine)
                        yield pa.RecordBatch.from_arrays([pa.array([d] * len(mine)), pa.array([float(y > 0)] * len(mine)), pa.array(x.tolist(), pa.list_(pa.float64()))], ["d", "y", "x"])
    got = sorted((r["d"], r["y"], tuple(r["x"])) for r in some.mapInArrow(run, "d long, y double, x array<double>").collect())
    return np.array([r[2] for r in got]).reshape(-1, FEATURES), np.array([r[1] for r in got])


def extract(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """``keys``, ``text``, ``n_chars``: the main text of each row of ``pages``, repeated and null keys included.

    A null or empty page has an empty text, as has one without any block; a page cut off anywhere is read to its end. Where no page names
    its content, the names that there are and the smoothness decide alone. An empty table gives no rows. Columns other than ``keys``
    and ``html`` are not looked at.
    """
    weights = fit(*sample(pages, html))
    rows = pages.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], whole_text(F.col(f"`{html}`")).alias("__t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__t"):
            texts = [main_text(t, weights) for t in b.column("__t").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             [*b.schema.names[:-1], "text", "n_chars"])
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(run, schema).select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)], "text", "n_chars")

"""Main text of web pages: gradient-boosted trees over DOM nodes, and a hierarchical decision per page.

Each structural node (blocks, scripts, form parts; inline markup belongs to the block around it) gets the probability that it
is or holds main text, from boosted trees over its tag, attribute tokens, depth, siblings and the densities of its subtree. A
dynamic programme then picks the most probable set of nodes in which a rejected node has no accepted descendant, so that
ancestors and descendants can't contradict each other. The trees are fitted on pages that training_pages() makes.

Defined results: null, empty and text-free html have an empty text. Broken markup is read as browsers do where that matters
for text: unclosed and wrongly closed elements, unquoted attributes, references without a semicolon, a tag cut off by the end.
Repeated rows are extracted row by row. Extra columns are ignored. Very long pages are read whole. Children are handled
without recursion, so any depth is possible.
"""

from __future__ import annotations

import html as html_module
import random
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import pieces, table

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
PARTS = frozenset("title script style noscript template iframe button select option textarea label svg math object canvas video audio dialog".split())
STRUCTURAL = BLOCKS | PARTS
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a paragraph outside of them can't be closed from.
SCOPES = frozenset("td th caption table button object template".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
#: Start tags that end an open element of these names, up to the nearest element of the third set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "body": ({"head"}, {"html"})}
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?]")


class Open:
    """The open elements. Where the nearest one of a name stands is known without a walk, so nesting of any depth reads in one pass."""

    def __init__(self):
        self.elements: list[tuple[str, int]] = [("", 0)]  # name, and the structural node it is in
        self.at: dict[str, list[int]] = {}  # places by name
        self.blocks: list[int] = []  # places of block elements
        self.scopes: list[int] = [0]  # places of elements that paragraphs stay within

    def push(self, name: str, node: int) -> None:
        place = len(self.elements)
        self.elements.append((name, node))
        self.at.setdefault(name, []).append(place)
        if name in BLOCKS:
            self.blocks.append(place)
        if name in SCOPES:
            self.scopes.append(place)

    def pop(self, to: int) -> None:
        while len(self.elements) > to:
            name, _ = self.elements.pop()
            self.at[name].pop()
            if name in BLOCKS:
                self.blocks.pop()
            if name in SCOPES:
                self.scopes.pop()

    def last(self, name: str) -> int:
        """Place of the innermost open element of this name; 0 if there is none."""
        return self.at[name][-1] if self.at.get(name) else 0

    @property
    def node(self) -> int:
        return self.elements[-1][1]

    def end(self, name: str) -> bool:
        """An end tag: whether it closed something. An inline one reaches no further than its block."""
        place = self.last(name)
        if not place or (name not in STRUCTURAL and self.blocks and place < self.blocks[-1]):
            return False
        self.pop(place)
        return True

    def make_room(self, name: str) -> None:
        """What a start tag closes: a block the paragraph it is in, list items and cells the ones before them."""
        if name in BLOCKS and (p := self.last("p")) > self.scopes[-1]:
            self.pop(p)
        if name in CLOSES:
            ends, within = CLOSES[name]
            bound = max(map(self.last, within))
            outermost = [at[i] for e in ends if (at := self.at.get(e)) and (i := bisect_right(at, bound)) < len(at)]
            if outermost:
                self.pop(min(outermost))


class Page:
    """The structural nodes in page order, and the stretches of text between their tags."""

    def __init__(self, source: str):
        self.tag, self.parent, self.attributes = [""], [-1], [""]
        self.text: list[tuple[int, bool, list[str]]] = [(0, False, [])]  # node, inside a link, parts
        stack = Open()
        at = 0

        def linked() -> bool:
            return bool(stack.at.get("a"))

        def say(text: str) -> None:
            if self.text[-1][0] != stack.node or self.text[-1][1] != linked():
                self.text.append((stack.node, linked(), []))
            self.text[-1][2].append(text)

        for m in TOKEN.finditer(source):
            if m.start() < at:  # inside a raw text element
                continue
            if m.start() > at:
                say(html_module.unescape(source[at : m.start()]))
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:
                if stack.end(name) and name in STRUCTURAL:
                    self.text.append((stack.node, linked(), []))
                continue
            if name == "br":
                say(" ")
            stack.make_room(name)
            node = stack.node
            if name in STRUCTURAL:
                self.tag.append(name)
                self.parent.append(node)
                self.attributes.append(m[3] or m[6] or "")
                node = len(self.tag) - 1
                self.text.append((node if name not in VOID else self.parent[node], linked(), []))
            if name in VOID:
                continue
            stack.push(name, node)
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                if name in ("title", "textarea"):
                    say(html_module.unescape(source[at : end.start() if end else len(source)]))
                stack.pop(len(stack.elements) - 1)
                self.text.append((stack.node, linked(), []))
                at = end.end() if end else len(source)
        if at < len(source):
            say(html_module.unescape(source[at:]))

    def blocks(self, chosen) -> str:
        """Text of the chosen nodes; what stands between the tags of one block is one line."""
        out, node, line = [], -1, []
        for i, (owner, _, parts) in enumerate(self.text):
            if not parts and i or owner != node:
                if line:
                    out.append(" ".join("".join(line).split()))
                node, line = owner, []
            if parts and chosen[owner]:
                line.append("".join(parts))
        if line:
            out.append(" ".join("".join(line).split()))
        return "\n".join(filter(None, out))


# --- features ------------------------------------------------------------------------------------------------------

TAGS = tuple("html head body article main section div p h1 h2 h3 h4 ul ol li nav header footer aside form script style title table tr td blockquote pre figure figcaption button select textarea label noscript iframe dl dt dd".split())
TAG_NUMBER = {t: i for i, t in enumerate(TAGS)}
ANCESTORS = ("article", "main", "nav", "header", "footer", "aside", "form", "li", "table")
NUMBERS = 24 + len(ANCESTORS)
BUCKETS = 96
N_FEATURES = NUMBERS + len(TAGS) + BUCKETS


#: Nodes whose features are held at once, whatever the size of a page.
NODES = 1 << 14


def feature_slices(page: Page) -> Iterator[tuple[int, np.ndarray]]:
    """First node and features of NODES nodes after nodes; what is kept for all nodes of a page are a few numbers each."""
    n = len(page.tag)
    own = np.zeros((n, 7), np.float32)  # characters, linked characters, words, punctuation, stretches, nodes, paragraphs
    for node, linked, parts in page.text:
        if parts:
            text = "".join(parts)
            words = text.split()
            size = sum(map(len, words))
            own[node] += (size, size * linked, len(words), len(PUNCTUATION.findall(text)) if size else 0, 1, 0, 0)
    parent = page.parent
    depth, index, count, same, above = ([0] * n for _ in range(5))
    alike: dict[tuple[int, str], int] = {}
    bit = {tag: 1 << k for k, tag in enumerate(ANCESTORS)}
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        index[i] = count[p]
        count[p] += 1
        key = (p, page.tag[i])
        alike[key] = alike.get(key, 0) + 1
        above[i] = above[p] | bit.get(page.tag[p], 0)
    for i in range(1, n):
        same[i] = alike[parent[i], page.tag[i]]
    own[1:, 5] = 1
    own[1:, 6] = [t == "p" for t in page.tag[1:]]
    rows = own.tolist()  # added up exactly, as doubles
    for i in range(n - 1, 0, -1):
        up, mine = rows[parent[i]], rows[i]
        for k in range(7):
            up[k] += mine[k]
    whole = np.array(rows)
    del rows, alike
    up = np.maximum(np.array(parent, np.int64), 0)
    depth, index, count, same, above = (np.array(c, np.int64) for c in (depth, index, count, same, above))
    size, total = whole[:, 0], max(whole[0, 0], 1.0)
    linked, density = (whole[:, 1] / np.maximum(size, 1)).astype(np.float32), (size / np.maximum(whole[:, 5], 1)).astype(np.float32)
    articles, mains = page.tag.count("article"), page.tag.count("main")
    for a in range(0, n, NODES):
        b = min(n, a + NODES)
        w, o, u, k = whole[a:b], own[a:b], up[a:b], count[up[a:b]]
        x = np.zeros((b - a, N_FEATURES), np.float32)
        x[:, 0], x[:, 1], x[:, 2], x[:, 3] = depth[a:b], index[a:b], k - index[a:b], count[a:b]
        x[:, 4], x[:, 5] = same[a:b], same[a:b] / np.maximum(k, 1)
        x[:, 6], x[:, 7] = np.log1p(w[:, 0]), w[:, 0] / total
        x[:, 8] = linked[a:b]
        x[:, 9] = w[:, 3] / np.maximum(w[:, 2], 1)
        x[:, 10] = density[a:b]  # text density of the subtree
        x[:, 11], x[:, 12] = w[:, 5], w[:, 6] / np.maximum(w[:, 5], 1)
        x[:, 13] = w[:, 0] / np.maximum(w[:, 2], 1)
        x[:, 14], x[:, 15] = np.log1p(o[:, 0].astype(float)), w[:, 2] / np.maximum(w[:, 4], 1)
        x[:, 16] = w[:, 0] / np.maximum(size[u], 1)
        x[:, 17] = linked[u]
        x[:, 18] = [TAG_NUMBER.get(page.tag[p], len(TAGS)) for p in u.tolist()]
        x[:, 19] = density[u]
        x[:, 20] = np.arange(a, b) / n
        x[:, 21] = w[:, 6]
        x[:, 22], x[:, 23] = articles, mains
        x[:, 24:NUMBERS] = above[a:b, None] >> np.arange(len(ANCESTORS)) & 1
        for i in range(max(a, 1), b):
            t = TAG_NUMBER.get(page.tag[i])
            if t is not None:
                x[i - a, NUMBERS + t] = 1
            if page.attributes[i]:
                for m in ATTRIBUTE.finditer(page.attributes[i]):
                    for token in re.findall(r"[a-z]+", (m[1] or m[2] or m[3] or "").lower()):
                        x[i - a, NUMBERS + len(TAGS) + zlib.crc32(token.encode()) % BUCKETS] = 1
        yield a, x


def features(page: Page) -> np.ndarray:
    return np.concatenate([x for _, x in feature_slices(page)])


# --- boosted trees -------------------------------------------------------------------------------------------------

TREES, DEPTH, RATE, BINS, RIDGE = 60, 5, 0.3, 16, 1.0


def gain_of(g_left: np.ndarray, h_left: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """What a split wins, from the sums of gradients and curvatures left of it and in all."""
    return g_left**2 / (h_left + RIDGE) + (g - g_left) ** 2 / (h - h_left + RIDGE) - g**2 / (h + RIDGE)


class Trees:
    """Boosted regression trees of the logistic loss, each complete to DEPTH: arrays of split features and thresholds by level."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        cuts = [np.unique(np.append(c, 0.0)) if len(np.unique(x[:, j])) > 1 else c[:0] for j, c in enumerate(cuts)]
        flag = ((x == 0) | (x == 1)).all(0)  # of these only the ones are added up
        flags = [j for j, c in enumerate(cuts) if len(c) and flag[j]]
        used = [j for j, c in enumerate(cuts) if len(c) and not flag[j]]
        ones, which = np.nonzero(x[:, flags])
        binned = np.stack([np.searchsorted(cuts[j], x[:, j]) for j in used], 1)  # x > cut k  <=>  bin > k
        width = int(binned.max()) + 1
        self.feature, self.threshold, self.value = [], [], []
        score = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.start = score[0]
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for level in range(DEPTH):
                k = 1 << level
                best, feature, threshold = np.full(k, 1e-9), np.zeros(k, np.int64), np.full(k, np.inf)
                gt, ht = (np.bincount(node, v, k)[:, None] for v in (g, h))
                for c, j in enumerate(used):
                    at = node * width + binned[:, c]
                    gs, hs = (np.bincount(at, v, k * width).reshape(k, width).cumsum(1) for v in (g, h))
                    gain = gain_of(gs, hs, gt, ht)[:, : len(cuts[j])]
                    top = gain.argmax(1)
                    better = gain[np.arange(k), top] > best
                    best[better] = gain[np.arange(k), top][better]
                    feature[better], threshold[better] = j, cuts[j][top[better]]
                if flags:
                    at = node[ones] * len(flags) + which
                    gs, hs = (t - np.bincount(at, v[ones], k * len(flags)).reshape(k, len(flags)) for t, v in ((gt, g), (ht, h)))
                    gain = gain_of(gs, hs, gt, ht)
                    top = gain.argmax(1)
                    better = gain[np.arange(k), top] > best
                    feature[better], threshold[better] = np.array(flags)[top[better]], 0.0
                self.feature.append(feature)
                self.threshold.append(threshold)
                node = node * 2 + (x[np.arange(len(y)), feature[node]] > threshold[node])
            value = RATE * np.bincount(node, g, 1 << DEPTH) / (np.bincount(node, h, 1 << DEPTH) + RIDGE)
            self.value.append(value)
            score = score + value[node]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.start), np.arange(len(x))
        for t, value in enumerate(self.value):
            node = np.zeros(len(x), np.int64)
            for level in range(DEPTH):
                f, c = self.feature[t * DEPTH + level], self.threshold[t * DEPTH + level]
                node = node * 2 + (x[rows, f[node]] > c[node])
            score += value[node]
        return score


def decode(parent: list[int], log_odds: np.ndarray) -> np.ndarray:
    """The most probable choice of nodes without a chosen node below one that isn't. The page itself is always chosen."""
    n = len(parent)
    yes, no = -np.logaddexp(0, -log_odds), -np.logaddexp(0, log_odds)
    take, leave = yes.tolist(), no.tolist()
    for i in range(n - 1, 0, -1):
        p = parent[i]
        take[p] += max(take[i], leave[i])
        leave[p] += leave[i]
    chosen = np.zeros(n, bool)
    chosen[0] = True
    for i in range(1, n):
        chosen[i] = chosen[parent[i]] and take[i] > leave[i]
    return chosen


# --- pages to learn from -------------------------------------------------------------------------------------------


def training_pages(n: int, seed: int) -> list[tuple[str, str]]:
    """(html, main text) of invented pages: many layouts, attribute names and faults of markup."""
    r = random.Random(seed)
    syllables = [a + b for a in "b d f k l m n p r s t v z".split() for b in "a e i o u é".split()]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 5)))
    words = lambda a, b: " ".join(word() for _ in range(r.randrange(a, b)))

    def prose(a: int, b: int) -> str:
        out = [word() + r.choice(["", "", "", ",", ".", ".", ";", "###", "!!", " |"]) for _ in range(r.randrange(a, b))]
        return (" ".join(out)).capitalize() + r.choice([".", ".", "", " & more.", " <i>x</i>"])

    def shown(text: str) -> tuple[str, str]:
        """Markup of a text, and the text."""
        plain = text.replace("<i>x</i>", "x")
        marked = text.replace(" & ", r.choice([" &amp; ", " & ", " &#38; "]))
        if r.random() < 0.2 and " " in plain:
            a, _, b = marked.partition(" ")
            marked = r.choice([f"<b>{a}</b> {b}", f'<a href="/x">{a}</a> {b}', f"<em>{a}</em>\n {b}"])
        return marked, plain

    def attribute(names: str) -> str:
        name = r.choice(names.split())
        name = r.choice([name, name, f"{name}-{word()}", f"{word()} {name}", f"{name}_{r.randrange(9)}"])
        return r.choice([f' class="{name}"', f' class="{name}"', f' id="{name}"', f" class='{name}' id='{word()}'"])

    link = lambda: f'<a href="/{word()}">{words(1, 3)}{r.choice(["", "", "", ",", ".", "###", "!!"])}</a>'
    links = lambda a, b: f"<ul>{''.join(f'<li>{link()}</li>' for _ in range(r.randrange(a, b)))}</ul>"

    def box(tag: str | None, names: str, inside: str) -> str:
        if tag and r.random() < 0.6:
            return f"<{tag}{attribute(names) if r.random() < 0.4 else ''}>{inside}</{tag}>"
        other = r.choice(["div", "div", "div", "section"])
        return f"<{other}{attribute(names)}>{inside}</{other}>"

    def boilerplate(where: str) -> str:
        loose = lambda: r.choice([prose(3, 20), f"<p>{prose(3, 25)}</p>", f"<span>{words(1, 8)}</span>"])
        kinds = {
            "nav": lambda: box("nav", "nav menu navbar navigation topnav breadcrumb links tabs", links(2, 9) if r.random() < 0.8 else " ".join(link() for _ in range(r.randrange(2, 6)))),
            "header": lambda: box("header", "header masthead topbar banner site-header logo branding", f"<div>{link()}</div>" + r.choice(["", f"<h1>{words(1, 4)}</h1>", f"<p>{words(2, 6)}</p>"])),
            "footer": lambda: box("footer", "footer copyright colophon bottom legal site-footer", f"&copy; {words(1, 3)} &middot; {prose(2, 14)}" + r.choice(["", links(2, 5), f"<p>{prose(2, 9)}</p>"])),
            "aside": lambda: box("aside", "sidebar aside widget related recommended popular trending rail side", f"<h3>{words(1, 3)}</h3>" + r.choice([links(2, 7), loose() * 1, f"<p>{prose(10, 60)}</p>"])),
            "ad": lambda: f"<div{attribute('ad ads advert advertisement sponsored promo promotion adslot banner-ad sponsor')}>{loose()}</div>",
            "notice": lambda: f"<{'div'}{attribute('cookie cookies consent notice alert gdpr popup modal newsletter-notice overlay paywall subscribe warning')}>{loose()}" + r.choice(["", f"<button>{words(1, 2)}</button>"]) + "</div>",
            "form": lambda: f"<form{r.choice(['', attribute('search signup newsletter login form contact')])}><label>{words(1, 3)}</label><input type=text>{r.choice(['', f'<select><option>{word()}<option>{word()}</select>', f'<textarea>{words(1, 5)}</textarea>'])}<button>{word()}</button>{r.choice(['', f'<p>{prose(3, 12)}</p>'])}</form>",
            "comments": lambda: box(None, "comments comment-list responses discussion replies disqus", f"<h2>{words(1, 3)}</h2>" + "".join(f"<div{attribute('comment reply comment-body response')}><p>{prose(4, 60)}</p></div>" if r.random() < 0.8 else f"<article{attribute('comment reply')}><p>{prose(5, 50)}</p></article>" for _ in range(r.randrange(1, 6)))),
            "share": lambda: f"<div{attribute('share social sharing buttons tools follow')}>{' '.join(link() for _ in range(r.randrange(2, 5)))}</div>",
            "script": lambda: f'<script>var t="</p>";f({r.randrange(99)});</script>',
            "style": lambda: "<style>p{margin:0}</style>",
            "noscript": lambda: f"<noscript>{loose()}</noscript>",
        }
        return kinds[where]() + (f"<!-- {words(1, 4)} -->" if r.random() < 0.2 else "")

    def article() -> tuple[str, list[str]]:
        title, plain = shown(prose(2, 12))
        out, texts = ([f"<h1>{title}</h1>"], [plain]) if r.random() < 0.85 else ([], [])
        broken = r.random() < 0.4
        for _ in range(r.choice([1, 1, 2, 3, 6, 12, 25])):
            kind = r.random()
            if kind < 0.72:
                m, p = shown(prose(1, r.choice([3, 8, 40, 150])))
                if broken and r.random() < 0.3:
                    out.append(f"<p><b>{m}<br>")
                else:
                    out.append(f"<p>{m}</p>" if r.random() < 0.9 else f"<p>{m}")
                texts.append(p)
            elif kind < 0.78:
                m, p = shown(prose(1, 6))
                out.append(f"<h{(k := r.randrange(2, 5))}>{m}</h{k}>")
                texts.append(p)
            elif kind < 0.84:
                items = [shown(prose(2, 20)) for _ in range(r.randrange(2, 6))]
                out.append(f"<ul>{''.join(f'<li>{m}</li>' for m, _ in items)}</ul>")
                texts += [p for _, p in items]
            elif kind < 0.88:
                m, p = shown(prose(5, 40))
                out.append(r.choice([f"<blockquote><p>{m}</p></blockquote>", f"<blockquote>{m}</blockquote>", f"<pre>{m}</pre>", f"<figure><img src=x><figcaption>{m}</figcaption></figure>"]))
                texts.append(p)
            elif kind < 0.9:
                cells = [[shown(prose(1, 5)) for _ in range(2)] for _ in range(r.randrange(1, 4))]
                out.append(f"<table>{''.join('<tr>' + ''.join(f'<td>{m}</td>' for m, _ in row) + '</tr>' for row in cells)}</table>")
                texts += [p for row in cells for _, p in row]
            elif kind < 0.93 and texts:
                m, p = shown(prose(8, 60))
                out.append(f"<div{r.choice(['', attribute('text paragraph body lead intro section')])}>{m}</div>")
                texts.append(p)
            else:
                out.append(boilerplate(r.choice(["ad", "ad", "share", "script", "form", "aside", "notice", "style"])))
        return "".join(out), texts

    pages = []
    for _ in range(n):
        body, texts = article()
        form = r.random()
        if form < 0.45:
            body = f"<article{r.choice(['', '', attribute('post article entry story hentry')])}>{body}</article>"
        elif form < 0.6:
            body = f"<main{r.choice(['', attribute('main content')])}>{body}</main>"
        else:
            body = f"<div{attribute('article post content entry story main post-content article-body entry-content maincontent text')}>{body}</div>"
        if r.random() < 0.3:
            body += boilerplate("comments")
        if r.random() < 0.25:
            body = f"<main>{body}</main>" if form < 0.45 else f"<div{attribute('content page main column')}>{body}</div>"
        before = [boilerplate(k) for k in r.sample(["nav", "header", "ad", "notice", "form", "script", "aside"], r.randrange(0, 5))]
        after = [boilerplate(k) for k in r.sample(["footer", "ad", "notice", "form", "script", "aside", "nav", "share", "noscript", "comments"], r.randrange(0, 5))]
        inner = "".join(before) + body + "".join(after)
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            inner = f"<div{r.choice(['', attribute('wrapper container page site layout row outer app root')])}>{inner}</div>"
        title = words(1, 9)
        page = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title}</title>{r.choice(["", boilerplate("style"), boilerplate("script")])}</head><body>{inner}{r.choice(["", boilerplate("footer")])}'
        pages.append((page + r.choice(["</body></html>", "</body></html>", ""]), "\n".join(filter(None, (" ".join(t.split()) for t in texts)))))
    return pages


def node_labels(page: Page, main: str) -> np.ndarray | None:
    """Which nodes are or hold main text: found by the text's lines, in page order. None if they can't be placed."""
    lines = main.split("\n") if main else []
    held = np.zeros(len(page.tag), bool)
    stretches: list[tuple[int, str]] = []
    node, line = -1, []
    for i, (owner, _, parts) in enumerate([*page.text, (-2, False, [])]):
        if not parts and i or owner != node:
            if text := " ".join("".join(line).split()):
                stretches.append((node, text))
            node, line = owner, []
        line += parts
    # The longest run of stretches that spells the lines; boilerplate inside the article is skipped.
    at = len(lines) - 1
    for owner, text in reversed(stretches):
        if at >= 0 and text == lines[at]:
            held[owner] = True
            at -= 1
    if at >= 0:
        return None
    for i in range(len(held) - 1, 0, -1):
        held[page.parent[i]] |= held[i]
    return held


@cache
def fitted(pages: int = 1600, seed: int = 1) -> Trees:
    xs, ys = [], []
    for source, main in training_pages(pages, seed):
        page = Page(source)
        y = node_labels(page, main)
        if y is not None:
            xs.append(features(page)[1:])
            ys.append(y[1:])
    return Trees(np.concatenate(xs), np.concatenate(ys).astype(float))


# --- Spark ---------------------------------------------------------------------------------------------------------


def node_odds(pages: list[Page], trees: Trees) -> list[np.ndarray]:
    """Log odds of all nodes; some NODES of them are looked at together, be they of many pages or a part of one."""
    out, held, rows = [np.zeros(len(p.tag)) for p in pages], [], 0

    def settle() -> None:
        odds, at = trees.log_odds(np.concatenate([x for *_, x in held])), 0
        for k, a, x in held:
            out[k][a : a + len(x)] = odds[at : at + len(x)]
            at += len(x)
        held.clear()

    for k, page in enumerate(pages):
        for a, x in feature_slices(page):
            held.append((k, a, x))
            rows += len(x)
            if rows >= NODES:
                settle()
                rows = 0
    if held:
        settle()
    return out


def extract_many(sources: list[str | None], trees: Trees) -> list[str]:
    pages = [Page(s or "") for s in sources]
    return [p.blocks(decode(p.parent, odds)) for p, odds in zip(pages, node_odds(pages, trees), strict=True)]


def extract(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(trees or fitted())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in pieces_of(big):
                text = extract_many(batch.column("html").to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def pieces_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return pieces(batch, 4 << 20, "html")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op8_html_extraction": (op8_html_extraction, None)}

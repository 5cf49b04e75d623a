"""Main-text extraction: gradient-boosted trees over DOM nodes, decoded by tree.

A page is parsed into its structural nodes (inline markup only marks link text).
Each node has features from its subtree (text, link and punctuation density), its
attribute tokens, its depth and place, and its siblings. Boosted trees give every
node log-odds of being main text. Decoding assigns each node one of three states,
*open* (a container that decides nothing), *main* and *other*, such that below an
*other* node everything is *other* and below a *main* node nothing is *open*; a
dynamic program takes the assignment with the largest total, so an ancestor and a
descendant never contradict each other.

The trees are fitted in one task on at most ``bound`` pages (a documented parameter;
chosen by the hash of their id). Their labels come from semantic elements
(``article``, ``main`` against ``nav``, ``footer``, ...); each page is also learned in
re-dressed variants, where those elements become classes of ``div`` and boxes with
foreign text (comments, notices, forms, related links) are put around and inside the
article, so that the trees do not hang on element names. Every page is then
extracted from its whole HTML.

Defined cases: null or empty HTML, or HTML without main text, gives the empty text.
Unclosed and misnested elements are closed as browsers do for paragraphs, list items
and table parts; an unclosed comment or script runs to the end. Repeated rows each
give a row. Columns beyond the named ones are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import arrow_map, bounded_sample
from riskspark.llm.quality import fit_task

BOUND = 160
TREES, DEPTH, RATE, BINS = 40, 4, 0.25, 32

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+|[^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
WORD_PART = re.compile(r"[a-z]+|\d+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt "
                   "ruby s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN = frozenset("script style noscript template svg math iframe object head title textarea select option canvas".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
         "option": {"select"}}
IN_HEAD = frozenset("title style script noscript template noframes".split())      # besides void ones
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# What attribute tokens commonly say about a box.
TOKEN_GROUPS = {
    "main": "article articlebody body content entry main post story text page blog prose",
    "menu": "nav navigation navbar menu menubar breadcrumb breadcrumbs tabs toc pagination pager toolbar sitemap",
    "edge": "header footer masthead banner topbar bottom foot head copyright legal colophon contentinfo",
    "side": "sidebar aside side widget rail complementary secondary panel",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted dfp adsense",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall disclaimer",
    "comment": "comment comments commentlist respond reply replies disqus discussion feedback review reviews reader",
    "form": "form search login signin register contact input",
    "share": "share sharing social follow related recommended recommendations more tags meta byline author links teaser",
}
GROUP_OF = {w: g for g, words in TOKEN_GROUPS.items() for w in words.split()}
TAG_GROUPS = {"main": "article main", "menu": "nav menu", "edge": "header footer", "side": "aside", "form": "form fieldset button dialog",
              "text": "p blockquote pre", "head": "h1 h2 h3 h4 h5 h6", "list": "ul ol dl", "item": "li dt dd", "table": "table tbody tr td th thead",
              "box": "div section figure figcaption details summary center"}
TAG_GROUP_OF = {t: g for g, tags in TAG_GROUPS.items() for t in tags.split()}
TOKEN_NAMES, TAG_NAMES = list(TOKEN_GROUPS), list(TAG_GROUPS)
HASHED_TOKENS = 8


class Page:
    """Structural nodes of a page (0 is the root) and its text blocks in order."""

    def __init__(self, source: str):
        self.tag, self.parent, self.depth, self.attrs = ["#root"], [-1], [0], [""]
        self.hidden = [False]
        self.blocks: list[tuple[int, str]] = []          # node, text
        self.own = [[0, 0, 0, 0, 0]]                     # characters, in links, words, stops, blocks
        self.parse(source)

    def open(self, tag: str, attrs: str, above: int) -> int:
        self.tag.append(tag)
        self.parent.append(above)
        self.depth.append(self.depth[above] + 1)
        self.attrs.append(attrs)
        self.hidden.append(self.hidden[above] or tag in HIDDEN)
        self.own.append([0, 0, 0, 0, 0])
        return len(self.tag) - 1

    def parse(self, source: str) -> None:
        stack, links = [0], 0
        parts: list[str] = []
        linked = 0
        at, lower = 0, None
        bare = 0                 # the body implied by text directly under the root

        def flush():
            nonlocal parts, linked, bare
            if parts:
                text = " ".join("".join(parts).split())
                node = stack[-1]
                if text and node == 0:
                    node = bare = bare or self.open("body", "", 0)
                if text and not self.hidden[node]:
                    self.blocks.append((node, text))
                    own = self.own[node]
                    own[0] += len(text)
                    own[1] += min(linked, len(text))
                    own[2] += text.count(" ") + 1
                    own[3] += text.count(".") + text.count(",") + text.count(";") + text.count("!") + text.count("?")
                    own[4] += 1
                parts, linked = [], 0

        def add(text):
            nonlocal linked
            if text:
                if self.tag[stack[-1]] == "head" and text.strip():
                    stack.pop()      # text cannot stand in head
                if "&" in text:
                    text = entities.unescape(text)
                parts.append(text)
                if links:
                    linked += len(text)

        while True:
            m = TOKEN.search(source, at)
            if not m:
                add(source[at:])
                break
            add(source[at:m.start()])
            at = m.end()
            name = m[2]
            if not name:
                continue
            name = name.lower()
            if name in INLINE:
                if name == "a":
                    links = 0 if m[1] else 1
                elif name in ("br", "img"):
                    parts.append(" ")
                continue
            if name in VOID:
                if name == "hr":
                    flush()
                continue
            flush()
            if m[1]:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == name:
                        del stack[k:]
                        links = 0
                        break
                continue
            self.imply_end(stack, name)
            if m[3].endswith("/") and name not in RAW and name in ("svg", "math", "iframe"):
                continue
            stack.append(self.open(name, m[3], stack[-1]))
            if name in RAW:
                lower = lower if lower is not None else source.lower()
                end = lower.find(f"</{name}", at) if len(lower) == len(source) else self.find_end(source, name, at)
                at = len(source) if end < 0 else end
        flush()

    @staticmethod
    def find_end(source: str, name: str, at: int) -> int:
        m = re.compile(f"</{name}", re.I).search(source, at)
        return m.start() if m else -1

    def imply_end(self, stack: list[int], name: str) -> None:
        """Close what the start of ``name`` closes: the head before anything that cannot
        stand in it, a paragraph before any block, and list items or table parts up
        to their list or table."""
        if self.tag[stack[-1]] == "head" and name not in IN_HEAD:
            stack.pop()
        closes, stop = CLOSES.get(name, ()), SCOPE.get(name, ())
        if self.tag[stack[-1]] == "p" or (self.tag[stack[-1]] in HEADINGS and name in HEADINGS):
            stack.pop()
        if not closes or name == "p":
            return
        cut = None
        for k in range(len(stack) - 1, 0, -1):
            t = self.tag[stack[k]]
            if t in stop:
                break
            if t in closes:
                cut = k
        if cut is not None:
            del stack[cut:]


def attribute_tokens(attrs: str) -> set[str]:
    if "=" not in attrs:
        return set()
    out: set[str] = set()
    for m in ATTRIBUTE.finditer(attrs):
        if m[1].lower() in ("class", "id", "role", "itemprop", "aria-label", "data-role"):
            value = m[2] or m[3] or m[4] or ""
            out.update(WORD_PART.findall(CAMEL.sub(" ", value).lower()))
    return out


FEATURES = (["depth", "children", "siblings", "rank", "chars", "words", "link share", "stops per word", "blocks", "block chars",
             "page share", "parent share", "place", "previous chars", "next chars", "previous links", "next links", "heading before",
             "lists below", "paragraphs below"]
            + [f"token {g}" for g in TOKEN_NAMES] + [f"above {g}" for g in TOKEN_NAMES]
            + [f"tag {g}" for g in TAG_NAMES] + [f"tag above {g}" for g in TAG_NAMES] + [f"hash {k}" for k in range(HASHED_TOKENS)])


def node_features(page: Page) -> np.ndarray:
    n = len(page.tag)
    total = [list(o) for o in page.own]
    below = [[0, 0] for _ in range(n)]
    kids: list[list[int]] = [[] for _ in range(n)]
    first = [0] * n
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        t, u = total[i], total[p]
        for k in range(5):
            u[k] += t[k]
        below[p][0] += below[i][0] + (page.tag[i] in ("ul", "ol"))
        below[p][1] += below[i][1] + (page.tag[i] == "p")
        kids[p].append(i)
    for k in kids:
        k.reverse()
    seen = 0
    for i in range(n):      # characters before a node, in document order
        first[i] = seen
        seen += page.own[i][0]
    x = np.zeros((n, len(FEATURES)), np.float32)
    every = max(total[0][0], 1)
    base = 20
    nt, ng = len(TOKEN_NAMES), len(TAG_NAMES)
    rank = [0] * n
    for k in kids:
        for r, i in enumerate(k):
            rank[i] = r
    for i in range(1, n):
        p = page.parent[i]
        t, row, mates, r = total[i], x[i], kids[p], rank[i]
        prev = total[mates[r - 1]] if r else (0,) * 5
        nxt = total[mates[r + 1]] if r + 1 < len(mates) else (0,) * 5
        words = max(t[2], 1)
        row[:base] = (min(page.depth[i], 20), min(len(kids[i]), 50), min(len(mates), 50), r / len(mates), np.log1p(t[0]), np.log1p(t[2]),
                      t[1] / max(t[0], 1), t[3] / words, min(t[4], 100), np.log1p(t[0] / max(t[4], 1)), t[0] / every,
                      t[0] / max(total[p][0], 1), first[i] / every, np.log1p(prev[0]), np.log1p(nxt[0]), prev[1] / max(prev[0], 1),
                      nxt[1] / max(nxt[0], 1), bool(r) and page.tag[mates[r - 1]] in HEADINGS, min(below[i][0], 20), min(below[i][1], 50))
        for w in attribute_tokens(page.attrs[i]):
            g = GROUP_OF.get(w)
            if g:
                row[base + TOKEN_NAMES.index(g)] = 1
            row[base + 2 * nt + 2 * ng + zlib.crc32(w.encode()) % HASHED_TOKENS] = 1
        g = TAG_GROUP_OF.get(page.tag[i])
        if g:
            row[base + 2 * nt + TAG_NAMES.index(g)] = 1
        # what the nodes above say, the nearest counting most
        row[base + nt:base + 2 * nt] = np.maximum(x[p, base:base + nt], x[p, base + nt:base + 2 * nt] * 0.5)
        a = base + 2 * nt
        row[a + ng:a + 2 * ng] = np.maximum(x[p, a:a + ng], x[p, a + ng:a + 2 * ng] * 0.5)
    return x


# ------------------------------------------------------------ boosted trees


class Trees:
    """Gradient-boosted complete trees of a fixed depth for a logistic loss."""

    def __init__(self, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray, start: float):
        self.feature, self.cut, self.leaf, self.start = feature, cut, leaf, start

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - (2 ** DEPTH - 1)]
        return out

    def dump(self) -> bytes:
        return json.dumps([a.tolist() for a in (self.feature, self.cut, self.leaf)] + [self.start]).encode()

    @classmethod
    def load(cls, raw: bytes) -> Trees:
        f, c, v, s = json.loads(raw)
        return cls(np.array(f, np.int64), np.array(c), np.array(v), s)


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, ridge: float = 1.0) -> Trees:
    """Fit by second-order histogram splits; a node without gain sends all rows left."""
    edges = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T      # features x cuts
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(x.shape[1])], 1)
    share = np.clip((y * weight).sum() / weight.sum(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    score = np.full(len(y), start)
    inner = 2 ** DEPTH - 1
    feats, cuts, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = (p - y) * weight, np.maximum(p * (1 - p), 1e-6) * weight
        at = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            for node in range(2 ** level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(at == node)
                best = (1e-6, 0, BINS)
                if len(rows) > 1:
                    gs, hs = g[rows], h[rows]
                    whole = gs.sum() ** 2 / (hs.sum() + ridge)
                    for f in range(x.shape[1]):
                        b = binned[rows, f]
                        gl = np.cumsum(np.bincount(b, gs, BINS))[:-1]
                        hl = np.cumsum(np.bincount(b, hs, BINS))[:-1]
                        gain = gl ** 2 / (hl + ridge) + (gs.sum() - gl) ** 2 / (hs.sum() - hl + ridge) - whole
                        gain[(hl < 0.5) | (hs.sum() - hl < 0.5)] = 0
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (gain[k], f, k)
                _, f, k = best
                feature[node] = f
                cut[node] = edges[f][k] if k < BINS else np.inf
                at[rows] = 2 * node + 1 + (binned[rows, f] > k)
        leaf = np.zeros(2 ** DEPTH)
        for j in range(2 ** DEPTH):
            rows = at == inner + j
            if rows.any():
                leaf[j] = -RATE * g[rows].sum() / (h[rows].sum() + ridge)
        score += leaf[at - inner]
        feats.append(feature)
        cuts.append(cut)
        leaves.append(leaf)
    return Trees(np.array(feats), np.minimum(np.array(cuts), 1e30), np.array(leaves), start)


# ----------------------------------------------------------------- decoding


def decode(page: Page, odds: np.ndarray) -> list[bool]:
    """Which nodes are main text: the best consistent assignment of states."""
    n = len(page.tag)
    main, other, open_ = odds.tolist(), (-odds).tolist(), [0.0] * n
    for i in range(n):      # an open node drops its own text, as if it were other
        if page.own[i][0]:
            open_[i] = -max(float(odds[i]), 0.0) - 0.1
    kids_main, kids_other, kids_open = [0.0] * n, [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        main[i] += kids_main[i]
        other[i] += kids_other[i]
        open_[i] += kids_open[i]
        p = page.parent[i]
        if p >= 0:
            kids_main[p] += max(main[i], other[i])
            kids_other[p] += other[i]
            kids_open[p] += max(main[i], other[i], open_[i])
    state = [0] * n          # 0 open, 1 main, 2 other; the root is open
    for i in range(1, n):
        above = state[page.parent[i]]
        if above == 2:
            state[i] = 2
        elif above == 1:
            state[i] = 1 if main[i] >= other[i] else 2
        else:
            best = max(main[i], other[i], open_[i])
            state[i] = 0 if open_[i] == best else 1 if main[i] == best else 2
    return [s == 1 for s in state]


def main_text(source: str | None, trees: Trees) -> str:
    return texts_of([source], trees)[0]


def texts_of(sources: list[str | None], trees: Trees) -> list[str]:
    """Main texts of pages; the trees run over the nodes of all of them at once."""
    pages = [Page(s or "") for s in sources]
    xs = [node_features(p) for p in pages]
    odds = trees.raw(np.concatenate(xs)) if xs else np.zeros(0)
    out, at = [], 0
    for p, x in zip(pages, xs):
        f = np.clip(odds[at:at + len(x)], -8, 8)
        at += len(x)
        for i in range(len(x)):
            if p.hidden[i]:
                f[i] = -8
        keep = decode(p, f)
        out.append("\n".join(t for node, t in p.blocks if keep[node]))
    return out


# ----------------------------------------------------------------- training

MAIN_TAGS = frozenset(("article", "main"))
OTHER_TAGS = frozenset(("nav", "header", "footer", "aside", "form", "menu", "dialog", "button"))


def node_labels(page: Page) -> np.ndarray:
    """1 main, 0 other, -1 not learned, from semantic elements and box tokens."""
    n = len(page.tag)
    out = np.full(n, -1)
    holds = [False] * n
    for i in range(n - 1, 0, -1):
        holds[page.parent[i]] |= holds[i] or page.tag[i] in MAIN_TAGS or "articlebody" in attribute_tokens(page.attrs[i])
    for i in range(1, n):
        p = page.parent[i]
        groups = {GROUP_OF.get(w) for w in attribute_tokens(page.attrs[i])}
        if out[p] == 0 or page.hidden[i] or page.tag[i] in OTHER_TAGS \
                or (groups & {"menu", "edge", "side", "advert", "notice", "comment", "form", "share"} and not holds[i]):
            out[i] = 0
        elif out[p] == 1 or (page.tag[i] in MAIN_TAGS and not holds[i]):
            out[i] = 1
        elif not holds[i]:
            out[i] = 0
    return out


SEMANTIC = re.compile(r"<(/?)(article|main|nav|header|footer|aside|form)\b([^>]*)>", re.I)


def redressed(source: str, foreign: list[str], seed: int) -> tuple[str, str] | None:
    """A variant of a page and the class that marks its main box.

    Semantic elements become ``div`` with usual class names; boxes with foreign text
    are put before, after and inside the article."""
    rng = np.random.default_rng(seed)
    pick = lambda words: str(rng.choice(words.split()))
    start, stop = source.lower().find("<article"), source.lower().rfind("</article>")
    if start < 0 or stop < 0:
        return None
    inner = source[source.find(">", start) + 1:stop]

    def say(least, most):
        words = foreign[int(rng.integers(len(foreign)))].split() or ["text"]
        k = int(rng.integers(least, most))
        at = int(rng.integers(max(1, len(words) - k)))
        return entities.escape(" ".join(words[at:at + k]))

    def box(kind):
        tag = pick({"menu": "nav div ul", "edge": "footer div header", "side": "aside div section", "form": "form div"}.get(kind, "div section aside"))
        name = pick(TOKEN_GROUPS[kind])
        attr = pick("class id")
        body = {"menu": lambda: "<ul>" + "".join(f'<li><a href="#">{say(1, 4)}</a></li>' for _ in range(int(rng.integers(3, 9)))) + "</ul>",
                "form": lambda: f"<label>{say(1, 4)}</label><input name=q><button>{say(1, 3)}</button>",
                "share": lambda: "".join(f'<a href="#">{say(1, 8)}</a> ' for _ in range(int(rng.integers(2, 7)))),
                "comment": lambda: f"<h3>{say(1, 3)}</h3>" + "".join(f"<div class='{pick('comment reply user item')}'><p>{say(4, 60)}</p></div>" for _ in range(int(rng.integers(1, 5)))),
                }.get(kind, lambda: "".join(f"<p>{say(3, 40)}</p>" for _ in range(int(rng.integers(1, 4)))) if rng.random() < 0.6 else say(3, 30))()
        return f'<{tag} {attr}="{pick("site- page- the- x-") if rng.random() < 0.5 else ""}{name}">{body}</{tag}>'

    cuts = [m.end() for m in re.finditer(r"</p>", inner)] or [len(inner)]
    if rng.random() < 0.5:
        at = cuts[int(rng.integers(len(cuts)))]
        inner = inner[:at] + box(pick("advert share notice side form")) + inner[at:]
    tail = box("comment") if rng.random() < 0.5 else ""
    if rng.random() < 0.5:
        inner += tail
        tail = ""
    shape = pick("article main div div div section")
    name = pick(TOKEN_GROUPS["main"])
    mark = f' class="{name}"' if rng.random() < 0.8 else ""
    before = "".join(box(k) for k in ("edge", "menu", "notice", "advert", "form") if rng.random() < 0.5)
    after = tail + "".join(box(k) for k in ("share", "side", "advert", "edge") if rng.random() < 0.5)
    wrap = rng.random() < 0.4
    return (f'<html><body>{"<div class=wrapper>" if wrap else ""}{before}<{shape}{mark} data-main="1">{inner}</{shape}>{after}'
            f'{"</div>" if wrap else ""}</body></html>'), "data-main"


def redressed_labels(page: Page, truth: str) -> np.ndarray:
    """Labels of a re-dressed page: inside the marked box main, but for the boxes in it."""
    n = len(page.tag)
    out = np.full(n, -1)
    holds = [truth in a for a in page.attrs]
    for i in range(n - 1, 0, -1):
        holds[page.parent[i]] |= holds[i]
    for i in range(1, n):
        p = page.parent[i]
        if truth in page.attrs[i]:
            out[i] = 1
        elif out[p] == 1:
            boxed = page.tag[i] in OTHER_TAGS or page.hidden[i] or {GROUP_OF.get(w) for w in attribute_tokens(page.attrs[i])} - {None, "main"}
            out[i] = 0 if boxed else 1
        elif out[p] == 0 or not holds[i]:
            out[i] = 0
    return out


def builtin_pages() -> list[str]:
    """Plain pages made by rule, learned in addition, so that a table without any
    semantic element still gives a model."""
    rng = np.random.default_rng(11)
    syllables = "ta re mi so la ko ne du vi pan ter lum".split()
    word = lambda: "".join(rng.choice(syllables, int(rng.integers(1, 4))))
    say = lambda a, b: " ".join(word() for _ in range(int(rng.integers(a, b)))) + "."
    out = []
    for _ in range(40):
        body = "".join(f"<p>{' '.join(say(4, 14) for _ in range(int(rng.integers(1, 7))))}</p>" for _ in range(int(rng.integers(1, 9))))
        out.append(f"<html><body><nav><ul>{''.join(f'<li><a href=x>{word()}</a></li>' for _ in range(5))}</ul></nav>"
                   f"<article><h1>{say(2, 9)}</h1>{body}</article><footer>&copy; {say(2, 6)}</footer></body></html>")
    return out


def builtin_fragments() -> list[tuple[str, int]]:
    """Inline markup without any box, and whether it is main text: prose is, bare
    links and a few words are not."""
    rng = np.random.default_rng(12)
    syllables = "ta re mi so la ko ne du vi pan ter lum".split()
    word = lambda: "".join(rng.choice(syllables, int(rng.integers(1, 4))))
    say = lambda a, b: " ".join(word() for _ in range(int(rng.integers(a, b))))
    out = []
    for _ in range(10):
        out.append((" ".join(f"{say(2, 7)} <b>{word()}</b>, {say(2, 7)}." for _ in range(int(rng.integers(3, 30)))), 1))
        out.append((" ".join(f'<a href="#">{say(1, 4)}</a>' for _ in range(int(rng.integers(2, 12)))), 0))
        out.append((say(1, 5), 0))
    return out


def fit(sources: list[str], variants: int = 3) -> Trees:
    sources = [s for s in sources if s] + builtin_pages()
    foreign = [" ".join(t for _, t in Page(s).blocks)[:4000] for s in sources[:200]]
    xs, ys, ws = [], [], []

    def learn(page, labels):
        x = node_features(page)
        use = labels >= 0
        if use.any():
            xs.append(x[use])
            ys.append(labels[use])
            # pages weigh the same, however many nodes they have
            w = np.log1p(np.array([o[0] for o in page.own])[use]) + 1
            ws.append(w / w.sum() * 20)

    for k, s in enumerate(sources):
        page = Page(s)
        if any(t in MAIN_TAGS for t in page.tag):
            learn(page, node_labels(page))
        for v in range(variants):
            if made := redressed(s, foreign, 1000 * v + k):
                page = Page(made[0])
                learn(page, redressed_labels(page, made[1]))
    for s, main in builtin_fragments():
        page = Page(s)
        learn(page, np.array([-1, main]))
    return boost(np.concatenate(xs), np.concatenate(ys).astype(float), np.concatenate(ws))


def extract_main_text(pages: DataFrame, bound: int = BOUND, id_col: str = "page_id", url_col: str = "url",
                      html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``."""
    d = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"),
                     pages[html_col].cast("string").alias("html"))
    chosen = bounded_sample(d.select("page_id").where("page_id IS NOT NULL").distinct(), "page_id", bound)
    sample = d.join(F.broadcast(chosen), "page_id").dropDuplicates(["page_id"]).select("page_id", "html")
    model = fit_task(sample, "page_id", lambda rows: fit([r["html"] for r in rows]).dump())
    sent = d.sparkSession.sparkContext.broadcast(model[0] if model else fit([]).dump())

    def extract(b: pa.RecordBatch):
        trees = Trees.load(sent.value)
        for at in range(0, b.num_rows, 200):
            part = b.slice(at, 200)
            texts = texts_of(part.column(2).to_pylist(), trees)
            yield {"page_id": part.column(0).to_pylist(), "url": part.column(1).to_pylist(), "text": texts,
                   "n_chars": [len(t) for t in texts]}

    return arrow_map(d, extract, f"page_id {dict(d.dtypes)['page_id']}, url string, text string, n_chars long")

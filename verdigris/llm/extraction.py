"""Main text of web pages: a recurrent labeller over the page's blocks.

A page becomes a sequence of leaf blocks, each with its tag path and text. A bidirectional LSTM in
numpy reads hashed vectors of both for the whole sequence and decides every block in its context. It
is trained here: on blocks of a bounded sample of pages that mark their article by semantic tags,
and on pages that a seeded generator lays out, whose labels are known.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.llm.arrow import with_columns
from verdigris.llm.store import least_hashed
from verdigris.llm.words import mix, words

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr".split())
RAW = frozenset("script style".split())
SILENT = frozenset("script style template svg iframe object canvas".split())
#: Open elements that a start tag closes, up to the nearest of their containers.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"})}
CONTAINERS = frozenset("html body div article main section aside nav header footer form ul ol li table td th blockquote".split())
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s>/]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
NAMES = re.compile(r"""(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
WORDY = re.compile(r"[a-z]+")

#: What the semantic tags of a page say of its blocks.
_MAIN = frozenset("article main".split())
_ASIDE = frozenset("nav aside footer form head button select textarea".split())
_NOISE = frozenset("ad ads advert advertisement promo promoted sponsor sponsored cookie cookies consent banner notice popup newsletter subscribe sidebar widget related share social comment comments reply replies menu breadcrumb breadcrumbs nav footer copyright disclaimer".split())
#: What bare pages lack: names of elements, and tags that say what they hold.
_BARE_NAMES = re.compile(r"""\s(?:class|id|role)=(?:"[^"]*"|[^\s>]+)""")
_BARE_TAGS = re.compile(r"<(/?)(?:article|aside|footer|header|main|nav|section)(?=[\s>])")
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}

PATH_DIM, WORD_DIM, HIDDEN = 40, 12, 20
WIDTH = PATH_DIM + WORD_DIM + 8
SAMPLE_PAGES, MADE_PAGES = 300, 400
#: Blocks of a page that are learned from: of a longer one, a run of so many.
RUN = 400
#: Steps of padding that one batch of pages may hold.
BATCH_STEPS = 20_000


class Node:
    """An open element: what its tag and names say, and all that the path to it says, by way of its parent."""

    __slots__ = ("main", "name", "noise", "parent", "tag", "vector")

    def __init__(self, tag: str, name: str, parent: Node | None):
        self.tag, self.name, self.parent = tag, name, parent
        self.main = tag in _MAIN or (parent is not None and parent.main)
        self.noise = tag in _ASIDE or not _NOISE.isdisjoint(name.split()[1:]) or (parent is not None and parent.noise)
        self.vector: np.ndarray | None = None

    def path(self) -> tuple[str, ...]:
        found, node = [], self
        while node is not None:
            found.append(node.name)
            node = node.parent
        return tuple(reversed(found))


@dataclass
class Block:
    node: Node | None
    text: str
    linked: float  # share of characters inside links

    @property
    def path(self) -> tuple[str, ...]:
        return self.node.path() if self.node is not None else ()


class Stack:
    """Open elements, with the places of each tag and of the containers, so that no step looks through all of them."""

    def __init__(self) -> None:
        self.nodes: list[Node] = []
        self.of_tag: dict[str, list[int]] = {}
        self.containers: list[int] = []
        self.links = self.silent = 0

    def top(self) -> Node | None:
        return self.nodes[-1] if self.nodes else None

    def push(self, tag: str, name: str) -> None:
        self.of_tag.setdefault(tag, []).append(len(self.nodes))
        if tag in CONTAINERS:
            self.containers.append(len(self.nodes))
        self.nodes.append(Node(tag, name, self.top()))
        self.links += tag == "a"
        self.silent += tag in SILENT

    def last(self, tags: Iterable[str]) -> int:
        return max((self.of_tag[t][-1] for t in tags if self.of_tag.get(t)), default=-1)

    def last_container(self) -> int:
        return self.containers[-1] if self.containers else -1

    def close(self, k: int) -> None:
        while len(self.nodes) > k:
            tag = self.nodes.pop().tag
            self.of_tag[tag].pop()
            if tag in CONTAINERS:
                self.containers.pop()
            self.links -= tag == "a"
            self.silent -= tag in SILENT


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order: text between starts and ends of elements that aren't inline, and
    line breaks. Character references are decoded and white space runs are one space. Time and memory
    are in proportion to the page, however deep its elements nest."""
    out: list[Block] = []
    stack = Stack()
    text: list[str] = []
    node: Node | None = None
    placed = False
    linked = 0
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal placed, linked
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                out.append(Block(node if placed else None, whole, min(1.0, linked / len(whole))))
            text.clear()
        placed, linked = False, 0

    def place() -> None:
        nonlocal node, placed
        if not placed:
            node, placed = stack.top(), True

    while at < n:
        start = page.find("<", at)
        if start < 0:
            start = n
        if start > at and not stack.silent:
            piece = html.unescape(page[at:start]) if "&" in page[at:start] else page[at:start]
            if not placed and not piece.isspace():
                place()
            text.append(piece)
            if stack.links:
                linked += len(piece)
        if start == n:
            break
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        if page[start + 1 : start + 2] in ("!", "?"):
            end = page.find(">", start)
            at = n if end < 0 else end + 1
            continue
        found = TAG.match(page, start)
        if not found:
            if re.match(r"</?[a-zA-Z]", page[start : start + 3]):  # a tag that never closes its quotes
                end = page.find(">", start)
                at = n if end < 0 else end + 1
            else:
                if not stack.silent:
                    text.append("<")
                    place()
                at = start + 1
            continue
        closing, tag, attributes = found[1], found[2].lower(), found[3]
        at = found.end()
        if tag not in INLINE and not stack.silent:
            flush()
        if closing:
            k = stack.last((tag,))
            if k >= 0 and (tag not in INLINE or k > stack.last_container()):
                stack.close(k)
            continue
        if tag in VOID:
            continue
        if tag not in INLINE and (k := stack.last(("p",))) > stack.last_container():
            stack.close(k)
        if tag in CLOSES:
            shut, until = CLOSES[tag]
            if (k := stack.last(shut)) > stack.last(until):
                stack.close(k)
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = n if end is None else end.end()
            continue
        if attributes.endswith("/"):
            continue
        names = " ".join(a or b or c for a, b, c in NAMES.findall(attributes)).lower() if attributes else ""
        stack.push(tag, " ".join([tag, *WORDY.findall(names)]))
    flush()
    return out


def _vectors(tokens: np.ndarray, dim: int) -> np.ndarray:
    """A fixed random vector for each hash: signs by its bits."""
    bits = (mix(tokens)[:, None] >> np.arange(dim, dtype=np.uint64)) & np.uint64(1)
    return (bits.astype(np.float32) * 2 - 1) / np.sqrt(np.float32(dim))


class Encoder:
    """Input vectors of blocks. A path's vector is the sum of its elements'; those of names are remembered."""

    def __init__(self) -> None:
        self.known: dict[str, np.ndarray] = {}

    def name(self, name: str) -> np.ndarray:
        if (found := self.known.get(name)) is None:
            found = _vectors(words(pa.array([name])).hashes, PATH_DIM).sum(axis=0)
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[name] = found
        return found

    def path(self, node: Node | None) -> np.ndarray:
        if node is None:
            return np.zeros(PATH_DIM, np.float32)
        todo = []
        while node is not None and node.vector is None:
            todo.append(node)
            node = node.parent
        above = node.vector if node is not None else np.zeros(PATH_DIM, np.float32)
        for node in reversed(todo):
            above = node.vector = above + self.name(node.name)
        return above

    def __call__(self, pages: list[list[Block]]) -> list[np.ndarray]:
        flat = [b for page in pages for b in page]
        if not flat:
            return [np.zeros((0, WIDTH), np.float32) for _ in pages]
        found = words(pa.array([b.text for b in flat]), lower=True)
        count = np.maximum(np.diff(found.bounds), 1)
        # sums of word vectors by differences of running sums, in blocks that bound memory
        sums = np.zeros((len(flat), WORD_DIM), np.float32)
        rows = found.rows()
        for a in range(0, len(rows), 1 << 16):
            r = rows[a : a + (1 << 16)]
            first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            sums[r[first]] += np.add.reduceat(_vectors(found.hashes[a : a + (1 << 16)], WORD_DIM), first, axis=0)
        size = np.array([len(b.text) for b in flat], np.float32)
        ends = np.array([b.text[-1] in ".!?…\"'»" for b in flat], np.float32)
        nth = np.concatenate([np.arange(len(p)) for p in pages])
        of = np.repeat([len(p) for p in pages], [len(p) for p in pages])
        plain = np.stack([np.log1p(size) / 5, np.log1p(count) / 4, np.array([b.linked for b in flat]), ends, nth / of, 1 - nth / of, np.log1p(of) / 5, np.ones(len(flat))], axis=1)
        whole = np.concatenate([np.stack([self.path(b.node) for b in flat]), sums / np.sqrt(count)[:, None], plain], axis=1).astype(np.float32)
        return np.split(whole, np.cumsum([len(p) for p in pages])[:-1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Labeller:
    """A bidirectional LSTM with one logit for each step."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)

        def direction() -> list[np.ndarray]:
            bias = np.zeros(4 * HIDDEN)
            bias[HIDDEN : 2 * HIDDEN] = 1  # remember at first
            return [rng.normal(0, 0.3 / np.sqrt(WIDTH), (WIDTH, 4 * HIDDEN)), rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN)), bias]

        self.weights = [w.astype(np.float32) for w in (*direction(), *direction(), rng.normal(0, 0.1, (2 * HIDDEN, 1)), np.zeros(1))]

    def _run(self, x: np.ndarray, mask: np.ndarray, way: int, keep: bool) -> tuple[np.ndarray, list]:
        """States of one direction; x is steps x pages x width and mask 1 where a page has the step."""
        w, u, b = self.weights[3 * way : 3 * way + 3]
        steps, pages = mask.shape
        pre = x @ w + b
        h = c = np.zeros((pages, HIDDEN), np.float32)
        out, trace = np.zeros((steps, pages, HIDDEN), np.float32), []
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            gates = pre[t] + h @ u
            i, f, o = (_sigmoid(gates[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(gates[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            squashed = np.tanh(new)
            if keep:
                trace.append((t, i, f, o, g, c, h, squashed, m))
            c = m * new + (1 - m) * c
            h = m * (o * squashed) + (1 - m) * h
            out[t] = h
        return out, trace

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, way, False)[0] for way in (0, 1)], axis=2)
        return (both @ self.weights[6])[:, :, 0] + self.weights[7]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over steps, and its gradients by back-propagation through time."""
        (ahead, trace_a), (back, trace_b) = (self._run(x, mask, way, True) for way in (0, 1))
        both = np.concatenate([ahead, back], axis=2)
        p = _sigmoid((both @ self.weights[6])[:, :, 0] + self.weights[7])
        total = mask.sum()
        loss = -float((mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / total)
        d = mask * (p - y) / total
        grads = [np.zeros_like(w) for w in self.weights]
        grads[6] = np.einsum("tph,tp->h", both, d)[:, None]
        grads[7] = np.array([d.sum()], np.float32)
        d_both = d[:, :, None] * self.weights[6][:, 0]
        for way, trace in ((0, trace_a), (1, trace_b)):
            u = self.weights[3 * way + 1]
            d_h = d_c = np.zeros((mask.shape[1], HIDDEN), np.float32)
            d_pre = np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
            for t, i, f, o, g, c, h, squashed, m in reversed(trace):
                d_h = d_h + d_both[t][:, way * HIDDEN : (way + 1) * HIDDEN]
                d_out = m * d_h
                d_new = m * d_c + d_out * o * (1 - squashed**2)
                gate = np.concatenate([d_new * g * i * (1 - i), d_new * c * f * (1 - f), d_out * squashed * o * (1 - o), d_new * i * (1 - g**2)], axis=1)
                d_pre[t] = gate
                grads[3 * way + 1] += h.T @ gate
                d_h = gate @ u.T + (1 - m) * d_h
                d_c = d_new * f + (1 - m) * d_c
            grads[3 * way] = np.tensordot(x, d_pre, ([0, 1], [0, 1]))
            grads[3 * way + 2] = d_pre.sum(axis=(0, 1))
        return loss, grads

    def predict(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of each block to be main text; pages of like length share a batch."""
        order = sorted(range(len(pages)), key=lambda k: len(pages[k]))
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        a = 0
        while a < len(order):
            b = a + 1
            while b < len(order) and (b + 1 - a) * len(pages[order[b]]) <= BATCH_STEPS:
                b += 1
            some = [pages[k] for k in order[a:b]]
            if len(some[-1]):
                p = _sigmoid(self.logits(*padded(some)))
                for k, page, column in zip(order[a:b], some, p.T, strict=True):
                    out[k] = column[: len(page)]
            a = b
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), WIDTH), np.float32), np.zeros((steps, len(pages)), np.float32)
    for k, page in enumerate(pages):
        x[: len(page), k], mask[: len(page), k] = page, 1
    return x, mask


def train(pages: list[tuple[np.ndarray, np.ndarray]], rounds: int = 15, size: int = 32, rate: float = 0.01, seed: int = 7) -> Labeller:
    """Adam over batches of pages (vectors, labels)."""
    model, rng = Labeller(seed), np.random.default_rng(seed)
    pages = [p for p in pages if len(p[0])]
    first, second = ([np.zeros_like(w) for w in model.weights] for _ in range(2))
    step = 0
    for r in range(rounds):
        order = rng.permutation(len(pages))
        # batches of like length, in random order
        chunks = [sorted(order[a : a + 8 * size], key=lambda k: len(pages[k][0])) for a in range(0, len(order), 8 * size)]
        for chunk in chunks:
            for a in range(0, len(chunk), size):
                some = [pages[k] for k in chunk[a : a + size]]
                x, mask = padded([p for p, _ in some])
                y = np.zeros_like(mask)
                for k, (_, label) in enumerate(some):
                    y[: len(label), k] = label
                _, grads = model.gradients(x, mask, y)
                step += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
                for k, g in enumerate(grads):
                    g = g * min(1.0, 1.0 / (norm + 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    now = rate * (1 - r / rounds) / (1 - 0.9**step) * np.sqrt(1 - 0.999**step)
                    model.weights[k] = (model.weights[k] - now * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return model


def marked(page: list[Block]) -> np.ndarray | None:
    """Labels of a page that marks its article by article or main, None of another."""
    nodes = [b.node for b in page if b.node is not None]
    if not any(node.main for node in nodes):
        return None
    return np.array([b.node is not None and b.node.main and not b.node.noise for b in page], np.float32)


def made_pages(count: int, seed: int = 11) -> list[tuple[list[Block], np.ndarray]]:
    """Pages of a seeded generator, parsed from HTML, with their labels: main text carries a mark in the
    text that is taken off again before anything reads it. Some pages are bare, without any names of
    elements, and some are long."""
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    syllables = "an er on th in re st ti en ou le que au de la ge sch un ei ver os ci ue mo ra ta".split()
    vocabulary = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(4000)]

    def phrase(low: int, high: int, stop: str = "") -> str:
        return " ".join(rng.choices(vocabulary, k=rng.randrange(low, high))).capitalize() + stop

    def links(tag: str, low: int, high: int) -> str:
        return "".join(f'<{tag}><a href="/{k}">{phrase(1, 4)}</a></{tag}>' for k in range(rng.randrange(low, high)))

    def noise() -> str:
        kind = rng.randrange(8)
        if kind == 0:
            return f'<div class="{pick("ad", "ads", "advert banner", "sponsor", "promo", "advertisement")}">{phrase(3, 25, ".")}</div>'
        if kind == 1:
            return f'<div class="{pick("cookie-notice", "cookie-consent", "notice", "gdpr banner", "popup")}"{pick("", " role=dialog")}><p>{phrase(5, 30, ".")}</p><button>{phrase(1, 3)}</button></div>'
        if kind == 2:
            return f'<{pick("aside", "div class=sidebar", "div id=sidebar")}><h3>{phrase(1, 4)}</h3><ul>{links("li", 2, 8)}</ul><p>{phrase(3, 30, ".")}</p></{"aside"}></div>'
        if kind == 3:
            return f'<form class="{pick("search", "newsletter", "subscribe", "login")}"><label>{phrase(1, 5)}</label><input name=q><button>{phrase(1, 2)}</button><p>{phrase(2, 12, ".")}</p></form>'
        if kind == 4:
            return f'<div class="{pick("related", "more-links", "share", "social", "tags", "widget")}"><h4>{phrase(1, 4)}</h4>{links(pick("p", "li", "div"), 2, 7)}</div>'
        if kind == 5:
            people = "".join(f'<{pick("div", "li", "p")} class="{pick("comment", "reply")}"><b>{phrase(1, 3)}</b><p>{phrase(4, 60, ".")}</p></div>' for _ in range(rng.randrange(1, 6)))
            return f'<{pick("section", "div")} {pick("id", "class")}="{pick("comments", "comment-list", "discussion", "disqus comments", "responses")}"><h3>{phrase(1, 3)}</h3>{people}</section></div>'
        if kind == 6:
            return f'<nav class="{pick("breadcrumb", "pager", "toc")}">{links(pick("span", "li"), 2, 6)}</nav>'
        return f"<script>var x='<p>{phrase(1, 5)}</p>';</script><noscript>{phrase(3, 9, '.')}</noscript>"

    def article() -> str:
        parts = [f"<h1>\x01{phrase(3, 12)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.randrange(1, 14) if rng.random() < 0.97 else rng.randrange(100, 800)):
            kind = rng.random()
            if kind < 0.72:
                parts.append(f"<p>{pick('', '', '<b>')}\x01{phrase(1, 120, '.')}{pick('', '', '', f' <a href=/x>{phrase(1, 4)}</a>')}{pick('</p>', '</p>', '</p>', '<br>')}")
            elif kind < 0.8:
                parts.append(f"<h{pick(2, 3)}>\x01{phrase(1, 6)}</h2></h3>")
            elif kind < 0.86:
                parts.append("<ul>" + "".join(f"<li>\x01{phrase(2, 20)}</li>" for _ in range(rng.randrange(2, 6))) + "</ul>")
            elif kind < 0.9:
                parts.append(f"<blockquote><p>\x01{phrase(5, 40, '.')}</p></blockquote>")
            elif kind < 0.93:
                parts.append(f"<table><tr><td>\x01{phrase(1, 4)}</td><td>\x01{phrase(1, 4)}</td></tr></table>")
            else:
                parts.append(noise())
        return "".join(parts)

    out = []
    for _ in range(count):
        name = pick("content", "post", "entry-content", "story", "article-body", "post-body", "main-content", "text")
        opening, end = pick(("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), (f'<div class="{name}">', "</div>"), (f'<div id="{name}">', "</div>"), (f'<section class="{name}">', "</section>"), ("<article class=post>", "</article>"))
        before = [f'<{pick("header", "div class=header", "div id=top")}><h2>{phrase(1, 4)}</h2><p>{phrase(2, 10)}</p></header></div>' if rng.random() < 0.4 else "", f'<nav{pick("", " class=menu")}><ul>{links("li", 2, 9)}</ul></nav>' if rng.random() < 0.8 else f'<div class="{pick("menu", "navbar", "nav")}"><ul>{links("li", 2, 9)}</ul></div>']
        before += [noise() for _ in range(rng.randrange(0, 3))]
        after = [noise() for _ in range(rng.randrange(0, 4))]
        after.append(f'<{pick("footer", "div class=footer", "div id=footer")}>&copy; {phrase(2, 12)} &middot; {phrase(2, 14, ".")}</footer></div>')
        page = f"<html><head><title>{phrase(3, 10)}</title><style>p{{}}</style></head><body>{''.join(before)}{opening}{article()}{end}{''.join(after)}{pick('</body></html>', '')}"
        if rng.random() < 0.25:
            page = _BARE_NAMES.sub("", _BARE_TAGS.sub(r"<\1div", page))
        found = blocks(page)
        labels = np.array(["\x01" in b.text for b in found], np.float32)
        out.append(([Block(b.node, b.text.replace("\x01", "").strip() or "x", b.linked) for b in found], labels))
    return out


def run_of(x: np.ndarray, y: np.ndarray, chance: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a page's vectors and labels a run of at most RUN; its start is ``chance`` modulo the places there are."""
    a = chance % (len(x) - RUN + 1) if len(x) > RUN else 0
    return x[a : a + RUN], y[a : a + RUN]


def fit(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", sample: int = SAMPLE_PAGES, made: int = MADE_PAGES) -> Labeller:
    """Trains on at most ``sample`` pages, those of least hash, whose semantic tags give labels, and on ``made`` pages
    of the generator. The bound keeps what reaches the driver small; sampled pages are parsed whole on
    the executors, and of one of over RUN blocks a run of that many is learned from, whose place its hash picks.
    Null pages don't count, repeated rows count each, and a null id is an id like another."""
    chosen = least_hashed(pages.filter(F.col(html_col).isNotNull()).select(F.col(html_col).alias("_html"), F.col(id_col).alias("_id")), ["_id", "_html"], sample).withColumn("_hash", F.xxhash64("_id"))

    def make(batch: pa.RecordBatch) -> list:
        encoder, vectors, labels = Encoder(), [], []
        for page, chance in zip(batch.column("_html").to_pylist(), batch.column("_hash").to_pylist(), strict=True):
            found = blocks(page)
            y = marked(found)
            x, y = run_of(encoder([found])[0], y, chance) if y is not None else (None, None)
            vectors.append(None if x is None else x.tobytes())
            labels.append(None if y is None else y.tobytes())
        return [pa.array(vectors, pa.binary()), pa.array(labels, pa.binary())]

    rows = with_columns(chosen, "_html", [T.StructField("_x", T.BinaryType()), T.StructField("_y", T.BinaryType())], make, ["_hash"]).collect()
    real = [(np.frombuffer(r._x, np.float32).reshape(-1, WIDTH), np.frombuffer(r._y, np.float32)) for r in sorted(rows, key=lambda r: (r._hash, r._x or b"")) if r._x]
    encoder = Encoder()
    return train(real + [run_of(encoder([page])[0], y, 7919 * k) for k, (page, y) in enumerate(made_pages(made))])


def extract(df: DataFrame, model: Labeller, html_col: str = "html", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``text_col``: the blocks of main text in page order, one a line; empty for null, empty and
    textless pages. Blocks are whole, and pages of any length and depth are read whole. Every row stands for itself: repeated rows have
    equal texts, ids play no part, and an empty table gives no rows. Other columns stay; one of that name is replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> list:
        pages = [blocks(page) if page else [] for page in batch.column(html_col).to_pylist()]
        chances = shared.value.predict(_encoder()(pages))
        return [pa.array(["\n".join([b.text for b, p in zip(page, chance, strict=True) if p >= 0.5]) for page, chance in zip(pages, chances, strict=True)], pa.string())]

    return with_columns(df, html_col, [T.StructField(text_col, T.StringType())], make, keep)


_held: list[Encoder] = []


def _encoder() -> Encoder:
    """One for each Python worker."""
    if not _held:
        _held.append(Encoder())
    return _held[0]

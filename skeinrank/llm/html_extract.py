"""Main text of web pages by a recurrent block labeller.

A page is cut into its leaf blocks of text: runs between block-level tags, with the path of open tags above each. A
bidirectional LSTM, written in numpy, reads the page's whole sequence of blocks, each as hashed vectors of its tag path
(names, classes and ids) and of its words and a few numbers, and labels every block as main text or not. The text is the
labelled blocks in page order. Scripts, styles, comments and other raw or hidden content make no blocks.

The labeller is trained here, on a bounded sample of pages (`sample`, of least hash, under 100 kB; training sequences of
more than `LONGEST` blocks are left out). Its labels come from pages that mark their parts: a block inside article or main,
and in none of the parts that never are main text, is main text. The rule gives labels only; the network reads tag and
class names as hashes, and learns what they tell. So that it does not hang on one way of marking, the sample's pages are
varied: parts get other names and classes, from lists of usual ones, notices, sidebars, forms and comments are put between
the blocks, also inside the article, and in one variant all names are drawn at random, so that the words, links, lengths
and the order of the blocks must tell. Pages with names in no list are labelled by these. Where no page of the sample marks
its parts, the longer blocks without links stand for main text in made-up pages.

Edge cases: a null or empty page has empty text; broken and unclosed tags are read as browsers do, roughly, and an open tag ends at the next
< at the latest; text without any tag is main text; a page without any text is empty; very long pages are labelled whole, in time and
memory in proportion to their blocks, their inputs read in slices; repeated rows give equal rows; an empty table gives no
rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements by how they are read.
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "object", "math", "textarea", "select", "title")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a new block of the same kind closes.
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = frozenset("html body main article section div nav header footer aside form ul ol dl table blockquote figure fieldset details dialog".split())
#: Parts that are never main text, by tag and by word in class, id or role.
NEVER_TAGS = frozenset("head nav footer aside form button dialog menu".split())
NEVER_WORDS = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar side widget related share social footer foot header masthead cookie cookies consent notice popup modal newsletter subscribe signup login search form comments comment replies reply respond discussion disqus".split()
)
MAIN_WORDS = frozenset("article main content post entry story body text".split())

#: Attributes: quoted values may hold > but no <, at which an open tag ends; nothing is read twice.
_ATTRS = r"(?:\"[^\"<]*\"|'[^'<]*'|[^'\"<>]|[\"'])*+"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<({'|'.join(RAW)})\b{_ATTRS}(?:>.*?(?:</\1\s*>|\Z)|(?=<)|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/<>]*+)({_ATTRS})(?:>|(?=<)|\Z)|<[!?/][^<>]*+>?|[^<]+|<",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s=/\"'<>]++)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z]+")

PATH_DIMS, WORD_DIMS, NUMBERS, HIDDEN = 128, 32, 6, 16
#: Blocks of a training sequence, at most.
LONGEST = 400
DIMS = PATH_DIMS + WORD_DIMS + NUMBERS

#: A node of a path: tag and the words of its class, id and role.
Node = tuple[str, tuple[str, ...]]


class Path:
    """The open tags above a block, as a link to the path above: what a path tells is added up as it grows."""

    __slots__ = ("above", "depth", "inside", "marks", "names", "never", "node")

    def __init__(self, above: Path | None = None, node: Node | None = None):
        self.above, self.node = above, node
        if above is None or node is None:
            self.depth, self.names, self.never, self.marks, self.inside = 0, 0, False, False, False
            return
        tag, words = node
        self.depth, self.names = above.depth + 1, above.names
        for name in (tag, *(f".{w}" for w in words)):
            self.names |= 1 << _slot(name, PATH_DIMS)
        self.inside = above.inside or tag in ("article", "main")
        # A header counts unless it is an article's own.
        self.never = above.never or tag in NEVER_TAGS or (tag == "header" and not self.inside) or (tag not in ("html", "body", "article", "main") and not NEVER_WORDS.isdisjoint(words))
        self.marks = above.marks or tag in ("article", "main") or (tag in ("div", "section", "td") and not MAIN_WORDS.isdisjoint(words))

    @property
    def marked(self) -> bool:
        """The labels' rule."""
        return self.marks and not self.never

    def nodes(self) -> list[Node]:
        out, at = [], self
        while at.above is not None:
            out.append(at.node)
            at = at.above
        return out[::-1]


TOP = Path()


def path_of(nodes: tuple[Node, ...]) -> Path:
    out = TOP
    for node in nodes:
        out = Path(out, node)
    return out


@dataclass(frozen=True)
class Block:
    path: Path
    text: str
    linked: float


def _read(tag: str, attrs: str) -> tuple[Node, bool]:
    """A tag with the words of its class, id and role, and whether it is hidden."""
    words: list[str] = []
    hidden = False
    if attrs:
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id", "role"):
                words += _WORD.findall(value.lower())
            elif name == "hidden":
                hidden = True
            elif name == "aria-hidden":
                hidden = hidden or value.lower() == "true"
            elif name == "style":
                hidden = hidden or bool(_NONE.search(value))
    return (tag, tuple(words)), hidden


class _Stack:
    """The open tags, with the number of each that is open, in all and since the last container."""

    def __init__(self):
        self.open: list[Path] = [TOP]
        self.all: Counter = Counter()
        self.since: list[Counter] = [Counter()]

    @property
    def top(self) -> Path:
        return self.open[-1]

    def push(self, node: Node) -> None:
        self.open.append(Path(self.top, node))
        self.all[node[0]] += 1
        if node[0] in CONTAINERS:
            self.since.append(Counter())
        else:
            self.since[-1][node[0]] += 1

    def pop(self) -> str:
        tag = self.open.pop().node[0]
        self.all[tag] -= 1
        if tag in CONTAINERS:
            self.since.pop()
        else:
            self.since[-1][tag] -= 1
        return tag

    def close(self, tag: str) -> None:
        """Closes the last of a tag and all in it; a stray end tag doesn't close what holds it."""
        if self.all[tag] if tag in CONTAINERS else self.since[-1][tag]:
            while self.pop() != tag:
                pass

    def __len__(self) -> int:
        return len(self.open) - 1


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page, in order, with character references decoded and white space joined."""
    out: list[Block] = []
    stack = _Stack()
    parts: list[str] = []
    links = [0, 0]  # open links, characters of the block inside them
    hidden: list[int] = []

    def end() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(stack.top, text, min(1.0, links[1] / len(text))))
            parts.clear()
        links[1] = 0

    for m in _TOKEN.finditer(page or ""):
        tag = m[3]
        if tag is None:
            token = m[0]
            if m[1] is not None:
                if m[1].lower() in ("title",) or m[1].lower() not in INLINE:
                    continue
            if token[0] != "<" or token == "<":
                if not hidden:
                    parts.append(token)
                    if links[0]:
                        links[1] += len(token.strip())
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                links[0] = 0 if m[2] else 1
            elif tag == "br":
                parts.append(" ")
            continue
        end()
        links[0] = 0
        if m[2]:
            stack.close(tag)
        elif tag not in VOID and not m[4].rstrip().endswith("/"):
            shut = SELF_CLOSING.get(tag, ("p",))
            while len(stack) and stack.top.node[0] in shut:
                stack.pop()
            node, unseen = _read(tag, m[4])
            stack.push(node)
            if unseen:
                hidden.append(len(stack))
        while hidden and hidden[-1] > len(stack):
            hidden.pop()
    end()
    return out


def _slot(name: str, dims: int) -> int:
    return crc32(name.encode()) % dims


def vectors(page: list[Block], a: int = 0, b: int | None = None) -> np.ndarray:
    """(blocks, DIMS): what the labeller reads of a page, or of its blocks from a to b."""
    some = page[a:b]
    out = np.zeros((len(some), DIMS))
    if some:
        bits = b"".join(x.path.names.to_bytes(PATH_DIMS // 8, "little") for x in some)
        out[:, :PATH_DIMS] = np.unpackbits(np.frombuffer(bits, np.uint8).reshape(len(some), -1), axis=1, bitorder="little")
    for i, x in enumerate(some):
        words = x.text.split(" ")
        slots = np.bincount([len(w) * 7 % WORD_DIMS if len(w) > 3 else crc32(w.lower().encode("utf-8", "surrogatepass")) % WORD_DIMS for w in words], minlength=WORD_DIMS)
        out[i, PATH_DIMS : PATH_DIMS + WORD_DIMS] = slots / len(words)
        out[i, PATH_DIMS + WORD_DIMS :] = (np.log1p(len(words)) / 5, x.linked, (a + i) / len(page), 1.0 if x.text[-1] in ".!?" else 0.0, min(x.path.depth, 40) / 10, sum(c.isdigit() for c in x.text[:200]) / 20)
    return out


class Labeller:
    """A bidirectional LSTM with one logistic output per block."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p[f"w{d}"] = rng.standard_normal((DIMS, 4 * HIDDEN)) / np.sqrt(DIMS)
            self.p[f"u{d}"] = rng.standard_normal((HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)
            self.p[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        self.p["o"], self.p["ob"] = rng.standard_normal(2 * HIDDEN) * 0.1, np.zeros(1)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """Hidden states of one direction, with what its gradients need; x: (pages, steps, DIMS), mask: (pages, steps)."""
        n, steps, _ = x.shape
        h, c, past = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), []
        out = np.zeros((n, steps, HIDDEN))
        z_in = x @ self.p[f"w{d}"] + self.p[f"c{d}"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = z_in[:, t] + h @ self.p[f"u{d}"]
            g = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
            a = np.tanh(z[:, 3 * HIDDEN :])
            c2 = f * c + i * a
            tc = np.tanh(c2)
            m = mask[:, t, None]
            past.append((t, h, c, i, f, o, a, tc, m))
            h, c = m * (o * tc) + (1 - m) * h, m * c2 + (1 - m) * c
            out[:, t] = h
        return out, past

    def score(self, read: Callable[[int, int], np.ndarray], mask: np.ndarray, width: int = 2048) -> np.ndarray:
        """(pages, steps): the output for each block; read(a, b) gives the inputs of steps a to b, which are read in slices."""
        n, steps = mask.shape
        total = np.full((n, steps), self.p["ob"][0])
        slices = [(a, min(a + width, steps)) for a in range(0, steps, width)]
        for k, d in enumerate("fb"):
            h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
            out = self.p["o"][k * HIDDEN : (k + 1) * HIDDEN]
            for a, b in slices if d == "f" else reversed(slices):
                z_in = read(a, b) @ self.p[f"w{d}"] + self.p[f"c{d}"]
                for t in range(a, b) if d == "f" else range(b - 1, a - 1, -1):
                    z = z_in[:, t - a] + h @ self.p[f"u{d}"]
                    g = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
                    m = mask[:, t, None]
                    c2 = g[:, HIDDEN : 2 * HIDDEN] * c + g[:, :HIDDEN] * np.tanh(z[:, 3 * HIDDEN :])
                    h, c = m * (g[:, 2 * HIDDEN :] * np.tanh(c2)) + (1 - m) * h, m * c2 + (1 - m) * c
                    total[:, t] += h @ out
        return total

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {d: self._run(x, mask, d) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        err = (1 / (1 + np.exp(-(both @ self.p["o"] + self.p["ob"]))) - y) * mask / mask.sum()
        g = {"o": np.einsum("nt,nth->h", err, both), "ob": np.array([err.sum()])}
        for k, d in enumerate("fb"):
            dh_out = err[:, :, None] * self.p["o"][k * HIDDEN : (k + 1) * HIDDEN]
            dh, dc = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN))
            dz_all, du = np.zeros((*x.shape[:2], 4 * HIDDEN)), np.zeros((HIDDEN, 4 * HIDDEN))
            for t, h, c, i, f, o, a, tc, m in reversed(runs[d][1]):
                dh = dh + dh_out[:, t]
                dhm, dcm = dh * m, dc * m
                do = dhm * tc
                dc2 = dcm + dhm * o * (1 - tc * tc)
                dz = np.concatenate([dc2 * a * i * (1 - i), dc2 * c * f * (1 - f), do * o * (1 - o), dc2 * i * (1 - a * a)], axis=1)
                dz_all[:, t] = dz
                du += h.T @ dz
                dh = dz @ self.p[f"u{d}"].T + dh * (1 - m)
                dc = dc2 * f + dc * (1 - m)
            g[f"w{d}"] = np.einsum("ntd,ntz->dz", x, dz_all, optimize=True)
            g[f"u{d}"], g[f"c{d}"] = du, dz_all.sum(axis=(0, 1))
        return g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int, batch: int = 32, rate: float = 0.02, seed: int = 5) -> Labeller:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), batch):
                some = [pages[i] for i in order[at : at + batch]]
                x, mask = padded([s[0] for s in some])
                y = np.zeros(mask.shape)
                for r, s in enumerate(some):
                    y[r, : len(s[1])] = s[1]
                g, step = self.gradients(x, mask, y), step + 1
                for k, v in g.items():
                    v = np.clip(v, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.999 * second[k] + 0.001 * v * v
                    self.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((len(pages), steps, DIMS)), np.zeros((len(pages), steps))
    for i, p in enumerate(pages):
        x[i, : len(p)], mask[i, : len(p)] = p, 1
    return x, mask


#: What the sample's parts may be called instead: containers of main text, and of what never is.
MAIN_FORMS = (
    (("article", ()),), (("main", ()),), (("main", ()), ("article", ())), (("div", ("content",)),), (("div", ("post", "content")),), (("section", ("article",)),),
    (("main", ()), ("div", ())), (("div", ("entry",)),), (("div", ()), ("article", ("post",))), (("article", ()), ("section", ())), (("article", ()), ("div", ("body",))),
)
OTHER_FORMS = (
    (("nav", ()), ("ul", ()), ("li", ())), (("nav", ()),), (("header", ()),), (("footer", ()),), (("aside", ()),), (("aside", ()), ("ul", ()), ("li", ())), (("form", ()),), (("form", ()), ("p", ())),
    (("div", ("ad",)),), (("div", ("ads",)), ("p", ())), (("div", ("advert",)),), (("div", ("banner",)),), (("div", ("menu",)), ("ul", ()), ("li", ())), (("div", ("sidebar",)), ("p", ())),
    (("div", ("cookie", "notice")),), (("div", ("notice",)), ("p", ())), (("div", ("footer",)), ("p", ())), (("div", ("header",)),), (("div", ("newsletter",)), ("p", ())), (("div", ("related",)), ("ul", ()), ("li", ())),
    (("section", ("comments",)), ("div", ("comment",)), ("p", ())), (("div", ("comments",)), ("p", ())), (("ol", ("comments",)), ("li", ("comment",)), ("p", ())), (("div", ("comment",)), ("p", ())), (("div", ("share",)),),
    (("header", ()), ("h1", ())), (("header", ()), ("h1", ())), (("header", ()), ("p", ())), (("header", ()), ("div", ("logo",))), (("footer", ()), ("p", ())), (("nav", ()), ("p", ())), (("aside", ()), ("p", ())), (("aside", ()), ("table", ()), ("tr", ()), ("td", ())),
    (("header", ()), ("div", ())), (("div", ("cookie",)),), (("div", ("promo",)), ("p", ())), (("ul", ("nav",)), ("li", ())), (("section", ("comments",)), ("article", ("comment",)), ("p", ())),
)
#: Kinds of blocks of main text; the first three are headings of an article.
LEAVES = (
    (("h1", ()),), (("header", ()), ("h1", ())), (("header", ()), ("p", ())), (("h2", ()),), (("h3", ()),), (("blockquote", ()),), (("blockquote", ()), ("p", ())), (("ul", ()), ("li", ())), (("ol", ()), ("li", ())),
    (("pre", ()),), (("table", ()), ("tr", ()), ("td", ())), (("table", ()), ("tr", ()), ("th", ())), (("table", ()), ("tbody", ()), ("tr", ()), ("td", ())), (("table", ()), ("caption", ())), (("figure", ()), ("figcaption", ())),
    (("dl", ()), ("dt", ())), (("dl", ()), ("dd", ())), (("div", ()),), (("section", ()), ("p", ())), (("address", ()),), (("details", ()), ("summary", ())), (("details", ()), ("p", ())), (),
)
ROOT: tuple[Node, ...] = (("html", ()), ("body", ()))
_TAGS = ("div", "section")
#: Tags that tell a kind of block, not a part of the page.
PLAIN = frozenset("html body p li ul ol pre table tbody tr td th caption figure figcaption dl dt dd blockquote h1 h2 h3".split())


def _leaf(first: bool, rng: np.random.Generator) -> tuple[Node, ...]:
    """Where a block of main text stands in its part: a heading, a paragraph, or any other kind of block."""
    if first and rng.random() < 0.7:
        return LEAVES[rng.integers(3)]
    return LEAVES[3 + rng.integers(len(LEAVES) - 3)] if rng.random() < 0.45 else (("p", ()),)


def _anonymous(page: list[Block], rng: np.random.Generator) -> list[Block]:
    """The page with every part under plain tags and names drawn at random, the same for the same path of names."""
    names: dict[Node, Node] = {}

    def other(node: Node) -> Node:
        if node[0] in PLAIN:
            return node[0], ()
        if node not in names:
            names[node] = (_TAGS[rng.integers(2)], ("".join(chr(97 + int(x)) for x in rng.integers(0, 26, 6)),))
        return names[node]

    return [Block(path_of(tuple(other(n) for n in b.path.nodes())), b.text, b.linked) for b in page]


def _renamed(form: tuple[Node, ...], words: list[str], rng: np.random.Generator) -> tuple[Node, ...]:
    """form with the names of its parts exchanged for others of a list, now and then."""
    return tuple((tag, (words[rng.integers(len(words))],) if names and rng.random() < 0.4 else names) for tag, names in form)


def varied(pages: list[list[Block]], seed: int = 9, skip: frozenset[str] = frozenset()) -> list[tuple[np.ndarray, np.ndarray]]:
    """Training sequences: each page as it is, with its parts named and mixed anew, and with names drawn at random.

    skip: names that are kept out of training.
    """
    rng = np.random.default_rng(seed)
    out = []
    texts = [b.text for p in pages for b in p] or ["text"]
    never_words, main_words = sorted(NEVER_WORDS - skip), sorted(MAIN_WORDS - skip)
    kept = lambda forms: [f for f in forms if not any(tag in skip or not skip.isdisjoint(words) for tag, words in f)]
    main_forms, other_forms = kept(MAIN_FORMS), kept(OTHER_FORMS)
    some_marked = any(b.path.marked for p in pages for b in p)
    for page in pages:
        y = np.array([b.path.marked if some_marked else len(b.text) > 60 and b.linked < 0.5 for b in page], float)
        if some_marked:
            out.append((vectors(page), y))
        if y.any():
            out.append((vectors(_anonymous(page, rng)), y))
        main = [b for b, is_main in zip(page, y, strict=True) if is_main]
        for _ in range(2):
            form = _renamed(main_forms[rng.integers(len(main_forms))], main_words, rng)
            mixed: list[tuple[Block, float]] = []

            def others(n: int, above: tuple[Node, ...], mixed=mixed) -> None:
                for _ in range(n):
                    kind = above + _renamed(other_forms[rng.integers(len(other_forms))], never_words, rng)
                    for _ in range(1 + int(rng.integers(4))):
                        t = texts[rng.integers(len(texts))]
                        t = t if rng.random() < 0.5 else " ".join(t.split(" ")[: 1 + int(rng.integers(5))])
                        mixed.append((Block(path_of(kind), t, float(rng.random() < 0.4)), 0.0))

            others(int(rng.integers(1, 4)), ROOT)
            for k, b in enumerate(main):
                if k and rng.random() < 0.08:
                    others(1, ROOT + form)
                text = b.text if rng.random() < 0.7 else " ".join(b.text.split(" ")[: 1 + int(rng.integers(8))])
                mixed.append((Block(path_of(ROOT + form + _leaf(k == 0, rng)), text, 0.0), 1.0))
            others(int(rng.integers(0, 3)), ROOT + form if rng.random() < 0.3 else ROOT)
            others(int(rng.integers(1, 3)), ROOT)
            out.append((vectors([b for b, _ in mixed]), np.array([v for _, v in mixed])))
        if main and rng.random() < 0.4:
            # Text without any part is the page's text.
            bare = [Block(path_of(((), ROOT)[int(rng.integers(2))] + ((), (("p", ()),), (("div", ()),))[int(rng.integers(3))]), b.text if rng.random() < 0.5 else " ".join(b.text.split(" ")[: 2 + int(rng.integers(8))]), 0.0) for b in main[: 1 + int(rng.integers(6))]]
            out.append((vectors(bare), np.ones(len(bare))))
    return [(x, y) for x, y in out if 0 < len(x) <= LONGEST]


def sampled(pages: DataFrame, sample: int) -> list[list[Block]]:
    """The blocks of at most `sample` pages of least hash; only their hashes are sorted, then their texts are fetched."""
    marked_rows = pages.where(F.length("html") < 100_000).select(F.xxhash64("page_id", "html").alias("h"), "html")
    keys = marked_rows.select("h").distinct().orderBy("h").limit(sample)
    rows = marked_rows.join(F.broadcast(keys), "h").groupBy("h").agg(F.first("html").alias("html")).orderBy("h").collect()
    return [p for p in (blocks(r.html) for r in rows) if p]


def fit(pages: DataFrame, sample: int = 300, epochs: int = 5) -> dict[str, np.ndarray] | None:
    """The weights; none if there is no page with text."""
    sequences = varied(sampled(pages, sample))
    return Labeller().fit(sequences, epochs).p if sequences else None


def main_text(page: list[Block], flags: np.ndarray) -> str:
    return "\n".join(b.text for b, f in zip(page, flags, strict=True) if f)


def _scores(model: Labeller, pages: list[list[Block]]) -> np.ndarray:
    steps = max(map(len, pages))
    mask = np.array([np.arange(steps) < len(p) for p in pages], float)

    def read(a: int, b: int) -> np.ndarray:
        x = np.zeros((len(pages), b - a, DIMS))
        for r, page in enumerate(pages):
            if len(page) > a:
                own = vectors(page, a, b)
                x[r, : len(own)] = own
        return x

    return model.score(read, mask)


def _extractor(weights: dict[str, np.ndarray] | None, group: int = 64):
    def run(batches):
        model = Labeller()
        if weights is not None:
            model.p = weights
        for batch in batches:
            pages = [blocks(h.as_py()) for h in batch["html"]]
            texts = [""] * len(pages)
            # Pages of like length are labelled together.
            order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i])) if weights is not None else []
            at = 0
            while at < len(order):
                some = order[at : at + max(1, min(group, 20_000 // len(pages[order[min(at + group, len(order)) - 1]])))]
                at += len(some)
                scores = _scores(model, [pages[i] for i in some])
                for r, i in enumerate(some):
                    texts[i] = main_text(pages[i], scores[r, : len(pages[i])] > 0)
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, sample: int = 300, epochs: int = 5) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    core = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return core.mapInArrow(_extractor(fit(core, sample, epochs)), "page_id long, url string, text string, n_chars long")

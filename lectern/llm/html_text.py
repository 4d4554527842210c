"""HTML extraction by a recurrent block labeller (operator 2).

A page is cut into leaf blocks: stretches of text between block-level tags, with the path of open elements. A numpy
bidirectional LSTM reads the sequence of all blocks of a page (hashed tag paths with classes and ids, hashed words, a
few figures) and labels each one as main text or not, so a block's label depends on the whole page.

The labeller is trained here (``train``), on pages that ``sample_page`` makes up: articles among menus, headers,
footers, sidebars, notices, adverts, forms and comments in many layouts, words invented, with sloppy and cut-off
markup. Training is seeded, takes some seconds on the driver, and its weights go to the workers.

Memory grows with a page's length alone, not with its nesting: an open element knows its parent and what its path says
as one number of ``PATH_DIM`` bits, and a long page's inputs are made ``AT_ONCE`` blocks at a time.

Defined cases: a null or empty page, or one without main text, gives an empty text. Scripts, styles, comments, heads,
templates and hidden parts are markup, never blocks. Character references are decoded; ``<br>`` is white space of its
block. Tags that are cut off at the end are dropped. Repeated rows and null ids or urls stay as they are; an empty table
gives no rows; a very long page is read whole; columns beside page_id, url and html don't matter, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from html import unescape
from itertools import chain
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import mapped
from lectern.llm.tokens import slices

PATH_DIM, WORD_DIM, FIGURES = 128, 32, 8
INPUT = PATH_DIM + WORD_DIM + FIGURES
HIDDEN = 16
PAGES, EPOCHS, RATE = 900, 6, 0.02
#: Blocks that are labelled at once (one page at least), and words and paths whose hashes a worker remembers.
AT_ONCE = 8192
REMEMBERED = 300_000
#: Bytes of pages that are cut into blocks at once, one page at least.
PAGE_BYTES = 1 << 20

RAW = "script|style|template|noscript|textarea|title|iframe|svg|select"
TOKEN = re.compile(rf"(?is)<!--.*?(?:-->|\Z)|<({RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-z][^>]*\Z")
ATTRIBUTE = re.compile(r"(?is)\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html label legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS = ".!?…\"”»"
#: An element's start ends these, if one is open closer than the others named.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


@dataclass(slots=True)
class Element:
    """An open element. Its path is itself and its parents, from the body on."""

    name: str
    hidden: bool  # it or a parent
    in_head: bool
    depth: int  # elements of the path
    says: int  # bits of what the path holds: each element's name, each word of its label
    last: str  # the name of the path's last element


@dataclass(slots=True)
class Leaf:
    text: str
    says: int  # bits of the path, with those of its last names in order
    depth: int
    linked: int  # characters in links


class Bits(dict):
    """what a path holds → its bit."""

    def __missing__(self, part: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[part] = got = 1 << zlib.crc32(part.encode("utf-8", "surrogatepass")) % PATH_DIM
        return got


def label_of(attributes: str, bits: Bits) -> tuple[int, bool]:
    """What an element's class, id and role say, and whether it is hidden."""
    says, hidden = 0, False
    if attributes and not attributes.isspace():
        words: list[str] = []
        for key, value in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                hidden = True
            elif key in ("class", "id", "role"):
                words += PART.findall(value)
        for x in words:
            says |= bits[f"w {x.lower()}"]
    return says, hidden


OUTSIDE = Element("", False, False, 0, 0, "")


def leaves(html: str | None, bits: Bits | None = None) -> list[Leaf]:
    """The blocks of a page that have text, in page order."""
    html, bits = html or "", Bits() if bits is None else bits
    out: list[Leaf] = []
    stack: list[Element] = [OUTSIDE]
    opened: dict[str, int] = defaultdict(int)  # how many elements of a name are open
    before: list[str] = [""]  # of each element the name of the path's last but one
    labels: dict[str, tuple[int, bool]] = {}
    text: list[str] = []
    links = linked = at = 0

    def flush() -> None:
        nonlocal linked
        joined = " ".join("".join(text).split())
        if joined and not (e := stack[-1]).hidden:
            ends = bits[f"e {e.last}"] | bits[f"e2 {before[-1]} {e.last}".replace("  ", " ")] if e.depth else bits["e2 "]
            out.append(Leaf(joined, e.says | ends, e.depth, linked))
        text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = unescape(piece) if "&" in piece else piece
            text.append(piece)
            if links:
                linked += len(piece)

    def drop(k: int) -> None:
        """Close the elements from the k-th on."""
        for e in stack[k:]:
            opened[e.name] -= 1
        del stack[k:], before[k:]

    def nearest(names: set[str], bounds: set[str]) -> int | None:
        """The place of the innermost open element of ``names`` inside the innermost of ``bounds``."""
        if any(opened[x] for x in names):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in names:
                    return k
                if stack[k].name in bounds:
                    return None
        return None

    for m in TOKEN.finditer(html):
        add(html[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if m[1]:
            if m[1].lower() in ("textarea", "select", "iframe", "svg"):
                text.append(" ")
        elif not name:
            continue
        elif name == "br":
            text.append(" ")
        elif name == "a":
            links = 0 if m[2] else 1
        elif name not in BLOCK:
            if name == "img" or name == "td":
                text.append(" ")
        elif m[2]:
            flush()
            k = nearest({name}, set())
            if k is not None:
                drop(k)
        else:
            flush()
            if name == "hr":
                continue
            if stack[-1].name == "p":
                drop(len(stack) - 1)
            if name in CLOSES and (k := nearest(*CLOSES[name])) is not None:
                drop(k)
            if name == "body" or name not in ("html", "head") and stack[-1].in_head:  # what the head left open
                drop(1)
            if m[4] not in labels:
                if len(labels) > REMEMBERED:
                    labels.clear()
                labels[m[4]] = label_of(m[4], bits)
            says, hidden = labels[m[4]]
            up, counts = stack[-1], name not in ("html", "body")
            before.append(up.last if counts else before[-1])
            stack.append(Element(name, up.hidden or hidden or name == "head", up.in_head or name == "head", up.depth + counts, up.says | (says | bits[f"t {name}"] if counts else 0), name if counts else up.last))
            opened[name] += 1
    add(html[at:])
    flush()
    return out


class WordRows(dict):
    """word → its position, with a sign in the lowest bit."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = got = zlib.crc32(word.lower().strip(".,;:!?()\"'").encode("utf-8", "surrogatepass")) % (2 * WORD_DIM)
        return got


def inputs(page: list[Leaf], words: WordRows, first: int = 0, whole: int | None = None) -> np.ndarray:
    """(blocks, INPUT) of a page, or of the blocks from ``first`` on of one that has ``whole``."""
    n, whole = len(page), whole or len(page)
    x = np.zeros((n, INPUT), np.float32)
    says = np.frombuffer(b"".join(leaf.says.to_bytes(PATH_DIM // 8, "little") for leaf in page), np.uint8).reshape(n, PATH_DIM // 8)
    x[:, :PATH_DIM] = np.unpackbits(says, axis=1, bitorder="little")
    raw = [leaf.text.split() for leaf in page]
    size = np.fromiter(map(len, raw), np.int64, n)
    rows = np.fromiter(map(words.__getitem__, chain.from_iterable(raw)), np.int64, int(size.sum()))
    bag = np.bincount(np.repeat(np.arange(n) * WORD_DIM, size) + (rows >> 1), 1.0 - 2 * (rows & 1), n * WORD_DIM).reshape(n, WORD_DIM)
    x[:, PATH_DIM : PATH_DIM + WORD_DIM] = np.clip(bag / np.sqrt(size + 1)[:, None], -1, 1)  # a word that recurs without end weighs no more
    for k, leaf in enumerate(page):
        t, chars = leaf.text, len(leaf.text)
        marks = t.count(".") + t.count(",") + t.count(";") + t.count("!") + t.count("?")
        x[k, -FIGURES:] = (min(1.0, log1p(chars) / 8), leaf.linked / chars, min(1.0, marks / chars * 10), t[-1] in ENDS, min(leaf.depth, 64) / 8, (first + k) / whole, "©" in t, 1)
    return x


@dataclass
class Weights:
    """For each direction: inputs, hidden state and bias to the four gates; then both hidden states to a logit."""

    wx: np.ndarray  # (2, INPUT, 4H)
    wh: np.ndarray  # (2, H, 4H)
    b: np.ndarray  # (2, 4H)
    out: np.ndarray  # (2H,)
    bias: np.ndarray  # (1,)

    def arrays(self) -> list[np.ndarray]:
        return [self.wx, self.wh, self.b, self.out, self.bias]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(w: Weights, d: int, gates: np.ndarray, mask: np.ndarray, saved: list | None = None) -> np.ndarray:
    """Hidden states (T, B, H) of one direction, its inputs already turned and weighed (``gates``: T, B, 4H); mask (T, B).
    saved: takes what ``backward`` needs, while training."""
    t_max, n = mask.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    hs = np.empty((t_max, n, HIDDEN), np.float32)
    for t in range(t_max):
        a = gates[t] + h @ w.wh[d]
        s = sigmoid(a[:, : 3 * HIDDEN])
        i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(a[:, 3 * HIDDEN :])
        new_c = f * c + i * g
        tanh_c = np.tanh(new_c)
        m = mask[t][:, None]
        if saved is not None:
            saved.append((h, c, i, f, o, g, tanh_c, m))
        h, c = m * o * tanh_c + (1 - m) * h, m * new_c + (1 - m) * c
        hs[t] = h
    return hs


def backward(w: Weights, d: int, x: np.ndarray, saved: list, dhs: np.ndarray, grads: Weights) -> None:
    dh, dc = np.zeros_like(dhs[0]), np.zeros_like(dhs[0])
    da = np.zeros((*dhs.shape[:2], 4 * HIDDEN), np.float32)
    for t in range(len(saved) - 1, -1, -1):
        h, c, i, f, o, g, tanh_c, m = saved[t]
        dh = dh + dhs[t]
        live, dlive = m * dh, dc * m
        dnew = dlive + live * o * (1 - tanh_c**2)
        da[t] = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), live * tanh_c * o * (1 - o), dnew * i * (1 - g**2)], 1)
        grads.wh[d] += h.T @ da[t]
        dh = da[t] @ w.wh[d].T + (1 - m) * dh
        dc = dnew * f + (1 - m) * dc
    flat = da.reshape(-1, 4 * HIDDEN)
    grads.wx[d] += x.reshape(-1, INPUT).T @ flat
    grads.b[d] += flat.sum(0)


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x and x with each page turned round (T, B, columns), mask (T, B)."""
    t_max, width = max(map(len, pages)), pages[0].shape[1]
    x, back, mask = np.zeros((t_max, len(pages), width), np.float32), np.zeros((t_max, len(pages), width), np.float32), np.zeros((t_max, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], back[: len(p), k], mask[: len(p), k] = p, p[::-1], 1
    return x, back, mask


def turned(hs: np.ndarray, sizes: list[int]) -> np.ndarray:
    out = np.zeros_like(hs)
    for k, n in enumerate(sizes):
        out[:n, k] = hs[:n, k][::-1]
    return out


def weighed(w: Weights, page: list[Leaf], words: WordRows) -> np.ndarray:
    """(blocks, 8H): a page's inputs weighed for the gates of both directions, ``AT_ONCE`` blocks at a time."""
    wx, b = np.concatenate([w.wx[0], w.wx[1]], 1), np.r_[w.b[0], w.b[1]]
    parts = [inputs(page[k : k + AT_ONCE], words, k, len(page)) @ wx + b for k in range(0, len(page), AT_ONCE)]
    return np.concatenate(parts) if parts else np.zeros((0, 8 * HIDDEN), np.float32)


def logits(w: Weights, pages: list[list[Leaf]], words: WordRows) -> list[np.ndarray]:
    """Of each block of each page, that it is main text. Pages of like length go together."""
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(pages[order[end]]) <= AT_ONCE:
            end += 1
        part = order[at:end]
        sizes = [len(pages[k]) for k in part]
        x, back, mask = padded([weighed(w, pages[k], words) for k in part])
        both = np.concatenate([forward(w, 0, x[:, :, : 4 * HIDDEN], mask), turned(forward(w, 1, back[:, :, 4 * HIDDEN :], mask), sizes)], 2)
        z = both @ w.out + w.bias
        for j, k in enumerate(part):
            out[k] = z[: sizes[j], j]
        at = end
    return out


def fit(pages: list[np.ndarray], labels: list[np.ndarray], seed: int, epochs: int = EPOCHS, batch: int = 30) -> Weights:
    rng = np.random.default_rng(seed)
    init = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-2]), shape).astype(np.float32)
    w = Weights(init(2, INPUT, 4 * HIDDEN), init(2, HIDDEN, 4 * HIDDEN), np.zeros((2, 4 * HIDDEN), np.float32), rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32), np.zeros(1, np.float32))
    w.b[:, HIDDEN : 2 * HIDDEN] = 1
    moments = [(np.zeros_like(a), np.zeros_like(a)) for a in w.arrays()]
    step = 0
    by_length = sorted(range(len(pages)), key=lambda k: len(pages[k]))
    groups = [by_length[k : k + batch] for k in range(0, len(by_length), batch)]
    for epoch in range(epochs):
        for g in rng.permutation(len(groups)):
            part = groups[g]
            sizes = [len(pages[k]) for k in part]
            x, back, mask = padded([pages[k] for k in part])
            sf, sb = [], []
            hf, hb = forward(w, 0, x @ w.wx[0] + w.b[0], mask, sf), forward(w, 1, back @ w.wx[1] + w.b[1], mask, sb)
            both = np.concatenate([hf, turned(hb, sizes)], 2)
            z = both @ w.out + w.bias
            y = np.zeros_like(z)
            for j, k in enumerate(part):
                y[: sizes[j], j] = labels[k]
            dz = ((sigmoid(z) - y) * mask / mask.sum()).astype(np.float32)
            grads = Weights(*[np.zeros_like(a) for a in w.arrays()])
            grads.out += np.einsum("tb,tbh->h", dz, both)
            grads.bias += dz.sum()
            dboth = dz[:, :, None] * w.out
            backward(w, 0, x, sf, dboth[:, :, :HIDDEN], grads)
            backward(w, 1, back, sb, turned(dboth[:, :, HIDDEN:], sizes), grads)
            step += 1
            rate = RATE * (1 - epoch / epochs)
            for a, g_, (m, v) in zip(w.arrays(), grads.arrays(), moments):
                m += 0.1 * (g_ - m)
                v += 0.01 * (g_ * g_ - v)
                a -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


@cache
def trained(seed: int = 3, n_pages: int = PAGES) -> Weights:
    """The labeller, once for each driver process."""
    from lectern.llm.sample_pages import sample_page

    rng, words, pages, labels = np.random.default_rng(seed), WordRows(), [], []
    for _ in range(n_pages):
        html, kept = sample_page(rng)
        page = leaves(html)
        if page:
            y = np.array([x.text in kept for x in page], np.float32)
            if not y[-1] and len(page[-1].text) > 12:  # a page that was cut off inside a block
                y[-1] = any(k.startswith(page[-1].text[:-6]) for k in kept)
            pages.append(inputs(page, words))
            labels.append(y)
    return fit(pages, labels, seed)


def main_texts(pages: list[str | None], w: Weights, words: WordRows, bits: Bits) -> list[str]:
    """The main text of each page."""
    cut = [leaves(p, bits) for p in pages]
    found = logits(w, cut, words)
    return ["\n".join(x.text for x, z in zip(p, f) if z > 0) for p, f in zip(cut, found)]


def extract(pages: DataFrame, w: Weights | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages`` (page_id, url, html)."""
    w = w or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bits = WordRows(), Bits()
        for b in batches:
            for at, n in slices(b.column(2), PAGE_BYTES):
                part = b.slice(at, n)
                texts = main_texts(part.column(2).to_pylist(), w, words, bits)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.transform(mapped, run, "page_id long, url string, text string, n_chars long")
